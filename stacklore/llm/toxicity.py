"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Training takes a bounded sample of labelled texts (``per_class`` of each label, by hash
of the id, weighted to the class shares). Every hashed n-gram that is in at least
``MIN_DOCS`` of them gets the log ratio of its smoothed shares in the two classes; a
logistic regression is fitted on presence times ratio. One row in FOLD first calibrates
the odds of a fit on the others. Scoring is one sum per text over the weights of its
distinct n-grams; whole texts, no shuffle.

Cases: null and empty texts have no n-gram and score the intercept. Copies score alike.
Rows without id keep a null id and are never trained on; labels of one id are merged by
their maximum. Other columns are ignored. Without labels of both classes the score is
the share of label 1 (0.5 without labels). An empty table gives an empty result.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stacklore.llm import classify

BITS = 20
SIZES = (3, 4, 5)
PER_CLASS = 2000
MIN_DOCS = 4
SMOOTHING = 1.0
DECAY = 4.0
STEPS = 80
FOLD = 5

_SEEDS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def ngrams(text):
    """Distinct hashed n-grams of one lower-case text, ends marked by a space."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    found = []
    for n, seed in zip(SIZES, _SEEDS):
        if codes.size < n:
            continue
        h = np.full(codes.size - n + 1, seed)
        for k in range(n):
            h = (h ^ codes[k:codes.size - n + 1 + k]) * np.uint32(0x01000193)
            h ^= h >> np.uint32(15)
        found.append(h >> np.uint32(32 - BITS))
    return np.concatenate(found) if found else np.zeros(0, np.uint32)


def _features(texts):
    return [np.unique(ngrams(t)) if t else np.zeros(0, np.uint32) for t in texts.to_pylist()]


def _fit_weights(found, labels, weights):
    """Weight of each n-gram, then the intercept, of the regression on presence times ratio."""
    size = 1 << BITS
    model = np.zeros(size + 1, np.float32)
    flat = np.concatenate(found).astype(np.int64)
    rows = np.repeat(np.arange(len(found)), [f.size for f in found])
    seen = np.bincount(flat, minlength=size)
    one = np.bincount(flat, labels[rows], minlength=size)
    # Shares of documents, not of n-grams, so that texts of any length count once.
    ratio = np.log(((one + SMOOTHING) / (labels.sum() + 2 * SMOOTHING))
                   / ((seen - one + SMOOTHING) / ((1 - labels).sum() + 2 * SMOOTHING)))
    ratio[seen < MIN_DOCS] = 0
    used = ratio[flat] != 0
    rows = rows[used]
    names, flat = np.unique(flat[used], return_inverse=True)
    scale = ratio[names].astype(np.float32)
    w, b = np.zeros(names.size, np.float32), _logit(labels, weights)
    m1, m2 = np.zeros(names.size + 1), np.zeros(names.size + 1)
    values = scale[flat]
    for step in range(1, STEPS + 1):
        z = np.bincount(rows, w[flat] * values, minlength=len(found)) + b
        error = (classify.sigmoid(z) - labels) * weights / weights.sum()
        slope = np.append(np.bincount(flat, error[rows] * values, minlength=names.size)
                          + DECAY * w / max(names.size, 1) ** 0.5, error.sum())
        m1 = 0.9 * m1 + 0.1 * slope
        m2 = 0.99 * m2 + 0.01 * slope ** 2
        move = 0.02 * (m1 / (1 - 0.9 ** step)) / (np.sqrt(m2 / (1 - 0.99 ** step)) + 1e-7)
        w, b = w - move[:-1].astype(np.float32), b - move[-1]
    model[names] = w * scale
    model[size] = b
    return model


def _logit(labels, weights):
    share = float((labels * weights).sum() / max(weights.sum(), 1e-9)) if len(labels) else 0.5
    return float(np.log(min(max(share, 1e-3), 1 - 1e-3) / (1 - min(max(share, 1e-3), 1 - 1e-3))))


def _calibration(z, labels, weights):
    """Slope and offset that make ``z`` of unseen rows a log-odds, by Newton steps."""
    a, c = 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1).astype(np.float64)
    for _ in range(25):
        p = classify.sigmoid(x @ [a, c])
        slope = x.T @ ((p - labels) * weights) + 1e-2 * np.array([a - 1, c])
        bend = (x * (p * (1 - p) * weights)[:, None]).T @ x + 1e-2 * np.eye(2)
        a, c = np.array([a, c]) - np.clip(np.linalg.solve(bend, slope), -1, 1)
    return max(a, 0.1), c


def _fit(found, labels, weights):
    """The fitted weights; a fold that the first fit has not seen calibrates the odds."""
    size = 1 << BITS
    fold = np.arange(len(found)) % FOLD == 0
    if min((labels[~fold] == 1).sum(), (labels[~fold] == 0).sum()) < 1:
        return np.append(np.zeros(size, np.float32), _logit(labels, weights))
    part = _fit_weights([f for f, out in zip(found, fold) if not out],
                        labels[~fold], weights[~fold])
    z = np.array([part[f].sum(dtype=np.float64) for f, out in zip(found, fold) if out]) + part[-1]
    a, c = _calibration(z, labels[fold], weights[fold])
    model = _fit_weights(found, labels, weights) * np.float32(a)
    model[-1] += c
    return model


def _score(texts, model):
    out = np.empty(len(texts))
    last = np.zeros(1 << BITS, np.int32)
    for row, text in enumerate(texts.to_pylist()):
        total = 0.0
        if text:
            found = ngrams(text)
            found = found[model[found] != 0]
            # The last place of each n-gram stands for all its places.
            place = np.arange(found.size, dtype=np.int32)
            last[found] = place
            total = float(model[found[last[found] == place]].sum(dtype=np.float64))
        out[row] = total
    return classify.sigmoid(out + float(model[-1]))


def train(docs, labelled, per_class=PER_CLASS) -> np.ndarray:
    """The model from ``labelled`` (doc_id, toxic); its size does not grow with the data."""
    ids = classify.sample_ids(labelled, "toxic", per_class)
    return classify.fit_on_sample(docs, ids, _features, _fit, (1 << BITS) + 1)


def score(docs, model) -> DataFrame:
    """doc_id and the probability of label 1 for every row of ``docs``."""
    return classify.score_texts(docs, _score, model)


def toxicity(docs, labels, held_out, per_class=PER_CLASS) -> DataFrame:
    """Train on the labels that ``held_out`` (a function of the id column) leaves, score all."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), per_class)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
