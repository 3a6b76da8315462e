"""Quality: logistic regression on hashed word n-grams, trained by FTRL-proximal updates.

Words are cut where letters meet signs, so that marks attached to words are features of
their own. A text is the sparse vector of its hashed one- and two-word counts, log-damped
and scaled to length one; two-word features that come OFTEN also share one feature for
each power of two, which lets the model see a text that repeats itself in any words. Training takes a bounded sample of labelled texts (``per_class``
of each label by hash of the id) and follows the regularised leader row by row; L1 keeps
the weights sparse. Scoring is one sparse dot product per text; whole texts, no shuffle.

Cases: null and empty texts have no feature and score the intercept. Copies score alike.
Rows without id keep a null id and are never trained on; labels of one id are merged by
their maximum. Other columns are ignored. Without labels the score is 0.5. An empty table
gives an empty result.
"""

import numpy as np
from pyspark.sql import DataFrame, functions as F

from stacklore.llm import classify, tokens

BITS = 20
PER_CLASS = 3000
EPOCHS = 8
ALPHA, BETA, L1, L2 = 1.0, 1.0, 0.0005, 0.0
# Features 0 to 31 are set aside: how often a text repeats two words, as powers of two.
REPEATS, OFTEN = 32, 4


def _keyed(hashes, rows):
    """Row and feature of each n-gram in one number."""
    feature = REPEATS + (hashes % np.uint64((1 << BITS) - REPEATS)).astype(np.int64)
    return (rows.astype(np.int64) << BITS) | feature


def _vectors(texts):
    """(features, values) for each text of an Arrow column."""
    out = [(np.zeros(0, np.int64), np.zeros(0))] * len(texts)
    for first, last, data, starts in tokens.pieces(texts):
        one, rows = tokens.word_hashes(data, starts, runs=True)
        two, rows2 = tokens.joined(one, rows, 2)
        # One sort by (row, feature) counts the features of all texts of the piece.
        pair, times = np.unique(_keyed(two, rows2), return_counts=True)
        often = times >= OFTEN
        again = np.repeat(((pair[often] >> BITS) << BITS)
                          | np.log2(times[often]).astype(np.int64), times[often])
        both, counts = np.unique(np.concatenate([_keyed(one, rows), again]), return_counts=True)
        both, counts = np.concatenate([both, pair]), np.concatenate([counts, times])
        order = np.argsort(both, kind="stable")
        both, values = both[order], 1 + np.log(counts[order])
        cut = np.searchsorted(both, np.arange(last - first + 1) << BITS)
        for k in range(last - first):
            v = values[cut[k]:cut[k + 1]]
            if v.size:
                out[first + k] = (both[cut[k]:cut[k + 1]] & ((1 << BITS) - 1),
                                  v / np.sqrt(v @ v))
    return out


def _weights(z, n):
    free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
    return -free / ((BETA + np.sqrt(n)) / ALPHA + L2)


def _fit(found, labels, weights):
    """Weight of each feature, then the intercept."""
    size = 1 << BITS
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    order = np.random.default_rng(7)
    found = [(np.append(f, size), np.append(v, 1.0)) for f, v in found]
    weights = weights / weights.mean() if len(weights) else weights
    for _ in range(EPOCHS):
        for row in order.permutation(len(found)):
            at, x = found[row]
            w = _weights(z[at], n[at])
            slope = (classify.sigmoid(w @ x) - labels[row]) * weights[row] * x
            step = (np.sqrt(n[at] + slope ** 2) - np.sqrt(n[at])) / ALPHA
            z[at] += slope - step * w
            n[at] += slope ** 2
    return _weights(z, n)


def _score(texts, model):
    return classify.sigmoid(np.array(
        [model[f].astype(np.float64) @ v for f, v in _vectors(texts)], np.float64)
        + float(model[-1]))


def train(docs, labelled, per_class=PER_CLASS) -> np.ndarray:
    """The model from ``labelled`` (doc_id, quality); its size does not grow with the data."""
    ids = classify.sample_ids(labelled, "quality", per_class)
    return classify.fit_on_sample(docs, ids, _vectors, _fit, (1 << BITS) + 1)


def score(docs, model) -> DataFrame:
    """doc_id and the probability of label 1 for every row of ``docs``."""
    return classify.score_texts(docs, _score, model)


def quality(docs, labels, held_out, per_class=PER_CLASS) -> DataFrame:
    """Train on the labels that ``held_out`` (a function of the id column) leaves, score all."""
    model = train(docs, labels.filter(~held_out(F.col("doc_id"))), per_class)
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
