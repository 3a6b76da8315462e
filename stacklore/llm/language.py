"""Language identification by partial matching over bytes (PPM, escape method C).

For every language, a context tree of byte orders 0 to 3 is counted on a bounded sample
(``per_lang`` texts by hash of the id, whole texts). The statistics are then frozen and
turned into code lengths: a byte seen in the longest context costs its share there, any
other byte costs the escape and its code one order lower, down to a flat order -1. The
language that codes a text in the fewest bits wins; the score is its share of the
likelihood.

Bytes beyond the ALPHABET - 1 commonest share one symbol, so code lengths of order 2 fit a
dense table and those of order 3 a table of the seen contexts. A text is scored in one
pass, without a shuffle.

Cases: a null text or one without a letter is ``und`` with score 0. Copies score alike.
Rows without id or language are never trained on but are predicted; no language in the
whole table makes every row ``und``. Other columns are ignored. An empty table gives an
empty result.
"""

import re

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from stacklore.llm.common import typed

ALPHABET = 64
ORDER = 3
PER_LANG = 400
UNKNOWN = "und"
# Word signs that are no decimal digit; those among them that are numbers are no letters.
_LETTERS = re.compile(r"[^\W\d_]+")
CHUNK = 1 << 20


def has_letter(text):
    """Whether a sign of the text is a letter; fractions and raised numbers are none."""
    return any(any(map(str.isalpha, run.group())) for run in _LETTERS.finditer(text))


def _symbols(text, table):
    """Symbols of a text that starts in a context of spaces."""
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    return table[np.concatenate([np.full(ORDER, 32, np.uint8), data])].astype(np.int64)


def _grams(symbols, n):
    """Numbers of all windows of n symbols that end at a byte of the text."""
    size = symbols.size - ORDER
    code = np.zeros(size, np.int64)
    for k in range(ORDER + 1 - n, ORDER + 1):
        code = code * ALPHABET + symbols[k:k + size]
    return code


def _sample(docs, held_out, per_lang):
    """Whole training texts of ``per_lang`` documents of every language."""
    rows = typed(docs, "doc_id", "lang").filter(
        F.col("doc_id").isNotNull() & F.col("lang").isNotNull()
        & ~held_out(F.col("doc_id"))).distinct()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.withColumn("_rank", F.row_number().over(by_hash)).filter(
        F.col("_rank") <= per_lang).drop("_rank")
    # per_lang rows for each language.
    return typed(docs, "doc_id", "text", "lang").filter(F.col("text").isNotNull()).join(
        F.broadcast(ids), ["doc_id", "lang"])


def _count(batches, table):
    """Counts of the longest windows of a task's texts, added up by language."""
    import pyarrow as pa

    total = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
            codes, n = np.unique(_grams(_symbols(text, table), ORDER + 1), return_counts=True)
            counts = total.setdefault(lang, {})
            for code, k in zip(codes.tolist(), n.tolist()):
                counts[code] = counts.get(code, 0) + k
    for lang, counts in total.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([lang] * len(counts), pa.string()), pa.array(list(counts), pa.int64()),
             pa.array(list(counts.values()), pa.int64())], ["lang", "code", "n"])


def _code_lengths(codes, counts):
    """(order 2 table, escape table, order 3 codes and bits) of one language, in bits."""
    dense, escape, bits = np.full(ALPHABET, np.log2(ALPHABET)), None, None
    for order in range(ORDER + 1):
        # Counts of (context of this order, byte), summed from the longest windows.
        keys, place = np.unique(codes % ALPHABET ** (order + 1), return_inverse=True)
        n = np.bincount(place, counts)
        contexts, home = np.unique(keys // ALPHABET, return_inverse=True)
        total, kinds = np.bincount(home, n), np.bincount(home)
        seen = np.log2((total + kinds)[home] / n)
        leave = np.log2((total + kinds) / kinds)
        if order < ORDER:
            wide = np.tile(dense, ALPHABET) if order else dense.copy()
            table = np.zeros(ALPHABET ** order)
            table[contexts] = leave
            wide = wide + np.repeat(table, ALPHABET)
            wide[keys] = seen
            dense = wide
        else:
            escape = np.zeros(ALPHABET ** ORDER)
            escape[contexts] = leave
            bits = seen
    return dense, escape, keys, bits


class Model:
    """Frozen code lengths of all languages; its size is bounded by the sample."""

    def __init__(self, table, langs, dense, escape, keys, bits):
        self.table, self.langs = table, langs
        self.dense, self.escape, self.keys, self.bits = dense, escape, keys, bits
        self._place = None

    def place(self):
        """Row of each order 3 window in ``bits``, 0 if no language has seen it."""
        if self._place is None:
            self._place = np.zeros(ALPHABET ** (ORDER + 1), np.int32)
            self._place[self.keys] = np.arange(1, self.keys.size + 1, dtype=np.int32)
        return self._place

    def __getstate__(self):
        return {**self.__dict__, "_place": None}

    def cost(self, text):
        """Bits of the whole text in every language."""
        total = np.zeros(len(self.langs))
        symbols = _symbols(text, self.table)
        for first in range(0, symbols.size - ORDER, CHUNK):
            part = symbols[first:first + CHUNK + ORDER]
            code = _grams(part, ORDER + 1)
            at = self.place()[code]
            known = at > 0
            total += self.bits[at[known] - 1].sum(0, dtype=np.float64)
            code = code[~known]
            total += self.dense[code % ALPHABET ** ORDER].sum(0, dtype=np.float64)
            total += self.escape[code // ALPHABET].sum(0, dtype=np.float64)
        return total


def train(docs, held_out, per_lang=PER_LANG) -> Model | None:
    """Count the sample in Spark and freeze it; None if no row has a language."""
    sample = _sample(docs, held_out, per_lang)

    def bytes_of(batches):
        import pyarrow as pa

        n = np.zeros(256, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                n += np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8),
                                 minlength=256)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256)), pa.array(n)], ["b", "n"])

    common = sample.select("text").mapInArrow(bytes_of, "b long, n long").groupBy("b").agg(
        F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(ALPHABET - 1).collect()
    table = np.zeros(256, np.uint8)
    for k, row in enumerate(common):
        if row["n"]:
            table[row["b"]] = k + 1
    found = sample.select("text", "lang").mapInArrow(
        lambda batches: _count(batches, table), "lang string, code long, n long").groupBy(
        "lang", "code").agg(F.sum("n").alias("n")).toArrow()
    if not found.num_rows:
        return None
    names = np.array(found.column("lang").to_pylist())
    codes, n = found.column("code").to_numpy(), found.column("n").to_numpy()
    langs = sorted(set(names.tolist()))
    per = [_code_lengths(codes[names == x], n[names == x]) for x in langs]
    keys = np.unique(codes)
    dense = np.stack([p[0] for p in per], 1)
    escape = np.stack([p[1] for p in per], 1)
    bits = dense[keys % ALPHABET ** ORDER] + escape[keys // ALPHABET]
    for k, (_, _, own, seen) in enumerate(per):
        bits[np.searchsorted(keys, own), k] = seen
    return Model(table, langs, dense.astype(np.float32), escape.astype(np.float32),
                 keys, bits.astype(np.float32))


def predict(docs, model) -> DataFrame:
    """doc_id, lang_pred and score for every row of ``docs``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            names, scores = [], []
            for text in batch.column("text").to_pylist():
                if model is None or not text or not has_letter(text):
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cost = model.cost(text)
                best = int(cost.argmin())
                names.append(model.langs[best])
                scores.append(float(1 / np.exp2(np.maximum(cost[best] - cost, -1000)).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(names, pa.string()),
                 pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return typed(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def language(docs, held_out, per_lang=PER_LANG) -> DataFrame:
    """Train on the rows that ``held_out`` (a function of the id column) leaves, predict all."""
    return predict(docs, train(docs, held_out, per_lang)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
