"""Line deduplication by content-defined chunks of lines.

Lines are hashed, and a rolling hash runs over WINDOW line hashes. A chunk ends where that
hash is smaller than both of its neighbours, so boundaries move with the text and not with
its place, and never follow each other: every chunk but the last of a text has two lines
or more, three on average. Chunks of MIN_LINES lines or more that occur again anywhere are
candidates by hash; those are compared as whole texts, and every occurrence but the first
(smallest doc_id, then place) is removed. DataFrame functions only.

Only hashes of chunks are shuffled to find repeats. The repeated hashes are sent to the
chunks up to the bound of ``only``; beyond it the chunks are shuffled once. From there on
texts travel for repeated chunks alone.
A chunk that a large share of documents holds is counted by partial aggregates and met by
``join_hot``.

Boundaries depend on the lines around them, so ``without_repeats`` misses most repeated
passages under six lines. ``without_repeated_runs`` misses none of two lines or more: every
two lines that follow each other are a seed, seeds are compared as whole texts, and every
occurrence but the first is removed. A run that came before consists of such seeds, so their
union is the whole run. The first occurrence of every line stays.

Cases: a null text stays null with no lines; an empty one has one empty line. Rows without
id are returned unchanged and remove nothing. Rows that share id and text are one document
and get the same result; rows that share only the id are told apart by their text. Other
columns are ignored. An empty table gives an empty result.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore.llm.common import join_hot, only, typed
from stacklore.session import cut_lineage

WINDOW = 2
MIN_LINES = 2


def _chunked(docs):
    """doc_id, text, text_hash, lines and the last line number of every chunk."""
    rows = typed(docs, "doc_id", "text").withColumn("lines", F.split("text", "\n"))
    rows = rows.withColumn("_h", F.transform("lines", lambda x: F.md5(x)))
    n = F.size("_h")
    rolling = F.transform("_h", lambda h, i: F.md5(F.concat(
        *[F.coalesce(F.get("_h", i - k), F.lit("")) for k in range(WINDOW - 1, 0, -1)], h)))
    rows = rows.withColumn("_roll", rolling)
    # Beyond the first and last line there is no neighbour (null), so no least one either.
    ends = F.filter(F.transform("_roll", lambda r, i: F.when(
        (i == n - 1) | ((r < F.get("_roll", i - 1)) & (r < F.get("_roll", i + 1))), i)),
        lambda i: i.isNotNull())
    rows = rows.withColumn("ends", ends)
    return rows.select("doc_id", "text", "lines", "ends",
                       F.xxhash64("text").alias("text_hash"))


def _chunks(rows):
    """One row per chunk: number k, lines n and the text."""
    spans = F.transform("ends", lambda e, k: F.struct(
        (F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 1).alias("first"), e.alias("last"),
        k.alias("k")))
    out = rows.select("doc_id", "text_hash", "lines", F.explode(F.filter(
        spans, lambda s: s["last"] - s["first"] + 1 >= MIN_LINES)).alias("s"))
    text = F.array_join(F.slice("lines", F.col("s.first") + 1,
                                F.col("s.last") - F.col("s.first") + 1), "\n")
    return out.select("doc_id", "text_hash", F.col("s.k").alias("k"),
                      text.alias("chunk")).withColumn("hash", F.xxhash64("chunk"))


def repeated(docs) -> DataFrame:
    """Chunks to remove: one row per document, (doc_id, text_hash, drops), drops its numbers."""
    rows = _chunked(docs).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    counts = _chunks(rows).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    counts = cut_lineage(counts, "line-hashes")
    found = cut_lineage(only(_chunks(rows), counts.select("hash"), "hash"), "line-candidates")
    # The bytes decide: groups are whole texts, not hashes.
    place = F.struct("doc_id", "text_hash", "k")
    groups = cut_lineage(found.groupBy("hash", "chunk").agg(
        F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "line-groups")
    return join_hot(found, groups, ["hash", "chunk"]).filter(place != F.col("first")).groupBy(
        "doc_id", "text_hash").agg(F.collect_set("k").alias("drops"))


def without_repeats(docs) -> DataFrame:
    """doc_id, text without repeated chunks, n_lines, n_chunks and n_removed of every row."""
    rows = _chunked(docs).join(repeated(docs), ["doc_id", "text_hash"], "left")
    none = F.array().cast("array<int>")
    n = F.size("ends")
    kept = F.array_sort(F.array_except(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), F.coalesce("drops", none)))
    rows = rows.withColumn("_kept", kept)
    parts = F.transform("_kept", lambda k: F.array_join(F.slice(
        "lines", F.coalesce(F.get("ends", k - 1), F.lit(-1)) + 2,
        F.get("ends", k) - F.coalesce(F.get("ends", k - 1), F.lit(-1))), "\n"))
    # Lines are null where the text is, so the text itself need not be shuffled beside them.
    return rows.select(
        "doc_id", F.when(F.col("lines").isNotNull(), F.array_join(parts, "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(n, F.lit(0)).cast("long").alias("n_chunks"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_removed"))


def _pairs(rows):
    """One row per two lines that follow each other: number p of the first, and their text."""
    rows = rows.filter(F.size("lines") >= MIN_LINES)
    pairs = F.transform(F.slice("lines", 1, F.size("lines") - 1), lambda x, i: F.concat(
        x, F.lit("\n"), F.get("lines", i + 1)))
    return rows.select("doc_id", "text_hash", F.posexplode(pairs).alias("p", "pair")).withColumn(
        "hash", F.xxhash64("pair"))


def _lined(docs):
    return typed(docs, "doc_id", "text").select(
        "doc_id", F.split("text", "\n").alias("lines"), F.xxhash64("text").alias("text_hash"))


def repeated_runs(docs) -> DataFrame:
    """Lines to remove: one row per document, (doc_id, text_hash, drops), drops its numbers."""
    rows = _lined(docs).filter("doc_id IS NOT NULL AND lines IS NOT NULL")
    counts = _pairs(rows).groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1")
    counts = cut_lineage(counts, "run-hashes")
    found = cut_lineage(only(_pairs(rows), counts.select("hash"), "hash"), "run-candidates")
    place = F.struct("doc_id", "text_hash", "p")
    groups = cut_lineage(found.groupBy("hash", "pair").agg(
        F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1"), "run-groups")
    late = join_hot(found, groups, ["hash", "pair"]).filter(place != F.col("first"))
    # Three equal lines: the second belongs to the first pair, which stays.
    touches = (F.col("first.doc_id") == F.col("doc_id")) & (
        F.col("first.text_hash") == F.col("text_hash")) & (F.col("first.p") == F.col("p") - 1)
    lines = F.when(touches, F.array(F.col("p") + 1)).otherwise(F.array("p", F.col("p") + 1))
    return late.select("doc_id", "text_hash", F.explode(lines).alias("line")).groupBy(
        "doc_id", "text_hash").agg(F.collect_set("line").alias("drops"))


def without_repeated_runs(docs) -> DataFrame:
    """doc_id, text without repeated runs of lines, n_lines and n_removed lines of every row."""
    rows = _lined(docs).join(repeated_runs(docs), ["doc_id", "text_hash"], "left")
    none = F.array().cast("array<int>")
    kept = F.array_sort(F.array_except(
        F.sequence(F.lit(0), F.greatest(F.size("lines") - 1, F.lit(0))), F.coalesce("drops", none)))
    rows = rows.withColumn("_kept", kept)
    return rows.select(
        "doc_id", F.when(F.col("lines").isNotNull(), F.array_join(F.transform(
            "_kept", lambda k: F.get("lines", k)), "\n")).alias("text"),
        F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("drops"), F.lit(0)).cast("long").alias("n_removed"))
