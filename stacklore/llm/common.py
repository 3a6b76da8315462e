"""Helpers of the training-data operators: tables, hot keys, ranks, components."""

from pyspark.sql import DataFrame, Window, functions as F, types as T

from stacklore.session import cut_lineage

# A word is a run of anything but the six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
HOT_SHARE = 1000
SENT_IDS = 2_000_000


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text):
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def held_out(doc_id, modulus, remainder):
    """Whether crc32 of the id as text leaves this remainder; a null id is not held out."""
    rest = F.crc32(doc_id.cast("string").cast("binary")) % modulus
    return F.coalesce(rest == remainder, F.lit(False))


def join_hot(many, one, keys, n="n", how="inner"):
    """Join ``many`` with one row per key where some keys may hold a large share of it.

    ``one`` has a column ``n``, the rows of ``many`` with that key. At most HOT_SHARE
    keys can hold one in HOT_SHARE rows each, so these are broadcast, and no key that
    is left for the shuffle holds more. ``many`` and ``one`` are read twice: pass
    written tables.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = one.filter(F.col(n) * HOT_SHARE >= total).drop(n)
    cold = one.filter(F.col(n) * HOT_SHARE < total).drop(n)
    spread = many.join(F.broadcast(hot.select(*keys)), keys, "left_anti")
    return many.join(F.broadcast(hot), keys).unionByName(spread.join(cold, keys, how),
                                                         allowMissingColumns=True)


def only(rows, ids, key="doc_id"):
    """The rows whose ``key`` is in ``ids``, a written table of distinct ids.

    Up to SENT_IDS ids (8 bytes each) are sent to the rows, which then need no shuffle;
    more of them are joined by key.
    """
    few = ids.count() <= SENT_IDS
    return rows.join(F.broadcast(ids) if few else ids, key, "left_semi")


def ranked(df, part, order, total, per_window=20_000, name="rank"):
    """Gapless ranks from 0 within ``part``, without one window for a whole part.

    ``order`` starts with a column of hashes: rows fall into buckets by its range,
    windows run inside buckets, and the sums of the buckets before give the offset.
    ``part`` has few values; the buckets grow with ``total``.
    """
    buckets = max(1, -(-total // per_window))
    width = -(-(2 ** 64) // buckets)
    # (hash >> 1) + 2^62 is in 0 .. 2^63, which avoids overflow in the range sums.
    place = F.shiftright(F.col(order[0]), 1) + F.lit(2 ** 62)
    marked = df.withColumn("_bucket", F.floor(place / F.lit(float(width // 2 + 1))).cast("long"))
    before = Window.partitionBy(part).orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    starts = marked.groupBy(part, "_bucket").agg(F.count("*").alias("_n")).select(
        F.col(part).alias("_part"), F.col("_bucket").alias("_b"),
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(part, "_bucket").orderBy(*order)
    joined = marked.join(starts, (F.col(part) == F.col("_part"))
                         & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(
        name, F.col("_start") + F.row_number().over(inside) - 1).drop(
        "_bucket", "_b", "_part", "_start")


def dealt(df, order, label, per_bucket=200_000) -> DataFrame:
    """``df`` written in buckets, numbered in ``_bucket``, that follow the sort order.

    Bucket b holds the rows between those of b - 1 and b + 1 in the order of the columns
    ``order``, so a scan over all rows is windows inside buckets and a few carried values
    per bucket. End ``order`` with a column that tells equal rows apart where many may be
    equal; the buckets grow with the rows, about ``per_bucket`` each.
    """
    rows = cut_lineage(df, label)
    buckets = max(1, -(-rows.count() // per_bucket))
    return cut_lineage(rows.repartitionByRange(buckets, *order).withColumn(
        "_bucket", F.spark_partition_id()), f"{label}-dealt")


def components(links, rounds=60) -> DataFrame:
    """Connected components of ``links`` (a, b): one row (node, label) per linked node.

    Every round a node takes the smallest label around it and then the label of its
    label, so the distance covered doubles. Both joins meet one row per key, and hot
    keys are broadcast (``join_hot``). Each round is written and read again.
    """
    both = cut_lineage(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "cc-edges")
    degree = cut_lineage(both.groupBy("b").agg(F.count("*").alias("n")), "cc-degree")
    labels = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("label")), "cc-labels")
    for _ in range(rounds):
        at_b = labels.join(degree, labels["node"] == degree["b"]).select("b", "label", "n")
        near = join_hot(both, at_b, "b").groupBy(F.col("a").alias("node")).agg(
            F.min("label").alias("near"))
        hooked = cut_lineage(labels.join(near, "node").select(
            "node", F.least("label", "near").alias("label"),
            F.col("label").alias("old")), "cc-hooked")
        sizes = hooked.groupBy(F.col("label").alias("node")).agg(F.count("*").alias("n"))
        roots = cut_lineage(hooked.select("node", F.col("label").alias("root")).join(
            sizes, "node").select(F.col("node").alias("label"), "root", "n"), "cc-roots")
        jumped = cut_lineage(join_hot(hooked, roots, "label").select(
            "node", F.col("root").alias("label"), "old"), "cc-labels")
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels
    raise RuntimeError("components did not settle")


def typed(docs, *columns, also=()):
    """Only these columns, with the types of ``documents``; missing ones are null."""
    kinds = {"doc_id": T.LongType(), "n_chars": T.LongType()}
    return docs.select(*[
        (F.col(c) if c in docs.columns else F.lit(None)).cast(
            kinds.get(c, T.StringType())).alias(c) for c in columns], *also)
