"""Text vectors without an outside model: hashed term counts, weighted, of unit length."""

from pyspark.sql import DataFrame, functions as F

from stacklore.session import cut_lineage


def text_embedding(rows: DataFrame, keys, document, dimension=768) -> DataFrame:
    """(keys, embedding) of every row; whole texts, one read of them.

    Words are hashed by md5 into ``dimension`` terms and counted once; the counts are
    written. A term's weight falls with the rows that hold it, log((n + 1) / (rows + 1)),
    and vectors have length one, or are zero where nothing has weight. ``keys`` name a row.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce(document, F.lit(""))), F.lit(r"(\w+)"))
    term = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("long") % dimension
    # A row without words keeps one null word, so it is counted and gets a vector.
    counts = cut_lineage(rows.select(*keys, F.explode_outer(words).alias("word")).select(
        *keys, term.cast("int").alias("term")).groupBy(*keys, "term").agg(
        F.count("*").alias("n")), "embedding-counts")
    total = counts.select(*keys).distinct().count()
    # One row per term, at most ``dimension``.
    weights = counts.where("term IS NOT NULL").groupBy("term").agg(
        F.log((F.lit(total) + 1) / (F.count("*") + 1)).alias("weight"))
    weighted = counts.join(F.broadcast(weights), "term", "left").withColumn(
        "value", F.coalesce(F.col("n") * F.col("weight"), F.lit(0.0)))
    entries = F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "value")))
    vectors = weighted.groupBy(*keys).agg(
        F.map_from_entries(entries).alias("_map"),
        F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("_norm"))
    places = F.sequence(F.lit(0), F.lit(dimension - 1))
    return vectors.select(*keys, F.transform(places, lambda i: F.coalesce(
        F.try_element_at("_map", i) / F.nullif(F.col("_norm"), F.lit(0.0)),
        F.lit(0.0))).alias("embedding"))
