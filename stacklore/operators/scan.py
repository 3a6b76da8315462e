"""Ordered scans over keys of any size.

A window over one key runs in one task, and one key may hold a third of the
rows. Here each key is cut into chunks along its order column. Windows run
inside the chunks, a second window runs over one small summary per chunk, and
the carried values are joined back. No task ever sees more than a chunk, or the
chunk summaries of a key.
"""

from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 1_000_000


def _chunked(df, order, width):
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(width)))


def with_neighbour(df: DataFrame, keys, order, value, out, ahead=False, width=CHUNK):
    """Add ``out`` = ``value`` of the previous (or next) row of the same key."""
    rows = _chunked(df, order, width).withColumn("_v", F.struct(value.alias("v")))
    # Reading a key backwards turns "next row" into "previous row".
    direction = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_chunk").orderBy(direction(order))
    closing = F.min_by if ahead else F.max_by
    edges = rows.groupBy(*keys, "_chunk").agg(closing("_v", order).alias("_edge"))
    across = Window.partitionBy(*keys).orderBy(direction("_chunk"))
    carried = edges.withColumn("_carry", F.lag("_edge").over(across)).drop("_edge")
    return (
        rows.withColumn("_prev", F.lag("_v").over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_prev", "_carry")["v"])
        .drop("_chunk", "_v", "_prev", "_carry")
    )


def with_running_sum(df: DataFrame, keys, order, value, out, width=CHUNK):
    """Add ``out`` = sum of ``value`` over the rows of the key up to this one."""
    rows = _chunked(df, order, width).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(
        Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_total"))
        .withColumn("_carry", F.coalesce(F.sum("_total").over(across), F.lit(0)))
        .drop("_total")
    )
    return (
        rows.withColumn("_part", F.sum("_v").over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.col("_part") + F.col("_carry"))
        .drop("_chunk", "_v", "_part", "_carry")
    )


def with_last_known(df: DataFrame, keys, order, value, out, ahead=False, width=CHUNK):
    """Add ``out`` = the nearest non-null ``value`` of the key before (or after) this row."""
    rows = _chunked(df, order, width).withColumn("_v", value)
    direction = (lambda c: F.col(c).desc()) if ahead else (lambda c: F.col(c).asc())
    inside = Window.partitionBy(*keys, "_chunk").orderBy(direction(order)).rowsBetween(
        Window.unboundedPreceding, -1)
    across = Window.partitionBy(*keys).orderBy(direction("_chunk")).rowsBetween(
        Window.unboundedPreceding, -1)
    closing = F.min_by if ahead else F.max_by
    known = F.col("_v").isNotNull()
    carried = (
        rows.groupBy(*keys, "_chunk")
        .agg(closing("_v", F.when(known, F.col(order))).alias("_edge"))
        .withColumn("_carry", F.last("_edge", ignorenulls=True).over(across))
        .drop("_edge")
    )
    return (
        rows.withColumn("_seen", F.last("_v", ignorenulls=True).over(inside))
        .join(carried, [*keys, "_chunk"])
        .withColumn(out, F.coalesce("_seen", "_carry"))
        .drop("_chunk", "_v", "_seen", "_carry")
    )
