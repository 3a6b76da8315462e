"""Streamed saves, merged batch by batch into a stored catalogue.

A save is admitted if no save with its (project, hash) was admitted before; batches come in
the order of arrival, and inside a batch ``seq`` decides. An admitted save is a new version
of its name: it becomes the current row, pending, and the row it replaces moves to the
history. ``created_at`` and ``call_count`` survive.

A batch meets the stored hashes and names of its own buckets only (``KeyedLog``), so its cost
follows the batch, and all that the stream remembers lies in those files: no keyed state is
held, none expires, and a copy is refused however late it comes. Late new content is admitted
as the latest version. A batch that is sent again changes nothing.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore.operators.catalogue import HASH, KEY
from stacklore.operators.scan import CHUNK, with_neighbour, with_running_sum
from stacklore.session import cut_lineage
from stacklore.streaming.keyed_log import BUCKETS, COMPACT_AFTER, KeyedLog

TABLES = {"hashes": HASH, "current": KEY, "history": [*KEY, "version"]}
WRITER = "saves"


def save_store(spark, path, buckets=BUCKETS, compact_after=COMPACT_AFTER) -> KeyedLog:
    return KeyedLog(spark, path, TABLES, buckets, compact_after)


def merge_batch(store: KeyedLog, saves: DataFrame, batch_id, writer=WRITER, width=CHUNK):
    """Admit and merge one batch of saves (project, name, code_hash, seq, ts and any others)."""
    if store.done(writer, batch_id):
        return
    saves = cut_lineage(saves, "batch")
    first = cut_lineage(saves.groupBy(*HASH).agg(
        F.min(F.struct("seq", "name", "ts")).alias("first")).select(*HASH, "first.*"), "first")
    held = store.read("hashes", store.buckets_of("hashes", first))
    if held is not None:
        first = cut_lineage(first.join(held, HASH, "left_anti"), "admitted")

    # Versions of a name follow each other inside the batch, and its stored row comes first.
    places = with_running_sum(first, KEY, "seq", F.lit(1), "place", width)
    places = cut_lineage(with_neighbour(
        places, KEY, "seq", F.col("ts"), "archived_at", ahead=True, width=width).select(
        *KEY, "seq", "place", "archived_at"), "places")
    names = cut_lineage(first.groupBy(*KEY).agg(
        F.min("ts").alias("_created"), F.min_by("ts", "seq").alias("_from")), "names")
    stored = store.read("current", store.buckets_of("current", names))
    before = names.withColumns({"_version": F.lit(0), "_calls": F.lit(0).cast("long")})
    replaced = None
    if stored is not None:
        replaced = stored.join(names, KEY)
        old = stored.select(*KEY, F.col("version").alias("_old"), "call_count", "created_at")
        before = names.join(old, KEY, "left").select(
            *KEY, F.coalesce("created_at", "_created").alias("_created"),
            F.coalesce("_old", F.lit(0)).alias("_version"),
            F.coalesce("call_count", F.lit(0)).cast("long").alias("_calls"))
    rows = saves.join(places, [*KEY, "seq"]).join(before, KEY).select(
        *saves.columns, F.lit("pending").alias("verification_status"),
        (F.col("_version") + F.col("place")).cast("int").alias("version"),
        F.col("_calls").alias("call_count"), F.col("_created").alias("created_at"),
        F.col("ts").alias("updated_at"), "archived_at")
    rows = cut_lineage(rows, "merged")
    history = rows.where("archived_at is not null")
    if replaced is not None:
        history = history.unionByName(replaced.withColumn("archived_at", F.col("_from")).select(
            *history.columns))
    store.commit(writer, batch_id, {
        "hashes": first.select(*HASH),
        "current": rows.where("archived_at is null").drop("archived_at"),
        "history": history})


def ingest_saves(saves: DataFrame, store: KeyedLog, checkpoint, trigger=None, writer=WRITER):
    """Start the stream; with the default trigger it ends when all that is there is merged."""
    return saves.writeStream.foreachBatch(
        lambda batch, batch_id: merge_batch(store, batch, batch_id, writer)).option(
        "checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
