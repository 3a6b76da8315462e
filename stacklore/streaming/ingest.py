"""Streams of calls, verdicts and exactly replayed saves (``saves`` merges saves).

Every sink is an append-only table with one folder per micro-batch. A batch that
runs again after a failure writes the same folder again, so each row counts once.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore.operators.catalogue import KEY, verdict_merge
from stacklore.operators.replay import ACCEPTED, replay_saves
from stacklore.session import cut_lineage


def _append(path):
    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def _start(stream, mode, sink, checkpoint, trigger):
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    if mode:
        writer = writer.outputMode(mode)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def finish(query):
    """Wait for a bounded stream; a failed stream raises, a waiting one is stopped."""
    try:
        query.awaitTermination()
    finally:
        query.stop()


# ---- saves: exact replay -------------------------------------------------------

HELD = "project string, name string, code_hash string, seq long"


def ingest_replay(saves: DataFrame, path, trigger=None):
    """Exact sequential admission, micro-batch by micro-batch.

    Files must arrive in seq order; a save that comes too late stops the stream, as it
    could change what was decided. A batch starts from the hash that each name held
    after the batch before, as saves that are known to be accepted, and leaves
    the same table for the next one.
    """
    def admit(batch, batch_id):
        log = batch.select("project", "name", "code_hash", "seq")
        if batch_id > 0:
            _check_order(log, path, batch_id)
            log = log.unionByName(log.sparkSession.read.schema(HELD).parquet(
                f"{path}/held/batch={batch_id - 1}").withColumn("_held", F.lit(True)),
                allowMissingColumns=True)
        else:
            log = log.withColumn("_held", F.lit(None).cast("boolean"))
        log = cut_lineage(log, "batch")
        decided = replay_saves(log.drop("_held"))
        decided.where(F.col("status") == ACCEPTED).groupBy(*KEY).agg(
            F.max_by(F.struct("code_hash", "seq"), "seq").alias("h")
        ).select(*KEY, "h.*").write.mode("overwrite").parquet(f"{path}/held/batch={batch_id}")
        arrived = log.where("_held is null").select("seq")
        decided.join(arrived, "seq", "left_semi").write.mode("overwrite").parquet(
            f"{path}/rows/batch={batch_id}")

    return _start(saves, None, admit, f"{path}/checkpoint", trigger)


def _check_order(log, path, batch_id):
    """Refuse a batch that starts before the end of the one before it."""
    spark, before = log.sparkSession, f"batch={batch_id - 1}"
    known = spark.read.schema("seq long").parquet(f"{path}/held/{before}", f"{path}/rows/{before}")
    last, first = known.agg(F.max("seq")).first()[0], log.agg(F.min("seq")).first()[0]
    if last is not None and first is not None and first <= last:
        raise ValueError(f"save {first} arrived after save {last}")


def replayed_saves(spark, path) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").drop("batch")


# ---- calls and verdicts ----------------------------------------------------------

def ingest_calls(calls: DataFrame, path, trigger=None):
    """Running totals per key; each batch writes the totals that changed."""
    totals = calls.groupBy(*KEY).agg(F.count("*").alias("calls"))
    return _start(totals, "update", _append(f"{path}/rows"), f"{path}/checkpoint", trigger)


def call_totals(spark, path) -> DataFrame:
    """Totals only grow, so the largest one is the latest."""
    return spark.read.parquet(f"{path}/rows").groupBy(*KEY).agg(F.max("calls").alias("calls"))


def ingest_verdicts(verdicts: DataFrame, path, trigger=None):
    """Latest verdict per key by event time; a late older one changes nothing."""
    latest = verdicts.groupBy(*KEY).agg(
        F.max(F.struct("ts", "event_id", "verification_status")).alias("verdict"))
    return _start(latest, "update", _append(f"{path}/rows"), f"{path}/checkpoint", trigger)


def apply_verdicts(spark, path, catalogue: DataFrame) -> DataFrame:
    latest = spark.read.parquet(f"{path}/rows").groupBy(*KEY).agg(F.max("verdict").alias("v"))
    return verdict_merge(catalogue, latest.select(
        *KEY, "v.verification_status", F.col("v.ts").alias("updated_at")))
