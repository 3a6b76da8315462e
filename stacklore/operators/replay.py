"""Exact sequential admission of a save log.

Saves of a project arrive in ``seq`` order (unique numbers). A save is rejected
when some name of the project holds its hash at that time; otherwise its name now
holds it. So a hash can come back (A, B, A) once its holder has moved on, and each
decision depends on earlier ones.

A name whose hashes nobody else saved follows its own log: a save is accepted when
its hash differs from the one before. The others fall into groups that names and
hashes link. A decision depends on its group alone, so groups are settled side by
side, each in one pass over its saves in order, as a stream that keeps what its
names hold. A group of more than ``FOLD_ROWS`` saves is cut by time: what its names
hold after one part enters the next one as saves known to be accepted, and the links
inside a part are fewer, so a part falls into smaller groups again. The number of
rounds is that of the parts of the largest group, however long its chains are.
"""

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stacklore.operators.links import connected
from stacklore.operators.scan import CHUNK, with_neighbour, with_running_sum
from stacklore.session import cut_lineage

NAME = ["project", "name"]
HASH = ["project", "code_hash"]
ACCEPTED, REJECTED = "accepted", "rejected"
COLUMNS = ["project", "name", "code_hash", "seq", "status"]
FOLD_ROWS = 2_000_000


def replay_saves(log: DataFrame, width=CHUNK, fold_rows=FOLD_ROWS) -> DataFrame:
    """Add ``status`` (accepted or rejected) to every save of the log."""
    saves = log.select("project", "name", "code_hash", "seq")
    per_hash = saves.groupBy(*HASH).agg((F.min("name") != F.max("name")).alias("_shared"))
    rows = with_neighbour(
        saves.join(per_hash, HASH), NAME, "seq", F.col("code_hash"), "_before", width=width)
    mixed = rows.groupBy(*NAME).agg(F.max("_shared").alias("_mixed"))
    rows = cut_lineage(rows.join(mixed, NAME).withColumn(
        "status",
        F.when(F.col("code_hash").eqNullSafe(F.col("_before")), REJECTED).otherwise(ACCEPTED),
    ).select(*COLUMNS, "_mixed"), "replay")
    alone = rows.where(~F.col("_mixed")).drop("_mixed")
    work = rows.where("_mixed").select("project", "name", "code_hash", "seq")
    if work.isEmpty():
        return alone
    return alone.unionByName(_settled(work, width, fold_rows))


def _grouped(saves):
    """``saves`` with the group of their names and hashes.

    Nodes are hashes of the values: two that coincide only join their groups.
    """
    links = saves.select(F.xxhash64(F.lit("name"), *NAME).alias("a"),
                         F.xxhash64(F.lit("hash"), *HASH).alias("b"))
    groups = connected(links)
    return saves.withColumn("node", F.xxhash64(F.lit("name"), *NAME)).join(groups, "node").drop("node")


def _settled(work, width, fold_rows):
    grouped = cut_lineage(_grouped(work), "grouped")
    large = cut_lineage(grouped.groupBy("group").agg(F.count("*").alias("n")).where(
        F.col("n") > fold_rows).select("group"), "large")
    if large.isEmpty():
        return _folded(grouped).select(*COLUMNS)
    done = _folded(grouped.join(large, "group", "left_anti")).select(*COLUMNS)
    parts = with_running_sum(grouped.join(large, "group", "left_semi"), ["group"], "seq",
                             F.lit(1), "place", width)
    parts = cut_lineage(parts.withColumn(
        "part", F.floor((F.col("place") - 1) / fold_rows).cast("int")).drop("group", "place"), "parts")
    held = None
    for part in range(parts.agg(F.max("part")).first()[0] + 1):
        saves = parts.where(F.col("part") == part).drop("part")
        if held is not None:
            saves = saves.withColumn("carried", F.lit(False)).unionByName(
                _touched(held, saves).withColumn("carried", F.lit(True)))
        else:
            saves = saves.withColumn("carried", F.lit(False))
        folded = cut_lineage(_folded(_grouped(cut_lineage(saves, "part"))), "folded")
        done = done.unionByName(folded.where(~F.col("carried")).select(*COLUMNS))
        held = cut_lineage(held_after(folded, held), "held")
    return done


def _touched(held, saves):
    """What is held by the names of ``saves``, or by others of their hashes."""
    by_name = held.join(saves.select(*NAME).distinct(), NAME, "left_semi")
    by_hash = held.join(saves.select(*HASH).distinct(), HASH, "left_semi")
    return by_name.unionByName(by_hash).distinct()


def held_after(decided, held=None) -> DataFrame:
    """(project, name, code_hash, seq) of the last accepted save of every name."""
    last = decided.where(F.col("status") == ACCEPTED).groupBy(*NAME).agg(
        F.max_by(F.struct("code_hash", "seq"), "seq").alias("h")).select(*NAME, "h.*")
    if held is None:
        return last
    return last.unionByName(held.join(last, NAME, "left_anti"))


def _folded(grouped):
    """``grouped`` with the status of every save, each group in one pass in seq order."""
    schema = grouped.schema.add("status", "string")
    spots = {c: grouped.columns.index(c) for c in ("group", "project", "name", "code_hash")}

    def fold(batches):
        # What the names of the group at hand hold, and who holds each hash.
        at, holds, holder = None, {}, {}
        for batch in batches:
            group, project, name, code_hash = (
                batch.column(spots[c]).to_pylist() for c in ("group", "project", "name", "code_hash"))
            status = []
            for g, p, n, h in zip(group, project, name, code_hash):
                if g != at:
                    at, holds, holder = g, {}, {}
                if (p, h) in holder:
                    status.append(REJECTED)
                    continue
                if (p, n) in holds:
                    del holder[p, holds[p, n]]
                holds[p, n], holder[p, h] = h, n
                status.append(ACCEPTED)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(status, pa.string())], [*batch.schema.names, "status"])

    return grouped.repartition("group").sortWithinPartitions("group", "seq").mapInArrow(fold, schema)
