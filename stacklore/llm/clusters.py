"""Centroid clustering of integer vectors by scalar lookup tables.

Components become integers, so a dimension holds few distinct values. Every round, a task
tabulates (value - centroid component) squared for each dimension, each value that occurs
in it among the task's batch, and each centroid; the distances of all vectors to all
centroids are then table rows gathered by value and summed over the dimensions, in 64-bit
integers and so exact. The tables hold the values of one Arrow batch of ``BATCH`` vectors,
so they never outgrow ``BATCH x centroids`` a dimension however wide the values spread; one
dimension is tabulated at a time.

A round reads the written vectors, adds vectors up per task and cluster, and sums one row
per task and cluster in Spark; the driver sees one row per centroid. Nothing is kept between
rounds but the centroids, so a lost executor costs its tasks of one round.

Cases: vectors with another number of components, a null one or one that is not finite are
left out, and so are null vectors. Centroids start as the ``k`` kept rows with the smallest
sha256 of ``<seed>:<vec_id>``; rows without id come last, and rows that share an id go by
their components. Fewer rows than ``k`` give fewer centroids, equal vectors may start
several; the smaller number then takes all of them and the others stay empty where they are.
A component beyond ``LIMIT`` in size (a value of 524,288) stops the job, as distances would
not fit 64 bits. Other columns are ignored; an empty table gives an empty result.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stacklore.session import cut_lineage

K, DIM, ROUNDS, SEED, STEPS = 40, 64, 5, 2, 256
BATCH = 4096
LIMIT = 2 ** 27


def integers(vectors, dim=DIM, steps=STEPS) -> DataFrame:
    """vec_id and v, the integers floor(steps * x), of the vectors that are kept."""
    x = F.col("embedding")
    real = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c)
                    & (F.abs(c.cast("double")) < F.lit(float("inf"))))
    kept = vectors.filter(x.isNotNull() & (F.size(x) == dim)).filter(real)
    scaled = F.transform(x, lambda c: F.floor(c.cast("double") * F.lit(float(steps))).cast("double"))
    kept = kept.select(F.col("vec_id").cast("long").alias("vec_id"), scaled.alias("v"))
    fits = F.forall("v", lambda c: F.abs(c) <= F.lit(float(LIMIT)))
    return kept.select("vec_id", F.when(fits, F.transform("v", lambda c: c.cast("long"))).otherwise(
        F.raise_error(F.lit("a component is too large for exact distances"))).alias("v"))


def starts(points, k=K, seed=SEED):
    """The first centroids, k at most, as a list of tuples."""
    turn = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = points.select(turn.alias("turn"), "v").orderBy(
        F.col("turn").asc_nulls_last(), "v").limit(k)
    return [tuple(r["v"]) for r in first.collect()]


def nearest(x, centroids):
    """(cluster, squared distance) of every row of the integers ``x``; ties go to the smaller."""
    total = np.zeros((len(x), len(centroids)), np.int64)
    for column, center in zip(x.T, centroids.T):
        values, place = np.unique(column, return_inverse=True)
        table = (values[:, None] - center[None, :]) ** 2
        total += table[place]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(x)), cluster]


def _blocks(batches, dim):
    """The vectors of a task as integer arrays of BATCH rows at most."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            yield part, part.column("v").flatten().to_numpy().reshape(part.num_rows, dim)


def means(points, centroids) -> list:
    """The centroids after one round: floors of exact means, empty ones as they were."""
    at, dim = np.array(centroids, np.int64), len(centroids[0])

    def add_up(batches):
        counts, sums = np.zeros(len(at), np.int64), np.zeros(at.shape, np.int64)
        for _, x in _blocks(batches, dim):
            cluster, _ = nearest(x, at)
            counts += np.bincount(cluster, minlength=len(at))
            order = np.argsort(cluster, kind="stable")
            found, first = np.unique(cluster[order], return_index=True)
            sums[found] += np.add.reduceat(x[order], first)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array(counts[used]),
             pa.array(list(sums[used]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = points.select("v").mapInArrow(add_up, "cluster int, n long, sums array<long>")
    whole = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(
        *[F.sum(F.col("sums")[d]) for d in range(dim)]).alias("sums"))
    new = list(centroids)
    for row in whole.collect():
        new[row["cluster"]] = tuple(s // row["n"] for s in row["sums"])
    return new


def assigned(points, centroids) -> DataFrame:
    """vec_id, cluster and distance of every vector."""
    at, dim = np.array(centroids, np.int64), len(centroids[0])

    def place(batches):
        for part, x in _blocks(batches, dim):
            cluster, distance = nearest(x, at)
            yield pa.RecordBatch.from_arrays(
                [part.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array(distance)],
                ["vec_id", "cluster", "distance"])

    return points.mapInArrow(place, "vec_id long, cluster int, distance long")


def clusters(vectors, k=K, dim=DIM, rounds=ROUNDS, seed=SEED) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every vector."""
    spark = vectors.sparkSession
    points = cut_lineage(integers(vectors, dim), "clusters-points")
    centroids = starts(points, k, seed)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, "
                                         "cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = means(points, centroids)
    rows = cut_lineage(assigned(points, centroids), "clusters-assigned")
    per = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(
        F.sum("distance").alias("s")).collect()}
    # One row per centroid, at most k.
    facts = spark.createDataFrame(
        [(c, per[c], sum(per.values()),
          hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c in per],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
