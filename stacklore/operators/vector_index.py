"""A stored index of vectors in cells, for searches that may miss a few neighbours.

Centres are fitted on a sample of fixed size per centre; every vector is stored in the
cell of its nearest centre. A query looks into its ``probes`` nearest cells that hold
rows of its project, and further on until they hold ``k`` rows, so a small project is
never crowded out. What it finds there is scored exactly, with all cells probed the
result is that of ``vectors.knn``. Only the folders of probed cells are read.

``probes_for`` measures how many cells a share of the true neighbours needs, on a sample
of the queries, so the number follows the data and is no constant.

Cases: null, empty and zero vectors never get here (``vector_prepare``). An empty set of
vectors gives an index without cells, which finds nothing; a query of an unknown project
finds nothing. Repeated keys stay as rows; ties go to project, then name. Other columns
of both sides are ignored.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from stacklore.operators import vectors as N
from stacklore.session import cut_lineage

KEY = N.KEY
ROWS_PER_CELL, MAX_CELLS = 4096, N.MAX_PIVOTS
TARGET, SAMPLED_QUERIES = 0.9, 256


class VectorIndex:
    """The index below ``path``: ``cells/cell=n`` (vectors), ``sizes`` and ``centres``."""

    def __init__(self, spark, path):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, vectors: DataFrame, path, cells=None) -> "VectorIndex":
        """Index every row of ``vectors`` (project, name, embedding), as prepared.

        ``cells`` defaults to one per ROWS_PER_CELL rows, at least the square root of the
        rows for small tables, MAX_CELLS at most; cells larger than a block are searched
        in blocks.
        """
        index, spark = cls(vectors.sparkSession, path), vectors.sparkSession
        vectors = vectors.select(*KEY, "embedding")
        if cells is None:
            rows = vectors.count()
            cells = int(max(1, min(MAX_CELLS, max(rows // ROWS_PER_CELL, rows ** 0.5))))
        centres, _ = N._centres(vectors, cells)
        centres = [] if centres is None else centres.tolist()
        spark.createDataFrame(
            list(enumerate(centres)), "cell int, centre array<double>").coalesce(1).write.parquet(
            f"{index.path}/centres")
        placed = index._by_distance(vectors, "project string, name string, embedding array<double>",
                                    first_only=True)
        # Large cells take several files, small ones share a task.
        placed.hint("rebalance", "cell").write.partitionBy("cell").parquet(f"{index.path}/cells")
        index.stored().groupBy("project", "cell").agg(F.count("*").alias("n")).write.parquet(
            f"{index.path}/sizes")
        return index

    def stored(self) -> DataFrame:
        """Every indexed vector with its cell."""
        return self.spark.read.schema(
            "project string, name string, embedding array<double>, cell int").parquet(
            f"{self.path}/cells")

    def _centres(self):
        """At most MAX_CELLS rows, as one matrix."""
        rows = self.spark.read.schema("cell int, centre array<double>").parquet(
            f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["centre"] for r in rows], dtype="float64")

    def _by_distance(self, rows, schema, first_only=False) -> DataFrame:
        """``rows`` with the nearest cell (``cell``) or all cells, nearest first (``cells``)."""
        sent = self.spark.sparkContext.broadcast(self._centres())

        def place(batches):
            centres = sent.value
            for batch in batches:
                if not len(batch):
                    continue
                if not len(centres):
                    if not first_only:
                        yield batch.assign(cells=[[] for _ in range(len(batch))])
                    continue
                product = N._matrix(batch["embedding"]) @ centres.T
                if first_only:
                    yield batch.assign(cell=product.argmax(axis=1).astype("int32"))
                else:
                    order = np.argsort(-product, axis=1, kind="stable").astype("int32")
                    yield batch.assign(cells=list(order))

        kept = [part.strip().split(" ")[0] for part in schema.split(", ")]
        return rows.select(*kept).mapInPandas(
            place, schema + (", cell int" if first_only else ", cells array<int>"))

    def _probed(self, queries, k, probes) -> DataFrame:
        """query_id, project, embedding and the list ``probed``: the cells a query looks into."""
        sizes = self.spark.read.schema("project string, cell int, n long").parquet(
            f"{self.path}/sizes")
        # One row per project and one for all, each with a map of at most MAX_CELLS entries.
        totals = sizes.groupBy("cell").agg(F.sum("n").alias("n")).select(
            F.lit(None).cast("string").alias("project"), "cell", "n")
        held = sizes.where("project is not null").unionByName(totals).groupBy("project").agg(
            F.map_from_entries(F.collect_list(F.struct("cell", "n"))).alias("held"))
        ranked = self._by_distance(
            queries, "query_id long, project string, embedding array<double>")
        start = F.struct(F.array().cast("array<int>").alias("cells"),
                         F.lit(0).cast("long").alias("rows"))

        def enter(state, cell):
            open_ = (F.size(state["cells"]) < probes) | (state["rows"] < k)
            return F.when(open_, F.struct(
                F.array_append(state["cells"], cell).alias("cells"),
                (state["rows"] + F.element_at("held", cell)).alias("rows"))).otherwise(state)

        inhabited = F.filter("cells", lambda c: F.map_contains_key("held", c))
        met = ranked.alias("q").join(held.alias("h"), F.col("q.project").eqNullSafe(F.col("h.project")))
        return met.select("query_id", "q.project", "embedding",
                          F.aggregate(inhabited, start, enter)["cells"].alias("probed"))

    def search(self, queries: DataFrame, k, probes, threshold=None,
               block_rows=N.BLOCK_ROWS) -> DataFrame:
        """k best (query_id, project, name, similarity, rank) per query of the probed cells.

        ``queries``: query_id, project (null = all projects), embedding, as prepared.
        """
        asked = cut_lineage(self._probed(queries, k, probes), "probed")
        visits = asked.select("query_id", "project", "embedding", F.explode("probed").alias("cell"))
        wanted = [r[0] for r in visits.select("cell").distinct().collect()]  # MAX_CELLS at most
        stored = self.stored().where(F.col("cell").isin(wanted) if wanted else F.lit(False))
        sizes = self.spark.read.schema("project string, cell int, n long").parquet(
            f"{self.path}/sizes").groupBy("cell").agg(
            F.ceil(F.sum("n") / block_rows).cast("int").alias("parts"))
        crowds = visits.groupBy("cell").agg(
            F.ceil(F.count("*") / N.QUERY_BLOCK_ROWS).cast("int").alias("crowds"))
        grid = cut_lineage(sizes.join(crowds, "cell"), "grid")  # a row per cell
        # Blocks of a cell's rows meet blocks of the queries that probe it.
        rows = stored.join(grid, "cell").select(
            "cell", F.pmod(F.xxhash64("name"), "parts").cast("int").alias("part"),
            F.explode(F.sequence(F.lit(0), F.col("crowds") - 1)).alias("crowd"), *KEY, "embedding")
        asks = visits.join(grid, "cell").select(
            "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
            F.pmod(F.xxhash64("query_id"), "crowds").cast("int").alias("crowd"),
            "query_id", "project", "embedding")

        def match(asks, rows):
            found = None
            if len(asks) and len(rows):
                found = N._block_matches(asks, rows, k, threshold)
            if found is None:
                found = pd.DataFrame(columns=["query_id", *KEY, "similarity"])
            return found

        at = ["cell", "part", "crowd"]
        found = asks.groupBy(*at).cogroup(rows.groupBy(*at)).applyInPandas(match, N.MATCHES)
        return N.top_k(found, k)

    def probes_for(self, queries: DataFrame, k, target=TARGET, sample=SAMPLED_QUERIES) -> int:
        """Cells to probe so that ``target`` of the true neighbours of a sample are found.

        The sample is bounded: the ``sample`` queries with the smallest hashes of their id.
        Their exact neighbours come from ``vectors.knn``.
        """
        asked = cut_lineage(queries.select("query_id", "project", "embedding").orderBy(
            F.xxhash64("query_id"), "query_id").limit(sample), "asked")
        stored = self.stored()
        true = N.knn(asked, stored, k).select("query_id", *KEY)
        homes = stored.select(*KEY, "cell").join(F.broadcast(true), KEY)  # sample * k rows
        order = self._probed(asked, 1 << 62, MAX_CELLS).select("query_id", "probed")
        places = homes.join(order, "query_id").select(
            F.array_position("probed", F.col("cell")).alias("place"))
        found = places.groupBy("place").agg(F.count("*").alias("n")).orderBy("place").collect()
        total, so_far = sum(r["n"] for r in found), 0
        for r in found:  # one row per cell at most
            so_far += r["n"]
            if so_far >= target * total:
                return int(r["place"])
        return 1


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """query_id, wanted and found: how many of the true neighbours a search returned."""
    hits = found.select("query_id", *KEY).distinct().withColumn("hit", F.lit(1))
    return true.select("query_id", *KEY).distinct().join(
        hits, ["query_id", *KEY], "left").groupBy("query_id").agg(
        F.count("*").alias("wanted"), F.count("hit").alias("found"))
