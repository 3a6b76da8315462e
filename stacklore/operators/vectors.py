"""Exact nearest neighbours and near duplicates.

Similarities are matrix products of bounded blocks inside Arrow tasks, and each
block returns only its best rows, never all pairs. A small query set is sent to
the vectors, which then stay where they are. A larger one meets them in a grid
of (vector block, query block) groups of bounded size, so a project of any size
is spread over many groups. Both ways give the same rows.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from stacklore.session import cut_lineage

KEY = ["project", "name"]
DIGITS = 6
BLOCK_ROWS = 8192
QUERY_BLOCK_ROWS = 4096
SENT_QUERY_BYTES = 32 * 1024 * 1024
MERGE_ROWS = 500_000
MAX_PIVOTS = 1024
SAMPLE_PER_PIVOT, SAMPLE_ROUNDS = 16, 4
LEADING_SHARE = 4
_PRODUCT_CELLS = 8_000_000
MATCHES = "query_id long, project string, name string, similarity double"


def vector_prepare(vectors: DataFrame, dimension=None) -> DataFrame:
    """Unit vectors of the right dimension; wrong sizes and zero vectors drop out."""
    rows = vectors.withColumn(
        "embedding", F.transform("embedding", lambda x: x.cast("double")))
    if dimension:
        rows = rows.where(F.size("embedding") == dimension)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x * x))
    return (
        rows.withColumn("_norm", norm).where("_norm > 0")
        .withColumn("embedding", F.transform("embedding", lambda x: x / F.col("_norm")))
        .drop("_norm")
    )


def rebuild(vectors: DataFrame, order, dimension=None) -> DataFrame:
    """The latest usable vector of each key."""
    rest = [c for c in vectors.columns if c not in KEY]
    usable = vector_prepare(vectors, dimension)
    return usable.groupBy(*KEY).agg(
        F.max_by(F.struct(*rest), order).alias("_v")).select(*KEY, "_v.*")


def _matrix(column):
    return np.vstack(column.to_numpy()).astype("float64")


def _block_matches(queries, vectors, k, threshold):
    """Best k vectors of this block per query; ties go to the smaller key."""
    vectors = vectors.sort_values(KEY, kind="stable").reset_index(drop=True)
    size, step = len(vectors), max(1, _PRODUCT_CELLS // max(1, len(vectors)))
    units, projects = _matrix(vectors["embedding"]), vectors["project"].to_numpy()
    out = []
    for start in range(0, len(queries), step):
        part = queries.iloc[start:start + step]
        wanted = part["project"].to_numpy()
        everywhere = part["project"].isna().to_numpy()
        scores = np.rint((_matrix(part["embedding"]) @ units.T) * 10**DIGITS).astype("int64")
        allowed = everywhere[:, None] | (wanted[:, None] == projects[None, :])
        if threshold is not None:
            allowed &= scores > round(threshold * 10**DIGITS)
        # One integer orders by score first and by key second, so it has no ties.
        rank = np.where(allowed, scores * size + np.arange(size)[::-1], np.iinfo("int64").min)
        kept = min(k, size)
        best = np.argpartition(rank, size - kept, axis=1)[:, size - kept:]
        row = np.repeat(np.arange(len(part)), kept)
        hit = best.ravel()
        ok = allowed[row, hit]
        row, hit = row[ok], hit[ok]
        out.append(pd.DataFrame({
            "query_id": part["query_id"].to_numpy()[row],
            "project": projects[hit],
            "name": vectors["name"].to_numpy()[hit],
            "similarity": scores[row, hit] / 10**DIGITS,
        }))
    return pd.concat(out) if out else None


def _best(parts, k):
    """Best k rows per query of several blocks of one task."""
    rows = pd.concat(parts).sort_values(
        ["query_id", "similarity", *KEY], ascending=[True, False, True, True])
    return rows.groupby("query_id").head(k)


def knn(queries: DataFrame, vectors: DataFrame, k, threshold=None,
        block_rows=BLOCK_ROWS, sent_bytes=SENT_QUERY_BYTES) -> DataFrame:
    """k best (project, name, similarity) per query, exactly.

    ``queries``: query_id, project (null = all projects), embedding; both sides
    as ``vector_prepare`` leaves them. Order: similarity, then project and name.
    """
    queries = cut_lineage(queries.select("query_id", "project", "embedding"), "queries")
    vectors = vectors.select(*KEY, "embedding")
    size = queries.agg(
        F.count("*").alias("rows"), F.sum(F.size("embedding") * 8).alias("bytes")).first()
    if (size["bytes"] or 0) <= sent_bytes:
        matches = _send_queries(queries, vectors, k, threshold)
    else:
        matches = _grid(queries, vectors, k, threshold, size["rows"], block_rows)
    return top_k(matches, k)


def top_k(matches: DataFrame, k, by=("query_id",)) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("similarity"), *KEY)
    return matches.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _send_queries(queries, vectors, k, threshold):
    spark = queries.sparkSession
    sent = spark.sparkContext.broadcast(queries.toPandas())  # at most ``sent_bytes``

    def match(batches):
        asked = sent.value
        kept, held = [], 0
        for batch in batches:
            if len(batch) and len(asked):
                kept.append(_block_matches(asked, batch, k, threshold))
                held += len(kept[-1])
            if held > MERGE_ROWS + 2 * k * len(asked):
                kept = [_best(kept, k)]
                held = len(kept[0])
        if kept:
            yield _best(kept, k)

    return vectors.mapInPandas(match, MATCHES)


def _grid(queries, vectors, k, threshold, query_rows, block_rows):
    bins = max(1, -(-vectors.count() // block_rows))
    query_blocks = max(1, -(-query_rows // QUERY_BLOCK_ROWS))
    # A project takes as many neighbouring bins as its rows need.
    spread = cut_lineage(vectors.groupBy("project").agg(
        F.least(F.ceil(F.count("*") / block_rows), F.lit(bins)).cast("int").alias("_parts")),
        "spread")

    def bin_of(part):
        return F.pmod(F.xxhash64("project") + part, F.lit(bins)).cast("int")

    placed = (
        vectors.join(spread, "project")
        .withColumn("bin", bin_of(F.pmod(F.xxhash64("name"), F.col("_parts"))))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
        .drop("_parts")
    )
    asked = queries.withColumn(
        "block", F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).cast("int"))
    in_project = (
        asked.where("project is not null").join(spread, "project")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
        .withColumn("bin", bin_of(F.col("_part"))).drop("_part", "_parts")
    )
    in_all = asked.where("project is null").withColumn(
        "bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))

    def match(queries, vectors):
        found = None
        if len(queries) and len(vectors):
            found = _block_matches(queries, vectors, k, threshold)
        if found is None:
            found = pd.DataFrame(columns=["query_id", *KEY, "similarity"])
        return found

    return (
        in_project.unionByName(in_all).groupBy("bin", "block")
        .cogroup(placed.groupBy("bin", "block")).applyInPandas(match, MATCHES)
    )


# ---- near duplicates ---------------------------------------------------------

PAIRS = ("project_a string, name_a string, project_b string, name_b string, "
         "similarity double")


def near_duplicate_pairs(vectors: DataFrame, threshold, pivots=None,
                         block_rows=BLOCK_ROWS) -> DataFrame:
    """Pairs of a project whose cosine reaches ``threshold``, a before b.

    Equal vectors are folded first: each copy is paired with the first of its
    group, and only the firsts are compared. They lie in the cell of the centre c
    with the largest product. With x in the cell of h and y in that of c,
    (x - y)(h - c) is at least xh - xc, so a pair no further apart than e needs
    xh - xc <= e |h - c|: x also visits those cells of higher number, every pair is
    met exactly once, and none is missed. Cells are cut into blocks that meet in
    a grid, one centre per block of rows up to a fixed number. In a block the
    products of the leading coordinates come first, and only pairs that reach the
    threshold with the norms of their other coordinates are multiplied out.
    """
    vectors = vectors.select(*KEY, "embedding")
    firsts = cut_lineage(vectors.groupBy("project", "embedding").agg(
        F.min("name").alias("first_name")), "firsts")
    copies = (
        vectors.join(firsts, ["project", "embedding"]).where("name <> first_name")
        .select(F.col("project").alias("project_a"), F.col("first_name").alias("name_a"),
                F.col("project").alias("project_b"), F.col("name").alias("name_b"),
                F.lit(1.0).alias("similarity"))
    )
    distinct = firsts.select("project", F.col("first_name").alias("name"), "embedding")
    return copies.unionByName(_close_pairs(distinct, threshold, pivots, block_rows))


def _centres(units, count):
    """``count`` centres at most, and the coordinates in falling order of their energy.

    Any centres give the right pairs. These follow the data: a few rounds of means on a
    sample of fixed size per centre, the rows with the smallest hashes.
    """
    rows = units.orderBy(F.xxhash64("name", "project")).limit(
        count * SAMPLE_PER_PIVOT).select("embedding").collect()
    if not rows:
        return None, None
    sample = np.array([r[0] for r in rows], dtype="float64")
    centres = sample[:count].copy()
    for _ in range(SAMPLE_ROUNDS):
        home = (sample @ centres.T).argmax(axis=1)
        for c in np.unique(home):
            mean = sample[home == c].mean(axis=0)
            norm = np.linalg.norm(mean)
            if norm > 0:
                centres[c] = mean / norm
    return centres, np.argsort(-(sample ** 2).sum(axis=0), kind="stable")


def placed_vectors(units, centres, threshold) -> DataFrame:
    """Units with ``home``, the number of their cell, and ``visits``, the others they enter."""
    spark = units.sparkSession
    centres = spark.sparkContext.broadcast(centres)
    # Similarities are rounded, so allow for half a digit more.
    reach = float(np.sqrt(max(0.0, 2 - 2 * (threshold - 10.0 ** -DIGITS))))

    def place(batches):
        c = centres.value
        apart = np.sqrt(np.maximum(0, (c ** 2).sum(1)[:, None] + (c ** 2).sum(1) - 2 * c @ c.T))
        for batch in batches:
            if not len(batch):
                continue
            product = _matrix(batch["embedding"]) @ c.T
            home = product.argmax(axis=1)
            less = product[np.arange(len(batch)), home][:, None] - product
            near = less <= reach * apart[home] + 1e-9
            near &= np.arange(len(c))[None, :] > home[:, None]
            batch["home"] = home.astype("int32")
            batch["visits"] = [np.flatnonzero(r).astype("int32") for r in near]
            yield batch

    return units.mapInPandas(
        place, "project string, name string, embedding array<double>, home int, visits array<int>")


def _close_pairs(units, threshold, pivots, block_rows):
    if pivots is None:
        pivots = min(MAX_PIVOTS, max(1, units.count() // block_rows))
    centres, order = _centres(units, pivots)
    if centres is None:
        return units.sparkSession.createDataFrame([], PAIRS)

    # Written once: the vectors are read from here by every step below.
    placed = cut_lineage(placed_vectors(units, centres, threshold), "placed")
    sizes = placed.groupBy("project", "home").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("parts"))
    sized = placed.join(sizes, ["project", "home"]).withColumn(
        "part", F.pmod(F.xxhash64("name"), F.col("parts")).cast("int"))
    # Residents of block p of a cell meet blocks p.. of that cell; visitors meet all.
    residents = sized.select(
        "project", F.col("home").alias("cell"), F.col("part").alias("block"),
        "name", "embedding", F.lit(True).alias("resident"), F.col("part").alias("from_part"))
    inside = sized.where("part < parts - 1").select(
        "project", F.col("home").alias("cell"),
        F.explode(F.sequence(F.col("part") + 1, F.col("parts") - 1)).alias("block"),
        "name", "embedding", F.lit(False).alias("resident"), F.col("part").alias("from_part"))
    visits = placed.select(
        "project", "name", "embedding", F.explode("visits").alias("cell"))
    # Guests of one cell can outnumber it, so they are cut into groups as well.
    guest_groups = visits.groupBy("project", "cell").agg(
        F.ceil(F.count("*") / block_rows).cast("int").alias("groups"))
    guests = (
        visits.join(sizes.withColumnRenamed("home", "cell"), ["project", "cell"])
        .join(guest_groups, ["project", "cell"])
        .select("project", "cell",
                F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("block"),
                "name", "embedding", F.lit(False).alias("resident"),
                F.pmod(F.xxhash64("name"), F.col("groups")).cast("int").alias("from_part"))
    )
    lower = F.lit(threshold)

    def residents_pairs(group):
        return _pairs(group, group, threshold, order, same=True)

    def guest_pairs(left, right):
        return _pairs(left, right, threshold, order, same=False)

    at = ["project", "cell", "block"]
    own = residents.groupBy(*at).applyInPandas(residents_pairs, PAIRS)
    visiting = inside.withColumn("kind", F.lit("inside")).unionByName(
        guests.withColumn("kind", F.lit("guest")))
    visitors = visiting.groupBy(*at, "kind", "from_part")
    # Residents are repeated once per visiting group that really occurs.
    groups = visiting.select(*at, "kind", "from_part").distinct().withColumnRenamed(
        "from_part", "visitor")
    hosts = residents.drop("from_part").join(groups, at)
    hosts = hosts.toDF(*hosts.columns).groupBy(*at, "kind", "visitor")
    across = visitors.cogroup(hosts).applyInPandas(guest_pairs, PAIRS)
    return own.unionByName(across).where(F.col("similarity") >= lower)


def close_scores(a, b, threshold, order):
    """(i, j, rounded product) of the rows of two unit matrices that reach the threshold.

    By Cauchy and Schwarz a product is at most that of the leading coordinates plus the
    product of the norms of the rest; where few pairs pass this, only they are multiplied out.
    """
    lead, rest = order[:len(order) // LEADING_SHARE], order[len(order) // LEADING_SHARE:]
    most = a[:, lead] @ b[:, lead].T + np.linalg.norm(a[:, rest], axis=1)[:, None] * \
        np.linalg.norm(b[:, rest], axis=1)[None, :]
    i, j = np.nonzero(most >= threshold - 10.0 ** -DIGITS)
    if len(i) > most.size // 8:
        scores = np.rint(a @ b.T * 10**DIGITS) / 10**DIGITS
        i, j = np.nonzero(scores >= threshold)
        return i, j, scores[i, j]
    scores = np.zeros(len(i))
    for at in range(0, len(i), 65536):
        part = slice(at, at + 65536)
        scores[part] = np.einsum("rd,rd->r", a[i[part]], b[j[part]])
    scores = np.rint(scores * 10**DIGITS) / 10**DIGITS
    close = scores >= threshold
    return i[close], j[close], scores[close]


def _pairs(left, right, threshold, order, same):
    out = []
    if len(left) and len(right):
        a, b = _matrix(left["embedding"]), _matrix(right["embedding"])
        names_a, names_b = left["name"].to_numpy(), right["name"].to_numpy()
        step = max(1, _PRODUCT_CELLS // len(b))
        for start in range(0, len(a), step):
            i, j, scores = close_scores(a[start:start + step], b, threshold, order)
            if same:
                once = j > start + i
                i, j, scores = i[once], j[once], scores[once]
            first, second = names_a[start + i], names_b[j]
            swap = first > second
            out.append(pd.DataFrame({
                "project_a": left["project"].iloc[0],
                "name_a": np.where(swap, second, first),
                "project_b": left["project"].iloc[0],
                "name_b": np.where(swap, first, second),
                "similarity": scores,
            }))
    return pd.concat(out) if out else pd.DataFrame(
        columns=["project_a", "name_a", "project_b", "name_b", "similarity"])
