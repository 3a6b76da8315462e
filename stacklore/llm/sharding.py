"""Sharding by balanced label propagation over linked documents.

Documents that share a link key (here: equal texts) are neighbours. Every document starts
in a shard by hash. Links larger than a shard are cut into the fewest pieces, whole shards
and a rest. Then shards are planned by size alone, the largest links first (``_plan``): how
many links of a size every shard takes, up to its exact quota. In each round a link prefers,
among the shards that have places for its size, the one that holds most of it, its members
move there, and where more want to enter than there are places, the others go on to the
next round. It ends when no place is left. A link is left over only if no shard had room
for it when its size was planned, so fewer links than shards are; these fill the rooms that
remain. Documents without links fill the gaps, so row counts differ by one at most.

All joins carry narrow rows, hot keys are broadcast (``join_hot``), and ranks are made in
buckets (``ranked``). The driver gets the loads of the shards, the links larger than a shard
and those left over (each fewer than shards) and the number of links of every size: of N
rows, the square root of 2 N sizes at most.

Cases: null texts have size 1, text_crc32 0 and no link; empty texts are equal texts.
Repeated rows are rows of their own, told apart by their place in the written table. Rows
without id are placed like others. Other columns are ignored. An empty table gives an
empty result.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore.llm.common import join_hot, ranked, typed
from stacklore.session import cut_lineage

SHARDS = 8


def _prepared(docs):
    text = F.coalesce("text", F.lit(""))
    return cut_lineage(typed(docs, "doc_id", "text").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2("text", 256).alias("link"), F.xxhash64("doc_id").alias("h"),
        F.monotonically_increasing_id().alias("row_id")), "shard-rows")


def _loads(rows, shards):
    found = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
    return [found.get(s, 0) for s in range(shards)]


def _spread(room, n, count):
    """Units of size n for every shard, so that the rooms left are as even as can be."""
    if count >= sum(r // n for r in room):
        return [r // n for r in room]
    low, high = 0, max(room)
    while low < high:
        level = (low + high) // 2
        if sum(max(0, (r - level) // n) for r in room) <= count:
            high = level
        else:
            low = level + 1
    give = [max(0, (r - low) // n) for r in room]
    for _ in range(count - sum(give)):
        s = max(range(len(room)), key=lambda s: room[s] - give[s] * n)
        give[s] += 1
    return give


def _tight(room, n, count):
    """Units of size n for every shard, the least room that fits first."""
    give = [0] * len(room)
    for s in sorted(range(len(room)), key=lambda s: room[s]):
        give[s] = min(count - sum(give), room[s] // n)
    return give


def _plan(counts, quotas):
    """{size: units for every shard} and the rooms left; the way that leaves fewer rows over."""
    plans = []
    for way in (_spread, _tight):
        room, plan = list(quotas), {}
        for n in sorted(counts, reverse=True):
            plan[n] = way(room, n, counts[n])
            room = [r - k * n for r, k in zip(room, plan[n])]
        plans.append((plan, room))
    return min(plans, key=lambda x: sum(x[1]))


def _cuts(sizes, quotas):
    """(link, k, first, end): pieces of the links larger than a shard, whole shards first."""
    cuts, shard = [], 0
    for link, n in sizes:
        first, k = 0, 0
        while n - first > quotas[shard]:
            cuts.append((link, k, first, first + quotas[shard]))
            first, k, shard = first + quotas[shard], k + 1, shard + 1
        cuts.append((link, k, first, n))
    return cuts


def _fill(sizes, room):
    """(unit, shard, first, end): what is left over fills the rooms, the largest first."""
    room, parts = list(room), []
    for unit, n in sizes:
        first = 0
        while first < n:
            s = max(range(len(room)), key=lambda s: room[s])
            end = min(n, first + room[s])
            parts.append((unit, s, first, end))
            room[s] -= end - first
            first = end
    return parts


def _parts(rows, key, cuts, column, total):
    """The rows of the keys in ``cuts`` with the value of the part they fall into."""
    spark = rows.sparkSession
    cuts = spark.createDataFrame(cuts, f"_key string, {column} int, _first long, _end long")
    few = rows.join(F.broadcast(cuts.select(F.col("_key").alias(key)).distinct()), key)
    few = ranked(few.withColumn("_by", F.xxhash64("h", "row_id")), key, ["_by", "h", "row_id"],
                 total, name="_at").drop("_by")
    return few.join(F.broadcast(cuts), (F.col(key) == F.col("_key")) & (
        F.col("_at") >= F.col("_first")) & (F.col("_at") < F.col("_end"))).drop(
        "_key", "_first", "_end", "_at")


def _propagate(linked, quotas):
    """(unit, home, n) of the units that settle whole, (unit, n) of the others, rooms left.

    ``linked`` has unit and shard of every linked row. A unit needs one row: its count by
    shard. Every round fills the places of a size in a shard that was wanted by too many, so
    there are as many rounds as shards at most.
    """
    shards, spark = len(quotas), linked.sparkSession
    here = [F.coalesce(F.sum(F.when(F.col("shard") == s, 1)), F.lit(0)).cast("long").alias(f"s{s}")
            for s in range(shards)]
    units = cut_lineage(linked.groupBy("unit").agg(
        F.count("*").alias("n"), *here), "shard-units")
    counts = {r["n"]: r["units"] for r in
              units.groupBy("n").agg(F.count("*").alias("units")).collect()}
    plan, room = _plan(counts, quotas)
    total = sum(counts.values())
    homes = spark.createDataFrame([], "unit string, home int, n long")
    names = [f"s{s}" for s in range(shards)]
    while any(any(places) for places in plan.values()):
        places = spark.createDataFrame(
            [(n, list(p)) for n, p in plan.items() if any(p)], "n long, places array<long>")
        best = F.array_max(F.array(*[F.when(F.get("places", F.lit(s)) > 0, F.struct(
            F.col(f"s{s}").alias("here"),
            F.pmod(F.xxhash64("unit", F.lit(s)), F.lit(1 << 20)).alias("tie"),
            F.lit(s).alias("shard"))) for s in range(shards)]))
        wish = units.join(F.broadcast(places), "n", "left").withColumn("to", best["shard"])
        wish = cut_lineage(wish.select(
            "unit", "n", *names, "to", F.xxhash64("unit").alias("by"),
            F.get("places", F.col("to")).alias("free"),
            F.coalesce(F.col("n") * shards + F.col("to"), F.lit(-1)).alias("part")), "shard-wishes")
        asked = wish.filter("to IS NOT NULL").groupBy("n", "to").agg(F.count("*").alias("k")).collect()
        turn = cut_lineage(ranked(wish, "part", ["by", "unit"], total, name="turn").withColumn(
            "enters", F.coalesce(F.col("turn") < F.col("free"), F.lit(False))), "shard-turns")
        homes = homes.unionByName(turn.filter("enters").select(
            "unit", F.col("to").alias("home"), "n"))
        units = turn.filter("NOT enters").select("unit", "n", *names)
        for r in asked:
            plan[r["n"]][r["to"]] -= min(r["k"], plan[r["n"]][r["to"]])
    return homes, units.select("unit", "n"), room


def shard(docs, shards=SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard for every row."""
    rows = _prepared(docs)
    total = rows.count()
    base, extra = divmod(total, shards)
    quotas = [base + (s < extra) for s in range(shards)]
    groups = cut_lineage(rows.filter("link IS NOT NULL").groupBy("link").agg(
        F.count("*").alias("n")).filter("n > 1"), "shard-links")
    narrow = ["row_id", "h", F.pmod("h", F.lit(shards)).cast("int").alias("shard")]
    linked = join_hot(rows, groups.filter(F.col("n") <= quotas[0]), "link").select(
        *narrow, F.col("link").alias("unit"))
    large = [(r["link"], r["n"]) for r in groups.filter(F.col("n") > quotas[0]).orderBy(
        F.desc("n"), "link").collect()]
    if large:
        pieces = _parts(rows, "link", _cuts(large, quotas), "k", total)
        linked = linked.unionByName(pieces.select(
            *narrow, F.concat_ws("/", "link", "k").alias("unit")))
    linked = cut_lineage(linked, "shard-linked")
    homes, rest, room = _propagate(linked, quotas)
    homes = cut_lineage(homes, "shard-homes")
    # Rows of one unit are dealt over the order of the shard: no window holds a whole unit.
    by = F.xxhash64("unit", "h").alias("by")
    placed = join_hot(linked, homes, "unit").select("row_id", "home", by)
    rest = [(r["unit"], r["n"]) for r in rest.orderBy(F.desc("n"), "unit").collect()]
    if rest:
        placed = placed.unionByName(_parts(linked, "unit", _fill(rest, room), "home", total).select(
            "row_id", "home", by))
    rows = rows.join(placed, "row_id", "left").withColumn("linked", F.col("home").isNotNull())
    # Linked rows come first in the order of a shard and fit its quota, so only others overflow.
    rows = rows.select(
        "doc_id", "size", "text_crc32", "row_id", "h",
        F.coalesce("home", F.pmod("h", F.lit(shards)).cast("int")).alias("home"),
        F.when(F.col("linked"), F.shiftrightunsigned("by", 2) - F.lit(2 ** 62)).otherwise(
            F.shiftrightunsigned("h", 2)).alias("by"))
    rows = cut_lineage(ranked(rows, "home", ["by", "h", "row_id"], total, name="place"),
                       "shard-places")
    counts = _loads(rows.select(F.col("home").alias("shard"), F.lit(1).alias("n")), shards)
    quota_of = F.element_at(F.array(*[F.lit(q) for q in quotas]), F.col("home") + 1)
    over = F.col("place") >= quota_of
    spilled = ranked(rows.filter(over).withColumn("all", F.lit(0)).drop("place"), "all",
                     ["by", "h", "row_id"], total, name="spill").drop("all")
    # The k-th spilled row takes the k-th free place, shard by shard.
    to, slot, first = F.lit(None).cast("int"), F.lit(None).cast("long"), 0
    for s in range(shards):
        free = max(0, quotas[s] - counts[s])
        inside = (F.col("spill") >= first) & (F.col("spill") < first + free)
        to = F.when(inside, F.lit(s)).otherwise(to)
        slot = F.when(inside, F.col("spill") - first + counts[s]).otherwise(slot)
        first += free
    keep = ["doc_id", "size", "text_crc32"]
    done = rows.filter(~over).select(*keep, F.col("home").cast("int").alias("shard"),
                                     F.col("place").cast("long").alias("slot")).unionByName(
        spilled.select(*keep, to.alias("shard"), slot.cast("long").alias("slot")))
    return done.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
