"""Mixing sources to target weights by Pareto order sampling.

Sources share ``budget`` times all words by weight, but none gets more than ``most`` times
its own size; the excess goes to the others by weight (``targets``). A source whose target
is at least its size first gives every document as many certain whole copies as fit. The
rest of the target is a sample of one more copy. Every document has a chance of inclusion:
its measure (the column ``appeal``, or its words with ``by_size``) times the level of its
source, at which the expected words of the sample are the words still wanted. Where that
reaches 1 the copy is certain, and the level of the others rises to the words then left.
Every other document draws a random number u from its id, the odds of u divided by the odds
of its chance rank the documents, and they are taken in that order until the words still
wanted are reached. Without a measure all documents of a source have the same chance, the
share of the source that is wanted, and the order is that of u.

Ranks fall into buckets of a known range, sums of buckets give every bucket the words
before it, and only the bucket in which the target is reached is ordered row by row; no
source is sorted as a whole. The draw depends on the id and the seed alone, so reruns agree.

Cases: a null or empty text has size 0, gets the whole copies of its source and is taken 0
words. A null source is a source of
its own, last in order. Rows that share an id (or have none) draw the same number and are
ordered by size. A source without words has target 0. Measures count as 1e-9 at least
(null ones too) and 1e12 at most. Other columns are ignored. An empty table gives an empty
result.
"""

from pyspark.sql import DataFrame, Window, functions as F

from stacklore.llm.common import WORD, join_hot
from stacklore.session import cut_lineage

WEIGHTS = (5, 2, 1)
BUDGET, MOST = 1.5, 2.0
SEED = "mix-1"
PER_BUCKET = 5_000


def sized(docs, row=None) -> DataFrame:
    """doc_id, source, appeal and size, the number of words; ``row`` too if it is named."""
    appeal = F.col("appeal").cast("double") if "appeal" in docs.columns else F.lit(1.0)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"), appeal.alias("appeal"),
        F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *[F.col(c).alias("row") for c in [row] if c])


def targets(sizes, weights=WEIGHTS, budget=BUDGET, most=MOST) -> DataFrame:
    """source, source_size, n_docs and target; one row per source.

    The level at which sources stop at their cap is found on the sources in order of cap
    over weight: those before the level are capped, the others share what is left. The
    windows run over one row per source, not over documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"),
                                      F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("_turn", F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("_turn") + 1)
    per = per.withColumn("weight", weight).withColumn("_cap", F.lit(most) * F.col("source_size"))
    everything = Window.partitionBy()
    level = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = level.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn(
        "_left", F.lit(budget) * F.sum("source_size").over(everything)
        - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))).withColumn(
        "_weights", F.sum("weight").over(everything)
        - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    share = F.col("_left") / F.col("_weights")
    # The first source whose share is below its cap sets the level for all after it.
    per = per.withColumn("_open", F.when(share * F.col("weight") <= F.col("_cap"), share))
    per = per.withColumn("_level", F.first("_open", ignorenulls=True).over(
        level.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    target = F.least("_cap", F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return per.select("source", "source_size", "n_docs", target.alias("target"))


def _levels(rows):
    """_s, _level and _sure of every source with words to sample.

    The chance of a document is its appeal times the level; _sure has the words of those at 1.
    Levels only rise, so certain documents stay certain, and the rounds end when none is new.
    """
    mass = cut_lineage(rows.filter("size > 0 AND _rest > 0").groupBy("source", "appeal").agg(
        F.sum("size").alias("words"), F.first("_rest").alias("_rest")), "mix-mass")
    levels = cut_lineage(mass.groupBy(F.col("source").alias("_s")).agg(
        (F.first("_rest") / F.sum(F.col("appeal") * F.col("words"))).alias("_level"),
        F.lit(0).cast("long").alias("_sure")), "mix-levels")
    while True:
        sure = F.col("appeal") * F.col("_level") >= 1
        sums = mass.join(levels, F.col("source").eqNullSafe(F.col("_s"))).groupBy("_s").agg(
            F.first("_level").alias("_old"), F.first("_sure").alias("_was"),
            F.first("_rest").alias("_rest"),
            F.coalesce(F.sum(F.when(sure, F.col("words"))), F.lit(0)).alias("_sure"),
            F.sum(F.when(~sure, F.col("appeal") * F.col("words"))).alias("_open"))
        levels = cut_lineage(sums.select("_s", F.greatest("_old", (
            F.col("_rest") - F.col("_sure")) / F.col("_open")).alias("_level"), "_sure",
            (F.col("_sure") > F.col("_was")).alias("_new")), "mix-levels")
        if levels.filter("_new").isEmpty():
            return levels.drop("_new")


def chances(rows, equal):
    """``rows`` with _chance, _certain (whether it is 1) and _rest less the certain words."""
    if equal:
        return rows.withColumn("_chance", F.when(
            F.col("source_size") > 0, F.col("_rest") / F.col("source_size"))).withColumn(
            "_certain", F.lit(False))
    met = rows.join(_levels(rows), F.col("source").eqNullSafe(F.col("_s")), "left")
    # A source with nothing left to sample has no level, and its documents no chance.
    return met.withColumn("_chance", F.least(F.lit(1.0), F.coalesce(
        F.col("appeal") * F.col("_level"), F.lit(0.0)))).withColumn("_certain", F.col("_chance") >= 1
                          ).withColumn("_rest", F.col("_rest") - F.coalesce("_sure", F.lit(0))
                          ).drop("_s", "_level", "_sure")


def mix(docs, weights=WEIGHTS, budget=BUDGET, most=MOST, seed=SEED, by_size=False,
        row=None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken for every row.

    ``row`` names a column that numbers the rows, which the result then has as ``row``:
    ids may be null or shared, so they don't tell which row has how many copies.
    """
    equal = not by_size and "appeal" not in docs.columns
    sizes = sized(docs, row)
    measure = F.col("size").cast("double") if by_size else F.col("appeal")
    sizes = cut_lineage(sizes.withColumn("appeal", F.least(F.greatest(
        measure, F.lit(1e-9)), F.lit(1e12))), "mix-sizes")
    per = cut_lineage(targets(sizes, weights, budget, most), "mix-targets")
    digits = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(
        F.col("doc_id").cast("string"), F.lit("none")))), 1, 12), 16, 10)
    u = (digits.cast("double") + 0.5) / F.lit(float(2 ** 48))
    rows = _with_source(sizes, per)
    rows = rows.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(
        F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    rows = rows.withColumn("_rest", F.col("target") - F.col("_whole") * F.col("source_size"))
    if not equal:
        rows = cut_lineage(rows, "mix-wanted")
    rows = chances(rows, equal)
    # Odds of u over odds of inclusion. The last document taken has about 1, where no more
    # rows lie close together than there are documents, so its bucket is never a large one.
    rows = rows.withColumn("_odds", u / (1 - u) * F.when(
        (F.col("_chance") > 0) & (F.col("_chance") < 1),
        (1 - F.col("_chance")) / F.col("_chance")).otherwise(1.0))
    place = F.col("_odds") / (1 + F.col("_odds"))
    rows = rows.withColumn("_bucket", F.floor(
        place * F.ceil(F.col("n_docs") / PER_BUCKET)).cast("long"))
    rows = cut_lineage(rows, "mix-ranked")
    # Certain documents, and those without words, take no place in the order.
    settled = rows.filter("_certain OR size = 0").withColumn(
        "_more", (F.col("_certain") & (F.col("size") > 0)).cast("long"))
    rows = rows.filter("NOT _certain AND size > 0")
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    sums = rows.groupBy("source", "_bucket").agg(
        F.sum("size").alias("_words"), F.count("*").alias("n")).withColumn(
        "_before", F.coalesce(F.sum("_words").over(before), F.lit(0)))
    sums = cut_lineage(sums.select(F.col("source").alias("_s"), F.col("_bucket").alias("_b"),
                                   "_words", "_before"), "mix-sums")
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("_s"))
                     & (F.col("_bucket") == F.col("_b")))
    inside = Window.partitionBy("source", "_bucket").orderBy(
        "_odds", "doc_id", "size", *["row"] * bool(row)).rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    at = rows.filter((F.col("_before") <= F.col("_rest"))
                     & (F.col("_before") + F.col("_words") > F.col("_rest"))).withColumn(
        "_more", (ahead + F.col("size") / 2 <= F.col("_rest")).cast("long"))
    apart = rows.filter(~((F.col("_before") <= F.col("_rest"))
                          & (F.col("_before") + F.col("_words") > F.col("_rest")))).withColumn(
        "_more", (F.col("_before") + F.col("_words") <= F.col("_rest")).cast("long"))
    done = apart.unionByName(at).unionByName(settled, allowMissingColumns=True).withColumn(
        "copies", F.col("_whole") + F.col("_more"))
    return done.select("doc_id", "source", "size", "source_size", "target", "copies",
                       (F.col("copies") * F.col("size")).alias("taken"),
                       *["row"] * bool(row))


def _with_source(sizes, per):
    """Every row with its source's sums; a source may hold any share of the rows."""
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("null"))
    many = cut_lineage(sizes.withColumn("_key", key), "mix-keyed")
    one = cut_lineage(per.withColumn("_key", key).withColumn("n", F.col("n_docs")).drop("source"),
                      "mix-sources")
    return join_hot(many, one, "_key").drop("_key")
