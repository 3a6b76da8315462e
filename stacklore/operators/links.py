"""Connected groups of linked values."""

from pyspark.sql import DataFrame, functions as F

from stacklore.session import cut_lineage


def connected(links: DataFrame, rounds=60) -> DataFrame:
    """One row (node, group) for each number in ``links`` (a, b); the group is its least node.

    Every round each group goes to the least group beside it, and from there on to where that
    one and the next go, so whole chains of groups merge and their number falls by a factor.
    All joins meet one row per node or group; a node that many links share is summed up in
    each task first and split by the skew join.
    """
    pairs = links.select("a", "b").distinct()
    both = cut_lineage(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))),
                       "links")
    groups = cut_lineage(both.groupBy(F.col("a").alias("node")).agg(
        F.least(F.min("b"), F.col("node")).alias("group")), "groups")
    for _ in range(rounds):
        near = both.join(groups.withColumnRenamed("node", "b"), "b").groupBy(
            F.col("a").alias("node")).agg(F.min("group").alias("near"))
        goes = cut_lineage(groups.join(near, "node").groupBy("group").agg(
            F.least("group", F.min("near")).alias("to")), "goes")
        if goes.where("to <> group").isEmpty():
            return groups
        for _ in range(2):
            # A group that has no row here is named by a node of another group's.
            further = goes.select(F.col("group").alias("to"), F.col("to").alias("far"))
            goes = goes.join(further, "to", "left").select("group", F.coalesce("far", "to").alias("to"))
        groups = cut_lineage(groups.join(goes, "group").select(
            "node", F.col("to").alias("group")), "groups")
    raise RuntimeError("the groups did not settle")
