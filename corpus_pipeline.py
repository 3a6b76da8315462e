"""From raw documents to shards: rules, near duplicates, benchmark passages, mixing, shards.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept.
All but the last return the columns of ``documents``; ``run`` writes each stage as Parquet
below spark.checkpoint.dir and reads it again, so a lost executor costs one stage at most.
"""

from pyspark.sql import functions as F

from stacklore.llm import decontamination, mixing, near_dedup, rules, sharding
from stacklore.llm.common import table
from stacklore.session import cut_lineage


def quality_rules(spark, docs, sf_dir):
    """Documents that the policy keeps."""
    return rules.passed(docs)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group that shares 80 % of its five-word shingles, smallest id first."""
    copies = near_dedup.near_duplicates(docs, threshold=80, shingle=5).filter(~F.col("kept")).select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def benchmark_passages(spark, docs, sf_dir):
    """Documents that hold no passage of the benchmark."""
    leaks = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(docs.columns)


def source_mix(spark, docs, sf_dir):
    """Every row as many times as the mix takes it, chances by size.

    Rows are numbered and written first, as ids may be null or shared and columns may have
    any name.
    """
    rows = cut_lineage(docs.select(F.struct("*").alias("doc"),
                                   F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    taken = mixing.mix(rows.select("doc.doc_id", "doc.source", "doc.text", "row"),
                       by_size=True, row="row").filter("copies > 0")
    met = rows.join(taken.select("row", F.col("copies").cast("int").alias("copies")), "row")
    return met.select("doc", F.explode(F.sequence(F.lit(1), "copies"))).select("doc.*")


def shards(spark, docs, sf_dir):
    """The shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("source_mix", source_mix),
    ("shards", shards),
]

# Near duplicates and spaced seeds have no SQL; the tests hold brute-force versions.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
