"""Every way of mixing meets its targets, sources at their cap and odd ids included."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stacklore.llm import mixing

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, doc string"


def corpus(spark):
    """Sources by code point weigh 5, 2, 1, 5, 2, 1: small heavy ones stop at twice their size."""
    sizes = {"a": 40, "b": 300, "c": 900, "d": 25, "e": 200, None: 600}
    rows, k = [], 0
    for s, n in sizes.items():
        for i in range(n):
            k += 1
            words = 1 + (i * 7 + len(str(s))) % 23
            rows.append((k if i % 9 else [None, 77, k][i % 3], " ".join(["w"] * words), "en", s, 1, "r", "d"))
    rows += [(9001, "", "en", "a", 0, "r", "d"), (9002, None, "en", None, 0, "r", "d")]
    return spark.createDataFrame(rows, DOCS).repartition(4)


def by_source(rows):
    got = rows.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"),
        F.max("size").alias("longest"), F.first("source_size").alias("source_size"),
        F.max(F.when(F.col("size") > 0, F.col("copies"))).alias("most")).collect()
    return {r["source"]: r for r in got}


@pytest.mark.parametrize("way", ["plain", "size", "appeal"])
def test_each_source_is_within_a_document_of_its_target(spark, way):
    docs = corpus(spark)
    if way == "appeal":
        docs = docs.withColumn("appeal", F.when(F.col("doc_id") % 5 == 0, 50.0).otherwise(
            F.when(F.col("doc_id") % 5 == 1, F.lit(None).cast("double")).otherwise(1.0)))
    got = by_source(mixing.mix(docs, by_size=way == "size"))
    assert len(got) == 6
    capped = [s for s, r in got.items() if r["target"] == 2 * r["source_size"]]
    assert {"a", "d"} <= set(capped) and len(capped) < 6
    for r in got.values():
        assert r["most"] <= 2 and abs(r["taken"] - r["target"]) <= r["longest"], r
    assert sum(r["target"] for r in got.values()) == pytest.approx(
        1.5 * sum(r["source_size"] for r in got.values()))


def test_pipeline_stage_takes_rows_not_ids(spark):
    docs = corpus(spark)
    out = corpus_pipeline.source_mix(spark, docs, None)
    assert out.columns == docs.columns
    words = F.coalesce(F.regexp_count("text", F.lit(mixing.WORD)), F.lit(0))
    taken = {r["source"]: r["n"] for r in out.groupBy("source").agg(F.sum(words).alias("n")).collect()}
    want = by_source(mixing.mix(docs, by_size=True))
    for s, r in want.items():
        assert abs(taken[s] - r["target"]) <= r["longest"], (s, taken[s], r)
    again = corpus_pipeline.source_mix(spark, docs, None)
    assert sorted(map(str, out.collect())) == sorted(map(str, again.collect()))


def test_pipeline_stage_on_nothing(spark):
    assert corpus_pipeline.source_mix(spark, corpus(spark).limit(0), None).collect() == []
