"""Rows that the test tables do not hold: odd replies, untested drafts, assets without evaluations."""

from pyspark.sql import functions as F

from stacklore.functions import replies
from stacklore.operators import catalogue, scoring
from stacklore.operators.embedding import text_embedding
from stacklore.sources.mirror import json_decode


def test_replies_hold_whole_json(spark):
    rows = [
        ('ok {"score": 3} and {x}', None),
        ('{"score": 55} {"score": 90}', None),
        ('Sure: {"score": 7} done', 7),
        ('[{"score": 7}, {"score": 9}]', 7),
        ('```json\n[{"score": 8}, {"score": 9}]\n```', 8),
        ('```\n{"score": 4}\n```', 4),
        ("[1, 2]", None), ("", None), (None, None),
    ]
    df = spark.createDataFrame(rows, "reply string, expected int").withColumn(
        "json", replies.response_json("reply"))
    for r in df.withColumn("score", replies.score_coerce("json")).collect():
        assert (r["json"] is None) == (r["expected"] is None), r
        assert r["score"] == (r["expected"] or 0), r


def test_json_columns_keep_what_they_cannot_read(spark):
    df = spark.createDataFrame([('["a"] junk',), ('["a", "b"]',), ("[] ]",), (None,)], "tags string")
    got = [(r["tags"], r["tags_raw"]) for r in json_decode(df, "tags").collect()]
    assert got == [(None, '["a"] junk'), (["a", "b"], None), (None, "[] ]"), (None, None)]


def test_untested_drafts_are_parsed(spark):
    rows = [("a", "def f(s):\n    return eval(s)\n", "", "python", True),
            ("b", "def f(s):\n    return eval(s)\n", "", "python", False)]
    df = spark.createDataFrame(
        rows, "asset_id string, code string, test_code string, language string, is_draft boolean")
    got = {r["asset_id"]: r["security_static"] for r in scoring.code_scores(df).collect()}
    assert got["a"] == 60


def test_report_covers_unseen_assets(spark):
    gated = spark.createDataFrame(
        [(1, 40.0, "missing_tests"), (2, 90.0, "weighted")], "asset_id long, score double, stage string")
    seen = spark.createDataFrame(
        [(2, "runtime", 90.0, "fine", False)],
        "asset_id long, evaluator string, score double, reason string, is_system_error boolean")
    got = {r["asset_id"]: r for r in scoring.verification_report(gated, seen).collect()}
    assert got[1]["reason"] == "Unverified: no test code" and got[1]["details"] == {}
    assert got[2]["reason"] == "runtime: fine"


def test_weighted_gate_has_the_static_layer(spark):
    rows = [(1, "deterministic", 100.0), (1, "runtime", 100.0),
            (1, "security_static", 70.0), (1, "dependency_vouch", 70.0)]
    long = spark.createDataFrame(rows, "asset_id long, evaluator string, score double")
    assets = spark.createDataFrame([(1, "python")], "asset_id long, language string")
    assert scoring.weighted_gate(long, assets).select(F.round("score", 6)).first()[0] == 92.5


def test_embedding_reads_whole_texts(spark):
    rows = [(1, "same " * 5000 + "end"), (2, "same " * 5000 + "other"), (3, ""), (4, None)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {r["id"]: r["embedding"] for r in text_embedding(df, ["id"], F.col("text"), 64).collect()}
    assert got[1] != got[2] and set(got[3]) == set(got[4]) == {0.0}


def test_merge_takes_the_last_save_of_a_key(spark):
    kinds = "project string, name string, code_hash string, version int, call_count long"
    old = spark.createDataFrame([("p", "a", "h1", 1, 7), ("p", "b", "h2", 3, 0)], kinds)
    saves = spark.createDataFrame(
        [("p", "a", "h5", 1), ("p", "a", "h6", 2), ("p", "c", "h9", 3)],
        "project string, name string, code_hash string, seq long")
    current, history = catalogue.merge_upsert(old, saves)
    got = {r["name"]: (r["code_hash"], r["version"], r["call_count"], r["action"])
           for r in current.collect()}
    assert got == {"a": ("h6", 2, 7, "new_version"), "b": ("h2", 3, 0, "keep"),
                   "c": ("h9", 1, 0, "insert")}
    assert [(r["name"], r["code_hash"]) for r in history.collect()] == [("a", "h1")]
