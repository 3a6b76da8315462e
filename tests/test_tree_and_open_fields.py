"""One file per asset, and metadata fields of any name."""

import json
import os

import pytest
from pyspark.sql import functions as F

from stacklore.operators import scoring as S
from stacklore.sources import mirror, tree

ODD = ["plain", "_helper", ".hidden", "a/b", "../up", "per%cent", "a%2Fb", "c++ x", "", "ä" * 150,
       "ends.py", "q?*#", "line\nend", "back\\slash", "%"]


def assets(spark, names, code="x = 1\n"):
    return spark.createDataFrame(
        [("p a" if i % 2 else "_p", n, f"{code}{i}", "python" if i % 3 else "c/c++", i)
         for i, n in enumerate(names)],
        "project string, name string, code string, language string, version int")


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def test_odd_names_come_back(spark, tmp_path):
    rows = assets(spark, ODD)
    mirror.mirror_write_tree(rows.drop("version"), str(tmp_path))
    back = mirror.mirror_read_tree(spark, str(tmp_path))
    assert back.where("code_from_file").count() == len(ODD)
    key = ["project", "name", "code", "language"]
    assert sorted(back.select(*key).collect()) == sorted(rows.select(*key).collect())
    assert not any(f for _, d, f in os.walk(tmp_path / "staging"))
    assert {f for f in os.listdir(tmp_path) if not f.startswith(".")} <= {"projects", "staging"}
    assert (tmp_path / "projects" / "p a" / "functions" / "python" / "%5Fhelper.py").exists()


def test_files_are_for_people_and_are_replaced(spark, tmp_path):
    rows = spark.sql("""SELECT 'p' AS project, 'f' AS name, 'a = 1' AS code, 'python' AS language,
        array('t') AS tags, named_struct('os', 'linux') AS env_fingerprint, array(0.5) AS embedding,
        timestamp'2024-06-01 10:00:00.5' AS created_at, cast(null AS string) AS description""")
    mirror.mirror_write_tree(rows, str(tmp_path))
    meta = tmp_path / "projects/p/metadata/f.json"
    assert meta.read_text().count("\n") > 5
    assert json.loads(meta.read_text())["tags"] == ["t"]
    assert "embedding" not in json.loads(meta.read_text())
    back = mirror.mirror_read_tree(spark, str(tmp_path)).collect()[0]
    assert back["created_at"] == rows.collect()[0]["created_at"] and back["tags"] == ["t"]
    # A later save replaces both files; other assets stay; a null code leaves the old file.
    mirror.mirror_write_tree(rows.withColumn("code", F.lit("a = 2")), str(tmp_path))
    mirror.mirror_write_tree(rows.withColumn("name", F.lit("g")).withColumn(
        "code", F.lit(None).cast("string")), str(tmp_path))
    got = by_name(mirror.mirror_read_tree(spark, str(tmp_path)))
    assert got["f"]["code"] == "a = 2" and got["g"]["code"] is None
    assert not got["g"]["code_from_file"]


def test_repeated_keys_nulls_and_empty_tables(spark, tmp_path):
    rows = spark.createDataFrame(
        [("p", "f", "b", None), ("p", "f", "a", None), (None, "g", "c", None), ("p", None, "d", None)],
        "project string, name string, code string, language string")
    mirror.mirror_write_tree(rows.limit(0), str(tmp_path))
    assert not (tmp_path / "projects").exists()
    mirror.mirror_write_tree(rows, str(tmp_path))
    got = {(r["project"], r["name"], r["code"])
           for r in mirror.mirror_read_tree(spark, str(tmp_path)).collect()}
    assert got == {("p", "f", "b"), ("default", "g", "c"), ("p", "unknown", "d")}


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path):
    """Spark is given no file of the tree, so the driver holds none of their names."""
    rows = assets(spark, [f"n{i}" for i in range(60)])
    mirror.mirror_write_tree(rows, str(tmp_path))
    code = tmp_path / "projects/p a/functions/python"
    (code / "_n1.py").write_text("hidden"), (code / "deeper").mkdir()
    (code / "deeper/n1.py").write_text("not here"), (tmp_path / "projects/file").write_text("")
    (tmp_path / "projects/p a/metadata/note.txt").write_text("{}")
    (tmp_path / "projects/_p/metadata/n1.json").unlink(missing_ok=True)
    (code / "n1.py").write_bytes(b"\r\nlast line end \xc3\xa9\n")
    back = mirror.mirror_read_tree(spark, str(tmp_path))
    assert not [f for f in back.inputFiles() if "/projects/" in f]
    got = by_name(back)
    assert len(got) == back.count() == 60 and all(r["code_from_file"] for r in got.values())
    assert got["n1"]["code"] == "\r\nlast line end \u00e9\n"
    with pytest.raises(FileNotFoundError):
        mirror.mirror_read_tree(spark, str(tmp_path / "none"))


def test_a_later_join_by_key_shuffles_no_texts(spark, tmp_path):
    """One shuffle of the metadata serves both joins, and code that nobody wants stays away."""
    rows = assets(spark, [f"n{i}" for i in range(40)]).withColumn("project", F.lit("p"))
    more = rows.where("version < 3").withColumns(
        {"language": F.lit("rust"), "code": F.lit("other")})
    mirror.mirror_export(rows.unionByName(more), str(tmp_path))
    back = mirror.mirror_read(spark, str(tmp_path))
    assert back.where("code <> 'other' and language = 'rust'").count() == 0
    assert back.count() == 43 and back.where("code_from_file").count() == 43
    keys = rows.select("project", "name").hint("merge")
    plan = back.hint("merge").join(keys, ["project", "name"]).select("name", "code_hash", "version")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 3
    shuffled = [line for line in text.split("\n") if "Exchange hashpartitioning" in line]
    assert shuffled and all("_file_code" not in line for line in text.split("\n"))


def test_a_failed_task_leaves_no_half_asset(spark, tmp_path):
    old = assets(spark, ["a", "b", "c"], "old")
    mirror.mirror_write_tree(old, str(tmp_path))
    new = assets(spark, ["a", "b", "c", "d"], "new").repartition(4, "name").withColumn(
        "code", F.when(F.col("name") == "d", F.raise_error(F.lit("no such code"))).otherwise(
            F.col("code")))
    with pytest.raises(Exception, match="no such code"):
        mirror.mirror_write_tree(new, str(tmp_path))
    got = by_name(mirror.mirror_read_tree(spark, str(tmp_path)))
    assert set(got) == {"a", "b", "c"}
    assert all(r["code"].startswith("old") for r in got.values())


def test_an_interrupted_move_is_ended_by_the_next_call(spark, tmp_path, monkeypatch):
    spark.dataSource.register(tree.PairFiles)
    job = tmp_path / "staging" / "job"
    pairs = spark.createDataFrame([(f"projects/p/functions/python/{n}.py", n, f"projects/p/metadata/{n}.json",
                                    json.dumps({"name": n})) for n in "abc"],
                                  "code_target string, code string, meta_target string, meta string")
    pairs.repartition(2).write.format("pair_files").option("staging", f"file:{job}") \
        .mode("append").save()
    assert not (tmp_path / "projects").exists()
    # One pair was moved before the driver was lost, another only by half.
    lines = [json.loads(line) for f in job.glob("*/moves.json") for line in f.read_text().splitlines()]
    for line, kinds in ((lines[0], ("code", "meta")), (lines[1], ("code",))):
        for kind in kinds:
            target = tmp_path / line[f"{kind}_target"]
            target.parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / line[f"{kind}_file"]).rename(target)
    # An attempt that does not count, and a job that was never decided.
    (job / "lost").mkdir()
    (job / "lost" / "moves.json").write_text('{"code_target": "projects/x"}')
    undecided = tmp_path / "staging" / "other"
    undecided.mkdir()
    tree.finish(spark, str(tmp_path))
    got = by_name(mirror.mirror_read_tree(spark, str(tmp_path)))
    assert {n: (r["code"], r["code_from_file"]) for n, r in got.items()} == {
        n: (n, True) for n in "abc"}
    assert not job.exists() and undecided.exists()


@pytest.mark.parametrize("layout", ["bulk", "tree"])
def test_fields_of_any_name_survive(spark, tmp_path, layout):
    rows = spark.sql("""SELECT 'p' AS project, 'f' AS name, 'a' AS code, 'python' AS language,
        7L AS reviewers, from_json('{"a b":{"x":[1,2.5,null]},"name":"not this","n":null}',
        'map<string,variant>') AS extra
        UNION ALL SELECT 'p', 'g', 'b', 'python', null, null""")

    def round_trip(rows, path):
        if layout == "tree":
            mirror.mirror_write_tree(rows, path)
            return mirror.mirror_read_tree(spark, path)
        mirror.mirror_export(rows, path)
        return mirror.mirror_read(spark, path)

    def fields(back):
        return {r["name"]: json.loads(r["e"]) for r in back.select(
            "name", F.to_json("extra").alias("e")).collect()}

    expected = {"f": {"reviewers": 7, "a b": {"x": [1, 2.5, None]}, "n": None}, "g": {}}
    once = round_trip(rows, str(tmp_path / "one"))
    assert fields(once) == expected
    twice = round_trip(once.drop("code_hash", "code_from_file", "folder"), str(tmp_path / "two"))
    assert {k: {n: x for n, x in v.items()} for k, v in fields(twice).items()} == expected


def test_records_of_odd_texts(spark):
    texts = spark.createDataFrame(
        [(1, '{"name":"a","k":1,"k":2,"K":3}'), (2, '{"bro'), (3, "[]"), (4, None), (5, "{}")],
        "id int, value string")
    got = {r["id"]: (r["name"], r["e"]) for r in mirror.records(
        texts, mirror.schemas.MIRROR_METADATA).select("id", "name", F.to_json("extra").alias("e"))
        .collect()}
    assert got == {1: ("a", '{"k":2,"K":3}'), 2: (None, "{}"), 3: (None, "{}"),
                   4: (None, "{}"), 5: (None, "{}")}


def test_reports_keep_the_details_of_evaluators(spark):
    def judge(code, language):
        if code == "bad":
            raise ValueError("no")
        return len(code), "length", {"chars": len(code), "seen": [language, None]}

    rows = spark.createDataFrame([(1, "abc", "python"), (2, "bad", "rust"), (3, "", "go")],
                                 "asset_id long, code string, language string")
    found = S.evaluate(rows, {**S.PLUGINS, "own": S.python_row_evaluator("own", judge, True)})
    # The same evaluator once more: the better row's details stay.
    worse = found.where("evaluator = 'own'").withColumn("score", F.lit(-1.0)).withColumn(
        "details", F.try_parse_json(F.lit('{"chars":99}')))
    gated = rows.select("asset_id", F.lit(1.0).alias("score"), F.lit("weighted").alias("stage"))
    gated = gated.unionByName(spark.sql("SELECT 4L AS asset_id, 0D AS score, 'weighted' AS stage"))
    got = {r["asset_id"]: r for r in S.verification_report(gated, found.unionByName(worse)).select(
        "asset_id", "reason", "is_system_error", F.map_keys("details").alias("keys"),
        F.to_json(F.col("details")["own"]["details"]).alias("own"),
        F.col("details")["structural"]["details"].isNull().alias("none")).collect()}
    assert json.loads(got[1]["own"]) == {"chars": 3, "seen": ["python", None]}
    assert json.loads(got[2]["own"]) == {"error_type": "ValueError"} and got[2]["is_system_error"]
    assert json.loads(got[3]["own"]) == {"chars": 0, "seen": ["go", None]}
    assert got[4]["keys"] == [] and got[1]["none"] and got[1]["keys"] == ["own", "structural"]
    plain = S.verification_report(gated, found.drop("details"))
    assert {r["asset_id"]: r["reason"] for r in plain.collect()} == {
        k: r["reason"] for k, r in got.items()}
