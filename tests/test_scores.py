"""Gate ladder, evaluators and code facts on hand examples."""

import pytest
from pyspark.sql import functions as F

from stacklore import constants as K
from stacklore.functions import code as C, facts as P, replies as R, text as X
from stacklore.operators import scoring as S
from stacklore.plans import QUERIES


def gate(spark, is_draft=False, has_test=True, language="python", **scores):
    values = [float(scores[e]) if e in scores else None for e in K.EVALUATORS]
    schema = "is_draft boolean, has_test boolean, language string, " + ", ".join(
        f"{e} double" for e in K.EVALUATORS)
    row = S.quality_gate(spark.createDataFrame(
        [(is_draft, has_test, language, *values)], schema)).first()
    return row["stage"], round(row["score"], 4)


GOOD = dict(structural=100, deterministic=100, runtime=100, security_static=100,
            dependency_vouch=100, ai_gate=90, metrics_gate=100)


@pytest.mark.parametrize("changes, expected", [
    ({}, ("weighted", 98.5)),
    ({"has_test": False}, ("missing_tests", 40.0)),
    ({"has_test": False, "is_draft": True}, ("weighted", 98.5)),
    ({"structural": 0, "security_static": 0}, ("structural", 0.0)),
    ({"security_static": 59}, ("security", 0.0)),
    ({"security_static": 60}, ("weighted", 94.5)),
    ({"dependency_vouch": 40}, ("dependency", 0.0)),
    ({"deterministic": 0}, ("deterministic", 0.0)),
    ({"runtime": 0}, ("runtime", 0.0)),
    ({"runtime": 0, "is_draft": True}, ("weighted", 68.5)),
    ({"ai_gate": 29}, ("ai_veto", 0.0)),
    ({"ai_gate": 30}, ("ai_cap", 30.0)),
    ({"ai_gate": 69}, ("ai_cap", 69.0)),
    ({"ruff": 40, "python_static": 0}, ("weighted", 94.5)),
    ({"eslint": 0}, ("weighted", 98.5)),
    ({"eslint": 40, "language": "JavaScript"}, ("weighted", 98.5)),
])
def test_gate_ladder(spark, changes, expected):
    if changes.get("language"):  # linters of JavaScript count for JavaScript
        expected = ("weighted", 94.5)
    assert gate(spark, **{**GOOD, **changes}) == expected


def test_gate_without_evaluators(spark):
    assert gate(spark) == ("no_evaluators", 0.0)


SECURITY = [
    ("def f(x):\n    return eval(x)\n", 60), ("API_KEY = 'sk-12345'\n", 60),
    ("import subprocess\nsubprocess.run('ls', shell=True)\n", 60),
    ("db.execute(f'SELECT {x}')\n", 60), ("def f(:\n", 0), ("def f(a):\n    return a + 1\n", 100),
    ("import pickle\npickle.loads(b)\n", 60), ("import json\njson.loads(b)\n", 100),
    ("TOKEN = 'abcd'\n", 100), ("self.token = 'abcdefgh'\n", 100),
]


def test_security_scores(spark):
    rows = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(SECURITY)], "i int, code string")
    got = rows.withColumn("f", P.code_facts("code")).select(
        "i", P.security_score("f", "code").alias("s")).orderBy("i").collect()
    assert [r["s"] for r in got] == [s for _, s in SECURITY]


def facts(spark, code, test=""):
    return spark.createDataFrame([(code, test)], "code string, test string").withColumn(
        "c", P.code_facts("code")).withColumn("t", P.test_facts("test"))


def test_assertions_that_count(spark):
    test = ("assert True\nassert 1 == 1\nassert f(1)\nself.assertEqual(f(1), 2)\n"
            "assertTrue(True)\nassert_all()\n")
    assert facts(spark, "", test).select(F.size(P.assertions("t"))).first()[0] == 2


@pytest.mark.parametrize("body, hollow", [
    ("pass", True), ("...", True), ("'doc'", True), ("'doc'\n    pass", True), ("return a", True),
    ("return b", False), ("return a + 1", False), ("x = a\n    return x", False), ("return", False)])
def test_hollow_bodies(spark, body, hollow):
    found = facts(spark, f"async def f(a):\n    {body}\n").select(
        F.size(P.hollow_functions("c"))).first()[0]
    assert bool(found) is hollow


def test_complexity_counts_branches_and_parameters(spark):
    code = ("def f(a, b, *c, d=1, **e):\n    with a:\n        for x in b:\n"
            "            if x and a or b:\n                pass\n    try:\n        pass\n"
            "    except E:\n        pass\n    return 1 if a else 2\n")
    f = facts(spark, code).select(F.get(P.of_kind("c", "function"), 0)).first()[0]
    assert (f["size"], f["params"]) == (9, 5)


def test_a_test_must_name_something_public(spark):
    def used(code, test):
        return facts(spark, code, test).select(P.tests_use_code("c", "t")).first()[0]

    assert used("def f(): return 1", "assert m.f() == 1")
    assert not used("def f(): return 1", "assert g() == 1")
    assert used("def _f(): return 1", "assert g() == 1")
    assert used("def f(", "assert g() == 1")


def test_imports_with_and_without_a_manifest(spark):
    code = "import os, numpy.linalg, requests\nfrom my_pkg.x import y\nfrom . import z\n"
    row = facts(spark, code)
    declared = F.array(F.lit("my-pkg"))
    assert row.select(P.undeclared_modules("c", declared)).first()[0] == ["numpy.linalg", "requests"]
    assert row.select(P.undeclared_modules("c")).first()[0] == ["my_pkg.x"]


def test_dependencies_of_both_languages(spark):
    js = ("import _ from 'lodash';\nconst fs = require('fs');\nimport a from \"axios\";\n"
          "import x from './local';\nimport '@types/node';\n")
    py = "import os\nimport sys\nimport pandas as pd\nfrom numpy import array\n  import later\n"
    row = spark.createDataFrame([(js, py)], "js string, py string").select(
        C.js_dependencies("js"), C.python_dependencies("py")).first()
    assert row[0] == ["@types/node", "axios", "lodash"]
    assert row[1] == ["numpy", "pandas"]


@pytest.mark.parametrize("text, ok", [
    ("", True), ("a(b[c]{d})", True), ("(]", False), (")", False), ("((", False), ("([)]", False),
    ("x(\n)", True), ("}{", False)])
def test_brackets(spark, text, ok):
    row = spark.createDataFrame([(text,)], "t string").select(C.brackets_balanced("t")).first()
    assert row[0] is ok


def test_a_failing_evaluator_is_a_system_error_and_no_crash(spark):
    def judge(code, language):
        return 1 / len(code), "fine"

    rows = spark.createDataFrame([(1, "x", "python"), (2, "", "python")],
                                 "asset_id long, code string, language string")
    got = S.evaluate(rows, {"own": S.python_row_evaluator("own", judge)}).orderBy("asset_id").collect()
    assert [(r["score"], r["is_system_error"]) for r in got] == [(1.0, False), (0.0, True)]
    assert "division" in got[1]["reason"]


def test_runtime_results(spark):
    cases = [("success", True, True), ("failure", True, True), ("timeout", True, True),
             ("memory_limit", True, True), ("error", True, True), ("success", False, True),
             ("success", True, False)]
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                                 "asset_id int, status string, has_test boolean, supported boolean")
    got = S.runtime(rows).orderBy("asset_id").collect()
    assert [(r["score"], r["is_system_error"]) for r in got] == [
        (100.0, False), (0.0, False), (0.0, True), (0.0, True), (0.0, True), (40.0, False),
        (0.0, True)]


@pytest.mark.parametrize("reply, score", [
    ('{"score": 85}', 85), ('{"score": "85"}', 85), ('{"score": "72.9"}', 72),
    ('{"score": {"z": "5", "b": 7.5, "a": 1}}', 7), ('{"score": null}', 0), ('{"score": [9]}', 0),
    ('{"score": "high"}', 0), ('{}', 0), ('{"score": true}', 1), ('{"score": -3.7}', -3)])
def test_score_coercion(spark, reply, score):
    assert spark.createDataFrame([(reply,)], "r string").select(
        R.score_coerce("r")).first()[0] == score


@pytest.mark.parametrize("old, current, count", [
    (("Linux", "3.11.1", "x86", "venv"), {}, 0),
    (("Windows", "3.11.1", "x86", "venv"), {}, 1),
    (("Linux", "3.10.9", "arm", "docker"), {}, 3),
    ((None, None, None, None), {}, 4)])
def test_environment_drift(spark, old, current, count):
    now = {"os": "Linux", "python_version": "3.11.7", "cpu_arch": "x86", "execution_driver": "venv"}
    row = spark.createDataFrame([(old,)], "s struct<os:string,python_version:string,"
                                          "cpu_arch:string,execution_driver:string>")
    assert len(row.select(X.env_drift("s", now)).first()[0]) == count


def test_hash_ignores_outer_space_and_line_ends(spark):
    texts = ["a\nb", "  a\r\nb\u00a0\n\u2003", "\x1ca\nb\x1f", "a b"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(
        X.code_hash("t")).collect()]
    assert got[0] == got[1] == got[2] != got[3]


def test_search_document_layout(spark):
    row = spark.createDataFrame([("n", "d", ["a", "b"], "c")],
                                "n string, d string, t array<string>, c string").select(
        X.search_document("n", "d", "t", "c")).first()
    assert row[0] == ("LOGIC ASSET: n\nTECHNICAL SPECIFICATION:\nd\nTAGS: a, b\n"
                      "--- IMPLEMENTATION DETAILS ---\nc")


@pytest.mark.parametrize("name, given", [
    ("metrics_score", 15), ("fact_test_calls_code", 15), ("code_gate", 16),
    ("deterministic_score", 16), ("dependency_set", 16)])
def test_many_parts_of_one_file_are_parsed_by_many_tasks(spark, tmp_path, name, given):
    """Keys that come twice and a null key are rows like any others."""
    keys = spark.range(24_000).select((F.col("id") % 16_000).alias("p_partkey"))
    keys.unionByName(spark.sql("select cast(null as bigint) as p_partkey")).coalesce(1).write.parquet(
        str(tmp_path / "part.parquet"))
    rows = QUERIES[name](spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() >= 3
    assert rows.where("asset_id is not null").count() == 24_000 * given // 16


def test_the_walk_is_that_of_ast():
    import ast

    for module in (P, C, S, K):
        tree = ast.parse(open(module.__file__).read())
        assert P._walk(tree) == [
            n for n in ast.walk(tree) if not isinstance(n, ast.expr_context)]
