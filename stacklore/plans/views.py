"""Catalogue tables derived from the given test tables."""

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stacklore.functions.text import code_hash
from stacklore.session import cut_lineage, spread

START = "2024-01-01 00:00:00"
SEARCH_WORDS = ["ther", "tion", "with", "elle", "der", "que", "and", "para"]
SYSTEMS = ["ubuntu-latest", "windows-latest", "macos-latest"]
PYTHONS = ["3.9", "3.10", "3.11", "3.12"]


def table(spark: SparkSession, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def minutes_after(count):
    return F.timestamp_seconds(F.unix_timestamp(F.lit(START)) + count * 60)


def _tags():
    return F.array("lang", "source", F.when(F.col("n_chars") > 1000, "long").otherwise("short"))


def _description():
    mark = F.when(F.col("doc_id") % 3 == 0, "[AI-DRAFT] ").otherwise("")
    return F.concat(mark, "text")


def save_requests(documents: DataFrame) -> DataFrame:
    """Saves in seq order; every tenth document is saved twice in a row."""
    again = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0)))
    seq = F.col("doc_id") * 2 + F.col("_again")
    return documents.withColumn("_again", F.explode(again)).select(
        F.col("lang").alias("project"),
        F.concat(F.lit("fn_"), (F.col("doc_id") % 40).cast("string")).alias("name"),
        F.col("text").alias("code"), F.col("lang").alias("language"),
        _description().alias("description"), _tags().alias("tags"),
        seq.alias("seq"), minutes_after(seq).alias("ts"), code_hash("text").alias("code_hash"))


def save_log(spark, sf_dir) -> DataFrame:
    return save_requests(table(spark, sf_dir, "documents"))


def narrow_log(spark, sf_dir) -> DataFrame:
    """The log without texts, written once: hashing reads every text only one time."""
    log = save_log(spark, sf_dir).select("project", "name", "seq", "ts", "code_hash")
    return cut_lineage(log, "log")


def assets_flat(spark, sf_dir) -> DataFrame:
    """One asset per document."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    created = minutes_after(F.col("doc_id"))
    return table(spark, sf_dir, "documents").join(labels, "doc_id", "left").select(
        "doc_id", F.col("source").alias("project"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.col("text").alias("code"), F.col("lang").alias("language"),
        _description().alias("description"), _tags().alias("tags"),
        F.when(F.col("doc_id") % 5 == 0, "").otherwise("assert run()").alias("test_code"),
        F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.4).otherwise(0.0)
        .alias("reliability_score"),
        F.when(F.col("quality") == 1, "verified").when(F.col("quality") == 0, "failed")
        .otherwise("pending").alias("verification_status"),
        (F.col("n_chars") % 10).alias("call_count"),
        code_hash("text").alias("code_hash"), F.lit(1).alias("version"),
        created.alias("created_at"),
        minutes_after(F.col("doc_id") + F.col("n_chars") % 5000).alias("updated_at"))


def document_keys(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        "doc_id", F.col("source").alias("project"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"))


def vectors(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "doc_id")
    return rows.join(document_keys(spark, sf_dir), "doc_id").select(
        "project", "name", "embedding", "label", "doc_id")


def search_queries(spark, sf_dir) -> DataFrame:
    """One query per (label, project): the mean vector and a word.

    Their number follows the labels and projects and not the rows. Queries of
    even labels search every project.
    """
    mean = vectors(spark, sf_dir).groupBy("label", "project").agg(
        Summarizer.mean(array_to_vector("embedding")).alias("mean"))
    query_id = (F.col("label") * 1000 + F.substring("project", 4, 9).cast("int")).cast("long")
    return mean.select(
        query_id.alias("query_id"), pick(SEARCH_WORDS, query_id % 8).alias("text"),
        vector_to_array("mean").alias("embedding"),
        F.when(F.col("label") % 2 == 1, F.col("project")).alias("project"),
        F.lit(None).cast("string").alias("language"),
        F.lit(None).cast("array<string>").alias("tags"))


EVALUATOR_OF_LINE = ["structural", "deterministic", "runtime", "security_static",
                     "dependency_vouch", "ai_gate", "metrics_gate"]


def evaluation_rows(spark, sf_dir) -> DataFrame:
    """Evaluations as they come, more than one per asset and evaluator."""
    line, score = F.col("l_linenumber"), F.col("l_quantity") * 2.0
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset_id"),
        pick(EVALUATOR_OF_LINE, line - 1).alias("evaluator"),
        F.when((line <= 3) & (score < 10), 0.0).otherwise(score).alias("score"),
        F.concat(F.lit("line "), line.cast("string")).alias("reason"),
        F.lit(False).alias("is_system_error"))


def evaluations(spark, sf_dir) -> DataFrame:
    """The best evaluation of each asset by each evaluator."""
    return evaluation_rows(spark, sf_dir).groupBy("asset_id", "evaluator").agg(
        F.max("score").alias("score"), F.max("reason").alias("reason"),
        F.max("is_system_error").alias("is_system_error"))


def gate_assets(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("asset_id"),
        (F.col("o_orderpriority") == "5-LOW").alias("is_draft"),
        (F.col("o_orderstatus") != "P").alias("has_test"),
        F.lit("python").alias("language"))


def events(spark, sf_dir, *types) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    return rows.where(F.col("event_type").isin(*types)) if types else rows


def lint_findings(spark, sf_dir) -> DataFrame:
    line = F.get_json_object("props", "$.k").cast("int")
    return events(spark, sf_dir, "error").select(
        F.col("user_id").alias("asset_id"), F.col("event_id").alias("seq"), line.alias("line"),
        (F.col("event_id") % 2 + 1).cast("int").alias("severity"),
        F.concat(F.lit("E"), line.cast("string")).alias("code"),
        F.concat(F.lit("finding "), F.col("event_id").cast("string")).alias("message"))


def user_asset_events(spark, sf_dir, stream, *types) -> DataFrame:
    """Events of the given types on the asset whose number is the user's."""
    keys = document_keys(spark, sf_dir).withColumnRenamed("doc_id", "user_id")
    rows = stream if stream is not None else table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "purchase", "verified").otherwise("failed")
    return rows.where(F.col("event_type").isin(*types)).join(keys, "user_id").select(
        "project", "name", "event_id", F.col("ts").cast("timestamp").alias("ts"),
        status.alias("verification_status"))


def ci_results(spark, sf_dir) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id", "value", pick(SYSTEMS, F.col("user_id") % 3).alias("os"),
        (F.lit(18) + F.col("user_id") % 2 * 2).cast("string").alias("node"),
        pick(PYTHONS, F.col("event_id") % 4).alias("python"),
        F.struct("ts", "event_id").alias("ts"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
        F.when(F.col("value") > 10, "Pass").otherwise("Fail").alias("status"))


def version_tags(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"),
        F.concat(F.lit("v"), F.col("p_size").cast("string"), F.lit("."),
                 (F.col("p_partkey") % 12).cast("string"), F.lit("."),
                 (F.col("p_partkey") % 7).cast("string")).alias("tag"))


def candidates(spark, sf_dir) -> DataFrame:
    """All events of each user by value, as a ranked candidate list."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    rows = events(spark, sf_dir).withColumn("_n", F.row_number().over(order))
    return rows.select(
        F.col("user_id").alias("query_id"), (F.col("_n") - 1).alias("position"),
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("name"),
        F.col("event_type").alias("description"), F.col("props").alias("code"))


def candidate_queries(spark, sf_dir) -> DataFrame:
    """Every user as a query, with a reply that ranks its candidates."""
    uid = F.col("query_id")

    def number(c):
        return c.cast("string")

    return events(spark, sf_dir).select(F.col("user_id").alias("query_id")).distinct().select(
        "query_id",
        F.concat(F.lit("query "), number(uid)).alias("text"),
        F.concat(
            F.lit("Order: ["), number(uid % 15), F.lit(", "), number(uid * 3 % 20),
            F.lit(", 99, "), number(uid % 15), F.lit(", "), number((uid + 1) % 15),
            F.lit("] done")).alias("reply"))


def code_assets(spark, sf_dir) -> DataFrame:
    """One asset per part, from sixteen code templates with known facts."""
    part = spread(table(spark, sf_dir, "part").select("p_partkey"))
    key = F.col("p_partkey").cast("string")
    template = F.col("p_partkey") % 16

    def filled(texts):
        return F.replace(pick(texts, template), F.lit("{k}"), key)

    return part.select(
        F.col("p_partkey").alias("asset_id"), template.cast("int").alias("template"),
        filled([c for c, _ in CODE_TEMPLATES]).alias("code"),
        filled([t for _, t in CODE_TEMPLATES]).alias("test_code"),
        F.when(template == 15, "javascript").otherwise("python").alias("language"))


_ADD = "def f_{k}(a, b):\n    return a + b\n"
_A3 = "assert f_{k}(1, 2) == 3\nassert f_{k}(0, 0) == 0\nassert f_{k}(2, 2) == 4\n"
_B3 = "assert f_{k}(1) == 2\nassert f_{k}(0) == 0\nassert f_{k}(2) == 4\n"
CODE_TEMPLATES = [
    (_ADD, _A3),
    (_ADD, "assert f_{k}(1, 2) == 3\n"),
    (_ADD, "assert True\nassert 1 == 1\n"),
    (_ADD, "x = 1\nassert x == 1\nassert x > 0\nassert x < 2\n"),
    ("def f_{k}(a):\n    return a\n\ndef g_{k}():\n    pass\n", _B3),
    ("import pandas\nimport torch\n\ndef f_{k}(a):\n    return a * 2\n", _B3),
    ("API_KEY = 'sk-1-abcdef'\n\ndef f_{k}(s):\n    return eval(s)\n", _B3),
    ("import subprocess\n\ndef f_{k}(c):\n    return subprocess.run(c, shell=True)\n", _B3),
    ("def f_{k}(db, x):\n    return db.execute('SELECT ' + x)\n", _A3),
    ("import ghost_lib\nimport phantom_pkg.sub\n\ndef f_{k}(a):\n    return ghost_lib.go(a)\n",
     _B3),
    ("def f_{k}(x):\n" + "".join(
        f"    if x > {i}:\n        x += 1\n" for i in range(12)) + "    return x\n", _B3),
    ("def f_{k}(a, b, c, d, e, g, h):\n    return a + h\n", _B3),
    ("def f_{k}()\n    return 1\n", _B3),
    ("def f_{k}(\n", _B3),
    ("import numpy.linalg\nfrom . import helper\n\ndef f_{k}(a):\n    return numpy.linalg.norm(a)\n"
     "\ndef g_{k}(a):\n    return f_{k}(a) + 1\n", _B3),
    ("const _ = require('lodash/fp');\nimport axios from \"axios\";\nimport '@types/node';\n"
     "const l = require('./local');\nfunction f_{k}(x) { return x * 2; }\n",
     "expect(f_{k}(1)).toBe(2);\nexpect(f_{k}(2)).toBe(4);\n"),
]
DECLARED = ["numpy", "pandas", "torch"]

MODULE_TEMPLATES = [
    "def solve_{k}(a):\n    b = a + 1\n    return b\n\ndef tiny_{k}(a):\n    return a\n",
    "class Box_{k}:\n    def __init__(self, a):\n        self.a = a\n        self.b = a\n\n"
    "    def Open(self):\n        value = self.a\n        return value\n",
    "import os\n\nasync def later_{k}(a):\n    x = a\n    return x\n\n"
    "def outer_{k}(a):\n    def inner_{k}(b):\n        c = b\n        return c\n    return inner_{k}(a)\n",
    "def broken_{k}(\n",
]


def module_files(spark, sf_dir) -> DataFrame:
    part = spread(table(spark, sf_dir, "part").select("p_partkey"))
    return part.select(
        F.col("p_partkey").alias("file_id"),
        F.replace(pick(MODULE_TEMPLATES, F.col("p_partkey") % 4), F.lit("{k}"),
                  F.col("p_partkey").cast("string")).alias("code"))
