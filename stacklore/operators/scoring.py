"""Scores, the quality gate and verdicts."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stacklore import constants as K
from stacklore.functions import code as C, facts as P

EVALUATION = ["asset_id", "evaluator", "score", "reason", "is_system_error"]


# ---- evaluators ---------------------------------------------------------------

def structural(assets):
    ok = C.brackets_balanced("code")
    return _evaluated(assets, "structural", F.when(ok, 100.0).otherwise(0.0), F.when(
        ok, "Structural integrity passed.").otherwise(
        "Structural error detected (unbalanced brackets)."))


def runtime(results):
    """Rows of the execution results table as scores.

    ``results``: asset_id, status, has_test, supported.
    """
    score, system, reason = runtime_score("status", "has_test", "supported")
    return results.select(
        "asset_id", F.lit("runtime").alias("evaluator"), score.alias("score"),
        reason.alias("reason"), system.alias("is_system_error"))


def runtime_score(status, has_test, supported):
    """Columns (score, is_system_error, reason) for one execution result."""
    status, has_test, supported = F.col(status), F.col(has_test), F.col(supported)
    infrastructure = ~status.isin("success", "failure")
    score = F.when(~has_test, 40.0).when(~supported, 0.0).when(
        status == "success", 100.0).otherwise(0.0)
    system = has_test & (~supported | infrastructure)
    reason = (
        F.when(~has_test, "No test code provided")
        .when(~supported, "No executor for the language")
        .when(status == "success", "Tests passed")
        .when(status == "failure", "Logic error")
        .when(status == "timeout", "Timed out")
        .when(status == "memory_limit", "Memory limit exceeded")
        .otherwise("Execution environment error"))
    return score, system, reason


def _evaluated(assets, evaluator, score, reason, system=None):
    return assets.select(
        "asset_id", F.lit(evaluator).alias("evaluator"), score.alias("score"),
        reason.alias("reason"), (F.lit(False) if system is None else system)
        .alias("is_system_error"))


# Plug-ins: DataFrame of assets -> evaluation rows. Callers may add their own.
PLUGINS = {"structural": structural}


def evaluate(assets: DataFrame, plugins=None) -> DataFrame:
    """All evaluation rows of all plug-ins, as one long table.

    If a plug-in has a column ``details`` (a variant of its own making), the table has it too,
    null for the others.
    """
    found = [plugin(assets) for plugin in (plugins or PLUGINS).values()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        rows.select(*EVALUATION, *[c for c in rows.columns if c == "details"]) for rows in found])


def python_row_evaluator(name, judge, with_details=False):
    """A plug-in from a Python function ``judge(code, language) -> (score, reason)``.

    With ``with_details`` it returns a third value, a dict of its own fields, which becomes
    the variant ``details``. A call that fails yields score 0 with a system error, and the
    kind of the error as its details; it never fails the job.
    """
    import json

    import pandas as pd

    @F.pandas_udf("score double, reason string, is_system_error boolean, details string")
    def run(code: pd.Series, language: pd.Series) -> pd.DataFrame:
        rows = []
        for text, lang in zip(code, language):
            try:
                score, reason, *details = judge(text, lang)
                rows.append((float(score), reason, False, json.dumps(details[0], allow_nan=False)
                             if with_details else None))
            except Exception as error:  # noqa: BLE001 - any fault is a verdict here
                rows.append((0.0, f"Evaluator error: {error}", True,
                             json.dumps({"error_type": type(error).__name__})))
        return pd.DataFrame(rows, columns=["score", "reason", "is_system_error", "details"])

    def plugin(assets):
        judged = assets.select("asset_id", run("code", "language").alias("r")).select(
            "asset_id", F.lit(name).alias("evaluator"), "r.*")
        if not with_details:
            return judged.drop("details")
        return judged.withColumn("details", F.try_parse_json("details"))

    return plugin


# ---- code scores ----------------------------------------------------------------

def code_scores(assets: DataFrame, declared=None) -> DataFrame:
    """Every score that follows from code and test text, one row per asset.

    ``assets``: asset_id, code, test_code, language and, optionally, is_draft. Rows that
    are badly nested, or empty of tests and no draft, are decided before any Python runs;
    the rest is parsed once per text, and all scores are expressions in the same row.
    """
    python = F.lower("language") == "python"
    prepared = assets.withColumn("structural", C.structural_score("code"))
    tested = F.length("test_code") > 0
    # Only an asset that is no draft stops at missing tests; drafts are judged by their code.
    draft = F.col("is_draft") if "is_draft" in assets.columns else F.lit(False)
    parsed = (F.col("structural") > 0) & python & (tested | F.coalesce(draft, F.lit(False)))
    facts = prepared.withColumn(
        "code_facts", P.code_facts(F.when(parsed, F.col("code")))
    ).withColumn("test_facts", P.test_facts(F.when(parsed & tested, F.col("test_code"))))
    code, test = F.col("code_facts"), F.col("test_facts")
    known = None if declared is None else F.array(
        *[F.lit(d) for d in declared]).cast("array<string>")

    def python_only(score, otherwise=100.0):
        return F.when(python, score).otherwise(otherwise)

    asserts = F.when(python, F.size(P.assertions(test))).otherwise(
        C.assertion_count("test_code", "language"))
    scored = facts.select(
        *assets.columns, "structural", "code_facts", "test_facts",
        asserts.alias("assertions"),
        python_only(P.tests_use_code(code, test), F.lit(True)).alias("tests_use_code"),
        F.when(python, P.hollow_functions(code)).alias("hollow"),
        F.when(python, P.heavy_imports(code)).alias("heavy"),
        python_only(P.security_score(code, "code")).alias("security_static"),
        python_only(P.dependency_score(code, known)).alias("dependency_vouch"),
        python_only(P.metrics_score(code)).alias("metrics_gate"),
        F.when(python, P.python_static_score(code)).alias("python_static"),
    )
    none = F.array().cast("array<string>")
    return scored.withColumn("deterministic", P.deterministic_score(
        "assertions", "tests_use_code",
        F.size(F.coalesce("hollow", none)), F.size(F.coalesce("heavy", none))))


# ---- gate -----------------------------------------------------------------------

def pivot_evaluations(evaluations: DataFrame) -> DataFrame:
    """One column per evaluator, the best score of each.

    One conditional aggregate per name of the fixed list: a single shuffle, where
    ``pivot`` would first group by asset and evaluator.
    """
    return evaluations.groupBy("asset_id").agg(*[
        F.max(F.when(F.col("evaluator") == e, F.col("score"))).alias(e) for e in K.EVALUATORS])


def static_average(language="language"):
    """Mean of security, dependency and the one linter that applies."""
    python = F.lower(language) == "python"
    linter = F.when(python, F.coalesce("ruff", "python_static")).otherwise(F.col("eslint"))
    parts = F.array_compact(F.array("security_static", "dependency_vouch", linter))
    total = F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(parts) > 0, total / F.size(parts))


def weighted_mean(columns: dict):
    """Mean of the columns that are not null, weighted by the given shares."""
    def share(name, weight):
        return F.when(F.col(name).isNotNull(), F.lit(weight)).otherwise(0.0)

    total = reduce(lambda a, b: a + b, [share(n, w) for n, w in columns.items()])
    value = reduce(lambda a, b: a + b, [
        F.coalesce(F.col(n) * w, F.lit(0.0)) for n, w in columns.items()])
    return F.when(total > 0, value / total)


def quality_gate(wide: DataFrame) -> DataFrame:
    """Add ``score`` and the deciding ``stage`` to one row per asset.

    ``wide``: is_draft, has_test, language and one nullable column per
    evaluator. A missing evaluator never rejects.
    """
    missing = [e for e in K.EVALUATORS if e not in wide.columns]
    rows = wide.select("*", *[F.lit(None).cast("double").alias(e) for e in missing])
    rows = rows.withColumn("static", static_average())
    raw = F.round(weighted_mean(K.GATE_WEIGHTS), 10)
    ai = F.col("ai_gate")
    draft = F.col("is_draft")

    ladder = [
        ("missing_tests", ~draft & ~F.col("has_test"), F.lit(K.UNTESTED_SCORE)),
        ("structural", F.col("structural") == 0, F.lit(0.0)),
        ("security", F.col("security_static") < K.SECURITY_FLOOR, F.lit(0.0)),
        ("dependency", F.col("dependency_vouch") < K.DEPENDENCY_FLOOR, F.lit(0.0)),
        ("deterministic", F.col("deterministic") == 0, F.lit(0.0)),
        ("runtime", (F.col("runtime") == 0) & ~draft, F.lit(0.0)),
        ("no_evaluators", raw.isNull(), F.lit(0.0)),
        ("ai_veto", ai < K.AI_VETO_BELOW, F.lit(0.0)),
        ("ai_cap", ai < K.AI_CAP_BELOW, F.least(raw, ai)),
    ]
    score = stage = F
    for name, condition, value in ladder:
        score, stage = score.when(condition, value), stage.when(condition, F.lit(name))
    return rows.withColumn("score", score.otherwise(raw)).withColumn(
        "stage", stage.otherwise(F.lit("weighted"))).drop(*missing)


def verdict(score, is_system_error):
    """Columns (status, reliability)."""
    score = F.col(score)
    status = F.when(F.col(is_system_error), "error").when(
        score >= K.VERIFIED_FROM, "verified").otherwise("failed")
    return status, score / 100.0


def verification_report(gated: DataFrame, evaluations: DataFrame) -> DataFrame:
    """Nested report of every gated asset: score, stage, details per evaluator, reasons.

    An asset has at most one entry per evaluator, so the map stays small; one that no
    evaluator has seen has an empty map. The reason starts with what the stage says.
    Evaluations may have ``details``, a variant with the evaluator's own values: each entry
    keeps those of the best row (by score, then reason), null where that has none.
    """
    own = ["details"] if "details" in evaluations.columns else []
    entry = F.struct("evaluator", F.struct(
        "score", "reason", "is_system_error", *own).alias("result"))
    best = F.struct("score", "reason")
    each = evaluations.groupBy("asset_id", "evaluator").agg(
        F.max("score").alias("score"), F.max("reason").alias("reason"),
        F.max("is_system_error").alias("is_system_error"),
        *[F.max_by(F.struct(c), best)[c].alias(c) for c in own])
    # Variants have no order, so entries are put in order by evaluator alone.
    by_name = (lambda a, b: F.when(a["evaluator"] < b["evaluator"], -1).when(
        a["evaluator"] > b["evaluator"], 1).otherwise(0))
    details = each.groupBy("asset_id").agg(
        F.array_sort(F.collect_list(entry), by_name).alias("entries"),
        F.max("is_system_error").alias("is_system_error"))
    rows = gated.select("asset_id", "score", "stage").join(details, "asset_id", "left")
    empty = F.from_json(F.lit("[]"), rows.schema["entries"].dataType)
    rows = rows.withColumn("entries", F.coalesce("entries", empty))
    said = F.transform("entries", lambda e: F.concat(
        e["evaluator"], F.lit(": "), e["result"]["reason"]))
    stage = F.create_map(*[F.lit(x) for item in K.STAGE_REASONS.items() for x in item])[
        F.col("stage")]
    return rows.select(
        "asset_id", "score", "stage",
        F.coalesce("is_system_error", F.lit(False)).alias("is_system_error"),
        F.map_from_entries("entries").alias("details"),
        F.array_join(F.concat(F.array_compact(F.array(stage)), said), " | ").alias("reason"))


def weighted_gate(evaluations: DataFrame, assets: DataFrame) -> DataFrame:
    """(asset_id, score): the weighted mean over all layers of a long table.

    The static layer is the mean of security, dependency and the linter of the language;
    it enters as a layer with its own weight. Assets without any layer have no row.
    """
    static = static_average().alias("static")
    layers = pivot_evaluations(evaluations).join(
        assets.select("asset_id", "language"), "asset_id").withColumn("static", static)
    return layers.select("asset_id", weighted_mean(K.GATE_WEIGHTS).alias("score")).where(
        "score IS NOT NULL")


# ---- findings to scores -----------------------------------------------------------

def lint_score(findings: DataFrame, shown=5) -> DataFrame:
    """Two points off per issue, with the first five messages and a rest count.

    The messages are cut to five per asset inside each task, before the shuffle.
    """
    from pyspark.sql import Window

    counts = findings.groupBy("asset_id").agg(F.count("*").alias("issues"))
    order = Window.partitionBy("asset_id").orderBy("seq")
    text = F.concat(F.lit("["), "code", F.lit("] L"), F.col("line").cast("string"),
                    F.lit(": "), "message")
    first = (
        findings.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= shown)
        .groupBy("asset_id").agg(F.array_sort(
            F.collect_list(F.struct("_n", text.alias("text")))).alias("_m"))
    )
    listed = F.array_join(F.transform("_m", lambda m: m["text"]), " | ")
    more = F.when(F.col("issues") > shown, F.concat(
        F.lit(" ...and "), (F.col("issues") - shown).cast("string"), F.lit(" more issues."))
    ).otherwise("")
    return counts.join(first, "asset_id").select(
        "asset_id", "issues",
        F.greatest(F.lit(0.0), 100.0 - F.col("issues") * 2.0).alias("score"),
        F.concat(listed, more).alias("reason"))


def eslint_score(findings: DataFrame) -> DataFrame:
    lost = F.sum(F.when(F.col("severity") == 2, 5.0).otherwise(1.0))
    return findings.groupBy("asset_id").agg(
        F.greatest(F.lit(0.0), 100.0 - lost).alias("score"), F.count("*").alias("issues"))


def vulnerability_score(findings: DataFrame) -> DataFrame:
    """40 off per high finding, 10 per other; findings of one file fit one row."""
    lost = F.sum(F.when(F.col("severity") == "high", 40.0).otherwise(10.0))
    entry = F.struct("position", F.concat(
        F.lit("L"), F.col("lineno").cast("string"), F.lit(": "), "message").alias("text"))
    return findings.groupBy("asset_id").agg(
        F.greatest(F.lit(0.0), 100.0 - lost).alias("score"),
        F.array_sort(F.collect_list(entry)).alias("_m")
    ).select("asset_id", "score", F.array_join(
        F.transform("_m", lambda m: m["text"]), "; ").alias("reason"))


def lint_density_score(errors, lines, formatted, security_penalty):
    density = F.col(errors) / F.greatest(F.col(lines), F.lit(1))
    lost = (F.least(density * 500.0, F.lit(70.0))
            + F.when(F.col(formatted), 0.0).otherwise(30.0) + F.col(security_penalty))
    return F.greatest(F.lit(0.0), 100.0 - F.round(lost, 9)).cast("int")


def undeclared_imports(imports: DataFrame, stdlib: DataFrame, declared: DataFrame,
                       local=None) -> DataFrame:
    """Score of each asset by its imports that nothing declares.

    ``imports``: asset_id, module; an asset without imports has a row without a module and
    scores 100. The lists of names may be large; the optimizer decides by their size how to
    join them.
    """
    top = F.substring_index("module", ".", 1)
    package = F.replace(F.lower(top), F.lit("_"), F.lit("-"))
    rows = imports.distinct().withColumn("top", top).withColumn("package", package)
    known = [(stdlib.select(F.col("module").alias("top")), "top"),
             (declared.select("package"), "package")]
    if local is not None:
        known.append((local.select(F.col("module").alias("top")), "top"))
    # Left joins keep assets without a missing module, so the imports are read once.
    missing = F.lit(True)
    for number, (names, key) in enumerate(known):
        rows = rows.join(names.distinct().withColumn(f"_in{number}", F.lit(True)), key, "left")
        missing = missing & F.col(f"_in{number}").isNull()
    return rows.groupBy("asset_id").agg(
        F.sort_array(F.collect_set(F.when(missing, F.col("module")))).alias("missing")
    ).withColumn("score", F.greatest(F.lit(0.0), 100.0 - F.size("missing") * 30.0))


# ---- drafts -----------------------------------------------------------------------

def stabilise_drafts(drafts: DataFrame, results: DataFrame) -> DataFrame:
    """Promote drafts whose tests pass, flag the others, skip those without tests.

    ``drafts``: catalogue rows with test_code; ``results``: project, name,
    runtime_score, reason. Adds outcome, new_description and new_reliability;
    dry runs read the outcome and write nothing.
    """
    from stacklore.functions.text import failed_description, verified_description

    joined = drafts.join(results, ["project", "name"], "left")
    untested = F.coalesce(F.length("test_code"), F.lit(0)) == 0
    passed = F.col("runtime_score") == 100
    outcome = F.when(untested, "skipped").when(passed, "promoted").otherwise("failed")
    reason = F.coalesce("reason", F.lit("no result"))
    return joined.withColumn("outcome", outcome).withColumn(
        "new_description",
        F.when(F.col("outcome") == "promoted", verified_description("description"))
        .when(F.col("outcome") == "failed", failed_description("description", reason))
        .otherwise(F.col("description")),
    ).withColumn(
        "new_reliability",
        F.when(F.col("outcome") == "promoted", 1.0)
        .when(F.col("outcome") == "failed", F.coalesce("runtime_score", F.lit(0.0)) / 100)
        .otherwise(F.col("reliability_score")))
