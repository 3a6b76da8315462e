"""Queries on code facts, scores, the gate and verdicts."""

from pyspark.sql import functions as F

from stacklore import constants as K
from stacklore.functions import code as C, facts as P
from stacklore.operators import catalogue, reports, scoring as S
from stacklore.plans import views as V
from stacklore.plans.registry import query
from stacklore.plans.sql_views import text as quoted, with_views
from stacklore.session import cut_lineage


def _by_template(column, values, kind="VARCHAR"):
    """SQL: one value per code template."""
    def literal(v):
        if v is None:
            return "NULL"
        return quoted(v) if isinstance(v, str) else str(v)

    return (f"SELECT p_partkey AS asset_id, ([{', '.join(map(literal, values))}])"
            f"[p_partkey % 16 + 1]::{kind} AS {column} FROM part")


def _scores(spark, d):
    return S.code_scores(V.code_assets(spark, d), V.DECLARED)


def _facts(spark, d):
    """Facts of every asset, also of the ones the gate turns away early."""
    rows = V.code_assets(spark, d).where("language = 'python'")
    return rows.withColumn("facts", P.code_facts("code")).withColumn(
        "tests", P.test_facts("test_code"))


def _listed(c):
    return F.array_join(F.array_sort(c), ",")


# ---- facts --------------------------------------------------------------------------

_PYTHON = "p_partkey % 16 < 15"


@query("fact_imports", f"""
    SELECT p_partkey AS asset_id, (['', '', '', '', '', 'pandas,torch', '', 'subprocess', '',
      'ghost_lib,phantom_pkg.sub', '', '', '', '', 'numpy.linalg'])[p_partkey % 16 + 1] AS modules
    FROM part WHERE {_PYTHON}""")
def fact_imports(spark, d):
    return _facts(spark, d).select("asset_id", _listed(P.imported_modules("facts"))
                                   .alias("modules"))


@query("dependency_set", _by_template("packages", [
    "", "", "", "", "", "pandas,torch", "", "subprocess", "", "ghost_lib,phantom_pkg", "", "", "",
    "", "numpy", "@types/node,axios,lodash"]))
def dependency_set(spark, d):
    """Parsed where the source parses, by line pattern where it does not."""
    python = F.col("language") == "python"
    rows = V.code_assets(spark, d).withColumn("facts", P.code_facts(F.when(python, F.col("code"))))
    parsed = C.clean_dependencies(F.transform(P.imported_modules("facts"), P.top_module))
    packages = F.when(~python, C.js_dependencies("code")).when(
        P.broken("facts"), C.python_dependencies("code")).otherwise(parsed)
    return rows.select("asset_id", F.array_join(packages, ",").alias("packages"))


@query("fact_assertions", f"""
    SELECT p_partkey AS asset_id, ([3, 1, 0, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3])
      [p_partkey % 16 + 1] AS assertions FROM part WHERE {_PYTHON}""")
def fact_assertions(spark, d):
    return _facts(spark, d).select("asset_id", F.size(P.assertions("tests")).alias("assertions"))


@query("fact_test_calls_code", f"""
    SELECT p_partkey AS asset_id, p_partkey % 16 NOT IN (2, 3) AS used
    FROM part WHERE {_PYTHON}""")
def fact_test_calls_code(spark, d):
    return _facts(spark, d).select("asset_id", P.tests_use_code("facts", "tests").alias("used"))


@query("fact_hollow", """
    SELECT p_partkey AS asset_id, unnest(['f_' || p_partkey, 'g_' || p_partkey]) AS function
    FROM part WHERE p_partkey % 16 = 4""")
def fact_hollow(spark, d):
    return _facts(spark, d).select("asset_id", F.explode(P.hollow_functions("facts"))
                                   .alias("function"))


@query("fact_heavy_imports", """
    SELECT p_partkey AS asset_id, unnest(['pandas', 'torch']) AS module
    FROM part WHERE p_partkey % 16 = 5""")
def fact_heavy_imports(spark, d):
    return _facts(spark, d).select("asset_id", F.explode(P.heavy_imports("facts"))
                                   .alias("module"))


def _findings(spark, d):
    return _facts(spark, d).select(
        "asset_id", F.posexplode(P.security_findings("facts", "code")).alias("position", "f")
    ).select("asset_id", "position", "f.lineno", "f.message", F.lit("high").alias("severity"))


_FINDINGS = """
    SELECT p_partkey AS asset_id, unnest(CASE p_partkey % 16
      WHEN 6 THEN [1, 4] WHEN 7 THEN [4] WHEN 8 THEN [2] ELSE [] END) AS lineno,
      unnest(CASE p_partkey % 16
      WHEN 6 THEN ['Potential hardcoded secret in variable ''API_KEY''',
                   'Dangerous usage of ''eval'' detected.']
      WHEN 7 THEN ['Subprocess ''run'' called with shell=True.']
      WHEN 8 THEN ['Potential SQL injection detected: String concatenation in SQL query']
      ELSE [] END) AS message FROM part"""


@query("fact_security", _FINDINGS)
def fact_security(spark, d):
    return _findings(spark, d).select("asset_id", "lineno", "message")


@query("vulnerability_score", f"""
    SELECT asset_id, (100 - 40 * count(*))::DOUBLE AS score,
           string_agg('L' || lineno || ': ' || message, '; ' ORDER BY lineno) AS reason
    FROM ({_FINDINGS}) GROUP BY asset_id""")
def vulnerability_score(spark, d):
    return S.vulnerability_score(_findings(spark, d))


@query("fact_function_metrics", """
    SELECT p_partkey AS asset_id, CASE WHEN u = 0 THEN 'f_' ELSE 'g_' END || p_partkey AS function,
           CASE WHEN t = 10 THEN 13 ELSE 1 END AS complexity,
           CASE WHEN t = 11 THEN 7 WHEN t IN (0, 1, 2, 3, 8) THEN 2
                WHEN t = 4 AND u = 1 THEN 0 ELSE 1 END AS params
    FROM (SELECT p_partkey, p_partkey % 16 AS t, unnest(CASE WHEN p_partkey % 16 IN (4, 14)
            THEN [0, 1] ELSE [0] END) AS u FROM part)
    WHERE t < 12 OR t = 14""")
def fact_function_metrics(spark, d):
    return _facts(spark, d).select(
        "asset_id", F.explode(P.of_kind("facts", "function")).alias("f")).select(
        "asset_id", F.col("f.name").alias("function"), F.col("f.size").alias("complexity"),
        F.col("f.params").alias("params"))


@query("metrics_score", f"""
    SELECT p_partkey AS asset_id, ([100, 100, 100, 100, 100, 100, 100, 100, 100, 100, 55, 70, 0, 0,
      100])[p_partkey % 16 + 1]::DOUBLE AS score FROM part WHERE {_PYTHON}""")
def metrics_score(spark, d):
    return _facts(spark, d).select("asset_id", P.metrics_score("facts").alias("score"))


@query("fact_python_static", f"""
    SELECT p_partkey AS asset_id, ([100, 100, 100, 100, 90, 100, 100, 100, 100, 95, 100, 100, 0, 0,
      75])[p_partkey % 16 + 1]::DOUBLE AS score FROM part WHERE {_PYTHON}""")
def fact_python_static(spark, d):
    return _facts(spark, d).select("asset_id", P.python_static_score("facts").alias("score"))


@query("fact_syntax_error", """
    SELECT p_partkey AS asset_id, 0.0::DOUBLE AS security, 0.0::DOUBLE AS dependency,
           0.0::DOUBLE AS metrics, 0.0::DOUBLE AS static, 0 AS hollow
    FROM part WHERE p_partkey % 16 IN (12, 13)""")
def fact_syntax_error(spark, d):
    # A one-element explode keeps the filter above the parse, which else runs twice.
    rows = _facts(spark, d).select("asset_id", "code", F.explode(F.array("facts")).alias("facts"))
    return rows.where(P.broken("facts")).select(
        "asset_id", P.security_score("facts", "code").alias("security"),
        P.dependency_score("facts").alias("dependency"),
        P.metrics_score("facts").alias("metrics"),
        P.python_static_score("facts").alias("static"),
        F.size(P.hollow_functions("facts")).alias("hollow"))


@query("undeclared_imports", """
    SELECT asset_id, missing, CAST(100 - 30 * n AS DOUBLE) AS score
    FROM (SELECT p_partkey AS asset_id, CASE p_partkey % 16 WHEN 7 THEN 'subprocess'
            WHEN 9 THEN 'ghost_lib,phantom_pkg.sub' ELSE '' END AS missing,
            CASE p_partkey % 16 WHEN 7 THEN 1 WHEN 9 THEN 2 ELSE 0 END AS n
          FROM part WHERE p_partkey % 16 < 15)""")
def undeclared_imports(spark, d):
    """Declared packages come from manifests made of the parts."""
    declared = V.table(spark, d, "part").select(F.explode(C.requirement_packages(F.concat(
        F.lit("numpy>=1\npandas\ntorch==2\npart_"), F.col("p_partkey").cast("string")))
    ).alias("package")).distinct()
    stdlib = spark.createDataFrame([(m,) for m in K.STDLIB_MODULES], "module string")
    imports = _facts(spark, d).select(
        "asset_id", F.explode_outer(P.imported_modules("facts")).alias("module"))
    return S.undeclared_imports(imports, stdlib, declared).withColumn(
        "missing", F.array_join("missing", ","))


@query("deterministic_score", _by_template("score", [
    100, 60, 0, 50, 40, 90, 100, 100, 100, 100, 100, 100, 100, None, 100, 80], "DOUBLE"))
def deterministic_score(spark, d):
    """Badly nested code is rejected before it is parsed and has no score."""
    return _scores(spark, d).select("asset_id", F.when(
        F.col("structural") > 0, F.col("deterministic")).alias("score"))


_GATE = [100, 78.1818, 0, 72.7273, 66.0606, 94.5455, 0, 91.5152, 95.1515, 0, 95.9091, 97.2727, 0,
         0, 96.9697, 89.0909]
_STAGE = ["weighted", "weighted", "deterministic", "weighted", "weighted", "weighted", "security",
          "weighted", "weighted", "dependency", "weighted", "weighted", "security", "structural",
          "weighted", "weighted"]


@query("code_gate", f"""
    SELECT p_partkey AS asset_id, (({_GATE})[p_partkey % 16 + 1])::DOUBLE AS score,
           ({_STAGE})[p_partkey % 16 + 1] AS stage,
           CASE WHEN ({_GATE})[p_partkey % 16 + 1] >= 70 THEN 'verified' ELSE 'failed' END
             AS status FROM part""")
def code_gate(spark, d):
    """From source text to verdict in one pass, without a shuffle of texts."""
    wide = _scores(spark, d).withColumns({
        "is_draft": F.lit(False), "has_test": F.length("test_code") > 0,
        "no_error": F.lit(False)})
    gated = S.quality_gate(wide)
    status, _ = S.verdict("score", "no_error")
    return gated.select("asset_id", F.round("score", 4).alias("score"), "stage",
                        status.alias("status"))


@query("gate_survivors", """
    SELECT p_partkey AS asset_id, p_partkey % 16 AS template FROM part
    WHERE p_partkey % 16 NOT IN (12, 13, 15)""")
def gate_survivors(spark, d):
    """Native checks first, then the parser on what is left."""
    rows = V.code_assets(spark, d).where(
        C.brackets_balanced("code") & (F.length("test_code") > 0) & (F.col("language") == "python"))
    return rows.withColumn("facts", P.code_facts("code")).where(~P.broken("facts")).select(
        "asset_id", F.col("template").cast("long").alias("template"))


# ---- gate -----------------------------------------------------------------------------

GATE = ("evaluations", "wide", "gated")


def _wide(spark, d):
    pivoted = S.pivot_evaluations(V.evaluation_rows(spark, d))
    return V.gate_assets(spark, d).join(pivoted, "asset_id", "left")


def _gated(spark, d):
    return S.quality_gate(_wide(spark, d))


@query("quality_gate", with_views(
    "SELECT asset_id, round(score, 6) AS score, stage FROM gated", *GATE))
def quality_gate(spark, d):
    return _gated(spark, d).select("asset_id", F.round("score", 6).alias("score"), "stage")


@query("weighted_gate_sum", with_views("""
    , layers AS (
      SELECT asset_id, evaluator AS layer, score FROM evaluations
      WHERE evaluator IN ('deterministic', 'runtime', 'ai_gate', 'metrics_gate')
      UNION ALL
      SELECT asset_id, 'static', avg(score) FROM evaluations
      WHERE evaluator IN ('security_static', 'dependency_vouch') GROUP BY asset_id)
    SELECT asset_id, round(sum(score * w) / sum(w), 6) AS score
    FROM layers JOIN (VALUES ('deterministic', 0.30::DOUBLE), ('runtime', 0.30), ('static', 0.20),
      ('ai_gate', 0.15), ('metrics_gate', 0.05)) v(layer, w) USING (layer)
    GROUP BY asset_id""", "evaluations"))
def weighted_gate_sum(spark, d):
    """The weighted mean over all layers, the static one among them."""
    return S.weighted_gate(V.evaluations(spark, d), V.gate_assets(spark, d)).select(
        "asset_id", F.round("score", 6).alias("score"))


@query("static_average", with_views("""
    SELECT asset_id, round(list_avg([sec, dep, CASE WHEN asset_id % 3 = 0 THEN met
             WHEN asset_id % 3 = 1 THEN coalesce(runtime, met) ELSE det END]), 6) AS score
    FROM wide""", "evaluations", "wide"))
def static_average(spark, d):
    """Other columns stand in for linters: the last row kind is JavaScript."""
    wide = _wide(spark, d).withColumns({
        "language": F.when(F.col("asset_id") % 3 == 2, "javascript").otherwise("Python"),
        "ruff": F.when(F.col("asset_id") % 3 == 1, F.col("runtime")),
        "python_static": F.col("metrics_gate"), "eslint": F.col("deterministic")})
    return wide.select("asset_id", F.round(S.static_average(), 6).alias("score"))


@query("verdict", with_views("""
    SELECT asset_id, CASE WHEN asset_id % 13 = 0 THEN 'error' WHEN round(score, 10) >= 70
             THEN 'verified' ELSE 'failed' END AS status,
           round(score / 100.0, 6) AS reliability FROM gated""", *GATE))
def verdict(spark, d):
    rows = _gated(spark, d).withColumn("faulty", F.col("asset_id") % 13 == 0)
    status, reliability = S.verdict("score", "faulty")
    return rows.select("asset_id", status.alias("status"),
                       F.round(reliability, 6).alias("reliability"))


_STAGE_SAYS = "CASE stage " + " ".join(
    f"WHEN '{k}' THEN '{v}'" for k, v in K.STAGE_REASONS.items()) + " END"


@query("verification_report", with_views(f"""
    SELECT g.asset_id, round(g.score, 6) AS score, g.stage, count(e.asset_id) AS evaluators,
           concat_ws(' | ', any_value({_STAGE_SAYS}), nullif(string_agg(
             evaluator || ': ' || reason, ' | ' ORDER BY evaluator), '')) AS reason,
           max(e.score) FILTER (evaluator = 'runtime') AS runtime
    FROM gated g LEFT JOIN evaluations e ON e.asset_id = g.asset_id
    GROUP BY g.asset_id, g.score, g.stage""", *GATE))
def verification_report(spark, d):
    reports_ = S.verification_report(_gated(spark, d), V.evaluation_rows(spark, d))
    return reports_.select(
        "asset_id", F.round("score", 6).alias("score"), "stage", "reason",
        F.size("details").cast("long").alias("evaluators"),
        F.col("details")["runtime"]["score"].alias("runtime"))


@query("report_details", with_views("""
    SELECT g.asset_id, e.evaluator, max(e.score)::DOUBLE AS score, l_linenumber::BIGINT AS line,
           count(*) AS parts, max(l_extendedprice)::DOUBLE AS price
    FROM gated g JOIN evaluations e ON e.asset_id = g.asset_id
    JOIN lineitem ON l_orderkey = e.asset_id AND 'line ' || l_linenumber = e.reason
    GROUP BY ALL""", *GATE))
def report_details(spark, d):
    """What each evaluator kept beside its score, read out of stored reports."""
    measured = V.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.count("*").alias("parts"), F.max("l_extendedprice").alias("price"))
    own = measured.select(
        F.col("l_orderkey").alias("asset_id"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("reason"),
        F.to_variant_object(F.struct(
            F.col("l_linenumber").alias("line"), F.struct("parts", "price").alias("found")))
        .alias("details"))
    evaluations = V.evaluation_rows(spark, d).join(own, ["asset_id", "reason"])
    stored = cut_lineage(S.verification_report(_gated(spark, d), evaluations), "reports")
    each = stored.select("asset_id", F.explode("details").alias("evaluator", "r"))

    def kept(path, kind):
        return F.variant_get("r.details", path, kind)

    return each.select(
        "asset_id", "evaluator", "r.score", kept("$.line", "long").alias("line"),
        kept("$.found.parts", "long").alias("parts"),
        kept("$.found.price", "double").alias("price"))


@query("evaluator_plugins", """
    SELECT doc_id AS asset_id, 'structural' AS evaluator, CASE WHEN list_reduce(list_concat([''],
      regexp_extract_all(text, '[()\\[\\]{}]')), lambda s, c: CASE
        WHEN c IN ('(', '[', '{') THEN s || c
        WHEN (c = ')' AND right(s, 1) = '(') OR (c = ']' AND right(s, 1) = '[')
          OR (c = '}' AND right(s, 1) = '{') THEN left(s, length(s) - 1)
        ELSE s || '!' END) = '' THEN 100 ELSE 0 END::DOUBLE AS score, false AS is_system_error
    FROM documents
    UNION ALL
    SELECT doc_id, 'words', CASE WHEN lang = 'es' THEN 0
      ELSE least(100, length(text) - length(replace(text, ' ', ''))) END::DOUBLE, lang = 'es'
    FROM documents""")
def evaluator_plugins(spark, d):
    """A built-in and a user evaluator; the latter fails on one language."""
    def judge(text, language):
        if language == "es":
            raise ValueError("no judge for es")
        return min(100, text.count(" ")), "spaces"

    assets = V.table(spark, d, "documents").select(
        F.col("doc_id").alias("asset_id"), F.col("text").alias("code"),
        F.col("lang").alias("language"))
    plugins = {**S.PLUGINS, "words": S.python_row_evaluator("words", judge)}
    return S.evaluate(assets, plugins).drop("reason")


# ---- findings ---------------------------------------------------------------------------

@query("lint_score", with_views("""
    SELECT asset_id, count(*) AS issues, greatest(0, 100 - 2 * count(*))::DOUBLE AS score,
           string_agg('[' || code || '] L' || line || ': ' || message, ' | ' ORDER BY seq)
             FILTER (n <= 5)
           || CASE WHEN count(*) > 5 THEN ' ...and ' || (count(*) - 5) || ' more issues.'
              ELSE '' END AS reason
    FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS n FROM lint)
    GROUP BY asset_id""", "lint"))
def lint_score(spark, d):
    return S.lint_score(V.lint_findings(spark, d))


@query("eslint_score", with_views("""
    SELECT asset_id, greatest(0, 100 - sum(CASE severity WHEN 2 THEN 5.0 ELSE 1.0 END))::DOUBLE
             AS score, count(*) AS issues FROM lint GROUP BY asset_id""", "lint"))
def eslint_score(spark, d):
    return S.eslint_score(V.lint_findings(spark, d))


@query("lint_density_score", with_views("""
    SELECT doc_id, score, CASE WHEN score >= 80 THEN 'high' WHEN score >= 50 THEN 'medium'
           ELSE 'low' END AS reliability
    FROM (SELECT doc_id, CAST(trunc(greatest(0, 100 - round(least(coalesce(e.n, 0) * 500.0
                   / (1 + length(text) - length(replace(text, chr(10), ''))), 70)
                 + CASE WHEN doc_id % 4 = 0 THEN 30 ELSE 0 END + (doc_id % 3) * 10, 9))) AS INTEGER)
                 AS score
          FROM documents LEFT JOIN (SELECT asset_id, count(*) AS n FROM lint GROUP BY ALL) e
            ON e.asset_id = doc_id)""", "lint"))
def lint_density_score(spark, d):
    from stacklore.functions.replies import reliability_tier

    errors = V.lint_findings(spark, d).groupBy("asset_id").agg(F.count("*").alias("errors"))
    rows = V.table(spark, d, "documents").join(
        errors, F.col("asset_id") == F.col("doc_id"), "left").select(
        "doc_id", F.coalesce("errors", F.lit(0)).alias("errors"),
        (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"),
        (F.col("doc_id") % 4 != 0).alias("formatted"),
        (F.col("doc_id") % 3 * 10).alias("penalty"))
    return rows.select("doc_id", S.lint_density_score(
        "errors", "lines", "formatted", "penalty").alias("score")).withColumn(
        "reliability", reliability_tier("score"))


# ---- drafts -------------------------------------------------------------------------------

def _stabilised(spark, d):
    flat = V.assets_flat(spark, d)
    # Labelled documents were run; the others have no result.
    results = flat.where("verification_status <> 'pending'").select(
        "project", "name", F.when(F.col("verification_status") == "verified", 100.0)
        .otherwise(0.0).alias("runtime_score"), F.lit("Logic error").alias("reason"))
    return S.stabilise_drafts(catalogue.draft_filter(flat), results)


_STABLE = """stable AS (
    SELECT project, name, CASE WHEN doc_id % 5 = 0 THEN 'skipped'
             WHEN verification_status = 'verified' THEN 'promoted' ELSE 'failed' END AS outcome,
           CASE verification_status WHEN 'pending' THEN 'no result' ELSE 'Logic error' END
             AS reason,
           description, reliability_score
    FROM assets_flat WHERE contains(description, '[AI-DRAFT]'))"""
_STABLE_SQL = with_views("", "assets_flat").rstrip() + ", " + _STABLE


@query("stabilise_drafts", _STABLE_SQL + """
    SELECT project, name, outcome, md5(CASE outcome
             WHEN 'promoted' THEN replace(description, '[AI-DRAFT]', '[VERIFIED]')
             WHEN 'failed' THEN description || chr(10) || '(Validation Failed: ' || reason || ')'
             ELSE description END) AS description_md5,
           CASE outcome WHEN 'promoted' THEN 1.0 WHEN 'failed' THEN 0.0
             ELSE reliability_score END AS reliability FROM stable""")
def stabilise_drafts(spark, d):
    return _stabilised(spark, d).select(
        "project", "name", "outcome", F.md5("new_description").alias("description_md5"),
        F.col("new_reliability").alias("reliability"))


@query("stabilise_summary", _STABLE_SQL + """
    SELECT outcome, count(*) AS assets FROM stable GROUP BY outcome""")
def stabilise_summary(spark, d):
    return reports.stabilise_summary(_stabilised(spark, d))
