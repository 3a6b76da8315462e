"""The derived tables of ``views`` as SQL, for checking results."""

from stacklore.plans import views as V

_SPACE = " || ".join(f"chr({n})" for n in [
    9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 133, 160, 5760, *range(8192, 8203), 8232, 8233,
    8239, 8287, 12288])


def code_hash(text):
    return f"sha256(replace(trim({text}, {_SPACE}), chr(13) || chr(10), chr(10)))"


def text(value):
    return "'" + value.replace("'", "''") + "'"


def pick(values, index):
    return f"([{', '.join(text(v) for v in values)}])[({index}) + 1]"


def template(values, index, key):
    return f"replace({pick(values, index)}, '{{k}}', CAST({key} AS VARCHAR))"


_DESCRIPTION = "CASE WHEN doc_id % 3 = 0 THEN '[AI-DRAFT] ' ELSE '' END || text"
_TAGS = "[lang, source, CASE WHEN n_chars > 1000 THEN 'long' ELSE 'short' END]"
_START = "TIMESTAMP '2024-01-01'"


def stamp(expression):
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S')"


VIEWS = {
    "save_log": f"""
        SELECT lang AS project, 'fn_' || (doc_id % 40) AS name, text AS code, lang AS language,
               {_DESCRIPTION} AS description, {_TAGS} AS tags, doc_id * 2 + again AS seq,
               {_START} + to_minutes(doc_id * 2 + again) AS ts, {code_hash('text')} AS code_hash
        FROM documents, (VALUES (0), (1)) v(again) WHERE again = 0 OR doc_id % 10 = 0""",
    "versions": """
        SELECT *, CAST(sum(CASE WHEN is_new_version THEN 1 ELSE 0 END) OVER (
                 PARTITION BY project, name ORDER BY seq) AS INTEGER) AS version
        FROM (SELECT *, lag(code_hash) OVER (PARTITION BY project, name ORDER BY seq)
                        IS DISTINCT FROM code_hash AS is_new_version FROM save_log)""",
    "current_assets": """
        SELECT * FROM versions
        QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY seq DESC) = 1""",
    "intervals": """
        SELECT project, name, version, code_hash, ts AS started_at,
               lead(ts) OVER (PARTITION BY project, name ORDER BY seq) AS archived_at
        FROM versions WHERE is_new_version""",
    "assets_flat": f"""
        SELECT d.doc_id, source AS project, 'doc_' || d.doc_id AS name, text AS code,
               lang AS language, {_DESCRIPTION.replace('doc_id', 'd.doc_id')} AS description,
               {_TAGS} AS tags,
               CASE WHEN d.doc_id % 5 = 0 THEN '' ELSE 'assert run()' END AS test_code,
               CASE quality WHEN 1 THEN 1.0 WHEN 0 THEN 0.4 ELSE 0.0 END::DOUBLE
                 AS reliability_score,
               CASE quality WHEN 1 THEN 'verified' WHEN 0 THEN 'failed' ELSE 'pending' END
                 AS verification_status,
               n_chars % 10 AS call_count, {code_hash('text')} AS code_hash, 1 AS version,
               {_START} + to_minutes(d.doc_id) AS created_at,
               {_START} + to_minutes(d.doc_id + n_chars % 5000) AS updated_at
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "vectors": """
        SELECT source AS project, 'doc_' || doc_id AS name, label, doc_id,
               embedding::DOUBLE[] AS raw,
               list_transform(embedding::DOUBLE[], lambda x: x / sqrt(list_dot_product(
                 embedding::DOUBLE[], embedding::DOUBLE[]))) AS embedding
        FROM embeddings JOIN documents ON vec_id = doc_id""",
    "search_queries": f"""
        SELECT query_id, {pick(V.SEARCH_WORDS, 'query_id % 8')} AS text, embedding,
               CASE WHEN label % 2 = 1 THEN project END AS project
        FROM (SELECT label, project,
                     CAST(label * 1000 + CAST(substr(project, 4) AS INTEGER) AS BIGINT) AS query_id,
                     list_transform(mean, lambda x: x / sqrt(list_dot_product(mean, mean))) AS embedding
              FROM (SELECT label, project, list(x ORDER BY pos) AS mean
                    FROM (SELECT label, project, pos, avg(x) AS x
                          FROM (SELECT label, project, unnest(raw) AS x,
                                       generate_subscripts(raw, 1) AS pos FROM vectors)
                          GROUP BY ALL) GROUP BY ALL))""",
    "cosines": """
        SELECT query_id, v.project, v.name,
               round(list_dot_product(q.embedding, v.embedding), 6) AS similarity
        FROM search_queries q JOIN vectors v ON q.project IS NULL OR q.project = v.project""",
    "vector_hits": """
        SELECT *, row_number() OVER (
                 PARTITION BY query_id ORDER BY similarity DESC, project, name) AS rank
        FROM cosines QUALIFY rank <= 5""",
    "keyword_hits": """
        SELECT query_id, a.project, a.name, 0.9::DOUBLE AS similarity
        FROM search_queries q JOIN assets_flat a
          ON (q.project IS NULL OR q.project = a.project)
         AND (contains(lower(a.name), q.text) OR contains(lower(a.description), q.text))""",
    "hybrid": """
        SELECT *, row_number() OVER (
                 PARTITION BY query_id ORDER BY similarity DESC, project, name) AS rank
        FROM (SELECT query_id, project, name, max(similarity) AS similarity
              FROM (SELECT * FROM cosines UNION ALL SELECT * FROM keyword_hits) GROUP BY ALL)""",
    "evaluations": f"""
        SELECT l_orderkey AS asset_id,
               {pick(V.EVALUATOR_OF_LINE, 'l_linenumber - 1')} AS evaluator,
               CASE WHEN l_linenumber <= 3 AND q * 2 < 10 THEN 0.0 ELSE q * 2.0 END AS score,
               'line ' || l_linenumber AS reason
        FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)""",
    "wide": """
        SELECT o_orderkey AS asset_id, o_orderpriority = '5-LOW' AS is_draft,
               o_orderstatus <> 'P' AS has_test, p.* EXCLUDE (asset_id)
        FROM orders LEFT JOIN (
          SELECT asset_id, max(score) FILTER (evaluator = 'structural') AS structural,
                 max(score) FILTER (evaluator = 'deterministic') AS det,
                 max(score) FILTER (evaluator = 'runtime') AS runtime,
                 max(score) FILTER (evaluator = 'security_static') AS sec,
                 max(score) FILTER (evaluator = 'dependency_vouch') AS dep,
                 max(score) FILTER (evaluator = 'ai_gate') AS ai,
                 max(score) FILTER (evaluator = 'metrics_gate') AS met
          FROM evaluations GROUP BY asset_id) p ON p.asset_id = o_orderkey""",
    "gated": """
        SELECT *, CASE stage WHEN 'missing_tests' THEN 40.0 WHEN 'ai_cap' THEN least(raw, ai)
                    WHEN 'weighted' THEN raw ELSE 0.0 END AS score
        FROM (SELECT *, CASE
                WHEN NOT is_draft AND NOT has_test THEN 'missing_tests'
                WHEN structural = 0 THEN 'structural'
                WHEN sec < 60 THEN 'security'
                WHEN dep < 70 THEN 'dependency'
                WHEN det = 0 THEN 'deterministic'
                WHEN runtime = 0 AND NOT is_draft THEN 'runtime'
                WHEN raw IS NULL THEN 'no_evaluators'
                WHEN ai < 30 THEN 'ai_veto' WHEN ai < 70 THEN 'ai_cap'
                ELSE 'weighted' END AS stage
              FROM (SELECT *, (coalesce(det * .30, 0) + coalesce(runtime * .30, 0)
                      + coalesce(stat * .20, 0) + coalesce(ai * .15, 0) + coalesce(met * .05, 0))
                    / nullif((CASE WHEN det IS NULL THEN 0 ELSE .30 END
                      + CASE WHEN runtime IS NULL THEN 0 ELSE .30 END
                      + CASE WHEN stat IS NULL THEN 0 ELSE .20 END
                      + CASE WHEN ai IS NULL THEN 0 ELSE .15 END
                      + CASE WHEN met IS NULL THEN 0 ELSE .05 END)::DOUBLE, 0) AS raw
                    FROM (SELECT *, list_avg([sec, dep]) AS stat FROM wide)))""",
    "lint": """
        SELECT user_id AS asset_id, event_id AS seq,
               CAST(json_extract_string(props, '$.k') AS INTEGER) AS line,
               CAST(event_id % 2 + 1 AS INTEGER) AS severity,
               'E' || json_extract_string(props, '$.k') AS code, 'finding ' || event_id AS message
        FROM events WHERE event_type = 'error'""",
    "ci": f"""
        SELECT event_id, value, {pick(V.SYSTEMS, 'user_id % 3')} AS os,
               CAST(18 + user_id % 2 * 2 AS VARCHAR) AS node,
               {pick(V.PYTHONS, 'event_id % 4')} AS python, ts,
               {stamp('ts')} AS timestamp, CASE WHEN value > 10 THEN 'Pass' ELSE 'Fail' END AS status
        FROM events""",
    "cand": """
        SELECT user_id AS query_id, n - 1 AS position, 'ev_' || event_id AS name,
               event_type AS description, props AS code
        FROM (SELECT *, row_number() OVER (
                PARTITION BY user_id ORDER BY value DESC, event_id) AS n FROM events)""",
    "code_assets": f"""
        SELECT p_partkey AS asset_id, p_partkey % 16 AS t,
               {template([c for c, _ in V.CODE_TEMPLATES], 'p_partkey % 16', 'p_partkey')} AS code,
               {template([t for _, t in V.CODE_TEMPLATES], 'p_partkey % 16', 'p_partkey')}
                 AS test_code
        FROM part""",
}


def with_views(body, *names):
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    return f"WITH {parts} {body}"
