"""Queries on the catalogue: sources, filters, saves, joins and set operations."""

from pyspark.sql import functions as F

from stacklore.functions import text as X
from stacklore.operators import catalogue as C, replay, reports
from stacklore.plans import views as V
from stacklore.plans.registry import query
from stacklore.plans.sql_views import code_hash, pick, stamp, template, with_views
from stacklore.session import scratch_dir
from stacklore.sources import ci, mirror, units

FLAT = ("assets_flat",)
LOG = ("save_log",)


def _time(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _joined(c):
    return F.array_join(c, ",").alias(c)


# ---- sources ---------------------------------------------------------------------

@query("catalogue_scan", """
    SELECT CASE WHEN doc_id % 7 = 0 OR doc_id % 11 = 0 THEN 'default' ELSE source END AS project,
           'doc_' || doc_id AS name, lang || ',' || source AS tags, n_chars FROM documents""")
def catalogue_scan(spark, d):
    raw = V.table(spark, d, "documents").select(
        F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, None)
        .otherwise(F.col("source")).alias("project"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"),
        F.to_json(F.array("lang", "source")).alias("tags"), "n_chars")
    rows = mirror.json_decode(C.scan(raw), "tags")
    return rows.select("project", "name", _joined("tags"), "n_chars")


@query("json_columns_decode", """
    SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a,b' WHEN 3 THEN source END AS tags,
           CASE WHEN doc_id % 4 = 2 THEN '["unclosed' END AS tags_raw FROM documents""")
def json_columns_decode(spark, d):
    raw = V.table(spark, d, "documents").select("doc_id", F.when(
        F.col("doc_id") % 4 == 0, '["a", "b"]').when(F.col("doc_id") % 4 == 1, "").when(
        F.col("doc_id") % 4 == 2, '["unclosed').otherwise(F.to_json(F.array("source")))
        .alias("tags"))
    return mirror.json_decode(raw, "tags").select("doc_id", _joined("tags"), "tags_raw")


@query("mirror_read", with_views(f"""
    SELECT project, name, language, language <> 'es' AS code_from_file,
           {code_hash("CASE WHEN language = 'es' THEN code ELSE code || ' edited' END")}
             AS code_hash,
           array_to_string(tags, ',') AS tags FROM assets_flat""", *FLAT))
def mirror_read(spark, d):
    """Files edited by hand: their code wins; Spanish assets have no code file."""
    path = scratch_dir(spark, "mirror")
    flat = V.assets_flat(spark, d).select(
        "doc_id", "project", "name", "code", "language", "tags", "code_hash")
    mirror.write_metadata(flat.withColumn("folder", F.col("project")).withColumn(
        "project", F.when(F.col("doc_id") % 2 == 0, F.col("project"))).drop("doc_id"), path)
    mirror.write_code(flat.where("language <> 'es'").withColumn(
        "code", F.concat("code", F.lit(" edited"))), path)
    return mirror.mirror_read(spark, path).select(
        "project", "name", "language", "code_from_file", "code_hash", _joined("tags"))


@query("mirror_export", with_views("""
    SELECT project, name, language, 'txt' AS extension, code_hash, description, call_count,
           array_to_string(tags, ',') AS tags FROM assets_flat""", *FLAT))
def mirror_export(spark, d):
    path = scratch_dir(spark, "mirror")
    mirror.mirror_export(V.assets_flat(spark, d).select(
        "project", "name", "code", "language", "tags", "description", "call_count"), path)
    back = mirror.mirror_read(spark, path)
    files = spark.read.parquet(f"{path}/code").select("project", "name", "extension")
    return back.join(files, C.KEY).select(
        "project", "name", "language", "extension", "code_hash", "description", "call_count",
        _joined("tags"))


@query("mirror_export_tree", with_views("""
    SELECT project, name, language, true AS code_from_file, code_hash, description, call_count,
           array_to_string(tags, ',') AS tags FROM assets_flat""", *FLAT))
def mirror_export_tree(spark, d):
    """One code file and one metadata file per asset, written and read back."""
    path = scratch_dir(spark, "mirror")
    mirror.mirror_write_tree(V.assets_flat(spark, d).select(
        "project", "name", "code", "language", "tags", "description", "call_count"), path)
    return mirror.mirror_read_tree(spark, path).select(
        "project", "name", "language", "code_from_file", "code_hash", "description",
        "call_count", _joined("tags"))


@query("mirror_open_fields", with_views("""
    SELECT a.project, a.name, d.n_chars::BIGINT AS n_chars, d.lang,
           CASE WHEN a.doc_id % 3 = 0 THEN a.doc_id END AS ticket,
           CASE WHEN a.doc_id % 3 = 0 THEN 2 ELSE 1 END AS others
    FROM assets_flat a JOIN documents d ON d.doc_id = a.doc_id""", *FLAT))
def mirror_open_fields(spark, d):
    """Metadata fields that no schema knows, through an export and an import."""
    path = scratch_dir(spark, "mirror")
    source = V.table(spark, d, "documents").select("doc_id", F.struct("n_chars", "lang").alias(
        "measured"), F.when(F.col("doc_id") % 3 == 0, F.to_json(F.struct(F.struct(
            "doc_id").alias("review note")))).alias("open"))
    rows = V.assets_flat(spark, d).join(source, "doc_id").withColumn(
        "extra", F.from_json("open", "map<string,variant>"))
    mirror.mirror_export(rows.select(
        "project", "name", "code", "language", "measured", "extra"), path)
    back = mirror.mirror_read(spark, path)
    return back.select(
        "project", "name",
        F.variant_get(F.col("extra")["measured"], "$.n_chars", "long").alias("n_chars"),
        F.variant_get(F.col("extra")["measured"], "$.lang", "string").alias("lang"),
        F.variant_get(F.col("extra")["review note"], "$.doc_id", "long").alias("ticket"),
        F.size("extra").alias("others"))


@query("mirror_join", with_views(f"""
    SELECT project, name, language, {code_hash("coalesce(p.html, a.code)")} AS code_hash,
           p.html IS NOT NULL AS code_from_file
    FROM assets_flat a LEFT JOIN pages p ON a.doc_id = p.page_id""", *FLAT))
def mirror_join(spark, d):
    """Metadata of documents joined to code files made from pages."""
    meta = V.assets_flat(spark, d).select("doc_id", "project", "name", "code", "language")
    files = V.table(spark, d, "pages").withColumnRenamed("page_id", "doc_id").join(
        meta.drop("code"), "doc_id").select(
        "project", "name", "language", F.col("html").alias("code"))
    return mirror.mirror_join(meta, files).select(
        "project", "name", "language", "code_hash", "code_from_file")


@query("delete_and_archive", with_views("""
    SELECT project, name, CASE WHEN toxic = 1 THEN 'archived' ELSE 'live' END AS state,
           CASE WHEN toxic = 1 THEN '2024-06-01 00:00:00' END AS archived_at
    FROM assets_flat a LEFT JOIN labels l ON a.doc_id = l.doc_id""", *FLAT))
def delete_and_archive(spark, d):
    keys = V.table(spark, d, "labels").where("toxic = 1").join(
        V.document_keys(spark, d), "doc_id")
    live, archived = C.delete_and_archive(
        V.assets_flat(spark, d).select(*C.KEY, "code_hash"), keys, "2024-06-01 00:00:00")
    return live.select(*C.KEY, F.lit("live").alias("state"),
                       F.lit(None).cast("string").alias("archived_at")).unionByName(
        archived.select(*C.KEY, F.lit("archived").alias("state"), _time("archived_at")))


_UNITS = f"""
    SELECT p_partkey AS file_id, u.unit, u.lines,
           'vault_' || replace(lower(u.unit), '.', '_') AS name, {code_hash('u.code')} AS code_hash
    FROM (SELECT p_partkey, unnest(CASE p_partkey % 4
        WHEN 0 THEN [{{'unit': 'solve_' || p_partkey, 'lines': 3, 'code':
          'def solve_' || p_partkey || '(a):' || chr(10) || '    b = a + 1' || chr(10)
          || '    return b'}}]
        WHEN 1 THEN [{{'unit': 'Open', 'lines': 3, 'code': '    def Open(self):' || chr(10)
          || '        value = self.a' || chr(10) || '        return value'}},
          {{'unit': 'Box_' || p_partkey || '.Open', 'lines': 3, 'code': '    def Open(self):'
          || chr(10) || '        value = self.a' || chr(10) || '        return value'}}]
        WHEN 2 THEN [{{'unit': 'outer_' || p_partkey, 'lines': 5, 'code': 'def outer_' || p_partkey
          || '(a):' || chr(10) || '    def inner_' || p_partkey || '(b):' || chr(10)
          || '        c = b' || chr(10) || '        return c' || chr(10) || '    return inner_'
          || p_partkey || '(a)'}},
          {{'unit': 'inner_' || p_partkey, 'lines': 3, 'code': '    def inner_' || p_partkey
          || '(b):' || chr(10) || '        c = b' || chr(10) || '        return c'}}]
        ELSE [] END) AS u FROM part)"""


@query("code_units_extract", _UNITS)
def code_units_extract(spark, d):
    found = units.registrable(units.code_units(V.module_files(spark, d), "vault_"))
    return found.select("file_id", "unit", "lines", "name", X.code_hash("code").alias("code_hash"))


@query("unit_change_scan", f"""
    SELECT CASE WHEN p_size > 40 THEN 'new' WHEN p_size % 2 = 0 THEN 'skip' ELSE 'update' END
             AS action, count(*) AS units
    FROM part JOIN ({_UNITS}) ON p_partkey = file_id GROUP BY ALL""")
def unit_change_scan(spark, d):
    """Units against a store that misses some and holds old text of others."""
    part = V.table(spark, d, "part").select(F.col("p_partkey").alias("file_id"), "p_size")
    found = units.registrable(units.code_units(V.module_files(spark, d), "vault_")).select(
        F.concat(F.lit("file_"), F.col("file_id").cast("string")).alias("project"),
        "name", "code", "file_id")
    stored = found.join(part.where("p_size <= 40"), "file_id").select(
        "project", "name",
        X.code_hash(F.when(F.col("p_size") % 2 == 0, F.col("code"))
                    .otherwise(F.concat("code", F.lit("\n# old")))).alias("code_hash"))
    return units.unit_change_scan(found.drop("file_id"), stored).groupBy("action").agg(
        F.count("*").alias("units"))


@query("ci_results_read", with_views("""
    SELECT os, node, python, status, timestamp FROM ci WHERE value >= 5""", "ci"))
def ci_results_read(spark, d):
    """Results written as JSON lines, the ones below 5 cut off in the middle."""
    path = scratch_dir(spark, "ci")
    good = F.to_json(F.struct("os", "node", "python", "status", "timestamp"))
    V.ci_results(spark, d).select(F.when(F.col("value") >= 5, good).otherwise(
        F.left(good, F.lit(20))).alias("value")).write.text(path)
    return ci.ci_results_read(spark, path).select("os", "node", "python", "status", "timestamp")


@query("schema_evolve", with_views("""
    SELECT 'default' AS project, name, language, 1.0::DOUBLE AS reliability_score,
           0::BIGINT AS call_count, 1 AS version, 'pending' AS verification_status,
           '' AS test_code, code_hash FROM assets_flat""", *FLAT))
def schema_evolve(spark, d):
    old = V.assets_flat(spark, d).select("name", "code", "description", "language", "code_hash")
    return C.schema_evolve(old.withColumn("organization", F.lit("x"))).select(
        "project", "name", "language", "reliability_score", "call_count", "version",
        "verification_status", "test_code", "code_hash")


# ---- filters -----------------------------------------------------------------------

@query("get_by_name", with_views("""
    SELECT k.project, k.name, coalesce(verification_status, 'not_found') AS verification_status,
           version
    FROM (SELECT 'src' || label AS project, 'doc_' || vec_id AS name FROM embeddings) k
    LEFT JOIN assets_flat a ON a.project = k.project AND a.name = k.name""", *FLAT))
def get_by_name(spark, d):
    keys = V.table(spark, d, "embeddings").select(
        F.concat(F.lit("src"), F.col("label").cast("string")).alias("project"),
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("name"))
    return C.get_by_name(V.assets_flat(spark, d), keys)


@query("get_by_hash", with_views(f"""
    SELECT project, name, code_hash FROM assets_flat a
    WHERE EXISTS (SELECT 1 FROM documents d WHERE 'src' || (d.doc_id % 20) = a.project
                  AND {code_hash('d.text')} = a.code_hash)""", *FLAT))
def get_by_hash(spark, d):
    hashes = V.table(spark, d, "documents").select(
        F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string")).alias("project"),
        X.code_hash("text").alias("code_hash"))
    return C.get_by_hash(V.assets_flat(spark, d).select(*C.KEY, "code_hash"), hashes)


@query("list_assets", with_views(f"""
    SELECT project, name, {stamp('updated_at')} AS updated_at FROM assets_flat
    WHERE list_contains(list_transform(tags, lambda x: lower(x)), 'long')
      AND list_contains(list_transform(tags, lambda x: lower(x)), 'en')
    ORDER BY assets_flat.updated_at DESC, project, name LIMIT 50""", *FLAT))
def list_assets(spark, d):
    return C.list_assets(V.assets_flat(spark, d), tags=["LONG", "en"]).select(
        *C.KEY, _time("updated_at"))


@query("summary_projection", with_views(f"""
    SELECT project, name, description, language, array_to_string(tags, ',') AS tags,
           reliability_score, version, {stamp('created_at')} AS created_at,
           {stamp('updated_at')} AS updated_at FROM assets_flat""", *FLAT))
def summary_projection(spark, d):
    return C.summary(V.assets_flat(spark, d)).select(
        *C.KEY, "description", "language", _joined("tags"), "reliability_score", "version",
        _time("created_at"), _time("updated_at"))


@query("draft_filter", with_views("""
    SELECT project, name, contains(upper(description), 'DRAFT') AS is_draft FROM assets_flat
    WHERE contains(description, '[AI-DRAFT]')""", *FLAT))
def draft_filter(spark, d):
    return C.draft_filter(V.assets_flat(spark, d)).select(
        *C.KEY, X.is_draft("description").alias("is_draft"))


@query("needs_enrichment", f"""
    SELECT item_id, length(d) < 10 OR n = 0 AS needed
    FROM (SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN '' WHEN 2 THEN 'short'
                 ELSE text END AS d, CASE WHEN item_id % 3 = 0 THEN 0 ELSE 1 END AS n
          FROM benchmark)""")
def needs_enrichment(spark, d):
    item = F.col("item_id")
    rows = V.table(spark, d, "benchmark").select(
        "item_id",
        F.when(item % 4 == 1, None).when(item % 4 == 2, "short").otherwise(F.col("text"))
        .alias("description"),
        F.when(item % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("t")))
        .alias("tags"))
    return rows.select("item_id", X.needs_enrichment("description", "tags").alias("needed"))


@query("description_audit", with_views("""
    SELECT project, name, reliability_score,
           CASE WHEN doc_id % 9 = 0 THEN 'EMPTY'
                ELSE 'EXISTS (length: ' || length(description) || ')' END AS status,
           CASE WHEN doc_id % 9 <> 0 THEN left(description, 100) END AS summary
    FROM assets_flat""", *FLAT))
def description_audit(spark, d):
    rows = V.assets_flat(spark, d).withColumn(
        "description", F.when(F.col("doc_id") % 9 != 0, F.col("description")))
    return rows.select(*C.KEY, "reliability_score", X.description_status("description")
                       .alias("status"), F.left("description", F.lit(100)).alias("summary"))


CURRENT_ENVIRONMENT = {"os": "Linux", "python_version": "3.11.4", "cpu_arch": "x86_64",
                       "execution_driver": "venv"}


@query("env_drift", """
    SELECT c_custkey, array_to_string(list_filter([
      CASE WHEN c_custkey % 3 <> 0 THEN 'OS mismatch: Stored=' || os || ', Current=Linux' END,
      CASE WHEN c_custkey % 4 <> 3 THEN 'Python Version Drift: Stored=' || py
           || ', Current=3.11.4' END,
      CASE WHEN c_custkey % 5 = 0 THEN 'Architecture Drift: Stored=arm64, Current=x86_64' END,
      CASE WHEN c_nationkey % 2 = 1
           THEN 'Execution Driver Change: Stored=docker, Current=venv' END],
      lambda x: x IS NOT NULL), ' | ') AS drift
    FROM (SELECT *, (['Linux', 'Windows', 'Darwin'])[c_custkey % 3 + 1] AS os,
                 '3.' || (8 + c_custkey % 4) || '.' || c_nationkey AS py FROM customer)""")
def env_drift(spark, d):
    key = F.col("c_custkey")
    stored = F.struct(
        V.pick(["Linux", "Windows", "Darwin"], key % 3).alias("os"),
        F.concat(F.lit("3."), (key % 4 + 8).cast("string"), F.lit("."),
                 F.col("c_nationkey").cast("string")).alias("python_version"),
        F.when(key % 5 == 0, "arm64").otherwise("x86_64").alias("cpu_arch"),
        F.when(F.col("c_nationkey") % 2 == 1, "docker").otherwise("venv")
        .alias("execution_driver"))
    rows = V.table(spark, d, "customer").select("c_custkey", stored.alias("stored"))
    return rows.select("c_custkey", F.array_join(
        X.env_drift("stored", CURRENT_ENVIRONMENT), " | ").alias("drift"))


# ---- saves -------------------------------------------------------------------------

@query("version_history", with_views("""
    SELECT project, name, seq, code_hash, version, is_new_version FROM versions""",
    "save_log", "versions"))
def version_history(spark, d):
    return C.version_history(V.narrow_log(spark, d).drop("ts"))


@query("current_state", with_views("""
    SELECT project, name, seq, version, code_hash, description FROM current_assets""",
    "save_log", "versions", "current_assets"))
def current_state(spark, d):
    return C.current_state(V.save_log(spark, d)).select(
        *C.KEY, "seq", "version", "code_hash", "description")


@query("history_intervals", with_views(f"""
    SELECT project, name, version, code_hash, {stamp('started_at')} AS started_at,
           {stamp('archived_at')} AS archived_at FROM intervals""",
    "save_log", "versions", "intervals"))
def history_intervals(spark, d):
    return C.history_intervals(V.narrow_log(spark, d)).select(
        *C.KEY, "version", "code_hash", _time("started_at"), _time("archived_at"))


AS_OF = "2024-01-01 12:00:00"


@query("as_of_state", with_views(f"""
    SELECT project, name, version, code_hash FROM intervals
    WHERE started_at <= TIMESTAMP '{AS_OF}'
      AND (archived_at IS NULL OR archived_at > TIMESTAMP '{AS_OF}')""",
    "save_log", "versions", "intervals"))
def as_of_state(spark, d):
    return C.as_of_state(V.narrow_log(spark, d), AS_OF).select(*C.KEY, "version", "code_hash")


@query("dedupe_first_seen", with_views("""
    SELECT seq, project, name, seq = first_seq AS accepted,
           CASE WHEN seq <> first_seq THEN first_name END AS duplicate_of
    FROM (SELECT *, min(seq) OVER w AS first_seq, arg_min(name, seq) OVER w AS first_name
          FROM save_log WINDOW w AS (PARTITION BY project, code_hash))""", *LOG))
def dedupe_first_seen(spark, d):
    log = V.narrow_log(spark, d).drop("ts")
    return C.dedupe_first_seen(log).drop("code_hash")


@query("dedupe_probe", with_views(f"""
    SELECT i.doc_id, i.project, i.code_hash, h.duplicate_of, h.duplicate_of IS NULL AS accepted
    FROM (SELECT doc_id, lang AS project, {code_hash('text')} AS code_hash FROM documents) i
    LEFT JOIN (SELECT project, code_hash, min(name) AS duplicate_of FROM current_assets
               GROUP BY ALL) h ON i.project = h.project AND i.code_hash = h.code_hash""",
    "save_log", "versions", "current_assets"))
def dedupe_probe(spark, d):
    incoming = V.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("project"), X.code_hash("text").alias("code_hash"))
    log = V.save_log(spark, d).select(*C.KEY, "seq", "code_hash")
    return C.dedupe_probe(incoming, C.latest_per_key(log))


@query("duplicate_groups", with_views("""
    SELECT project, code_hash, count(*) AS copies, min(seq) AS first_seq,
           arg_min(name, seq) AS first_name
    FROM save_log GROUP BY ALL HAVING count(*) > 1""", *LOG))
def duplicate_groups(spark, d):
    return C.duplicate_groups(V.save_log(spark, d))


_INCOMING = f"""incoming AS (
    SELECT lang AS project, 'fn_' || (doc_id % 50) AS name, {code_hash('text')} AS code_hash,
           source AS description, TIMESTAMP '2024-03-01' AS updated_at
    FROM documents QUALIFY row_number() OVER (
      PARTITION BY lang, doc_id % 50 ORDER BY doc_id DESC) = 1),
  merged AS (
    SELECT coalesce(o.project, n.project) AS project, coalesce(o.name, n.name) AS name,
           o.project IS NULL AS is_insert, n.project IS NULL AS is_keep,
           o.code_hash AS old_hash, n.code_hash AS new_hash, o.version AS old_version,
           o.description AS old_description, n.description AS new_description
    FROM current_assets o FULL JOIN incoming n ON o.project = n.project AND o.name = n.name)"""
_MERGE = with_views("", "save_log", "versions", "current_assets").rstrip() + ", " + _INCOMING


@query("merge_upsert", _MERGE + f"""
    SELECT project, name, 'current' AS kind,
           CASE WHEN is_keep THEN 'keep' WHEN is_insert THEN 'insert'
                WHEN old_hash = new_hash THEN 'refresh' ELSE 'new_version' END AS action,
           CAST(CASE WHEN is_insert THEN 1 WHEN is_keep OR old_hash = new_hash THEN old_version
                ELSE old_version + 1 END AS INTEGER) AS version,
           CASE WHEN is_keep THEN old_hash ELSE new_hash END AS code_hash,
           CASE WHEN is_keep THEN old_description ELSE new_description END AS description
    FROM merged
    UNION ALL
    SELECT project, name, 'history', 'archived', old_version, old_hash, old_description
    FROM merged WHERE NOT is_keep AND NOT is_insert AND old_hash <> new_hash""")
def merge_upsert(spark, d):
    doc = F.col("doc_id")
    incoming = C.latest_per_key(V.table(spark, d, "documents").select(
        F.col("lang").alias("project"),
        F.concat(F.lit("fn_"), (doc % 50).cast("string")).alias("name"),
        X.code_hash("text").alias("code_hash"), F.col("source").alias("description"),
        F.lit("2024-03-01").cast("timestamp").alias("updated_at"), doc.alias("seq")))
    catalogue = C.current_state(V.save_log(spark, d)).select(
        *C.KEY, "code_hash", "description", "version", F.col("ts").alias("updated_at"))
    current, history = C.merge_upsert(catalogue, incoming.drop("seq"))
    columns = [*C.KEY, "action", "version", "code_hash", "description"]
    return current.select(*columns, F.lit("current").alias("kind")).unionByName(
        history.withColumn("action", F.lit("archived")).select(
            *columns, F.lit("history").alias("kind")))


# One save after the other per project, with what every name holds as a map.
REPLAY_SQL = "WITH RECURSIVE " + with_views("", "save_log").strip()[5:] + """, ordered AS (
      SELECT *, row_number() OVER (PARTITION BY project ORDER BY seq) AS n FROM save_log),
    run AS (
      SELECT DISTINCT project, 0::BIGINT AS n, ''::VARCHAR AS name, ''::VARCHAR AS code_hash,
             -1::BIGINT AS seq, ''::VARCHAR AS status, MAP([''], ['']) AS holds FROM save_log
      UNION ALL
      SELECT o.project, o.n, o.name, o.code_hash, o.seq,
             CASE WHEN list_contains(map_values(holds), o.code_hash) THEN 'rejected'
                  ELSE 'accepted' END,
             CASE WHEN list_contains(map_values(holds), o.code_hash) THEN holds
                  ELSE map_concat(holds, MAP([o.name], [o.code_hash])) END
      FROM run JOIN ordered o ON o.project = run.project AND o.n = run.n + 1)
    SELECT project, name, code_hash, seq, status FROM run WHERE n > 0"""


@query("replay_saves", REPLAY_SQL)
def replay_saves(spark, d):
    return replay.replay_saves(V.narrow_log(spark, d))


@query("call_counts", with_views("""
    SELECT a.project, a.name, a.call_count + coalesce(c.n, 0) AS call_count FROM assets_flat a
    LEFT JOIN (SELECT user_id, count(*) AS n FROM events WHERE event_type = 'click'
               GROUP BY ALL) c ON c.user_id = a.doc_id""", *FLAT))
def call_counts(spark, d):
    calls = V.user_asset_events(spark, d, None, "click")
    return C.count_calls(V.assets_flat(spark, d).select(*C.KEY, "call_count"), calls)


@query("verdict_merge", with_views(f"""
    SELECT a.project, a.name, coalesce(v.status, a.verification_status) AS verification_status,
           coalesce(v.score, a.reliability_score) AS reliability_score,
           {stamp('coalesce(v.ts, a.updated_at)')} AS updated_at
    FROM assets_flat a LEFT JOIN (
      SELECT user_id, arg_max(CASE event_type WHEN 'purchase' THEN 'verified' ELSE 'failed' END,
                              event_id) AS status, max(ts) AS ts,
             arg_max(CASE event_type WHEN 'purchase' THEN 0.9::DOUBLE END, event_id) AS x,
             CASE WHEN status = 'verified' THEN 0.9::DOUBLE END AS score
      FROM events WHERE event_type IN ('purchase', 'error') GROUP BY user_id) v
    ON v.user_id = a.doc_id""", *FLAT))
def verdict_merge(spark, d):
    events = V.user_asset_events(spark, d, None, "purchase", "error")
    latest = events.groupBy(*C.KEY).agg(F.max(F.struct(
        "ts", "event_id", "verification_status")).alias("v"))
    verdicts = latest.select(
        *C.KEY, "v.verification_status", F.col("v.ts").alias("updated_at"),
        F.when(F.col("v.verification_status") == "verified", 0.9).alias("reliability_score"))
    catalogue = V.assets_flat(spark, d).select(
        *C.KEY, "verification_status", "reliability_score", "updated_at")
    return C.verdict_merge(catalogue, verdicts).withColumn(
        "updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))


# ---- comparisons ---------------------------------------------------------------------

_MIRROR = f"""mirror AS (
    SELECT project, name, CASE WHEN quality = 0 THEN {code_hash("code || ' edited'")}
           ELSE code_hash END AS code_hash
    FROM assets_flat a LEFT JOIN labels l ON a.doc_id = l.doc_id
    WHERE coalesce(toxic, 0) = 0
    UNION ALL SELECT 'src0', 'page_' || page_id, {code_hash('html')} FROM pages)"""


def _mirror(spark, d):
    """The catalogue as someone left it: edits, missing rows and new ones."""
    labels = V.table(spark, d, "labels")
    flat = V.assets_flat(spark, d).select("doc_id", *C.KEY, "code", "code_hash").join(
        labels, "doc_id", "left").where(F.coalesce("toxic", F.lit(0)) == 0)
    edited = X.code_hash(F.concat("code", F.lit(" edited")))
    pages = V.table(spark, d, "pages").select(
        F.lit("src0").alias("project"),
        F.concat(F.lit("page_"), F.col("page_id").cast("string")).alias("name"),
        X.code_hash("html").alias("code_hash"))
    return flat.select(*C.KEY, F.when(F.col("quality") == 0, edited).otherwise(
        F.col("code_hash")).alias("code_hash")).unionByName(pages)


@query("catalogue_mirror_diff", with_views("", *FLAT).rstrip() + f""", {_MIRROR}
    SELECT coalesce(c.project, m.project) AS project, coalesce(c.name, m.name) AS name,
           CASE WHEN m.name IS NULL THEN 'only_catalogue' WHEN c.name IS NULL THEN 'only_mirror'
                WHEN c.code_hash = m.code_hash THEN 'same' ELSE 'changed' END AS state
    FROM assets_flat c FULL JOIN mirror m ON c.project = m.project AND c.name = m.name""")
def catalogue_mirror_diff(spark, d):
    catalogue = V.assets_flat(spark, d).select(*C.KEY, "code_hash")
    return C.catalogue_mirror_diff(catalogue, _mirror(spark, d)).select(*C.KEY, "state")


@query("restore_union", with_views("", *FLAT).rstrip() + f""", {_MIRROR}
    SELECT project, name, code_hash, CASE WHEN c AND m THEN 'both' WHEN c THEN 'current'
           ELSE 'restored' END AS origin
    FROM (SELECT project, name, code_hash, bool_or(c) AS c, bool_or(NOT c) AS m
          FROM (SELECT project, name, code_hash, true AS c FROM assets_flat
                UNION ALL SELECT *, false FROM mirror) GROUP BY ALL)""")
def restore_union(spark, d):
    catalogue = V.assets_flat(spark, d).select(*C.KEY, "code_hash")
    return C.restore_union(catalogue, _mirror(spark, d))


@query("restore_summary", with_views("", *FLAT).rstrip() + f""", {_MIRROR}
    SELECT CASE WHEN bad THEN 'failed' ELSE 'success' END AS outcome,
           CASE WHEN bad THEN name || ': hash differs' END AS error, count(*) AS assets
    FROM (SELECT m.name, c.code_hash IS NOT NULL AND c.code_hash <> m.code_hash AS bad
          FROM mirror m LEFT JOIN assets_flat c ON c.project = m.project AND c.name = m.name)
    GROUP BY ALL""")
def restore_summary(spark, d):
    catalogue = V.assets_flat(spark, d).select(*C.KEY, "code_hash")
    diff = C.catalogue_mirror_diff(catalogue, _mirror(spark, d))
    outcomes = diff.where("state <> 'only_catalogue'").withColumn(
        "error", F.when(F.col("state") == "changed", "hash differs"))
    return reports.restore_summary(outcomes)


@query("vector_desync", with_views("""
    SELECT coalesce(a.project, v.project) AS project, coalesce(a.name, v.name) AS name,
           a.name IS NOT NULL AS in_catalogue, v.name IS NOT NULL AS in_vectors
    FROM assets_flat a FULL JOIN (SELECT 'src' || (vec_id % 20) AS project,
           'doc_' || vec_id AS name FROM embeddings) v
      ON a.project = v.project AND a.name = v.name
    WHERE a.name IS NULL OR v.name IS NULL""", *FLAT))
def vector_desync(spark, d):
    vectors = V.table(spark, d, "embeddings").select(
        F.concat(F.lit("src"), (F.col("vec_id") % 20).cast("string")).alias("project"),
        F.concat(F.lit("doc_"), F.col("vec_id").cast("string")).alias("name"))
    return C.vector_desync(V.assets_flat(spark, d), vectors)


@query("stale_embeddings", with_views("""
    SELECT a.project, a.name, CASE WHEN vec_id IS NULL THEN 'missing'
           WHEN label % 5 = 0 THEN 'model' ELSE 'dimension' END AS reason
    FROM assets_flat a LEFT JOIN embeddings e ON a.doc_id = e.vec_id
    WHERE vec_id IS NULL OR label % 5 = 0 OR label % 3 = 0""", *FLAT))
def stale_embeddings(spark, d):
    held = V.vectors(spark, d).select(
        *C.KEY, F.when(F.col("label") % 5 == 0, "m1").otherwise("m2").alias("model"),
        F.when(F.col("label") % 3 == 0, 32).otherwise(F.size("embedding")).alias("dimension"))
    return C.stale_embeddings(V.assets_flat(spark, d), held, "m2", 64).select(*C.KEY, "reason")


# ---- reports -----------------------------------------------------------------------------

@query("asset_count", with_views("""
    SELECT project, count(*) AS assets FROM assets_flat GROUP BY ROLLUP (project)""", *FLAT))
def asset_count(spark, d):
    return reports.asset_count(V.table(spark, d, "documents").withColumnRenamed(
        "source", "project"))


@query("catalogue_metrics", with_views("""
    SELECT count(*) AS assets, CAST(sum(call_count) AS BIGINT) AS calls,
           round(avg(reliability_score), 9) AS reliability FROM assets_flat""", *FLAT))
def catalogue_metrics(spark, d):
    return reports.catalogue_metrics(V.assets_flat(spark, d)).withColumn(
        "reliability", F.round("reliability", 9))


@query("latest_assets", with_views(f"""
    SELECT project, name, {stamp('created_at')} AS created_at FROM assets_flat
    ORDER BY assets_flat.created_at DESC, project, name LIMIT 10""", *FLAT))
def latest_assets(spark, d):
    return C.latest_assets(V.assets_flat(spark, d)).select(*C.KEY, _time("created_at"))


@query("explorer_listing", with_views(f"""
    SELECT name, project, language, printf('%.1f%%', reliability_score * 100) AS reliability,
           array_to_string(tags, ', ') AS tags, {stamp('updated_at')} AS updated
    FROM assets_flat ORDER BY updated_at DESC, project, name LIMIT 100""", *FLAT))
def explorer_listing(spark, d):
    return reports.explorer_listing(V.assets_flat(spark, d))


@query("health_rollup", """
    SELECT user_id, ([ 'Healthy', 'Warning', 'Error'])[max(CASE event_type WHEN 'error' THEN 2
             WHEN 'signup' THEN 1 ELSE 0 END) + 1] AS status, count(*) AS components
    FROM events GROUP BY user_id""")
def health_rollup(spark, d):
    rows = V.events(spark, d).withColumn("status", F.when(
        F.col("event_type") == "error", "Error").when(
        F.col("event_type") == "signup", "Warning").otherwise("Healthy"))
    return reports.health_rollup(rows, by=["user_id"])


@query("compat_matrix", with_views("""
    SELECT os, coalesce(max(s) FILTER (python = '3.9'), 'N/A') AS py39,
           coalesce(max(s) FILTER (python = '3.10'), 'N/A') AS py310,
           coalesce(max(s) FILTER (python = '3.11'), 'N/A') AS py311,
           coalesce(max(s) FILTER (python = '3.12'), 'N/A') AS py312
    FROM (SELECT os, python, arg_max(status, event_id) AS s FROM ci GROUP BY ALL) GROUP BY os""",
    "ci"))
def compat_matrix(spark, d):
    wide = reports.compat_matrix(V.ci_results(spark, d), V.PYTHONS)
    return wide.toDF("os", *["py" + v.replace(".", "") for v in V.PYTHONS])


@query("certification_rows", with_views("""
    SELECT os, node, python, timestamp, CASE status WHEN 'Pass' THEN 'PASS' ELSE 'FAIL' END
             AS label FROM ci""", "ci"))
def certification_rows(spark, d):
    rows = V.ci_results(spark, d).withColumn("status", F.lower("status"))
    return reports.certification_rows(rows).select("os", "node", "python", "timestamp", "label")


@query("next_version", """
    SELECT p_brand AS project, 'v' || v[1] || '.' || v[2] || '.' || (v[3] + 1) AS next_version
    FROM (SELECT p_brand, max([CAST(p_size AS BIGINT), p_partkey % 12, p_partkey % 7]) AS v
          FROM part GROUP BY p_brand)""")
def next_version(spark, d):
    return reports.next_version(V.version_tags(spark, d))
