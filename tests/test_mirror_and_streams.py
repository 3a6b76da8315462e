"""Files and streams: what is written comes back, and streams equal tables."""

import json

import pytest
from pyspark.sql import functions as F

from stacklore.operators import catalogue as C
from stacklore.operators.replay import replay_saves
from stacklore.plans import QUERIES, views as V
from stacklore.sources import ci, mirror
from stacklore.streaming import ingest as S, saves

ASSET = ("project string, name string, code string, description string, language string, "
         "tags array<string>")


def test_tree_layout_and_old_metadata(spark, tmp_path):
    meta = tmp_path / "projects" / "p a" / "metadata"
    code = tmp_path / "projects" / "p a" / "functions" / "python"
    meta.mkdir(parents=True), code.mkdir(parents=True)
    (meta / "f.json").write_text(json.dumps(
        {"name": "f", "code": "old", "tags": ["a", "b"], "code_hash": "stale"}, indent=4))
    (code / "f.py").write_text("new\n")
    (code / "f.txt").write_text("not this one")
    (meta / "c++.json").write_text('{"name": "c++", "code": "x"}')
    (code / "c++.py").write_text("plus")
    (meta / "g.json").write_text(json.dumps(
        {"name": "g", "project": "other", "language": "rust", "code": "fn", "tags": "[\"x\"]",
         "dependencies": None}))
    # Code beside the metadata counts, code in the folder of the named project does not.
    (meta / "h.json").write_text('{"name": "h", "project": "other", "code": "old", '
                                 '"verification_status": "verified", "test_metrics": {"passed": 3}, '
                                 '"env_fingerprint": "{}", "created_at": "2024-06-01 10:00:00"}')
    (code / "h.py").write_text("beside")
    far = tmp_path / "projects" / "other" / "functions" / "python"
    far.mkdir(parents=True)
    (far / "h.py").write_text("far away")
    (meta / "broken.json").write_text("{")
    rows = {r["name"]: r for r in mirror.mirror_read_tree(spark, str(tmp_path)).collect()}
    assert set(rows) == {"f", "g", "c++", "h"}
    h = rows["h"]
    assert (h["project"], h["folder"], h["code"], h["code_from_file"]) == (
        "other", "p a", "beside", True)
    assert (h["verification_status"], json.loads(h["test_metrics"]), h["env_fingerprint"]) == (
        "verified", {"passed": 3}, "{}")
    assert str(h["created_at"]) == "2024-06-01 10:00:00" and h["updated_at"] is None
    assert rows["c++"]["code"] == "plus"
    f, g = rows["f"], rows["g"]
    assert (f["project"], f["code"], f["tags"], f["language"]) == ("p a", "new\n", ["a", "b"], "python")
    assert f["code_hash"] != "stale" and f["code_from_file"]
    assert (g["project"], g["code"], g["tags"], g["dependencies"]) == ("other", "fn", ["x"], [])


def test_export_edit_import_is_a_new_version_and_then_the_same(spark, tmp_path):
    from stacklore.functions.text import code_hash

    live = spark.createDataFrame([("p", "f", "a = 1", "d", "python", ["t"]),
                                  ("007", "f", "b = 1", "d", "python", [])], ASSET)
    edited = live.withColumn("code", F.when(F.col("project") == "p", "a = 2").otherwise(
        F.col("code")))
    mirror.write_metadata(live.withColumn("folder", F.col("project")).withColumn(
        "project", F.lit(None).cast("string")), str(tmp_path))
    mirror.write_code(edited, str(tmp_path))
    back = mirror.mirror_read(spark, str(tmp_path))
    hashed = live.withColumn("code_hash", code_hash("code"))
    diff = C.catalogue_mirror_diff(hashed, back)
    assert {(r["project"], r["state"]) for r in diff.collect()} == {("p", "changed"), ("007", "same")}
    catalogue = hashed.select("project", "name", "code", "code_hash", F.lit(1).alias("version"))
    current, _ = C.merge_upsert(catalogue, back.select("project", "name", "code", "code_hash"))
    assert {(r["project"], r["version"]) for r in current.collect()} == {("p", 2), ("007", 1)}
    assert C.catalogue_mirror_diff(current, back).where("state <> 'same'").count() == 0


def test_export_keeps_every_field(spark, tmp_path):
    rows = spark.sql("""SELECT 'p' AS project, 'f' AS name, 'a = 1' AS code, 'python' AS language,
        array('t') AS tags, 'verified' AS verification_status, named_struct('os', 'linux')
        AS env_fingerprint, timestamp'2024-06-01 10:00:00.5' AS created_at""")
    mirror.mirror_export(rows, str(tmp_path))
    back = mirror.mirror_read(spark, str(tmp_path)).collect()[0]
    assert back["verification_status"] == "verified" and back["env_fingerprint"] == '{"os":"linux"}'
    assert back["created_at"] == rows.collect()[0]["created_at"] and back["tags"] == ["t"]


def test_broken_results_are_left_out(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"os": "linux", "status": "pass"}\n{"os": "li')
    assert [r["os"] for r in ci.ci_results_read(spark, str(tmp_path)).collect()] == ["linux"]


SAVES = ("seq long, project string, name string, code_hash string, description string, "
         "language string, ts timestamp")


def write_in_order(spark, frame, path, parts, order="seq"):
    """One file per part, in order, with rising modification times."""
    import os

    rows = frame.orderBy(order).collect()
    size = -(-len(rows) // parts)
    for i in range(parts):
        part = rows[i * size:(i + 1) * size]
        spark.createDataFrame(part, frame.schema).coalesce(1).write.mode("append").parquet(
            f"{path}/part{i}")
        for name in os.listdir(f"{path}/part{i}"):
            os.utime(f"{path}/part{i}/{name}", (1000 + i, 1000 + i))
    return spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(
        f"{path}/part*")


def test_streamed_replay_equals_the_table(spark, sf_dir, tmp_path):
    log = V.save_log(spark, sf_dir).select("project", "name", "code_hash", "seq")
    # Few hashes per project, so that names compete for them across batches.
    log = log.withColumn("code_hash", F.concat(F.lit("h"), (F.col("seq") * 7 % 11).cast("string")))
    stream = write_in_order(spark, log, str(tmp_path / "in"), 3)
    S.finish(S.ingest_replay(stream, str(tmp_path / "out")))

    def rows(df):
        return {(r["seq"], r["status"]) for r in df.collect()}

    streamed = rows(S.replayed_saves(spark, str(tmp_path / "out")))
    assert streamed == rows(replay_saves(log))
    assert len(streamed) == log.count()


def test_streamed_replay_refuses_late_saves(spark, tmp_path):
    log = spark.createDataFrame(
        [("p", f"n{k}", f"h{k}", k) for k in range(6)],
        "project string, name string, code_hash string, seq long").withColumn(
        "turn", -F.col("seq"))
    stream = write_in_order(spark, log, str(tmp_path / "in"), 3, order="turn")
    with pytest.raises(Exception, match="arrived after save"):
        S.finish(S.ingest_replay(stream, str(tmp_path / "out")))


def test_streamed_saves_calls_and_verdicts_over_several_batches(spark, sf_dir, tmp_path):
    log = V.save_log(spark, sf_dir).select(*SAVES.replace(",", "").split()[0::2])
    store = saves.save_store(spark, str(tmp_path / "s"), buckets=4)
    S.finish(saves.ingest_saves(write_in_order(spark, log, str(tmp_path / "in"), 3), store,
                                str(tmp_path / "check")))
    first = C.dedupe_first_seen(log).where("accepted").drop("accepted", "duplicate_of")
    expected = C.current_state(first).select("project", "name", "seq", "version")
    got = store.read("current").select("project", "name", "seq", "version")
    assert sorted(got.collect()) == sorted(expected.collect())

    events = V.user_asset_events(spark, sf_dir, None, "click", "purchase", "error")
    # Late rows: the newest events come first.
    stream = write_in_order(spark, events.withColumn("back", -F.col("event_id")),
                            str(tmp_path / "e"), 3, "back")
    S.finish(S.ingest_calls(stream, str(tmp_path / "c")))
    totals = S.call_totals(spark, str(tmp_path / "c"))
    assert sorted(totals.collect()) == sorted(
        events.groupBy("project", "name").agg(F.count("*").alias("calls")).collect())

    S.finish(S.ingest_verdicts(stream, str(tmp_path / "v")))
    catalogue = V.document_keys(spark, sf_dir).select(
        "project", "name", F.lit("pending").alias("verification_status"))
    merged = S.apply_verdicts(spark, str(tmp_path / "v"), catalogue)
    latest = events.groupBy("project", "name").agg(F.max_by(
        "verification_status", F.struct("ts", "event_id")).alias("s"))
    wrong = merged.join(latest, ["project", "name"], "left").where(
        "verification_status <> coalesce(s, 'pending')")
    assert wrong.count() == 0


@pytest.mark.parametrize("files", [0, 1, 3])
def test_a_table_streams_as_one_file_and_as_a_folder(spark, tmp_path, files):
    """``files`` 0 is a single file; the replay of the stream is that of the table."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    rows = pa.table({
        "doc_id": pa.array(range(90), pa.int64()), "text": [f"text {i % 7}" for i in range(90)],
        "lang": ["en", "de", "fr"] * 30, "source": ["src0"] * 90,
        "n_chars": pa.array([6] * 90, pa.int64())})
    if files:
        (tmp_path / "documents.parquet").mkdir()
        for n in range(files):
            size = 90 // files
            pq.write_table(rows.slice(n * size, size), tmp_path / f"documents.parquet/part-{n}.parquet")
    else:
        pq.write_table(rows, tmp_path / "documents.parquet")
    listed = lambda df: sorted(map(tuple, df.select("project", "name", "seq", "status").collect()))
    streamed = listed(QUERIES["stream_replay"](spark, str(tmp_path)))
    assert len(streamed) == 99  # every tenth document is saved twice
    assert streamed == listed(QUERIES["replay_saves"](spark, str(tmp_path)))
