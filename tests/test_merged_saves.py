"""Micro-batches merged into buckets: repeats, failures, compaction, late copies."""

import random

import pytest
from pyspark.sql import functions as F

from stacklore.operators import catalogue as C
from stacklore.streaming import saves
from stacklore.streaming.keyed_log import KeyedLog

SAVES = "project string, name string, code_hash string, seq long, ts timestamp, code string"


def batch(spark, rows):
    return spark.createDataFrame(
        [(p, n, h, seq, None, f"code of {h}") for p, n, h, seq in rows], SAVES).withColumn(
        "ts", F.timestamp_seconds(F.col("seq") * 60))


def plain(batches):
    """current {(project, name): (hash, seq, version, created, code)} and history rows."""
    seen, current, history = set(), {}, set()
    for rows in batches:
        for p, n, h, seq in sorted(rows, key=lambda r: r[3]):
            if (p, h) in seen:
                continue
            seen.add((p, h))
            old = current.get((p, n))
            if old:
                history.add((p, n, *old[:3], seq))
            current[p, n] = (h, seq, old[2] + 1 if old else 1, old[3] if old else seq, f"code of {h}")
    return current, history


def read(store):
    at = lambda r, c: r[c].timestamp() // 60
    current = {(r["project"], r["name"]): (r["code_hash"], r["seq"], r["version"], at(r, "created_at"),
                                          r["code"]) for r in store.read("current").collect()}
    history = [(r["project"], r["name"], r["code_hash"], r["seq"], r["version"], at(r, "archived_at"))
               for r in store.read("history").collect()]
    assert len(history) == len(set(history))
    return current, set(history)


@pytest.fixture
def batches():
    rng, seq, out = random.Random(2), 0, []
    for _ in range(4):
        rows = []
        for _ in range(25):
            seq += 1
            # One name holds a third of all rows, and contents come again over all batches.
            name = "hot" if rng.random() < 0.33 else f"n{rng.randint(0, 8)}"
            rows.append((rng.choice("pq"), name, f"h{rng.randint(0, 60)}", seq))
        out.append(rows)
    out.append([])
    # Late rows: older numbers than all before, two copies and one new content.
    out.append([("p", "n1", out[0][0][2], -3), ("q", "n1", out[0][0][2], -2), ("p", "late", "new", -1)])
    return out


def test_batches_agree_with_one_save_after_the_other(spark, tmp_path, batches):
    store = saves.save_store(spark, str(tmp_path), buckets=4, compact_after=2)
    for k, rows in enumerate(batches):
        saves.merge_batch(store, batch(spark, rows), k, width=5)
        assert read(store) == plain(batches[:k + 1])
        # Never more than one piece a bucket is left over by compaction at two.
        assert all(len(x) < 2 for p in store.head()["pieces"].values() for x in p.values())
        before = store.head()
        saves.merge_batch(store, batch(spark, rows), k)
        saves.merge_batch(store, batch(spark, [("p", "x", "unseen", 999)]), k)
        assert store.head() == before
    assert store.read("current").where("call_count <> 0 or verification_status <> 'pending'").isEmpty()


def test_merged_batches_agree_with_merge_upsert(spark, tmp_path, batches):
    store = saves.save_store(spark, str(tmp_path), buckets=3, compact_after=100)
    fields = ["code_hash", "seq", "created_at", "version", "call_count"]
    table = spark.createDataFrame([], "project string, name string, code_hash string, seq long, "
                                      "created_at timestamp, version int, call_count long")
    for k, rows in enumerate(batches[:2]):
        # One save a name and batch, all of content not seen before.
        once = {(p, n): (p, n, f"{k}-{h}-{seq}", seq) for p, n, h, seq in rows}
        arrived = batch(spark, list(once.values()))
        saves.merge_batch(store, arrived, k)
        table, _ = C.merge_upsert(table, arrived.withColumn("created_at", F.col("ts")).drop("ts", "code"))
        table = table.drop("action")
    want = sorted(map(str, table.select(*C.KEY, *fields).collect()))
    assert sorted(map(str, store.read("current").select(*C.KEY, *fields).collect())) == want


def test_a_failed_batch_leaves_nothing_and_runs_again(spark, tmp_path, batches, monkeypatch):
    store = saves.save_store(spark, str(tmp_path), buckets=4)
    saves.merge_batch(store, batch(spark, batches[0]), 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedLog, "_publish", lambda self, head: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            saves.merge_batch(store, batch(spark, batches[1]), 1)
    assert read(store) == plain(batches[:1])
    saves.merge_batch(store, batch(spark, batches[1]), 1)
    assert read(store) == plain(batches[:2])


def test_of_two_writers_of_one_version_the_second_fails(spark, tmp_path):
    one = KeyedLog(spark, str(tmp_path), {"t": ["k"]}, buckets=2)
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    one.commit("x", 0, {"t": rows})
    stale = one.head()
    one.commit("y", 0, {"t": rows.where("k = 1").withColumn("v", F.lit("c"))})
    stale["version"] += 1
    with pytest.raises(RuntimeError, match="another writer"):
        one._publish(stale)
    assert sorted(map(tuple, one.read("t").collect())) == [(1, "c"), (2, "b")]
    assert one.done("x", 0) and one.done("y", 0) and not one.done("y", 1) and not one.done("z", 0)


def test_a_read_takes_the_files_of_its_buckets_alone(spark, tmp_path):
    log = KeyedLog(spark, str(tmp_path), {"t": ["k"]}, buckets=8)
    rows = spark.range(200).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    assert log.read("t") is None
    log.commit("w", 0, {"t": rows})
    log.commit("w", 1, {"t": rows.where("k = 7").withColumn("v", F.lit("y"))})
    wanted = log.buckets_of("t", rows.where("k = 7"))
    files = log.read("t", wanted).inputFiles()
    assert len(wanted) == 1 and all(f"_bucket={wanted[0]}/" in f for f in files) and len(files) == 2
    assert [r["v"] for r in log.read("t", wanted).where("k = 7").collect()] == ["y"]
    assert log.read("t", []).count() == 0 and log.read("t").count() == 200
    with pytest.raises(ValueError, match="columns of t"):
        log.commit("w", 2, {"t": rows.drop("v")})
