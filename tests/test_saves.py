"""Saves, versions and merges on small logs with known answers."""

import random

import pytest
from pyspark.sql import functions as F

from stacklore.operators import catalogue as C, scan
from stacklore.operators.replay import replay_saves

LOG = "project string, name string, code_hash string, seq long"


def log(spark, rows):
    return spark.createDataFrame(
        [("p", n, h, i) for i, (n, h) in enumerate(rows)], LOG)


def brute_replay(rows):
    holds, out = {}, {}
    for project, name, code_hash, seq in sorted(rows, key=lambda r: r[3]):
        held = code_hash in [h for (p, _), h in holds.items() if p == project]
        out[seq] = "rejected" if held else "accepted"
        if not held:
            holds[(project, name)] = code_hash
    return out


def statuses(df):
    return {r["seq"]: r["status"] for r in df.collect()}


def test_a_hash_comes_back_after_its_holder_moved_on(spark):
    rows = [("f", "A"), ("f", "B"), ("f", "A"), ("g", "A"), ("f", "C"), ("g", "A"), ("h", "A")]
    assert statuses(replay_saves(log(spark, rows))) == dict(enumerate(
        ["accepted", "accepted", "accepted", "rejected", "accepted", "accepted", "rejected"]))
    first = C.dedupe_first_seen(log(spark, rows)).orderBy("seq").collect()
    assert [r["accepted"] for r in first] == [True, True, False, False, True, False, False]
    assert [r["duplicate_of"] for r in first] == [None, None, "f", "f", None, "f", "f"]


@pytest.mark.parametrize("seed, names, hashes, width", [
    (1, 3, 3, 1000), (2, 6, 4, 7), (3, 4, 12, 5), (4, 1, 2, 3), (5, 30, 1, 4)])
def test_replay_equals_one_by_one(spark, seed, names, hashes, width):
    draw = random.Random(seed)
    rows = [(f"p{draw.randrange(2)}", f"n{draw.randrange(names)}", f"h{draw.randrange(hashes)}", i)
            for i in range(80)]
    decided = replay_saves(spark.createDataFrame(rows, LOG), width=width)
    assert statuses(decided) == brute_replay(rows)


def test_replay_follows_a_long_chain_and_a_hot_hash(spark):
    chain = [row for i in range(60) for row in ((f"n{i}", "H"), (f"n{i}", f"u{i}"))]
    hot = [(f"m{i}", "HOT") for i in range(200)] + [("m0", "free"), ("m7", "HOT"), ("m8", "HOT")]
    rows = [("p", n, h, i) for i, (n, h) in enumerate(chain + hot)]
    decided = statuses(replay_saves(spark.createDataFrame(rows, LOG), width=16))
    assert decided == brute_replay(rows)
    assert sum(s == "accepted" for s in decided.values()) == 120 + 3


@pytest.mark.parametrize("width", [1, 3, 10, 1000])
def test_scans_do_not_depend_on_the_chunk_width(spark, width):
    draw = random.Random(width)
    seqs = sorted(draw.sample(range(60), 30))
    values = [draw.choice([None, 1, 2, 3]) for _ in seqs]
    df = spark.createDataFrame([("k", s, v) for s, v in zip(seqs, values)],
                               "k string, seq long, v int")

    def column(out):
        return [r["x"] for r in out.orderBy("seq").collect()]

    before = [None, *values[:-1]]
    after = [*values[1:], None]
    sums, known, ahead = [], [], []
    for i in range(len(values)):
        sums.append(sum(v or 0 for v in values[:i + 1]))
        known.append(next((v for v in reversed(values[:i]) if v is not None), None))
        ahead.append(next((v for v in values[i + 1:] if v is not None), None))
    v = F.col("v")
    assert column(scan.with_neighbour(df, ["k"], "seq", v, "x", width=width)) == before
    assert column(scan.with_neighbour(df, ["k"], "seq", v, "x", True, width)) == after
    assert column(scan.with_running_sum(
        df, ["k"], "seq", F.coalesce(v, F.lit(0)), "x", width)) == sums
    assert column(scan.with_last_known(df, ["k"], "seq", v, "x", width=width)) == known
    assert column(scan.with_last_known(df, ["k"], "seq", v, "x", True, width)) == ahead


@pytest.mark.parametrize("width", [2, 1000])
def test_versions_are_dense_and_history_is_whole(spark, width):
    draw = random.Random(9)
    rows = [(draw.choice("ab"), draw.choice("XYZ")) for _ in range(40)]
    saves = log(spark, rows).withColumn("ts", F.timestamp_seconds("seq"))
    versions = C.version_history(saves, width).collect()
    for name in "ab":
        mine = [r for r in sorted(versions, key=lambda r: r["seq"]) if r["name"] == name]
        assert sorted({r["version"] for r in mine}) == list(range(1, mine[-1]["version"] + 1))
        for one, two in zip(mine, mine[1:]):
            step = one["code_hash"] != two["code_hash"]
            assert two["version"] - one["version"] == step
    intervals = C.history_intervals(saves, width).collect()
    assert sum(r["archived_at"] is None for r in intervals) == 2
    assert C.current_state(saves, width).count() == 2


CATALOGUE = ("project string, name string, code_hash string, description string, version int, "
             "call_count long, created_at string, updated_at string")


def test_merge_insert_refresh_and_new_version(spark):
    old = spark.createDataFrame([
        ("p", "same", "h1", "old", 3, 7, "t0", "t0"), ("p", "changed", "h2", "old", 1, 4, "t0", "t0"),
        ("p", "kept", "h3", "old", 2, 1, "t0", "t0")], CATALOGUE)
    new = spark.createDataFrame([
        ("p", "same", "h1", "new", "t1"), ("p", "changed", "h9", "new", "t1"),
        ("q", "same", "h1", "new", "t1")],
        "project string, name string, code_hash string, description string, updated_at string")
    current, history = C.merge_upsert(old, new)
    rows = {(r["project"], r["name"]): r for r in current.collect()}
    assert {k: (r["action"], r["version"], r["description"]) for k, r in rows.items()} == {
        ("p", "same"): ("refresh", 3, "new"), ("p", "changed"): ("new_version", 2, "new"),
        ("p", "kept"): ("keep", 2, "old"), ("q", "same"): ("insert", 1, "new")}
    assert rows["p", "same"]["call_count"] == 7 and rows["p", "same"]["created_at"] == "t0"
    assert rows["q", "same"]["call_count"] == 0
    [archived] = history.collect()
    assert (archived["name"], archived["version"], archived["code_hash"], archived["archived_at"]
            ) == ("changed", 1, "h2", "t1")


def test_merge_into_an_empty_catalogue(spark):
    new = spark.createDataFrame([("p", "a", "h", "d", "t")],
                                "project string, name string, code_hash string, "
                                "description string, updated_at string")
    current, history = C.merge_upsert(spark.createDataFrame([], CATALOGUE), new)
    assert [r["action"] for r in current.collect()] == ["insert"]
    assert history.count() == 0


def test_tags_match_in_any_case_and_all_must_match(spark):
    rows = spark.createDataFrame([
        ("projA", "func1", ["Tag1", "common"], 1), ("projB", "func2", ["tag2", "common"], 2)],
        "project string, name string, tags array<string>, updated_at int")

    def names(**filters):
        return [r["name"] for r in C.list_assets(rows, **filters).collect()]

    assert names() == ["func2", "func1"]
    assert names(tags=["COMMON"]) == ["func2", "func1"]
    assert names(tags=["common", "tag1"]) == ["func1"]
    assert names(project="projB") == ["func2"]
    assert names(project="projB", tags=["tag1"]) == []
    assert names(limit=1) == ["func2"]


def test_null_and_empty_projects_are_the_default_one(spark):
    rows = spark.createDataFrame([(None,), ("",), ("p",)], "project string")
    assert [r[0] for r in C.scan(rows).collect()] == ["default", "default", "p"]


def one_by_one(rows):
    holds, out = {}, {}
    for p, n, h, seq in sorted(rows, key=lambda r: r[3]):
        held = {x for (q, _), x in holds.items() if q == p}
        out[seq] = "rejected" if h in held else "accepted"
        if h not in held:
            holds[p, n] = h
    return out


def test_a_chain_across_200_hashes_settles_in_one_pass(spark, monkeypatch):
    from stacklore.operators import replay

    # Name k saves hash k + 1, then k, which the name before has just left.
    rows = [("p", f"n{k}", f"h{k}", 2 * k) for k in range(200)]
    rows += [("p", f"n{k}", f"h{k + 1}", 2 * (k + 200) + 1) for k in range(199, -1, -1)]
    rows += [("q", f"n{k % 3}", f"h{k % 2}", 1000 + k) for k in range(20)]
    passes = []
    fold = replay._folded
    monkeypatch.setattr(replay, "_folded", lambda g: passes.append(1) or fold(g))
    decided = statuses(replay_saves(spark.createDataFrame(rows, LOG)))
    assert decided == one_by_one(rows) and len(passes) == 1


@pytest.mark.parametrize("seed", [1, 2])
def test_groups_cut_by_time_agree_with_one_save_after_the_other(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("pq"), f"n{rng.randint(0, 5)}", f"h{rng.randint(0, 7)}", k) for k in range(90)]
    rows += [("alone", "n", f"h{k // 2}", 500 + k) for k in range(6)]
    decided = statuses(replay_saves(spark.createDataFrame(rows, LOG), width=9, fold_rows=12))
    assert decided == one_by_one(rows)


def test_connected_groups_of_paths_stars_and_pairs(spark):
    from stacklore.operators.links import connected

    rng = random.Random(4)
    names = rng.sample(range(-10**6, 10**6), 600)
    links = [(names[i], names[i + 1]) for i in range(299)]
    links += [(names[300], names[i]) for i in range(301, 500)] + [(names[i], names[i + 1]) for i in range(500, 600, 2)]
    got = {r["node"]: r["group"] for r in connected(
        spark.createDataFrame(links + links[:5], "a long, b long"), rounds=9).collect()}
    parts = [names[:300], names[300:500]] + [names[i:i + 2] for i in range(500, 600, 2)]
    assert got == {n: min(p) for p in parts for n in p}


def test_of_several_verdicts_for_a_key_the_latest_counts(spark):
    catalogue = spark.createDataFrame(
        [("p", "f", "pending", None), ("p", "g", "pending", None)],
        "project string, name string, verification_status string, updated_at timestamp")
    verdicts = spark.sql("""
        SELECT 'p' AS project, 'f' AS name, s AS verification_status, t AS updated_at,
               map('note', s) AS report
        FROM VALUES ('verified', timestamp'2024-01-02'), ('failed', timestamp'2024-01-01'),
                    ('failed', timestamp'2024-01-02') AS v(s, t)""")
    got = C.verdict_merge(catalogue, verdicts).orderBy("name").collect()
    assert [(r["name"], r["verification_status"], r["report"]) for r in got] == [
        ("f", "verified", {"note": "verified"}), ("g", "pending", None)]


def test_assets_without_imports_have_nothing_undeclared(spark):
    from stacklore.operators import scoring

    imports = spark.createDataFrame([(1, None), (2, "os.path"), (2, "ghost.sub"), (2, "ghost.sub")],
                                    "asset_id long, module string")
    names = spark.createDataFrame([("os",)], "module string")
    got = scoring.undeclared_imports(imports, names, names.select(F.lit("x").alias("package")))
    assert {r["asset_id"]: (r["missing"], r["score"]) for r in got.collect()} == {
        1: ([], 100.0), 2: (["ghost.sub"], 70.0)}
