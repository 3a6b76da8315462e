"""Vectors and batch search on small inputs."""

import numpy as np
import pytest

from stacklore.operators import search, vectors as N

QUERY = ("query_id long, text string, embedding array<double>, project string, "
         "language string, tags array<string>")
ASSET = "project string, name string, description string, language string, tags array<string>"


def unit(*x):
    x = np.array(x, dtype=float)
    return [float(v) for v in x / np.linalg.norm(x)]


def random_units(seed, count, size=6):
    x = np.random.default_rng(seed).normal(size=(count, size))
    return x / np.linalg.norm(x, axis=1)[:, None]


def vectors(spark, rows):
    return spark.createDataFrame(rows, "project string, name string, embedding array<double>")


def test_a_big_project_does_not_crowd_out_a_small_one(spark):
    held = vectors(spark, [("A", f"a{i:02}", unit(1, 0.01 * i)) for i in range(20)]
                   + [("B", "b", unit(0.9, 0.5))])
    queries = spark.createDataFrame([(1, "B", unit(1, 0)), (2, None, unit(1, 0)), (3, "C", unit(1, 0))],
                                    "query_id long, project string, embedding array<double>")
    found = N.knn(queries, held, 5).collect()
    assert [(r["project"], r["name"]) for r in found if r["query_id"] == 1] == [("B", "b")]
    assert [r["name"] for r in sorted(found, key=lambda r: r["rank"]) if r["query_id"] == 2] == [
        "a00", "a01", "a02", "a03", "a04"]
    assert not [r for r in found if r["query_id"] == 3]


@pytest.mark.parametrize("sent, block", [(1 << 30, 8192), (-1, 7), (-1, 8192)])
@pytest.mark.parametrize("threshold", [None, 0.2])
def test_both_ways_of_knn_equal_brute_force(spark, sent, block, threshold):
    units, asks = random_units(1, 60), random_units(2, 9)
    held = [(f"p{i % 3 if i % 2 else 0}", f"v{i:02}", [float(x) for x in u])
            for i, u in enumerate(units)]
    queries = [(i, None if i % 2 else f"p{i % 4}", [float(x) for x in u])
               for i, u in enumerate(asks)]
    expected = []
    for i, project, u in queries:
        scored = sorted((-round(float(np.dot(u, v)), 6), p, n) for p, n, v in held
                        if project in (None, p))
        if threshold is not None:
            scored = [s for s in scored if -s[0] > threshold]
        expected += [(i, p, n, -s, rank + 1) for rank, (s, p, n) in enumerate(scored[:4])]
    got = N.knn(spark.createDataFrame(queries, "query_id long, project string, "
                                               "embedding array<double>"),
                vectors(spark, held), 4, threshold, block, sent).collect()
    assert sorted((r["query_id"], r["project"], r["name"], r["similarity"], r["rank"])
                  for r in got) == sorted(expected)


def test_equal_similarities_are_ranked_by_key(spark):
    held = vectors(spark, [("p", f"n{i}", unit(1, 1)) for i in range(9, 0, -1)])
    queries = spark.createDataFrame([(1, None, unit(1, 0))],
                                    "query_id long, project string, embedding array<double>")
    assert [r["name"] for r in N.knn(queries, held, 3).orderBy("rank").collect()] == [
        "n1", "n2", "n3"]


def test_prepare_drops_zero_and_wrong_size_and_keeps_the_latest(spark):
    rows = spark.createDataFrame([
        ("p", "a", [3.0, 4.0], 1), ("p", "a", [0.0, 2.0], 2), ("p", "zero", [0.0, 0.0], 1),
        ("p", "long", [1.0, 2.0, 3.0], 1)],
        "project string, name string, embedding array<double>, seq int")
    assert [(r["name"], r["embedding"]) for r in N.rebuild(rows, "seq", 2).collect()] == [
        ("a", [0.0, 1.0])]


@pytest.mark.parametrize("threshold", [0.5, 0.9])
@pytest.mark.parametrize("pivots, block", [(1, 5), (4, 3), (8, 1000)])
def test_near_duplicates_equal_brute_force(spark, threshold, pivots, block):
    units = np.vstack([random_units(3, 40, 3)] + [random_units(4, 5, 3)] * 3)
    rows = [(f"p{i % 2}", f"v{i:02}", [float(x) for x in u]) for i, u in enumerate(units)]
    got = N.near_duplicate_pairs(vectors(spark, rows), threshold, pivots, block).collect()
    firsts, expected = {}, []
    for project, name, u in rows:
        first = firsts.setdefault((project, tuple(u)), name)
        if first != name:
            expected.append((project, first, name))
    kept = [(p, n, u) for (p, u), n in firsts.items()]
    expected += [(p, n, m) for p, n, u in kept for q, m, w in kept
                 if p == q and n < m and round(float(np.dot(u, w)), 6) >= threshold]
    assert sorted((r["project_a"], r["name_a"], r["name_b"]) for r in got) == sorted(expected)


def asset(name, description="", project="p", language="python", tags=()):
    return (project, name, description, language, list(tags))


def ask(number, text=None, project=None, language=None, tags=None):
    return (number, text, None, project, language, tags)


ASSETS = [
    asset("normalize_args", "Cleans arguments", tags=["Util"]),
    asset("percent", "100% literal", language="JavaScript"),
    asset("other", "nothing here", project="q", tags=["util", "net"]),
    asset("x", "ARGUMENT parser", project="q"),
]
ASKS = [
    ask(1, "ARG"), ask(2, "%"), ask(3, "_"), ask(4, None, "q"), ask(5, None, None, "javascript"),
    ask(6, None, None, None, ["UTIL"]), ask(7, "arg", "q"), ask(8), ask(9, "ar", tags=["util"]),
    ask(10, "#util", "q"), ask(11, "absent"),
]
HITS = {1: ["normalize_args", "x"], 2: ["percent"], 3: ["normalize_args"], 4: ["other", "x"],
        5: ["percent"], 6: ["normalize_args", "other"], 7: ["x"], 9: ["normalize_args"],
        10: ["other"]}


@pytest.mark.parametrize("stored", [False, True])
def test_keyword_search_is_literal_and_filtered(spark, tmp_path, stored):
    queries, assets = search.route_tags(spark.createDataFrame(ASKS, QUERY)), spark.createDataFrame(
        ASSETS, ASSET)
    index = None
    if stored:
        search.piece_postings(assets).write.parquet(str(tmp_path / "index"))
        index = spark.read.parquet(str(tmp_path / "index"))
    found = search.keyword_matches(queries, assets, 5, index).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append(r["name"])
        assert r["similarity"] == 0.9
    assert {k: sorted(v) for k, v in got.items()} == HITS


def test_one_keyword_filter_agrees(spark):
    assets = spark.createDataFrame(ASSETS, ASSET)
    for number, text, _, project, language, tags in ASKS[:7]:
        names = [r["name"] for r in search.keyword_filter(
            assets, text, language, tags, project).collect()]
        assert sorted(names) == HITS[number]


def test_hybrid_takes_the_larger_similarity(spark):
    assets = spark.createDataFrame(ASSETS, ASSET)
    held = vectors(spark, [("p", "normalize_args", unit(1, 0)), ("p", "percent", unit(1, 1)),
                           ("q", "x", unit(0, 1))])
    queries = spark.createDataFrame([(1, "arg", unit(1, 0), None, None, None)], QUERY)
    got = search.hybrid_search(queries, assets, held, 3).orderBy("rank").collect()
    assert [(r["name"], r["similarity"]) for r in got] == [
        ("normalize_args", 1.0), ("x", 0.9), ("percent", 0.707107)]


def test_many_odd_texts_equal_brute_force(spark, monkeypatch):
    import random

    from stacklore.functions import pieces

    monkeypatch.setattr(pieces, "SLICE_BYTES", 64)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab\u00e9\u00c9\U0001f600% _\n") for _ in range(rng.randint(0, 9)))
    assets = [asset(f"n{i}", rng.choice([word() + word(), None, "", "hot text"])) for i in range(120)]
    assets.append(asset("long", "x" * 5000 + "needle" + "y" * 5000))
    texts = [word() for _ in range(80)] + ["needle", "hot", "\u00e9", "t", "xy", "N1", None, "", "ot te"]
    found = search.keyword_matches(
        spark.createDataFrame([ask(i, t) for i, t in enumerate(texts)], QUERY),
        spark.createDataFrame(assets, ASSET), 1000).collect()
    lowered = [(a[1], (a[1] + "\0" + a[2] if a[2] is not None else a[1]).lower()) for a in assets]
    expected = [(i, n) for i, t in enumerate(texts) if t for n, x in lowered if t.lower() in x]
    assert sorted((r["query_id"], r["name"]) for r in found) == sorted(expected)


@pytest.mark.parametrize("stored", [False, True])
def test_first_hits_by_key_come_from_slices_of_the_catalogue(spark, tmp_path, monkeypatch, stored):
    """Frequent texts ask in the first slices only; keys may be null or come twice."""
    monkeypatch.setattr(search, "MANY", -1)
    asked, sliced = [], search._hits_among

    def counted(wanted, texts, index):
        asked.append(wanted.count())
        return sliced(wanted, texts, index)

    monkeypatch.setattr(search, "_hits_among", counted)
    assets = [asset(f"n{i:03}", "common words" + (" and a rare phrase" if i % 90 == 0 else ""),
                    project=f"p{i % 3}") for i in range(300)]
    assets += assets[5:8] + [asset("lost", "common words", project=None)]
    texts = ["common", "common words", "on wo", "rare phrase", "n29", "absent words", "c"]
    rows = spark.createDataFrame(assets, ASSET)
    index = None
    if stored:
        search.piece_postings(rows).write.parquet(str(tmp_path / "index"))
        index = spark.read.parquet(str(tmp_path / "index"))
    found = search.keyword_matches(spark.createDataFrame(
        [ask(i, t) for i, t in enumerate(texts)], QUERY), rows, 3, index).collect()
    lowered = [(p, n, f"{n}\0{d}") for p, n, d, *_ in assets if p]
    # An asset that comes twice is met by both of its texts.
    expected = [(i, p, n) for i, t in enumerate(texts) for p, n in sorted(
        (p, n) for p, n, x in lowered for q, m, y in lowered if (p, n) == (q, m) and t in x)[:3]]
    assert sorted((r["query_id"], r["project"], r["name"]) for r in found) == sorted(expected)
    assert len(asked) == 4 and asked[0] == len(texts) and asked[-1] < asked[0]


def test_texts_that_share_only_short_pieces_are_not_met(spark, monkeypatch):
    """Assets with all three-byte pieces of a text, but not the text, are no candidates."""
    met, cut = [], search.cut_lineage

    def counted(rows, label="step"):
        kept = cut(rows, label)
        if label == "candidates":
            met.append(kept.count())
        return kept

    monkeypatch.setattr(search, "cut_lineage", counted)
    assets = [asset(f"a{i}", "alpha blue, pha be, a bet, betas") for i in range(200)]
    assets.append(asset("b", "the alpha betas"))
    found = search.keyword_matches(spark.createDataFrame([ask(1, "alpha betas")], QUERY),
                                   spark.createDataFrame(assets, ASSET), 5).collect()
    assert [r["name"] for r in found] == ["b"] and met == [1]


def test_texts_meet_no_cross_join(spark):
    found = search.keyword_matches(spark.createDataFrame(ASKS, QUERY),
                                   spark.createDataFrame(ASSETS, ASSET), 5)
    plan = found._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("block", [64, 8192])
def test_near_duplicates_of_clustered_vectors_meet_few_others(spark, block):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    units = np.vstack([c + 0.25 * rng.normal(size=(30, 64)) for c in centres])
    units /= np.linalg.norm(units, axis=1)[:, None]
    rows = [("p", f"v{i:04}", [float(x) for x in u]) for i, u in enumerate(units)]
    df = vectors(spark, rows)
    got = N.near_duplicate_pairs(df, 0.9, 64, block).collect()
    scores = np.round(units @ units.T, 6)
    expected = {(f"v{i:04}", f"v{j:04}") for i, j in zip(*np.nonzero(np.triu(scores >= 0.9, 1)))}
    assert expected and {(r["name_a"], r["name_b"]) for r in got} == expected and len(got) == len(expected)
    # Pairs that come together at all: in a cell, or as a visitor and a resident of its cell.
    centres, _ = N._centres(df, 64)
    placed = N.placed_vectors(df, centres, 0.9).collect()
    sizes = {}
    for r in placed:
        sizes[r["home"]] = sizes.get(r["home"], 0) + 1
    met = sum(n * (n - 1) // 2 for n in sizes.values()) + sum(
        sizes.get(c, 0) for r in placed for c in r["visits"])
    assert met < 0.1 * len(units) * (len(units) - 1) / 2


def test_leading_coordinates_leave_few_products(monkeypatch):
    units = random_units(7, 600, 64)
    order = np.arange(64)
    lead, rest = order[:16], order[16:]
    most = units[:, lead] @ units[:, lead].T + np.outer(*[np.linalg.norm(units[:, rest], axis=1)] * 2)
    assert (most >= 0.9).mean() < 0.1
    near = np.vstack([units, units[:5] + 0.01])
    near /= np.linalg.norm(near, axis=1)[:, None]
    for threshold in (0.9, 0.3):
        i, j, s = N.close_scores(near, near, threshold, order)
        full = np.rint(near @ near.T * 1e6) / 1e6
        assert {*zip(i, j)} == {*zip(*np.nonzero(full >= threshold))} and np.allclose(s, full[i, j])
