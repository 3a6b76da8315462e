"""URL filters, centroid clusters and the prefix trie against brute force on odd rows."""

import functools
import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from stacklore.llm import clusters, prefix_trie, url_filters
from stacklore.llm.common import dealt

PAGES = "page_id long, url string, host int, path int, row string, stack string, html string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(params=[5, 200_000])
def buckets(request, monkeypatch):
    """Small buckets carry sums and stacks over many borders."""
    for module in (url_filters, prefix_trie):
        monkeypatch.setattr(module, "dealt", functools.partial(dealt, per_bucket=request.param))


# ---- url filters ----

def host_path(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    after = rest[cut:]
    return rest[:cut].translate(LOWER), after[:min([after.find(c) for c in "?#" if c in after]
                                                   or [len(after)])]


def judged(url, rules):
    host, path = host_path(url)
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow"


def urls(spark, values):
    return spark.createDataFrame([(k if k % 7 else None, u, 1, 2, "r", "s", "<p>")
                                  for k, u in enumerate(values)], PAGES)


def rows_of(df, *columns):
    return sorted(map(str, (tuple(r[c] for c in columns) for r in df.collect())))


ODD_URLS = [None, "", "no scheme", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x",
            "http://example.com/en", "http://example.com/en/?q#f", "http://example.com?/en/",
            "http://example.com#/en/", "http://.com/", "http://com/", "http://acom/", "http://com./",
            "http://a..com/", "http://net/es/", "http://x.net/es", "http://x.net/fr/é\n", "a://b://c/d",
            "http://example.com/\U0010ffff/x", "http://É.com/", "http://example.com:80/en/",
            "http://x.net/es/" + "y" * 50_000]


def test_urls_by_the_given_rules(spark, buckets):
    values = ODD_URLS * 3 + ["http://hot.example.com/en/1"] * 60
    rules = [(h, p, v) for v, h, p in url_filters.RULES]
    want = sorted(str((k if k % 7 else None, *judged(u, rules))) for k, u in enumerate(values))
    got = rows_of(url_filters.judge(urls(spark, values)), "page_id", "host", "path", "rule", "verdict")
    assert got == want


def test_deeply_nested_random_rules(spark, buckets):
    rng = random.Random(3)
    label = lambda: rng.choice(["a", "b", "ab", "c", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice("/ab\U0010ffff") for _ in range(rng.randint(0, 5)))
    rules = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(150)}
    values = [f"x://{host()}/{path()}" for _ in range(250)]
    table = spark.createDataFrame([(v, h, p) for (h, p), v in rules.items()]
                                  + [(v, h.upper(), p) for (h, p), v in rules.items()]
                                  + [("block", None, "/"), ("allow", "b.a", "/"), ("block", "b.a", "/")],
                                  url_filters.RULE_SCHEMA)
    rules["b.a", "/"] = "block"
    want = sorted(str((k if k % 7 else None, *judged(u, [(*r, v) for r, v in rules.items()])))
                  for k, u in enumerate(values))
    got = rows_of(url_filters.judge(urls(spark, values), table),
                  "page_id", "host", "path", "rule", "verdict")
    assert got == want


def test_urls_without_pages_or_rules(spark):
    none = spark.createDataFrame([], url_filters.RULE_SCHEMA)
    assert url_filters.judge(urls(spark, [])).collect() == []
    got = url_filters.judge(urls(spark, ["http://a.com/x", None]), none, default="block").collect()
    assert sorted((r["host"], r["rule"], r["verdict"]) for r in got) == [
        ("", None, "block"), ("a.com", None, "block")]


def test_url_plan_has_no_python_and_no_cross_join(spark):
    plan = url_filters.judge(urls(spark, ODD_URLS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


# ---- clusters ----

VECTORS = "vec_id long, embedding array<float>, v string, cluster int, distance string, label int"


def clustered(rows, k, dim, rounds):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dim and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(256 * x) for x in e]))
    turn = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest()
                      if r[0] is not None else "", r[1])
    centers = [v for _, v in sorted(kept, key=turn)[:k]]

    def near(v):
        return min(((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centers = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c
                   for j, c in enumerate(centers)]
    per = {}
    for _, v in kept:
        d, j = near(v)
        per[j] = per.get(j, 0) + d
    return sorted(str((i, near(v)[1], near(v)[0], per[near(v)[1]], sum(per.values()), hashlib.sha256(
        ",".join(map(str, centers[near(v)[1]])).encode()).hexdigest())) for i, v in kept)


def test_clusters_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    f32 = lambda x: __import__("struct").unpack("f", __import__("struct").pack("f", x))[0]
    rows = [(i, [f32(rng.gauss(i % 5, 0.4)) for _ in range(6)]) for i in range(300)]
    rows += [(i, [0.5] * 6) for i in range(300, 420)] + [(7, rows[7][1]), (7, [9.0] * 6), (None, [1.0] * 6)]
    rows += [(500, None), (501, []), (502, [1.0] * 5), (503, [1.0] * 5 + [None]), (504, [1.0] * 7),
             (505, [1.0] * 5 + [math.nan]), (506, [1.0] * 5 + [math.inf]), (None, None)]
    df = spark.createDataFrame([(i, e, "?", 3, "?", 1) for i, e in rows], VECTORS).repartition(5)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    for batch in (7, 4096):
        monkeypatch.setattr(clusters, "BATCH", batch)
        got = rows_of(clusters.clusters(df, k=9, dim=6, rounds=4), *columns)
        assert got == clustered(rows, 9, 6, 4)
    assert rows_of(clusters.clusters(df, k=2000, dim=6, rounds=2), *columns) == clustered(rows, 2000, 6, 2)
    assert clusters.clusters(df.limit(0)).collect() == []
    assert clusters.clusters(df.filter("vec_id > 499"), dim=6).collect() == []


def test_components_beyond_exact_distances_stop_the_job(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0], "", 0, "", 0)], VECTORS)
    with pytest.raises(Exception, match="too large"):
        clusters.clusters(df, dim=2)


# ---- prefix trie ----

TURNS = "conv_id long, turn long, role string, text string, pos string, depth int, ref int, n string"


def rebuilt(rows):
    own = {}
    key = lambda t: (t[0] is not None, t[0] or 0, hashlib.sha256(
        f"{len(t[1])}:{t[1]}{t[2]}".encode()).hexdigest())
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn, role or "", text or ""))
    own = {c: [t[1:] for t in sorted(ts, key=key)] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(math.fmod(c, 100))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def nodes_of(rows):
    whole = rebuilt(rows)
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    out = []
    for node, convs in members.items():
        under = [x for x in members if x[:len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = [x for x in under if not any(y[:len(x)] == x and len(y) > len(x) for y in under)]
        saved = sum((len(members[x]) - 1) * len(x[-1][1]) for x in under if x)
        ends = ",".join(str(c) for c in sorted(convs) if len(whole[c]) == len(node))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs),
                    len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(str, out))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        "ends_sha256"]


def turns(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, 2, "n") for r in rows], TURNS).repartition(3)


def test_trie_equals_brute_force(spark, buckets, monkeypatch):
    monkeypatch.setattr(prefix_trie, "IDS", 4)
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 24), *range(100, 118), *range(205, 212), -7, -100, -130]:
        for t in range(rng.randint(1, 7)):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "user", None]),
                         rng.choice(["a", "b", "é\U0001f600", "", None])))
    rows += [(300, t, "user", "x" * (t % 3)) for t in range(60)]  # the longest holds many turns
    rows += [(310, t, "user", "x" * (t % 3)) for t in range(60)]
    rows += [(c, 0, "user", "a") for c in range(320, 360)]
    rows += [rows[0], rows[0], (None, 1, "user", "a"), (None, None, None, None), (400, 1, "user", "y" * 60_000)]
    assert rows_of(prefix_trie.trie(turns(spark, rows)), *TRIE) == nodes_of(rows)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(turns(spark, [])).collect() == []
    assert prefix_trie.trie(turns(spark, [(None, 1, "user", "a")])).collect() == []


def test_mistaken_references_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie.F, "sha2", lambda c, bits: F.lit("0" * 64))
    with pytest.raises(RuntimeError, match="reference"):
        prefix_trie.trie(turns(spark, [(1, 0, "user", "a"), (2, 0, "user", "b")]))


def test_mistaken_fingerprints_are_noticed(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "FIELDS", [(2, 1), (2, 1), (2, 1)])
    rows = [(c, t, "user", f"{c}-{t}") for c in range(100, 140) for t in range(3)]
    with pytest.raises(RuntimeError, match="fingerprint"):
        prefix_trie.trie(turns(spark, rows))
