"""The training-data operators against brute force, planted cases and odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from stacklore.llm import (
    decontamination, language, line_dedup, mixing, near_dedup, quality, rules, sharding,
    token_counts, toxicity,
)
from stacklore.llm.common import components, held_out, join_hot, ranked, table
from stacklore.llm.queries import QUERIES
from stacklore.session import scratch_dir

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def odd_rows(spark):
    """Nulls, empty and very long texts, repeated rows, and clashing extra columns."""
    long = " ".join(f"w{k}" for k in range(30_000))
    rows = [(1, None, "a"), (2, "", None), (3, long, "a"), (3, long, "a"), (None, "x y z", None),
            (5, " \n\t ", "b"), (6, "é ü\n" * 60, "b"), (7, "x" * 50_000, None)]
    return frame(spark, rows).withColumns({
        "score": F.lit("?"), "key": F.lit(1), "node": F.lit(2), "label": F.lit(3),
        "size": F.lit(4), "n": F.lit(5), "h": F.lit(6), "kept": F.lit(7)})


def empty(spark):
    return spark.createDataFrame([], DOCS)


LABELS = "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("name", [
    "toxicity", "quality", "language", "rules", "near", "lines", "shards", "leaks", "mix", "tokens"])
def test_odd_and_empty_tables(spark, name):
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (None, 1, 1), (5, None, None)], LABELS)
    none = spark.createDataFrame([], LABELS)
    items = spark.createDataFrame([(1, None), (None, "a b"), (2, "")], "item_id long, text string")
    fold = lambda c: held_out(c, 5, 0)
    run = {
        "toxicity": lambda d, lab: toxicity.toxicity(d, lab, fold),
        "quality": lambda d, lab: quality.quality(d, lab, fold),
        "language": lambda d, lab: language.language(d, fold),
        "rules": lambda d, lab: rules.apply_policy(rules.ledger(d)),
        "near": lambda d, lab: near_dedup.near_duplicates(d),
        "lines": lambda d, lab: line_dedup.without_repeats(d),
        "shards": lambda d, lab: sharding.shard(d),
        "leaks": lambda d, lab: decontamination.contaminated(d, items),
        "mix": lambda d, lab: mixing.mix(d),
        "tokens": lambda d, lab: token_counts.counted(d),
    }[name]
    per_row = {"leaks": 0, "tokens": 2}.get(name, 1)
    assert run(odd_rows(spark), labels).count() == 8 * per_row
    assert run(odd_rows(spark), none).count() == 8 * per_row
    assert run(empty(spark), none).count() == 0


def accuracy(spark, sf, op, label):
    rows = op.join(table(spark, sf, "labels"), "doc_id").filter(f"held_out AND {label} IS NOT NULL")
    got = rows.agg(F.avg((F.col("predicted") == F.col(label)).cast("int"))).first()[0]
    base = rows.agg(F.avg(label)).first()[0]
    return got, max(base, 1 - base)


def test_classifiers_beat_the_larger_class(spark):
    sf = "/root/testdata/sf0.01"
    got, base = accuracy(spark, sf, QUERIES["op1_toxicity"](spark, sf), "toxic")
    assert got > base
    got, base = accuracy(spark, sf, QUERIES["op3_quality"](spark, sf), "quality")
    assert got > base
    lang = QUERIES["op2_language_id"](spark, sf).filter("held_out").join(
        table(spark, sf, "documents").select("doc_id", "lang"), "doc_id")
    assert lang.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_scores_do_not_use_labels_or_ids(spark):
    text = "the and of worthless trash"
    docs = frame(spark, [(k, text, f"s{k}") for k in range(6)])
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(6)], LABELS)
    scores = toxicity.toxicity(docs, labels, lambda c: held_out(c, 5, 0)).select("score").distinct()
    assert scores.count() == 1


def test_held_out_follows_crc32(spark):
    got = spark.range(50).select("id", held_out(F.col("id"), 5, 0).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 5 == 0) for r in got)


def brute_language(texts, langs, text, order=3):
    """Code lengths of the same model from plain dictionaries."""
    counts = {x: [Counter() for _ in range(order + 1)] for x in langs}
    for t, x in zip(texts, langs):
        data = b" " * order + t.encode()
        for k in range(order, len(data)):
            for n in range(order + 1):
                counts[x][n][data[k - n:k + 1]] += 1
    out = {}
    for x in set(langs):
        bits, data = 0.0, b" " * order + text.encode()
        for k in range(order, len(data)):
            for n in range(order, -1, -1):
                ctx = data[k - n:k]
                seen = {g: c for g, c in counts[x][n].items() if g[:-1] == ctx}
                total, kinds = sum(seen.values()), len(seen)
                if data[k - n:k + 1] in seen:
                    bits -= np.log2(seen[data[k - n:k + 1]] / (total + kinds))
                    break
                if kinds:
                    bits -= np.log2(kinds / (total + kinds))
            else:
                bits += np.log2(language.ALPHABET)
        out[x] = bits
    return out


def test_language_code_lengths_are_those_of_the_tree(spark):
    texts = ["abba abba cab", "der und die", "abcab bca ab", "und der die das"]
    langs = ["x", "y", "x", "y"]
    docs = spark.createDataFrame(list(zip(range(4), texts, langs)), "doc_id long, text string, lang string")
    model = language.train(docs, lambda c: F.lit(False))
    for text in ("abba die", "und cab", "der"):
        want = brute_language(texts, langs, text)
        assert model.cost(text) == pytest.approx([want[x] for x in model.langs], rel=1e-5)


def brute_rules(text):
    w = WORD.findall(text or "")
    windows = Counter(tuple(w[k:k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k:k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def test_rule_measures(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d é |x #y".split()) for _ in range(rng.randint(0, 80)))
             .replace("c d", "c\nd") for _ in range(60)] + [None, "", "a b c a b c", "a a a a"]
    docs = frame(spark, [(k, t, "s") for k, t in enumerate(texts)])
    rows = rules.apply_policy(rules.ledger(docs)).collect()
    for r in rows:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"],
                r["n_repeat_words"]) == brute_rules(texts[r["doc_id"]])
        assert r["kept"] == (r["fail_bits"] == 0)
    found = {r["rule"]: r for r in rules.ablation(rules.ledger(docs)).collect()}
    bits = [r["fail_bits"] for r in rows]
    for name, bit in rules.BIT.items():
        assert found[name]["n_failed"] == sum(1 for b in bits if b & bit)
        assert found[name]["n_failed_alone"] == sum(1 for b in bits if b == bit)
    assert rules.passed(docs).count() == sum(1 for b in bits if not b)


def brute_near(rows, size=3, threshold=85):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k:k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    label = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and
             100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])]
    for _ in sets:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return {i: (len(sets[i]), label[i]) for i in sets}


def test_bands_follow_the_threshold():
    assert [near_dedup.band_rows(t) for t in (80, 85)] == [4, 5]
    for t in (50, 70, 80, 85, 95):
        rows = near_dedup.band_rows(t)
        assert (1 - (t / 100) ** rows) ** (near_dedup.REGISTERS // rows) <= near_dedup.MISS


@pytest.mark.parametrize("size, threshold", [(3, 85), (5, 80)])
def test_near_duplicates_with_a_large_group(spark, size, threshold):
    """Copies of copies: members differ too much to be linked with the first one directly."""
    rng = random.Random(1)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for i in range(120):
        words = list(base)
        for k in rng.sample(range(150), rng.choice([0, 1, 3, 5, 8, 12])):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    rows += [(200 + i, " ".join(f"y{i}_{k}" for k in range(40))) for i in range(30)]
    rows += [(300, "a b"), (301, "A  B"), (302, None), (303, ""), (304, "a b c")]
    docs = frame(spark, [(i, t, "s") for i, t in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"])
           for r in near_dedup.near_duplicates(docs, threshold, size).collect()}
    assert got == brute_near(rows, size, threshold)


def test_sketch_estimates_and_merges():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 2 ** 63, 4000, dtype=np.int64).astype(np.uint64)
    a, b = pool[:2000], pool[400:2200]
    items = np.concatenate([a, b, np.union1d(a, b)])
    regs = near_dedup.sketch(items, np.array([0, 2000, 3800, 3800 + 2200]))
    assert (near_dedup.merge(regs[0], regs[1]) == regs[2]).all()
    j = near_dedup.likely_similarity(regs[:1], regs[1:2], np.array([2000.0]), np.array([1800.0]))
    assert abs(j[0] - 1600 / 2200) < 0.15


def test_components_of_long_chains_and_stars(spark):
    links = [(k, k + 1) for k in range(100)] + [(1000, 1000 + k) for k in range(1, 300)]
    got = {r["node"]: r["label"] for r in components(
        spark.createDataFrame(links, "a long, b long")).collect()}
    assert set(got[k] for k in range(101)) == {0}
    assert set(got[1000 + k] for k in range(300)) == {1000}


def test_hot_joins_and_ranks(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    assert join_hot(many, one, "k").filter("k = 0 AND first = 0").count() == 4000
    assert join_hot(many, one, "k").filter("k = first").count() == 5000
    got = ranked(spark.range(3000).select((F.col("id") % 3).alias("p"), F.xxhash64("id").alias("h"), "id"),
                 "p", ["h", "id"], 3000, per_window=100, name="r")
    stats = got.groupBy("p").agg(F.min("r"), F.max("r"), F.countDistinct("r")).collect()
    assert all(tuple(r)[1:] == (0, 999, 1000) for r in stats)


def test_lines_keep_the_first_of_a_repeated_chunk(spark):
    passage = "\n".join(f"shared line {k}" for k in range(12))
    docs = frame(spark, [(k, f"own {k}\nmore {k}\n{passage}\nend {k}", "s") for k in range(9)])
    got = {r["doc_id"]: r for r in line_dedup.without_repeats(docs).collect()}
    assert got[0]["n_removed"] == 0 and passage in got[0]["text"]
    assert all(got[k]["n_removed"] > 0 and f"own {k}" in got[k]["text"] for k in range(1, 9))
    assert max(len(got[k]["text"]) for k in range(1, 9)) < len(got[0]["text"])


def brute_lines(rows):
    """Texts without repeated chunks, by the least rolling hash of three lines."""
    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    seen, left = set(), {}
    for doc_id, text in sorted(rows):
        lines = text.split("\n")
        h = [md5(x) for x in lines]
        roll = [md5((h[i - 1] if i else "") + h[i]) for i in range(len(h))]
        kept, chunk = [], []
        for i, line in enumerate(lines):
            chunk.append(line)
            inner = 0 < i < len(lines) - 1
            if i == len(lines) - 1 or (inner and roll[i] < min(roll[i - 1], roll[i + 1])):
                if len(chunk) < 2 or tuple(chunk) not in seen:
                    kept += chunk
                if len(chunk) > 1:
                    seen.add(tuple(chunk))
                chunk = []
        left[doc_id] = "\n".join(kept)
    return left


def test_lines_agree_with_brute_force_and_lose_no_inner_line(spark):
    rng = random.Random(11)
    passage = [f"shared line {k}" for k in range(60)]
    rows = []
    for k in range(40):
        own = [[f"own {k} {j} {rng.random()}" for j in range(rng.randint(1, 9))] for _ in range(2)]
        rows.append((k, "\n".join(own[0] + passage + ["same"] * rng.randint(0, 4) + own[1])))
    rows += [(50, ""), (51, "one line"), (52, "\n\n\n"), (53, "\n\n\n")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.without_repeats(
        frame(spark, [(k, t, "s") for k, t in rows])).collect()}
    assert got == brute_lines(rows)
    for k in range(1, 40):
        assert sum(x.startswith("shared") for x in got[k].split("\n")) <= 12


def test_sharding_keeps_groups_and_counts(spark):
    rows = [(k, f"single {k}", "s") for k in range(300)]
    rows += [(1000 + k, f"group {k // 4}", "s") for k in range(200)]
    rows += [(2000 + k, "very large", "s") for k in range(250)] + [(None, None, "s")]
    got = sharding.shard(frame(spark, rows)).collect()
    sizes = Counter(r["shard"] for r in got)
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 1
    for s, n in sizes.items():
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n))
    homes = {}
    for r in got:
        if r["doc_id"] is not None and 1000 <= r["doc_id"] < 2000:
            homes.setdefault((r["doc_id"] - 1000) // 4, set()).add(r["shard"])
    assert sum(len(h) > 1 for h in homes.values()) <= 3
    assert all(r["law"] == "rows" and r["grown_shard"] is None for r in got)


def test_leaks_survive_substitutions(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    items = [[word() for _ in range(30)] for _ in range(20)]
    rows = []
    for k, item in enumerate(items):
        copy = list(item)
        for p in rng.sample(range(30), 3):
            copy[p] = word()
        rows.append((k, " ".join([word() for _ in range(40)] + copy + [word() for _ in range(40)]), "s"))
        rows.append((100 + k, " ".join(word() for _ in range(120)), "s"))
        rows.append((200 + k, f"{word()} {' '.join(item).upper()}.", "s"))
    tests = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in
           decontamination.contaminated(frame(spark, rows), tests).collect()}
    assert got == {(k, k) for k in range(20)} | {(200 + k, k) for k in range(20)}


def test_mix_meets_targets(spark):
    rng = random.Random(9)
    rows = [(k, " ".join(["w"] * rng.randint(1, 60)), f"s{k % 7}" if k % 50 else None)
            for k in range(3000)]
    got = mixing.mix(frame(spark, rows)).collect()
    by = {}
    for r in got:
        assert r["taken"] <= 2 * r["size"]
        x = by.setdefault(r["source"], [0, r["target"], r["source_size"]])
        x[0] += r["taken"]
    assert all(abs(taken - target) <= 30 and target <= 2 * size for taken, target, size in by.values())
    total = sum(r["size"] for r in got)
    assert sum(x[1] for x in by.values()) == pytest.approx(1.5 * total)
    again = {(r["doc_id"], r["taken"]) for r in mixing.mix(frame(spark, rows).repartition(7)).collect()}
    assert again == {(r["doc_id"], r["taken"]) for r in got}


def test_unequal_chances_follow_the_appeal(spark):
    rows = frame(spark, [(k, "w w w", "s" if k < 2000 else "t") for k in range(4000)]).withColumn(
        "appeal", F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(1.0))
    got = mixing.mix(rows, weights=(1, 3), budget=0.4).groupBy((F.col("doc_id") % 2).alias("odd")).agg(
        F.sum("copies").alias("n")).collect()
    n = {r["odd"]: r["n"] for r in got}
    assert n[0] > 1.5 * n[1]


def test_token_batches_are_idempotent_and_signed(spark):
    store = scratch_dir(spark, "test-tokens")
    keys = ["source", "lang", "tokenizer"]
    rows = frame(spark, [(1, "a b c", "s"), (2, "d e", "s"), (3, None, "t")])
    counts = token_counts.counted(rows).filter("tokenizer = 'words-1'")
    assert token_counts.commit(store, "b1", token_counts.change("insert", counts))
    assert not token_counts.commit(store, "b1", token_counts.change("insert", counts))
    revised = counts.filter("doc_id = 1").withColumn("n_tokens", F.lit(10).cast("long"))
    assert token_counts.commit(store, "b2", token_counts.change("revise", revised))
    assert token_counts.commit(store, "b3", token_counts.change("delete", counts.filter("doc_id = 2")))
    unknown = counts.filter("doc_id = 2").withColumn("doc_id", F.lit(9).cast("long"))
    assert token_counts.commit(store, "b4", token_counts.change("delete", unknown))
    got = {tuple(r[k] for k in keys): (r["n_docs"], r["n_tokens"])
           for r in token_counts.totals(spark, store).collect()}
    assert got == {("s", "en", "words-1"): (1, 10), ("t", "en", "words-1"): (1, 0)}
    now = {r["doc_id"]: (r["n_docs"], r["n_tokens"])
           for r in token_counts.current(spark, store).collect()}
    assert now == {1: (1, 10), 3: (1, 0)}


def test_token_totals_against_brute_force(spark, sf_dir):
    got = {tuple(r)[:3]: tuple(r)[3:] for r in QUERIES["op4_token_counts"](spark, sf_dir).collect()}
    encoder = token_counts._encoder(token_counts.VOCABULARY)
    want, seen = Counter(), set()
    for r in table(spark, sf_dir, "documents").orderBy("doc_id").collect():
        if r["text"] in seen:
            continue
        seen.add(r["text"])
        text = "\n".join(dict.fromkeys(r["text"].split("\n")))
        want[(r["source"], r["lang"], "words-1")] += len(WORD.findall(text))
        want[(r["source"], r["lang"], "byte-bpe-50k")] += len(encoder.encode_ordinary(text))
    assert {k: v[1] for k, v in got.items()} == dict(want)


def test_pipeline_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kept = rules.passed(docs)
    assert kept.columns == docs.columns
    once = corpus_pipeline.near_duplicates(spark, kept, sf_dir)
    labels = brute_near([(r["doc_id"], r["text"]) for r in kept.collect()], 5, 80)
    assert {r["doc_id"] for r in once.collect()} == {i for i, (_, c) in labels.items() if i == c}
    result = corpus_pipeline.run(spark, sf_dir).collect()
    items = [" ".join(WORD.findall(r["text"].lower())) for r in table(spark, sf_dir, "benchmark").collect()]
    left = {r["doc_id"] for r in result}
    for r in once.filter(F.col("doc_id").isin(list(left))).collect():
        flat = " ".join(WORD.findall(r["text"].lower()))
        assert not any(x in flat for x in items)
    sizes = Counter(r["shard"] for r in result)
    assert max(sizes.values()) - min(sizes.values()) <= 1
