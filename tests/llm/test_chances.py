"""Frequencies of inclusion against the chances that the measure gives."""

import random

from stacklore.llm import mixing


def chances(rows, wanted):
    """{measure: chance}: measure times the level at which the expected words are ``wanted``."""
    sure, left = set(), wanted
    while True:
        level = left / sum(a * n for a, n in rows if a not in sure)
        new = {a for a, _ in rows if a not in sure and a * level >= 1}
        if not new:
            return {a: 1.0 if a in sure else a * level for a, _ in rows}
        sure |= new
        left = wanted - sum(n for a, n in rows if a in sure)


def frequencies(spark, rows, wanted, by_size):
    """Share taken of every measure, and its count; one source, target ``wanted`` words."""
    docs = spark.createDataFrame([(k, " ".join(["w"] * n), "s", float(a)) for k, (a, n) in
                                  enumerate(rows)], "doc_id long, text string, source string, appeal double")
    if by_size:
        docs = docs.drop("appeal")
    total = sum(n for _, n in rows)
    got = {r["doc_id"]: r["copies"] for r in mixing.mix(
        docs, budget=wanted / total, by_size=by_size).collect()}
    assert len(got) == len(rows)
    taken = sum(got[k] * n for k, (_, n) in enumerate(rows))
    assert abs(taken - wanted) <= max(n for _, n in rows)
    counts = {}
    for k, (a, _) in enumerate(rows):
        c = counts.setdefault(a, [0, 0])
        c[0] += got[k]
        c[1] += 1
    return {a: (x / n, n) for a, (x, n) in counts.items()}


def close(got, want):
    for a, (share, n) in got.items():
        p = want[a]
        assert abs(share - p) <= 4 * (p * (1 - p) / n) ** 0.5 + 1e-12, (a, share, p, n)


def test_frequencies_follow_the_appeal_and_large_ones_are_certain(spark):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 4, 8]), rng.randint(1, 9)) for _ in range(20_000)]
    rows += [(60, 3)] * 200 + [(3000, 5)] * 50
    wanted = 0.3 * sum(n for _, n in rows)
    want = chances(rows, wanted)
    assert want[60] == want[3000] == 1.0 and 0.5 < want[8] < 1
    close(frequencies(spark, rows, wanted, False), want)


def test_frequencies_follow_the_size(spark):
    rng = random.Random(5)
    rows = [(n, n) for n in (rng.choice([1, 3, 6, 12, 100]) for _ in range(12_000))]
    rows = [(a, n) for k, (a, n) in enumerate(rows) if n < 100 or k % 20 == 0]
    wanted = 0.5 * sum(n for _, n in rows)
    want = chances(rows, wanted)
    assert want[100] == 1.0
    close(frequencies(spark, rows, wanted, True), want)
