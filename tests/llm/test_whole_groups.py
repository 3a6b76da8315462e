"""Groups that fit a shard are cut only where no shard has room, larger ones least."""

import random
from collections import Counter

import pytest

from stacklore.llm import sharding

DOCS = "doc_id long, text string"


def homes(spark, sizes, singles=0):
    """{group: shards it lies in} for groups of these sizes; checks counts and slots."""
    texts = [f"group {g}" for g, n in enumerate(sizes) for _ in range(n)]
    texts += [f"single {k}" for k in range(singles)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()
    loads = Counter(r["shard"] for r in got)
    quotas = [len(texts) // 8 + (s < len(texts) % 8) for s in range(8)]
    assert [loads[s] for s in range(8)] == quotas
    for s in range(8):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(quotas[s]))
    found = {}
    for r in got:
        if texts[r["doc_id"]].startswith("group"):
            found.setdefault(int(texts[r["doc_id"]][6:]), set()).add(r["shard"])
    return found


@pytest.mark.parametrize("size", [2, 4, 20])
def test_groups_stay_whole_where_every_row_has_copies(spark, size):
    found = homes(spark, [size] * (4000 // size))
    assert sum(len(h) > 1 for h in found.values()) <= (7 if 500 % size else 0)


def test_mixed_groups_without_singles(spark):
    rng = random.Random(7)
    found = homes(spark, [rng.choice([2, 2, 2, 3, 5, 20, 90]) for _ in range(400)])
    assert sum(len(h) > 1 for h in found.values()) <= 7


def test_groups_under_the_quota_are_never_cut_and_larger_ones_least(spark):
    found = homes(spark, [200, 240, 125, 126] + [4] * 150, singles=709)
    assert all(len(h) == 1 for h in found.values())
    found = homes(spark, [600, 190, 2], singles=1208)
    assert len(found[0]) == 3 and len(found[1]) == 1 and len(found[2]) == 1


def test_plans_leave_nothing_that_fits():
    rng = random.Random(8)
    for _ in range(300):
        counts = Counter(rng.choice([2, 3, 7, 20, 55, 90]) for _ in range(rng.randint(1, 60)))
        total = sum(n * c for n, c in counts.items()) + rng.choice([0, 3, 40])
        quotas = [total // 8 + (s < total % 8) for s in range(8)]
        counts = Counter({n: c for n, c in counts.items() if n <= quotas[0]})
        plan, room = sharding._plan(counts, quotas)
        assert min(room) >= 0
        assert room == [q - sum(n * p[s] for n, p in plan.items()) for s, q in enumerate(quotas)]
        for n, c in counts.items():
            assert sum(plan[n]) == c or max(room) < n
    assert sum(sharding._plan({6: 1, 4: 2, 3: 2}, [10, 10])[1]) == 0
