"""The stored vector index, and replies of a provider kept in a log."""

import hashlib
import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from stacklore.operators import provider, vectors as N
from stacklore.operators.vector_index import MAX_CELLS, VectorIndex, recall

ASKED = "query_id long, project string, embedding array<double>"
HELD = "project string, name string, embedding array<double>"


def clustered(seed, count, groups=20, size=16, noise=0.25):
    rng = np.random.default_rng(seed)
    middle = np.random.default_rng(99).normal(size=(groups, size))
    x = middle[rng.integers(0, groups, count)] + noise * rng.normal(size=(count, size))
    return [[float(v) for v in r] for r in x / np.linalg.norm(x, axis=1)[:, None]]


def rows_of(df):
    return sorted(tuple(r[c] for c in ("query_id", "project", "name", "similarity", "rank"))
                  for r in df.collect())


@pytest.fixture(scope="module")
def tables(spark):
    held = [("big" if i % 50 else "small", f"v{i:04}", u) for i, u in enumerate(clustered(1, 1500))]
    held += [held[0], held[7]]  # repeated rows
    asked = [(i, [None, "big", "small", "nobody"][i % 4], u)
             for i, u in enumerate(clustered(2, 40))]
    return (spark.createDataFrame(held, HELD).withColumn("cell", F.lit("clash")),
            spark.createDataFrame(asked, ASKED).withColumn("cells", F.lit("clash")))


@pytest.mark.parametrize("block_rows", [20, 8192])
def test_all_cells_give_the_exact_result(spark, tables, tmp_path, block_rows):
    held, asked = tables
    index = VectorIndex.build(held, str(tmp_path / "index"), cells=25)
    assert index.stored().count() == held.count()
    got = index.search(asked, 4, MAX_CELLS, block_rows=block_rows)
    assert rows_of(got) == rows_of(N.knn(asked, held, 4))
    near = index.search(asked, 4, MAX_CELLS, threshold=0.9, block_rows=block_rows)
    assert rows_of(near) == rows_of(N.knn(asked, held, 4, threshold=0.9))


def test_few_cells_find_most_neighbours(spark, tables, tmp_path):
    held, asked = tables
    index = VectorIndex.build(held, str(tmp_path / "index"), cells=25)
    probes = index.probes_for(asked, 4)
    assert 1 <= probes <= 6
    found, true = index.search(asked, 4, probes), N.knn(asked, held, 4)
    sums = recall(found, true).agg(F.sum("found"), F.sum("wanted")).first()
    assert sums[0] >= 0.9 * sums[1]
    # A small project fills its k however few cells are asked for.
    small = index.search(asked.where("project = 'small'"), 4, 1)
    assert {r["count"] for r in small.groupBy("query_id").count().collect()} == {4}
    assert not found.where("query_id % 4 = 3").collect()


def test_recall_of_the_registered_search(spark, sf_dir):
    from stacklore.plans import search_queries as S, views as V
    found = S.vector_search_ann(spark, sf_dir).select("query_id", "project", "name")
    held = N.vector_prepare(V.vectors(spark, sf_dir), 64)
    asked = held.where("doc_id % 100 = 0").select(
        F.col("doc_id").cast("long").alias("query_id"), "embedding",
        F.when(F.col("doc_id") % 200 == 0, F.col("project")).alias("project"))
    sums = recall(found, N.knn(asked, held, S.K)).agg(F.sum("found"), F.sum("wanted")).first()
    assert sums[0] >= 0.9 * sums[1] > 0


def test_empty_index_and_no_queries(spark, tables, tmp_path):
    held, asked = tables
    nothing = VectorIndex.build(held.limit(0), str(tmp_path / "none"))
    assert nothing.search(asked, 4, 3).collect() == []
    assert nothing.probes_for(asked, 4) == 1
    index = VectorIndex.build(held, str(tmp_path / "index"), cells=3)
    assert index.search(asked.limit(0), 4, 3).collect() == []


def test_grid_cuts_each_query_before_the_shuffle(spark, tables):
    """A task passes on k rows per query, however many blocks it met."""
    held, asked = tables
    plan = N.knn(asked, held, 4, sent_bytes=-1, block_rows=50)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert "WindowGroupLimit" in physical and "Partial" in physical
    assert physical.index("Final") < physical.index("Exchange") < physical.index("Partial")


# ---- provider ----------------------------------------------------------------------------

def flaky(folder):
    """Fails the first call of every prompt whose digest starts low; notes every call."""
    def reply(prompts):
        out = []
        for p in prompts:
            name = hashlib.md5(p.encode()).hexdigest()
            before = len(list(Path(folder).glob(f"{name}-*")))
            (Path(folder) / f"{name}-{uuid.uuid4().hex}").touch()
            out.append(None if name[0] < "8" and not before else f"re: {p}")
        return out

    return reply


def calls(folder):
    return len(list(Path(folder).iterdir()))


def test_each_prompt_is_answered_once(spark, tmp_path):
    noted = tmp_path / "calls"
    noted.mkdir()
    texts = [f"prompt {i}" for i in range(40)] + ["", "long " * 30000]
    rows = [(i, t) for i, t in enumerate(texts * 3)] + [(900, None)]
    prompts = spark.createDataFrame(rows, "id long, prompt string").withColumn(
        "prompt_key", F.lit("clash"))
    log = provider.reply_log(spark, str(tmp_path / "log"))
    got = provider.ask(prompts, flaky(str(noted)), log, "m", batch=7, tasks=3)
    assert got.columns == ["id", "prompt", "prompt_key", "reply"]
    assert {(r["id"], r["reply"]) for r in got.collect()} == {
        (i, None if t is None else f"re: {t}") for i, t in rows}
    failed = sum(hashlib.md5(t.encode()).hexdigest()[0] < "8" for t in texts)
    assert failed and calls(noted) == len(texts) + failed
    assert log.read("replies").count() == len(texts)

    more = prompts.select("id", "prompt").union(
        spark.createDataFrame([(901, "new"), (902, "new")], "id long, prompt string"))
    again = provider.ask(more, flaky(str(noted)), log, "m")
    assert {r["reply"] for r in again.where("id > 900").collect()} == {"re: new"}
    assert calls(noted) <= len(texts) + failed + 2
    other = provider.ask(prompts.where("id = 0"), lambda ps: ["x" for _ in ps], log, "other")
    assert other.first()["reply"] == "x"
    assert provider.ask(prompts.where("id = 0"), None, log, "m").first()["reply"] == "re: prompt 0"


def test_what_never_answers_stays_open(spark, tmp_path):
    log = provider.reply_log(spark, str(tmp_path / "log"))
    prompts = spark.createDataFrame([(1, "a"), (2, None)], "id long, prompt string")
    failed = provider.ask(prompts, lambda ps: [None for _ in ps], log, "m", tries=2)
    assert [(r["id"], r["reply"]) for r in failed.orderBy("id").collect()] == [(1, None), (2, None)]
    assert provider.ask(prompts.limit(0), None, log, "m").collect() == []
    later = provider.ask(prompts, lambda ps: ["b" for _ in ps], log, "m")
    assert [r["reply"] for r in later.orderBy("id").collect()] == ["b", None]
    with pytest.raises(ValueError):
        provider.ask(prompts.withColumn("reply", F.lit("")), None, log, "m")
