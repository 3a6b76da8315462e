"""Repeated runs of two lines or more go whole, whatever stands around them."""

import random

from stacklore.llm import line_dedup

DOCS = "doc_id long, text string"


def test_passages_of_two_to_five_lines_go_whole(spark):
    rng = random.Random(3)
    own = lambda: [f"own {rng.random()}" for _ in range(rng.randint(1, 4))]
    passages = [[f"passage {k} line {j}" for j in range(2 + k % 4)] for k in range(40)]
    rows = [(copy * 100 + k, "\n".join(own() + passage + own()))
            for copy in range(3) for k, passage in enumerate(passages)]
    got = {r["doc_id"]: r for r in line_dedup.without_repeated_runs(
        spark.createDataFrame(rows, DOCS)).collect()}
    for k, text in rows:
        lines = text.split("\n")
        left = [x for x in lines if k < 100 or x.startswith("own")]
        assert got[k]["text"].split("\n") == left
        assert got[k]["n_removed"] == len(lines) - len(left)


def test_runs_that_touch_themselves_and_odd_rows(spark):
    rows = [(1, "x\nx\nx\nx"), (2, "a\nb\nc"), (3, "b\nc\nd"), (4, "c\na"), (5, ""), (6, None),
            (None, "a\nb"), (7, "c\na"), (8, "e\nf"), (8, "e\nf"), (9, "a")]
    got = line_dedup.without_repeated_runs(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(((r["doc_id"] or 0), r["text"]) for r in got) == [
        (0, "a\nb"), (1, "x\nx"), (2, "a\nb\nc"), (3, "d"), (4, "c\na"), (5, ""), (6, None),
        (7, ""), (8, "e\nf"), (8, "e\nf"), (9, "a")]
