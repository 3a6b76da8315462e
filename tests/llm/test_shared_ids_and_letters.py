"""Ids that hold several texts, and texts without a letter."""

import random

from stacklore.llm import language, near_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def components(rows):
    """{id: smallest id reachable} by all pairs; rows of one id are one node."""
    sets = [(i, shingles(t)) for i, t in rows]
    label = {i: i for i, _ in rows}
    links = [(i, j) for i, a in sets for j, b in sets
             if a and b and 100 * len(a & b) >= 85 * len(a | b)]
    changed = True
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            if (label[i], label[j]) != (low, low):
                label[i] = label[j] = low
                changed = True
    return label


def test_an_id_with_several_texts_joins_their_groups(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.choice("abcdefgh") + str(rng.randint(0, 60)) for _ in range(40)) for _ in range(9)]
    near = texts[3] + " tail"
    rows = [(1, texts[0]), (2, texts[1]), (5, texts[0]), (5, texts[1]),  # 5 bridges 1 and 2
            (7, texts[2]), (7, texts[3]), (8, near), (9, texts[4]), (9, texts[5]), (9, texts[6]),
            (10, texts[6]), (11, texts[4]), (4, texts[5]), (20, texts[7]), (21, texts[8]), (21, texts[8])]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS)
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()]
    want = components(rows)
    assert sorted(got) == sorted((i, want[i], i == want[i]) for i, _ in rows)
    assert want[5] == want[2] == 1 and want[8] == 7 and want[9] == want[11] == 4


def test_numbers_and_signs_are_no_letters(spark):
    assert not any(map(language.has_letter, ["", "½ ² ³", "12 ½", "_ - 7", "Ⅷ ①", "٣"]))
    assert all(map(language.has_letter, ["a", "½a", "12 é", "中", "_x_"]))
    rows = [(i, "the house and the garden", "en", "s", 1) for i in range(30)]
    rows += [(i, "la maison et le jardin", "fr", "s", 1) for i in range(30, 60)]
    odd = [(100, "½ ² ³", "en", "s", 1), (101, "12 ½", "fr", "s", 1), (102, None, "en", "s", 1),
           (103, "the ½", "en", "s", 1)]
    from stacklore.llm.common import held_out
    got = language.language(spark.createDataFrame(rows + odd, DOCS), lambda c: held_out(c, 5, 0))
    found = {r["doc_id"]: r["lang_pred"] for r in got.filter("doc_id >= 100").collect()}
    assert found == {100: "und", 101: "und", 102: "und", 103: "en"}
