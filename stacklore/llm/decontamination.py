"""Benchmark decontamination by spaced seeds.

A seed is the hash of the words that a fixed mask selects from SPAN words in a row; words
it skips may differ. Test items and documents meet on equal seeds, and each meeting gives
a diagonal: the place of the item in the document. Along every diagonal the words are then
compared one by one, and the best stretch (1 for an equal word, -MISS for another) counts
as contamination if it holds enough equal words: MIN_MATCH, or SHARE of a short item.
Words are lower-cased and freed of signs first. DataFrame functions only.

The seeds of the test items are broadcast up to BROADCAST_ROWS (24 bytes each); beyond
that the same join shuffles both sides by seed. Texts without a hit are left out before
texts are shuffled (``only``).

Cases: null and empty texts have no words and no hits; items under SPAN words have no seed
and are not searched. Rows and items without id are left out, as a hit could not name
them. Repeated rows and rows sharing an id give one result per id and item, the best.
Other columns are ignored. Empty tables give an empty result.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore.llm.common import SPACE, only, typed
from stacklore.session import cut_lineage

SIGNS = r"[^\p{L}\p{M}\p{N}\x20\x09-\x0D]+"
SPAN = 9
# Places of a mask, in 0 .. SPAN - 1.
MASKS = [(0, 1, 3, 5, 7, 8), (0, 2, 3, 4, 6, 8)]
MISS = 2
MIN_MATCH, SHARE = 13, 0.7
BROADCAST_ROWS = 2_000_000


def plain_words(text):
    """Lower-case words without signs."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SIGNS, "")
    return F.filter(F.split(bare, SPACE), lambda w: w != "")


def seeds(rows, key) -> DataFrame:
    """(key, pos, seed) for every mask and place of the words in column ``w``."""
    hashed = rows.select(key, F.transform("w", lambda x: F.xxhash64(x)).alias("_h"))
    places = F.greatest(F.size("_h") - (SPAN - 1), F.lit(0))

    def masked(number, mask):
        return F.transform(F.slice("_h", 1, places), lambda x, i: F.xxhash64(
            F.lit(number), x, *[F.get("_h", i + place) for place in mask[1:]]))

    every = F.concat(*[masked(number, mask) for number, mask in enumerate(MASKS)])
    return hashed.select(key, places.alias("_places"), F.posexplode(every).alias("_at", "seed")
                         ).select(key, (F.col("_at") % F.col("_places")).alias("pos"), "seed")


def _best_stretch(doc, item, diagonal):
    """Equal words in the best stretch of the item laid over the document."""
    equal = F.transform(item, lambda w, i: F.coalesce(
        (i + diagonal >= 0) & (F.get(doc, F.greatest(i + diagonal, F.lit(0))) == w), F.lit(False)))
    zero = F.lit(0)
    start = F.struct(zero.alias("score"), zero.alias("same"), zero.alias("best"),
                     zero.alias("most"))

    def step(s, hit):
        score = s["score"] + F.when(hit, 1).otherwise(-MISS)
        alive = score > 0
        score = F.when(alive, score).otherwise(0)
        same = F.when(alive, s["same"] + hit.cast("int")).otherwise(0)
        up = score > s["best"]
        return F.struct(score.alias("score"), same.alias("same"),
                        F.when(up, score).otherwise(s["best"]).alias("best"),
                        F.when(up, same).otherwise(s["most"]).alias("most"))

    return F.aggregate(equal, start, step, lambda s: s["most"])


def contaminated(docs, items) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, n_matched and the two lengths.

    The length of the document is also what keeps its words from being split anew for every
    word of the item: a column used once would be put in place where it is used.
    """
    texts = typed(docs, "doc_id", "text").filter("doc_id IS NOT NULL")
    tests = cut_lineage(items.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    ).filter("item_id IS NOT NULL").withColumn("w", plain_words(F.col("text"))).select(
        "item_id", "w"), "leak-items")
    probes = cut_lineage(seeds(tests, "item_id").select(
        "seed", "item_id", F.col("pos").alias("item_pos")).distinct(), "leak-seeds")
    if probes.count() <= BROADCAST_ROWS:
        probes = F.broadcast(probes)
    hits = seeds(texts.withColumn("w", plain_words(F.col("text"))), "doc_id").join(
        probes, "seed").select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias(
            "diagonal")).distinct()
    hits = cut_lineage(hits, "leak-hits")
    ids = cut_lineage(hits.select("doc_id").distinct(), "leak-ids")
    found = only(texts, ids).join(hits, "doc_id").join(
        tests.select("item_id", F.col("w").alias("item")), "item_id").withColumn(
        "w", plain_words(F.col("text"))).select(
        "doc_id", "item_id", F.size("item").cast("long").alias("n_item_words"),
        F.size("w").cast("long").alias("n_doc_words"),
        _best_stretch(F.col("w"), F.col("item"), F.col("diagonal")).cast("long").alias("n"))
    enough = F.least(F.lit(float(MIN_MATCH)), F.lit(SHARE) * F.col("n_item_words"))
    return found.filter(F.col("n") >= enough).groupBy("doc_id", "item_id").agg(
        F.max("n").alias("n_matched"), F.max("n_item_words").alias("n_item_words"),
        F.max("n_doc_words").alias("n_doc_words"))
