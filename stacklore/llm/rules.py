"""Quality rules as a bitmask ledger: every rule is evaluated once, policies come later.

``ledger`` measures each document and stores one failure bit per rule beside the
measurements. A policy is a version and a mask of the rules that count; applying one,
or asking what each rule removes (``ablation``), only combines bits and never reads a
text again. All of it is DataFrame functions: no shuffle for the ledger, one narrow
aggregate for the ablation.

Cases: a null or empty text has no words and fails the word count. Repeated rows and
ties stay as they are. A null ``doc_id`` is kept as null. Other columns of the input
are ignored, whatever their names. An empty table gives an empty ledger.
"""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stacklore.llm.common import typed, words

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50

# Rules in bit order. Each is a condition on measurements that is true on failure.
RULES = [
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("long_words", "word_chars > 40 * n_words"),
    ("short_words", "2 * word_chars < 3 * n_words"),
    ("symbols", "10 * n_symbols > 3 * n_words"),
    ("repeated_lines", "10 * n_dup_lines > 6 * n_lines"),
    ("capitals", "10 * n_capitals > 6 * word_chars"),
    ("few_letters", "2 * n_letters < word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["few_words"] | BIT["repeated_words"]

# Policies by version: the rules whose failure removes a document.
POLICIES = {
    "base-1": BASE_MASK,
    "web-1": sum(BIT.values()),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
            "n_lines", "n_capitals", "n_letters"]


def _without(text, pattern):
    return F.char_length(F.regexp_replace(text, pattern, "")).cast("long")


def _same_words(w, i, j):
    """Whether the 3-word windows at two places of ``w`` hold the same words."""
    return reduce(lambda x, y: x & y, [F.get(w, i + k) == F.get(w, j + k) for k in range(3)])


def measures(docs, keep=None) -> DataFrame:
    """One row per input row: doc_id and every measurement, each taken once.

    ``keep`` carries the whole input row along, as a struct of that name.
    """
    carried = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(keep)] if keep else []
    split = typed(docs, "doc_id", "text", also=carried).withColumn(
        "text", F.coalesce("text", F.lit(""))).withColumn("_w", words(F.col("text")))
    split = split.withColumn("_lines", F.filter(
        F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    # 3-word windows by hash. Only texts that repeat a hash sort them with their places:
    # equal windows lie side by side, and their words are compared.
    split = split.withColumn("_h", F.transform("_w", lambda x: F.xxhash64(x)))
    split = split.withColumn("_x", F.transform(
        F.slice("_h", 1, F.greatest(F.size("_h") - 2, F.lit(0))),
        lambda x, i: F.xxhash64(x, F.get("_h", i + 1), F.get("_h", i + 2))))
    split = split.withColumn("_sorted", F.when(
        F.size("_x") > F.size(F.array_distinct("_x")), F.array_sort(
            F.transform("_x", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))))
    pairs = F.filter(
        F.zip_with("_sorted", F.slice("_sorted", 2, F.greatest(F.size("_sorted"), F.lit(1))),
                   lambda a, b: F.when(a["x"] == b["x"], F.array(a["i"], b["i"]))),
        lambda pair: pair.isNotNull())
    split = split.withColumn("_pairs", pairs)
    split = split.withColumn("_at", F.array_sort(F.array_distinct(F.flatten(F.filter(
        "_pairs", lambda p: _same_words("_w", F.get(p, 0), F.get(p, 1)))))))
    # Each place covers the words up to the next one, three at most.
    covered = F.aggregate(
        F.zip_with("_at", F.slice("_at", 2, F.greatest(F.size("_at"), F.lit(1))),
                   lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)).cast("long")),
        F.lit(0).cast("long"), lambda s, x: s + x)
    return split.select(
        "doc_id", *([keep] if keep else []),
        F.size("_w").cast("long").alias("n_words"),
        F.char_length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        (F.char_length("text") - _without("text", SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.char_length("text") - _without("text", "[A-Z]+")).cast("long").alias("n_capitals"),
        (F.char_length("text") - _without("text", r"\p{L}+")).cast("long").alias("n_letters"))


def ledger(docs, keep=None) -> DataFrame:
    """Measurements and ``fail_bits``, bit k for rule k of RULES."""
    bits = F.lit(0).cast("long")
    for name, condition in RULES:
        bits = bits.bitwiseOR(
            F.when(F.expr(condition), F.lit(BIT[name])).otherwise(F.lit(0)).cast("long"))
    return measures(docs, keep).withColumn("fail_bits", bits)


def apply_policy(entries, version="web-1") -> DataFrame:
    """The ledger with the verdict of one policy: base_failed, kept and the version."""
    mask = POLICIES[version] | BASE_MASK
    return entries.withColumns({
        "base_failed": F.col("fail_bits").bitwiseAND(F.lit(BASE_MASK)) != 0,
        "kept": F.col("fail_bits").bitwiseAND(F.lit(mask)) == 0,
        "policy": F.lit(version)})


def passed(docs, version="web-1") -> DataFrame:
    """The rows of ``docs`` that a policy keeps, unchanged."""
    # A one-element explode keeps the filter above the measurements; pushed below them it
    # would measure every text twice.
    judged = apply_policy(ledger(docs, "_row"), version).select(
        F.explode(F.array(F.struct("kept", "_row"))).alias("_judged"))
    return judged.filter("_judged.kept").select("_judged._row.*")


def ablation(entries, version="web-1") -> DataFrame:
    """What each rule of a policy removes, and what it alone removes.

    Documents are first counted by mask, at most 2^rules rows, and rules meet masks.
    """
    mask = POLICIES[version] | BASE_MASK
    masks = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(
        F.count("*").alias("n"))
    used = [(name, BIT[name]) for name, _ in RULES if BIT[name] & mask]
    per = masks.withColumn("rule", F.explode(F.array(*[
        F.struct(F.lit(name).alias("name"), F.lit(bit).cast("long").alias("bit"))
        for name, bit in used])))
    hit = F.col("bits").bitwiseAND(F.col("rule.bit")) != 0
    alone = F.col("bits") == F.col("rule.bit")
    return per.groupBy(F.col("rule.name").alias("rule"), F.col("rule.bit").alias("bit")).agg(
        F.sum("n").alias("n_docs"),
        F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(alone, F.col("n")).otherwise(0)).alias("n_failed_alone"))
