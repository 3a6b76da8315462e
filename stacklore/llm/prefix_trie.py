"""Prefix trie of rebuilt conversations from composable monoid fingerprints.

Conversation c is rebuilt as the first h(c) turns of its base conversation followed by its own
turns after its first h(c); h is crc32 of the decimal id modulo ``HEADS``. The trie has a node
for each distinct sequence of first d rebuilt turns.

No rebuilt text is ever made. A turn is referred to by the sha256 of its role and text, a
sequence by a fingerprint: the sum over its places i of (reference * B^i) modulo three primes.
With its length a fingerprint is an element of a monoid, (s, m) * (t, n) = (s + B^m t, m + n),
so the fingerprint of every rebuilt prefix is the product of a head of the base and a piece of
the own turns, and that piece is a difference of two own prefixes. Prefixes of the stored
conversations are all that is hashed, by running sums over buckets of the sorted rows.

Equality is not left to the hashes. All stored turns with one reference are compared byte by
byte (least and greatest role and text agree), and all members of a node must share the
reference of their last turn and the node of their prefix before it; by induction their
sequences are equal. A mismatch stops the job with an error.

A conversation belongs to its nodes as rows (conv_id, depth, fingerprint), without text. Sums
over subtrees need no walk: every node counts towards the conversation that names it, its
smallest member, and a node's sum adds up its members' sums. Hot nodes are summed in each task
first, joined by sending them (``join_hot``), and their ending ids are joined to texts by
thousands before one task streams them through the digest.

Cases: turns go by number, null first, and rows of one number by their reference, the sha256;
equal rows all count. Null roles and texts are empty. Rows without conv_id belong to no conversation and are
left out. Negative ids have the base that truncated division gives. Conversations that are
rebuilt without turns belong to the root alone. Other columns are ignored; an empty table
gives an empty result, without a root.
"""

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stacklore.llm.common import dealt, join_hot
from stacklore.session import cut_lineage

HEADS, FAMILY = 6, 100
# Primes below 2^31: products of two residues stay below 2^62.
FIELDS = [(2147483647, 1103515245), (2147483629, 1566083941), (2147483587, 69621001)]
F_AT, G_AT = ["f0", "f1", "f2"], ["g0", "g1", "g2"]
NODE = ["depth", *F_AT]
IDS = 1000


def power_column(base, prime):
    """A function of a column of exponents: base ** exponent modulo prime."""
    @F.pandas_udf("long")
    def power(exponents: pd.Series) -> pd.Series:
        e = exponents.to_numpy().astype(np.uint64)
        out, square = np.ones(len(e), np.uint64), base
        for _ in range(int(e.max(initial=0)).bit_length()):
            out = np.where(e & np.uint64(1), out * np.uint64(square) % np.uint64(prime), out)
            square = square * square % prime
            e = e >> np.uint64(1)
        return pd.Series(out.astype(np.int64))

    return power


def stored_turns(conversations) -> DataFrame:
    """Per stored turn: conv_id, pos from 1, ref, n_chars, its terms and prefix sums f0 to f2."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    raw = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("ref"),
        F.length(text).cast("long").alias("n_chars"), role.alias("role"), text.alias("text"))
    same = raw.groupBy("ref").agg(*[f(c).alias(f"{n}_{c}") for c in ("role", "text")
                                    for n, f in (("least", F.min), ("most", F.max))])
    if not same.filter("least_role <> most_role OR least_text <> most_text").isEmpty():
        raise RuntimeError("different turns share a reference")
    order = ["conv_id", "turn", "ref", "row"]
    rows = dealt(raw.drop("role", "text").withColumn("row", F.monotonically_increasing_id()),
                 order, "trie-rows")
    part = ["conv_id", "_bucket"]
    earlier = Window.partitionBy("conv_id").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    inside = Window.partitionBy(*part).orderBy(*order)
    base = rows.groupBy(*part).agg(F.count("*").alias("_n")).select(
        *part, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    rows = rows.join(base, part).withColumn("pos", F.col("_base") + F.row_number().over(inside))
    terms = [F.conv(F.substring("ref", 1 + 15 * k, 15), 16, 10).cast("long") % p
             * power_column(b, p)(F.col("pos")) % p for k, (p, b) in enumerate(FIELDS)]
    rows = cut_lineage(rows.select(*part, "pos", "ref", "n_chars", *[
        t.alias(f"t{k}") for k, t in enumerate(terms)]), "trie-terms")
    so_far = Window.partitionBy(*part).orderBy("pos").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = rows.groupBy(*part).agg(*[F.sum(f"t{k}").alias(f"_s{k}") for k in range(3)]).select(
        *part, *[F.coalesce(F.sum(f"_s{k}").over(earlier), F.lit(0)).alias(f"_b{k}")
                 for k in range(3)])
    rows = rows.join(base, part)
    return cut_lineage(rows.select("conv_id", "pos", "ref", "n_chars", "t0", "t1", "t2", *[
        ((F.col(f"_b{k}") + F.sum(f"t{k}").over(so_far)) % p).alias(f"f{k}")
        for k, (p, _) in enumerate(FIELDS)]), "trie-turns")


def _shift(value, k, back):
    """B^-back times a residue, ``back`` below HEADS."""
    p, b = FIELDS[k]
    return value * F.element_at(F.array(*[
        F.lit(pow(b, -s, p)) for s in range(HEADS)]), back.cast("int") + 1) % p


def memberships(turns) -> DataFrame:
    """A row for each conversation and depth: its node f, the node before g, the last turn.

    ``size`` is the depth at which the conversation ends. Only fingerprints are combined:
    the base's head and the own turns meet as sums of residues.
    """
    heads = turns.groupBy("conv_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(
        F.when(F.col("pos") < HEADS, F.struct("pos", "ref", "n_chars", *F_AT)))).alias("own"))
    heads = cut_lineage(heads, "trie-heads")
    base = heads.select(F.col("conv_id").alias("base"), F.col("own").alias("lent"))
    convs = heads.withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY).join(
        base, "base", "left").withColumn("h", (F.crc32(
            F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int"))
    lent = F.slice(F.coalesce("lent", F.array().cast(heads.schema["own"].dataType)), 1, F.col("h"))
    convs = convs.withColumn("lent", lent).withColumn("taken", F.size("lent")).withColumn(
        "size", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = cut_lineage(convs, "trie-convs")

    start = F.struct(F.lit(0).cast("long").alias("pos"), F.lit(None).cast("string").alias("ref"),
                     F.lit(0).cast("long").alias("n_chars"),
                     *[F.lit(0).cast("long").alias(f) for f in F_AT])
    steps = convs.select("conv_id", "size", F.concat(F.array(start), "lent").alias("lent")).select(
        "conv_id", "size", "lent", F.posexplode("lent").alias("at", "turn"))
    before = F.element_at("lent", F.greatest("at", F.lit(1)))
    head = steps.select(
        "conv_id", "size", F.col("at").cast("long").alias("depth"), *[f"turn.{f}" for f in F_AT],
        *[F.when(F.col("at") > 0, before[f]).alias(g) for f, g in zip(F_AT, G_AT)],
        "turn.ref", "turn.n_chars")

    last, cut = F.try_element_at("lent", F.lit(-1)), F.element_at("own", F.greatest("h", F.lit(1)))
    joint = convs.filter("n > h").select(
        "conv_id", "n", "size", "h", "taken",
        *[F.coalesce(F.when(F.col("taken") > 0, last[f]), F.lit(0)).alias(f"l{k}")
          for k, f in enumerate(F_AT)],
        *[F.coalesce(F.when(F.col("h") > 0, cut[f]), F.lit(0)).alias(f"c{k}")
          for k, f in enumerate(F_AT)])
    own = join_hot(turns, cut_lineage(joint, "trie-joint"), "conv_id").filter("pos > h")
    back = F.col("h") - F.col("taken")

    def at(k, prefix):
        p = FIELDS[k][0]
        piece = (prefix - F.col(f"c{k}") + 2 * p) % p
        return (F.col(f"l{k}") + _shift(piece, k, back)) % p

    own = own.select(
        "conv_id", "size", (F.col("pos") - back).cast("long").alias("depth"),
        *[at(k, F.col(f)).alias(f) for k, f in enumerate(F_AT)],
        *[at(k, F.col(F_AT[k]) - F.col(f"t{k}")).alias(g) for k, g in enumerate(G_AT)],
        "ref", "n_chars")
    return cut_lineage(head.unionByName(own), "trie-members")


def _digests(ends) -> DataFrame:
    """``NODE`` and ends_sha256 of every node at which conversations end.

    Ids are joined by ranges of IDS; nodes with several ranges are sorted and streamed, as
    a digest is one sequence, with a single range in memory at a time.
    """
    text = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")),
                                    lambda c: c.cast("string")), ",")
    ranges = cut_lineage(ends.withColumn("range", F.floor(F.col("conv_id") / IDS)).groupBy(
        *NODE, "range").agg(text.alias("ids")), "trie-ends")
    counts = cut_lineage(ranges.groupBy(*NODE).agg(F.count("*").alias("ranges")), "trie-ranges")
    one = ranges.join(counts.filter("ranges = 1"), NODE).select(
        *NODE, F.sha2("ids", 256).alias("ends_sha256"))

    def stream(batches):
        at, digest = None, None

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.int64()) for x in at] + [pa.array([digest.hexdigest()])],
                [*NODE, "ends_sha256"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*NODE, "ids"]]
            for *node, ids in zip(*columns):
                if node != at:
                    if at:
                        yield out()
                    at, digest = node, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if at:
            yield out()

    many = ranges.join(counts.filter("ranges > 1"), NODE, "left_semi").repartition(
        *NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "ids")
    return one.unionByName(many.mapInArrow(
        stream, "depth long, f0 long, f1 long, f2 long, ends_sha256 string"))


def trie(conversations) -> DataFrame:
    """A row for each node; see the module's text for the columns' sums."""
    members = memberships(stored_turns(conversations.select("conv_id", "turn", "role", "text")))
    alike = [*G_AT, "ref"]
    nodes = cut_lineage(members.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"),
        F.first("n_chars").alias("n_chars"),
        *[F.min(c).alias(c) for c in alike], *[F.max(c).alias(f"max_{c}") for c in alike]),
        "trie-nodes")
    if not nodes.filter(" OR ".join(f"{c} <> max_{c}" for c in alike)).isEmpty():
        raise RuntimeError("different prefixes share a fingerprint")

    children = nodes.filter("depth > 0").groupBy(
        (F.col("depth") - 1).alias("depth"), *[F.col(g).alias(f) for f, g in zip(F_AT, G_AT)]).agg(
        F.count("*").alias("n_children"))
    nodes = cut_lineage(nodes.select(*NODE, *G_AT, "conv_id", "n_convs", (
        (F.col("n_convs") - 1) * F.col("n_chars")).alias("own")).join(
        children, NODE, "left").fillna(0, ["n_children"]), "trie-named")

    # Sums from a node down the conversation that names it, by buckets of that order.
    named = dealt(nodes.select("conv_id", "depth", *F_AT, "own", "n_children"),
                  ["conv_id", "depth"], "trie-down")
    part = ["conv_id", "_bucket"]
    below = Window.partitionBy("conv_id").orderBy(F.desc("_bucket")).rowsBetween(
        Window.unboundedPreceding, -1)
    down = Window.partitionBy(*part).orderBy(F.desc("depth")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    rest = named.groupBy(*part).agg(F.sum("own").alias("_own")).select(
        *part, F.coalesce(F.sum("_own").over(below), F.lit(0)).alias("_rest"))
    downs = named.join(rest, part).select(
        *NODE, (F.col("_rest") + F.sum("own").over(down)).alias("down"))

    # What a conversation brings to the nodes that others name.
    brings = named.groupBy("conv_id").agg(
        F.sum("own").alias("brings"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"),
        F.min("depth").alias("from_depth"), (F.max("depth") + 1).alias("n"))
    met = join_hot(members.select("conv_id", *NODE), cut_lineage(brings, "trie-brings"), "conv_id")
    sums = met.groupBy(*NODE).agg(
        F.sum("leaf").alias("n_leaves"),
        F.sum(F.when(F.col("depth") < F.col("from_depth"), F.col("brings"))).alias("others"))

    digests = _digests(members.filter("size = depth").select("conv_id", *NODE))
    parents = cut_lineage(nodes.filter("n_children > 0").select(
        F.col("depth").alias("pd"), *[F.col(f).alias(f"p{k}") for k, f in enumerate(F_AT)],
        F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("n")), "trie-parents")
    up = ["pd", "p0", "p1", "p2"]
    kids = cut_lineage(nodes.filter("depth > 0").select(
        *NODE, (F.col("depth") - 1).alias("pd"), *[F.col(g).alias(f"p{k}")
                                                  for k, g in enumerate(G_AT)]), "trie-kids")
    parents = join_hot(kids, parents, up).select(*NODE, "parent_conv_id")
    return nodes.join(parents, NODE, "left").join(downs, NODE).join(sums, NODE).join(
        digests, NODE, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("down") + F.coalesce("others", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
