"""Near duplicates: SetSketch registers, banded, estimated by likelihood, then verified.

A document is the set of its distinct shingles (3 words, an argument), A-Z folded. Every shingle gives
exponentially spread values in rising order, one per register; a register keeps the least
value over the set as a truncated logarithm to base 1.001, so the sketch of a union is
the register-wise maximum (``merge``). Equal bands of registers make two documents
candidates; the joint likelihood of equal, larger and smaller registers estimates their
similarity, and only pairs far below the threshold are dropped by it (five standard
errors). The rest is decided on the full sets of words.

Exact copies collapse first. Within a bucket every document meets the first one, and the
links found join components. Buckets of up to SMALL documents that are not one component
by then compare the rest directly. In larger ones, members of the smallest components lead
and meet the whole bucket in blocks (``_block_links``), round by round, until all that
never led are one component: any other pair has been compared or is connected anyway. So no
link within a bucket is lost, and no group emits its pairs. The rows of a band follow the
threshold, so that two texts at it meet in a bucket but for a chance of MISS: 4e-7 at 85 with
25 bands of 5 registers, 5e-8 at 80 with 32 bands of 4.

Cases: null and empty texts have no shingle, n_shingles 0, and are a component of their
own; one or two words are one shingle. Repeated rows stay as rows; rows that share an id
are one document and linked by any of their texts. A row without id can't be named: its
component is null and it is kept. Other columns are ignored. An empty table gives an
empty result.
"""

import hashlib

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from stacklore.llm import tokens
from stacklore.llm.common import components, join_hot, only, typed
from stacklore.session import cut_lineage

SHINGLE = 3
REGISTERS = 128
BASE, RATE, TOP = 1.001, 20.0, 65534
MISS = 1e-6
THRESHOLD = 85
SLACK = 0.16
SMALL = 32
LEADERS, LEADER_CHUNK, MEMBER_CHUNK = 256, 256, 256
_WORDS = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, REGISTERS + 1, dtype=np.uint64) * _WORDS


def _shingles(data, starts, n_rows, shingle):
    """Distinct shingle hashes of each row: (hashes, ends of rows)."""
    hashes, rows = tokens.word_hashes(data, starts, lower=True)
    count = np.bincount(rows, minlength=n_rows)
    full, home = tokens.joined(hashes, rows, shingle)
    parts = [(full, home)]
    for n in range(1, shingle):
        short = (count == n)[rows]
        if short.any():
            parts.append(tokens.joined(hashes[short], rows[short], n))
    full = np.concatenate([p[0] for p in parts])
    home = np.concatenate([p[1] for p in parts])
    cut = np.searchsorted(np.sort(home, kind="stable"), np.arange(n_rows + 1))
    full = full[np.argsort(home, kind="stable")]
    sets = [np.unique(full[cut[k]:cut[k + 1]]) for k in range(n_rows)]
    ends = np.append(0, np.cumsum([s.size for s in sets]))
    return (np.concatenate(sets) if sets else full), ends


def sketch(items, ends):
    """SetSketch registers of many sets of hashes, a row of integers for each set.

    Round j gives every item its j-th smallest value and the register it belongs to, a
    register it has not met before; items that can't lower any register of their set drop
    out, so most items end after one or two rounds.
    """
    n_sets, m = len(ends) - 1, REGISTERS
    least = np.full((n_sets, m), np.inf)
    sets = np.repeat(np.arange(n_sets), np.diff(ends))
    where = tokens.mix(items ^ _WORDS)
    first = (where & np.uint64(m - 1)).astype(np.int64)
    stride = ((where >> np.uint64(20)) & np.uint64(m - 1)).astype(np.int64) | 1
    value = np.zeros(items.size)
    limit = np.full(n_sets, np.inf)
    left = np.arange(items.size)
    for j in range(m):
        u = tokens.mix(items[left] + _STEPS[j])
        u = ((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53
        at = value[left] - np.log(u) / (m - j)
        open_ = at < limit[sets[left]]
        left, at = left[open_], at[open_]
        if not left.size:
            break
        value[left] = at
        register = (first[left] + j * stride[left]) & (m - 1)
        np.minimum.at(least.reshape(-1), sets[left] * m + register, at)
        limit = least.max(1)
    with np.errstate(divide="ignore"):
        levels = np.floor(1 - (np.log(least) - np.log(RATE)) / np.log(BASE))
    return np.clip(np.nan_to_num(levels, neginf=0), 0, TOP + 1).astype(np.uint16)


def merge(a, b):
    """Sketch of the union of two sets."""
    return np.maximum(a, b)


def band_rows(threshold):
    """Most registers a band may have for pairs at the threshold to be missed by MISS at most."""
    for rows in range(REGISTERS, 1, -1):
        if (1 - (threshold / 100) ** rows) ** (REGISTERS // rows) <= MISS:
            return rows
    return 1


def _bands(registers, rows):
    """One 64-bit key per band of ``rows`` registers, different in every band."""
    out = np.zeros((registers.shape[0], REGISTERS // rows), np.uint64)
    for band in range(out.shape[1]):
        key = np.full(registers.shape[0], _STEPS[band])
        for k in range(rows):
            key = tokens.mix(key + registers[:, band * rows + k].astype(np.uint64) + _WORDS)
        out[:, band] = key
    return out.view(np.int64)


def likely_similarity(a, b, size_a, size_b, steps=40):
    """Most likely Jaccard similarity of pairs of sketches, with the set sizes given.

    With shares u, v of the sizes, a register is larger on the one side with chance
    p(u - vJ), on the other with p(v - uJ), p(x) = -log_b(1 - x (b - 1) / b). The
    likelihood is concave in J, so its peak is found by golden sections.
    """
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = size_a / (size_a + size_b)
    v = 1 - u
    most = np.minimum(u / v, v / u)

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j):
        one, two = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return (up * np.log(one + tiny) + down * np.log(two + tiny)
                + same * np.log(np.maximum(1 - one - two, tiny)))

    low, high, g = np.zeros(len(up)), most, (5 ** 0.5 - 1) / 2
    for _ in range(steps):
        x, y = high - g * (high - low), low + g * (high - low)
        better = likelihood(x) > likelihood(y)
        low, high = np.where(better, low, x), np.where(better, y, high)
    return (low + high) / 2


def sketches(docs, shingle=SHINGLE, threshold=THRESHOLD) -> DataFrame:
    """doc_id, n_shingles, digest of the folded words, registers and band keys of each row."""
    rows = band_rows(threshold)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column("text")
            for first, last, data, starts in tokens.pieces(texts):
                n = last - first
                items, ends = _shingles(data, starts, n, shingle)
                registers = sketch(items, ends)
                raw = tokens.LOWER[data].tobytes()
                digests = [hashlib.md5(b" ".join(raw[starts[k]:starts[k + 1]].split())).digest()
                           for k in range(n)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(first, n), pa.array(np.diff(ends)),
                    pa.array(digests, pa.binary()),
                    pa.array([r.tobytes() for r in registers], pa.binary()),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1, dtype=np.int32) * (REGISTERS // rows)),
                        pa.array(_bands(registers, rows).reshape(-1)))],
                    ["doc_id", "n_shingles", "digest", "registers", "bands"])

    return typed(docs, "doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, registers binary, bands array<long>")


def _set_of(text, shingle):
    found = text.encode("utf-8", "replace")
    found = tokens.LOWER[np.frombuffer(found, np.uint8)].tobytes().split()
    if len(found) < shingle:
        return {tuple(found)} if found else set()
    return set(zip(*[found[k:] for k in range(shingle)]))


def _plausible(pairs, nodes, threshold):
    """Pairs (a, b) whose sketches don't rule out the threshold."""
    about = nodes.select("node", "n_shingles", "registers")
    sides = cut_lineage(pairs.join(about.select(
        F.col("node").alias("b"), F.col("n_shingles").alias("size_b"),
        F.col("registers").alias("registers_b")), "b"), "near-sides")
    leaders = cut_lineage(sides.groupBy("a").agg(F.count("*").alias("n")).join(
        about.withColumnRenamed("node", "a"), "a"), "near-leaders")
    floor = threshold / 100 - SLACK

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(
                batch.num_rows, -1) for c in ("registers", "registers_b"))
            j = likely_similarity(a, b, batch.column("n_shingles").to_numpy().astype(float),
                                  batch.column("size_b").to_numpy().astype(float))
            keep = pa.array(j >= floor)
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return join_hot(sides, leaders, "a").select(
        "a", "b", "n_shingles", "registers", "size_b", "registers_b").mapInArrow(
        run, "a long, b long")


def _verified(pairs, docs, threshold, shingle):
    """Pairs (a, b) with 100 * intersection >= threshold * union on the full sets."""
    ids = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(),
                      "near-ids")
    texts = only(typed(docs, "doc_id", "text").filter(F.col("text").isNotNull()), ids)
    sides = cut_lineage(pairs.join(texts.select(
        F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b"), "near-texts")
    leaders = cut_lineage(sides.groupBy("a").agg(F.count("*").alias("n")).join(
        texts.withColumnRenamed("doc_id", "a"), "a"), "near-lead-texts")

    def run(batches):
        import pyarrow as pa

        last, mine = None, set()
        for batch in batches:
            keep = []
            for text, other in zip(batch.column("text").to_pylist(),
                                   batch.column("text_b").to_pylist()):
                if text != last:
                    last, mine = text, _set_of(text, shingle)
                theirs = _set_of(other, shingle)
                both = len(mine & theirs)
                keep.append(100 * both >= threshold * (len(mine) + len(theirs) - both) > 0)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return join_hot(sides, leaders, "a").sortWithinPartitions("a").select(
        "a", "b", "text", "text_b").mapInArrow(run, "a long, b long").distinct()


def _block_links(members, leaders, nodes, docs, threshold, shingle):
    """Links (a, b) between ``leaders`` and all members of their buckets, block by block.

    Members and leaders of a bucket are cut into chunks by hash, and a group holds one
    chunk of each: at most about LEADER_CHUNK + MEMBER_CHUNK texts. A pair is compared
    only under the first of the bands that both share, and gives a row only if linked.
    """
    ids = cut_lineage(members.select(F.col("node").alias("doc_id")).distinct(), "near-ids")
    texts = only(typed(docs, "doc_id", "text"), ids).withColumnRenamed("doc_id", "node").join(
        nodes.select("node", "n_shingles", "registers", "bands"), "node")
    marked = members.join(leaders.withColumn("leads", F.lit(True)), "node", "left").withColumn(
        "leads", F.coalesce("leads", F.lit(False)))
    marked = cut_lineage(marked, "near-marked")
    sizes = cut_lineage(marked.groupBy("key").agg(
        F.count("*").alias("n"),
        F.ceil(F.count("*") / MEMBER_CHUNK).alias("m_chunks"),
        F.ceil(F.count_if("leads") / LEADER_CHUNK).alias("l_chunks")).filter(
        "l_chunks > 0"), "near-chunks")
    about = join_hot(marked, sizes, "key").withColumn("h", F.xxhash64("node"))
    own = about.select("key", "node", "label", F.lit(False).alias("leads"),
                       F.pmod("h", "m_chunks").alias("m"),
                       F.explode(F.sequence(F.lit(0).cast("long"), F.col("l_chunks") - 1)).alias("l"))
    led = about.filter("leads").select(
        "key", "node", "label", "leads",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("m_chunks") - 1)).alias("m"),
        F.pmod("h", "l_chunks").alias("l"))
    rows = own.unionByName(led).join(texts, "node")

    def compare(block):
        import pyarrow as pa

        node = block.column("node").to_numpy()
        label = block.column("label").to_numpy()
        size = block.column("n_shingles").to_numpy().astype(float)
        text = block.column("text").to_pylist()
        key = block.column("key")[0].as_py()
        regs = np.frombuffer(b"".join(block.column("registers").to_pylist()),
                             np.uint16).reshape(len(node), -1)
        bands = np.array(block.column("bands").to_pylist(), np.int64)
        leads = block.column("leads").to_numpy(zero_copy_only=False)
        sets, found = {}, []
        others = np.flatnonzero(~leads)

        def set_of(k):
            if k not in sets:
                sets[k] = _set_of(text[k], shingle)
            return sets[k]

        for k in np.flatnonzero(leads):
            same = bands[others] == bands[k]
            first = bands[k][same.argmax(1)] == key
            near = others[first & (label[others] != label[k])]
            if not near.size:
                continue
            j = likely_similarity(np.broadcast_to(regs[k], (near.size, REGISTERS)), regs[near],
                                  np.full(near.size, size[k]), size[near])
            for o in near[j >= threshold / 100 - SLACK]:
                mine, theirs = set_of(k), set_of(o)
                both = len(mine & theirs)
                if 100 * both >= threshold * (len(mine) + len(theirs) - both) > 0:
                    found.append((node[k], node[o]))
        return pa.table({"a": pa.array([x[0] for x in found], pa.int64()),
                         "b": pa.array([x[1] for x in found], pa.int64())})

    return rows.groupBy("key", "m", "l").applyInArrow(compare, "a long, b long").distinct()


def _next_leaders(members):
    """One member of each of the LEADERS smallest components of every bucket."""
    groups = members.groupBy("key", "label").agg(
        F.count("*").alias("_n"), F.min("node").alias("node"))
    smallest = Window.partitionBy("key").orderBy("_n", "node")
    return groups.withColumn("_rank", F.row_number().over(smallest)).filter(
        F.col("_rank") <= LEADERS).select("node").distinct()


def near_duplicates(docs, threshold=THRESHOLD, shingle=SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of ``docs``."""
    rows = cut_lineage(sketches(docs, shingle, threshold), "near-sketches")
    digests = cut_lineage(rows.filter((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
                          .groupBy("digest").agg(F.min("doc_id").alias("node"),
                                                 F.count("*").alias("n")), "near-digests")
    nodes = cut_lineage(rows.join(
        digests.select("digest", F.col("node").alias("doc_id")), ["digest", "doc_id"]).select(
        F.col("doc_id").alias("node"), "n_shingles", "registers", "bands").distinct(),
        "near-nodes")
    links, labels = _all_links(nodes, docs, threshold, shingle)
    named = join_hot(rows.select("doc_id", "n_shingles", "digest").filter("n_shingles > 0"),
                     digests, "digest", how="left").select("doc_id", "n_shingles", "node")
    alone = rows.filter("n_shingles = 0").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    # Rows of one id with several texts belong together through that id.
    several = named.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    shared = named.join(several, "doc_id").select("a", F.col("node").alias("b")).filter(
        "a <> b").distinct()
    shared = cut_lineage(shared, "near-shared")
    if not shared.isEmpty():
        labels = components(links.unionByName(shared))
    found = named.join(labels, "node", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce(
            "label", "node")).alias("component_id"))
    return found.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _all_links(nodes, docs, threshold, shingle):
    """Verified links (a, b) that join all that any bucket could join, and their components."""
    members = nodes.select("node", F.explode("bands").alias("key"))
    shared = cut_lineage(members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("lead")).filter("n > 1"), "near-buckets")
    members = cut_lineage(join_hot(cut_lineage(members, "near-bands"), shared, "key"),
                          "near-members")

    def check(pairs):
        likely = cut_lineage(_plausible(cut_lineage(pairs.distinct(), "near-pairs"), nodes,
                                        threshold), "near-likely")
        return _verified(likely, docs, threshold, shingle)

    def still_open(rows, labels):
        """Members of the buckets that hold more than one component, with labels and sizes."""
        rows = cut_lineage(rows.join(labels, "node", "left").select(
            "key", "node", F.coalesce("label", "node").alias("label")), "near-rest")
        open_ = cut_lineage(rows.groupBy("key").agg(
            F.count("*").alias("n"), F.min("label").alias("_low"),
            F.max("label").alias("_high")).filter("_low < _high").select(
            "key", "n", F.col("n").alias("size")), "near-open")
        return cut_lineage(join_hot(rows, open_, "key"), "near-members")

    # First every member meets the first of its bucket.
    links = cut_lineage(check(members.filter("node <> lead").select(
        F.col("lead").alias("a"), F.col("node").alias("b"))), "near-links")
    labels = components(links)
    members = still_open(members.filter("node <> lead").select("key", "node"), labels)
    # Then small buckets compare all their components at once, SMALL members at most.
    small = members.filter(F.col("size") <= SMALL)
    here, there = small.alias("x"), small.alias("y")
    pairs = here.join(there, (F.col("x.key") == F.col("y.key"))
                      & (F.col("x.node") < F.col("y.node"))
                      & (F.col("x.label") != F.col("y.label"))).select(
        F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    new = cut_lineage(check(pairs), "near-links")
    if not new.isEmpty():
        links = cut_lineage(links.unionByName(new), "near-all-links")
        labels = components(links)
    # Large ones send leaders, until what never led is one component.
    members = still_open(members.filter(F.col("size") > SMALL).select("key", "node"), labels)
    while not members.isEmpty():
        leaders = cut_lineage(_next_leaders(members), "near-leaders")
        new = cut_lineage(_block_links(members.select("key", "node", "label"), leaders, nodes,
                                       docs, threshold, shingle), "near-links")
        if not new.isEmpty():
            links = cut_lineage(links.unionByName(new), "near-all-links")
            labels = components(links)
        members = still_open(members.select("key", "node").join(leaders, "node", "left_anti"),
                             labels)
    return links, labels
