"""The queries of this subpackage and their SQL."""

from pyspark.sql import functions as F

from stacklore.llm import (
    clusters,
    decontamination,
    language,
    line_dedup,
    mixing,
    near_dedup,
    prefix_trie,
    quality,
    rules,
    sharding,
    token_counts,
    toxicity,
    url_filters,
)
from stacklore.llm.common import held_out, join_hot, table
from stacklore.session import cut_lineage, scratch_dir

QUERIES = {}
ORACLES = {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


SQL_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

RULES_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {SQL_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (
  SELECT rid, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS x
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS p FROM d WHERE len(w) >= 3)),
rep AS (SELECT rid, p FROM (SELECT *, count(*) OVER (PARTITION BY rid, x) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p + k) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT d.doc_id, len(w)::BIGINT AS n_words,
         length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cov.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
         len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
         len(regexp_extract_all(t, '\pL'))::BIGINT AS n_letters
  FROM d LEFT JOIN cov USING (rid)),
b AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN word_chars > 40 * n_words THEN 4 ELSE 0 END
    + CASE WHEN 2 * word_chars < 3 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 10 * n_symbols > 3 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 10 * n_dup_lines > 6 * n_lines THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_capitals > 6 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars THEN 128 ELSE 0 END AS fail_bits
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_lines, n_capitals, n_letters, fail_bits::BIGINT AS fail_bits,
       fail_bits & 3 <> 0 AS base_failed, fail_bits = 0 AS kept, 'web-1' AS policy
FROM b"""


@query("op5_rule_ledger", RULES_SQL)
def op5_rule_ledger(spark, sf_dir):
    return rules.apply_policy(rules.ledger(table(spark, sf_dir, "documents")), "web-1")


@query("op1_toxicity")
def op1_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                             lambda c: held_out(c, 5, 0))


@query("op2_language_id")
def op2_language_id(spark, sf_dir):
    return language.language(table(spark, sf_dir, "documents"), lambda c: held_out(c, 5, 0))


@query("op3_quality")
def op3_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                           lambda c: held_out(c, 3, 1))


NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ')
    ELSE w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] END AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k
  FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
  WHERE 100 * k >= 85 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON both_ways.a = reach.r)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r) AS component_id,
       d.doc_id = min(r) AS kept
FROM documents d JOIN reach USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n"""


@query("op9_near_dedup", NEAR_SQL)
def op9_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4_token_counts(spark, sf_dir):
    """Totals after three batches: all documents, texts without repeated lines, no copies.

    The second batch revises documents that repeat a line, counted without the repeats;
    the third deletes all but the first of documents with equal texts. The second is sent
    twice, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents")
    store = scratch_dir(spark, "tokens")
    token_counts.commit(store, "batch-1", token_counts.change(
        "insert", token_counts.counted(docs)))
    lines = docs.withColumn("_lines", F.split("text", "\n")).withColumn(
        "_once", F.array_distinct("_lines")).filter(F.size("_once") < F.size("_lines"))
    revised = token_counts.change("revise", token_counts.counted(
        lines.withColumn("text", F.array_join("_once", "\n")).drop("_lines", "_once")))
    token_counts.commit(store, "batch-2", revised)
    token_counts.commit(store, "batch-2", revised)
    keyed = cut_lineage(docs.select("doc_id", F.sha2("text", 256).alias("h")), "tokens-hashes")
    firsts = cut_lineage(keyed.groupBy("h").agg(
        F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "tokens-copies")
    copies = join_hot(keyed, firsts, "h").filter("doc_id <> first").select("doc_id")
    gone = copies.withColumn("tokenizer", F.explode(F.array(
        *[F.lit(t) for t in token_counts.TOKENIZERS]))).select(
        "doc_id", F.lit(None).cast("string").alias("source"),
        F.lit(None).cast("string").alias("lang"), "tokenizer", F.lit(0).alias("n_tokens"))
    token_counts.commit(store, "batch-3", token_counts.change("delete", gone))
    return token_counts.totals(spark, store)


LINES_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x, len(ls) AS n FROM d),
h AS (SELECT *, md5(coalesce(lag(md5(x)) OVER (PARTITION BY doc_id ORDER BY i), '') || md5(x)) AS r FROM l),
e AS (SELECT *, CASE WHEN i = n OR (r < lag(r) OVER w AND r < lead(r) OVER w) THEN 1 ELSE 0 END AS ends
      FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
k AS (SELECT *, coalesce(sum(ends) OVER (PARTITION BY doc_id ORDER BY i
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS k FROM e),
c AS (SELECT doc_id, k, count(*) AS m, string_agg(x, chr(10) ORDER BY i) AS chunk FROM k GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN m >= 2 THEN row_number() OVER (PARTITION BY m >= 2, chunk ORDER BY doc_id, k)
        ELSE 1 END AS rn FROM c),
t AS (SELECT doc_id, count(*) AS n_chunks, sum(m) AS n_lines, count(*) FILTER (rn > 1) AS n_removed,
             coalesce(string_agg(chunk, chr(10) ORDER BY k) FILTER (rn = 1), '') AS kept
      FROM f GROUP BY doc_id)
SELECT doc_id, n_lines::BIGINT AS n_lines, n_chunks, n_removed, length(kept)::BIGINT AS kept_chars,
       md5(kept) AS kept_md5 FROM t
UNION ALL SELECT doc_id, 0, 0, 0, NULL, NULL FROM documents WHERE text IS NULL"""


@query("op6_line_dedup", LINES_SQL)
def op6_line_dedup(spark, sf_dir):
    done = line_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_chunks", "n_removed",
                       F.char_length("text").cast("long").alias("kept_chars"),
                       F.md5("text").alias("kept_md5"))


RUNS_SQL = r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, generate_subscripts(ls, 1) AS i, unnest(ls) AS x FROM d),
p AS (SELECT doc_id, i, x || chr(10) || lead(x) OVER (PARTITION BY doc_id ORDER BY i) AS pair FROM l),
f AS (SELECT *, first_value(doc_id) OVER w AS fd, first_value(i) OVER w AS fi
      FROM p WHERE pair IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY doc_id, i)),
g AS (SELECT DISTINCT doc_id, i FROM (
        SELECT doc_id, unnest(CASE WHEN fd = doc_id AND fi = i - 1 THEN [i + 1] ELSE [i, i + 1] END) AS i
        FROM f WHERE fd <> doc_id OR fi <> i)),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
             coalesce(string_agg(x, chr(10) ORDER BY l.i) FILTER (g.i IS NULL), '') AS kept
      FROM l LEFT JOIN g ON g.doc_id = l.doc_id AND g.i = l.i GROUP BY l.doc_id)
SELECT doc_id, n_lines, n_removed, length(kept)::BIGINT AS kept_chars, md5(kept) AS kept_md5 FROM t
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL"""


@query("op6_line_runs", RUNS_SQL)
def op6_line_runs(spark, sf_dir):
    """Every repeated run of two lines or more; op6_line_dedup is bound to chunks by its SQL."""
    done = line_dedup.without_repeated_runs(table(spark, sf_dir, "documents"))
    return done.select("doc_id", "n_lines", "n_removed",
                       F.char_length("text").cast("long").alias("kept_chars"),
                       F.md5("text").alias("kept_md5"))


@query("op7_sharding")
def op7_sharding(spark, sf_dir):
    return sharding.shard(table(spark, sf_dir, "documents"))


@query("op8_decontamination")
def op8_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"),
                                        table(spark, sf_dir, "benchmark"))


# The level of a source is found on its documents in falling order of size: the first k are
# certain where the level that the others then share leaves the next one below a chance of 1.
MIX_SQL = rf"""
WITH s AS (SELECT doc_id, source, len({SQL_WORDS})::BIGINT AS size FROM documents),
p AS (SELECT source, sum(size)::BIGINT AS source_size FROM s GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)::INT + 1]::DOUBLE AS w,
             2.0::DOUBLE * source_size AS cap FROM p),
b AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER ()
        - coalesce(sum(cap) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
        sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ws
      FROM w),
v AS (SELECT first(rest / ws ORDER BY cap / w, source) FILTER (rest / ws * w <= cap) AS level FROM b),
t AS (SELECT source, source_size, least(cap, coalesce(level * w, cap)) AS target FROM b, v),
r AS (SELECT row_number() OVER () AS rid, s.doc_id, s.source, s.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size) ELSE 0 END::BIGINT AS whole,
        target - whole * t.source_size AS rest,
        (('0x' || substr(md5('mix-1|' || coalesce(doc_id::VARCHAR, 'none')), 1, 12))::BIGINT + 0.5::DOUBLE)
          / 281474976710656.0::DOUBLE AS u
      FROM s JOIN t ON t.source IS NOT DISTINCT FROM s.source),
c AS (SELECT *, (rest - coalesce(sum(size) OVER larger, 0)) / (sum(size::DOUBLE * size) OVER not_larger) AS lev,
             coalesce(sum(size) OVER larger, 0) AS above FROM r WHERE size > 0 AND rest > 0
      WINDOW larger AS (PARTITION BY source ORDER BY size DESC RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
        not_larger AS (PARTITION BY source ORDER BY size DESC RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
l AS (SELECT source, arg_min(lev, above) AS lev, min(above) AS sure FROM c WHERE lev * size < 1 GROUP BY source),
i AS (SELECT r.*, least(1.0::DOUBLE, coalesce(size::DOUBLE * lev, 0)) AS pi, coalesce(sure, 0) AS sure
      FROM r LEFT JOIN l ON l.source IS NOT DISTINCT FROM r.source),
o AS (SELECT *, pi >= 1 AS certain, CASE WHEN size > 0 AND pi > 0 AND pi < 1 THEN u / (1 - u) * ((1 - pi) / pi)
        ELSE 1e300 END AS odds FROM i),
q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY source ORDER BY certain, odds, doc_id, size
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead FROM o WHERE NOT certain
      UNION ALL SELECT *, 0 FROM o WHERE certain),
k AS (SELECT *, whole + CASE WHEN certain OR size > 0 AND ahead + size / 2.0 <= rest - sure THEN 1 ELSE 0 END AS copies FROM q)
SELECT doc_id, source, size, source_size, target, copies, copies * size AS taken FROM k"""


@query("op10_mixing", MIX_SQL)
def op10_mixing(spark, sf_dir):
    """Chances in proportion to the words of a document."""
    return mixing.mix(table(spark, sf_dir, "documents"), by_size=True)


URL_SQL = r"""
WITH u AS (SELECT row_number() OVER () AS rid, page_id,
             CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
h AS (SELECT rid, page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
        coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM u),
rules(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'),
  ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
best AS (SELECT rid, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM h JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN best USING (rid)"""


@query("op11_url_filters", URL_SQL)
def op11_url_filters(spark, sf_dir):
    return url_filters.judge(table(spark, sf_dir, "pages"))


def _cluster_sql(rounds=5, k=40):
    """Plain distances, one pair of steps for each round."""
    steps = [rf"""
WITH p AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id) NULLS LAST, v) - 1 AS c, v FROM p
  QUALIFY c < {k}),
l AS MATERIALIZED (SELECT rid, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM p)"""]
    for r in range(rounds + 1):
        steps.append(rf"""
b{r} AS MATERIALIZED (SELECT c, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM c{r}),
s{r} AS MATERIALIZED (SELECT rid, c, sum((l.x - b{r}.x) * (l.x - b{r}.x))::BIGINT AS distance
  FROM l JOIN b{r} USING (d) GROUP BY rid, c),
a{r} AS MATERIALIZED (SELECT rid, c, distance FROM s{r}
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)""")
        if r < rounds:
            steps.append(rf"""
m{r} AS MATERIALIZED (SELECT c, d, CASE WHEN sum(x) >= 0 THEN sum(x) // count(*)
    ELSE -((-sum(x) + count(*) - 1) // count(*)) END::BIGINT AS x
  FROM a{r} JOIN l USING (rid) GROUP BY c, d),
n{r} AS (SELECT c, list(x ORDER BY d) AS v FROM m{r} GROUP BY c),
c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} USING (c))""")
    return ",".join(steps) + rf"""
SELECT vec_id, c::INTEGER AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
       sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(v, ',')) AS centroid_sha256
FROM a{rounds} JOIN p USING (rid) JOIN c{rounds} k USING (c)""".replace("to_string(v,", "to_string(k.v,")


@query("op12_clusters", _cluster_sql())
def op12_clusters(spark, sf_dir):
    return clusters.clusters(table(spark, sf_dir, "embeddings"))


# Sequences are lists of whole turns here; crc32 runs bit by bit over the decimal digits.
TRIE_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           sha256(length(r)::VARCHAR || ':' || r || x)) AS pos, r, x
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
        WHERE conv_id IS NOT NULL)),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT,
    list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda y, z: xor(y >> 1, (y & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)),
b AS (
  SELECT c.conv_id, 0 AS own, pos, r, x FROM c JOIN t ON t.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, 1, pos, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
s AS (SELECT conv_id, row_number() OVER w AS depth, length(x) AS chars,
        list({'r': r, 'x': x}) OVER w AS seq FROM b WINDOW w AS (PARTITION BY conv_id ORDER BY own, pos)),
m AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM (
        SELECT conv_id, depth, chars, seq FROM s
        UNION ALL SELECT conv_id, 0, 0, [] FROM c)),
n AS MATERIALIZED (
  SELECT depth, seq, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(chars) AS own,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM m GROUP BY depth, seq),
k AS (SELECT a.depth, a.seq, count(b.seq) AS n_children FROM n a
      LEFT JOIN n b ON b.depth = a.depth + 1 AND list_slice(b.seq, 1, a.depth) = a.seq GROUP BY a.depth, a.seq),
z AS (SELECT * FROM n JOIN k USING (depth, seq)),
up AS (SELECT seq[1:d] AS seq, count(*) FILTER (n_children = 0) AS n_leaves, sum(own) AS saved_tokens
       FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM z) GROUP BY 1)
SELECT z.conv_id, z.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, z.n_convs, z.n_children,
       n_leaves, saved_tokens::BIGINT AS saved_tokens, z.ends_sha256
FROM z JOIN up ON up.seq = z.seq LEFT JOIN n p ON p.depth = z.depth - 1 AND p.seq = list_slice(z.seq, 1, z.depth - 1)"""


@query("op13_prefix_trie", TRIE_SQL)
def op13_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
