"""Queries on vectors and batch search."""

from pyspark.sql import functions as F

from stacklore.operators import ranking, search, vectors as N
from stacklore.operators.catalogue import KEY, summary
from stacklore.operators.vector_index import MAX_CELLS, VectorIndex
from stacklore.plans import views as V
from stacklore.plans.registry import query
from stacklore.plans.sql_views import with_views
from stacklore.session import scratch_dir

HITS = ("vectors", "search_queries", "cosines", "vector_hits")
HYBRID = ("assets_flat", "vectors", "search_queries", "cosines", "keyword_hits", "hybrid")
K = 5


def _vectors(spark, d):
    return N.vector_prepare(V.vectors(spark, d), 64)


def _queries(spark, d):
    return N.vector_prepare(V.search_queries(spark, d), 64)


def _hybrid(spark, d, k=K):
    return search.hybrid_search(
        _queries(spark, d), V.assets_flat(spark, d), _vectors(spark, d), k)


@query("vector_prepare", with_views("""
    SELECT project, name, round(embedding[1], 6) AS first, round(list_sum(embedding), 6) AS total
    FROM vectors""", "vectors"))
def vector_prepare(spark, d):
    rows = N.rebuild(V.vectors(spark, d), "doc_id", 64)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return rows.select("project", "name", F.round(F.get("embedding", 0), 6).alias("first"),
                       F.round(total, 6).alias("total"))


@query("vector_search", with_views(
    "SELECT query_id, project, name, similarity, rank FROM vector_hits", *HITS))
def vector_search(spark, d):
    return N.knn(_queries(spark, d), _vectors(spark, d), K)


@query("knn_join", with_views(
    "SELECT query_id, project, name, similarity, rank FROM vector_hits", *HITS))
def knn_join(spark, d):
    """The same search as a grid of blocks, the way of large query sets."""
    return N.knn(_queries(spark, d), _vectors(spark, d), K, sent_bytes=-1, block_rows=256)


def _index(spark, d):
    return VectorIndex.build(_vectors(spark, d), scratch_dir(spark, "index"))


@query("vector_search_ann")
def vector_search_ann(spark, d):
    """Every hundredth vector looks for its neighbours in an index of all, half in its project."""
    every = V.vectors(spark, d).where("doc_id % 100 = 0")
    queries = N.vector_prepare(every.select(
        F.col("doc_id").cast("long").alias("query_id"), "embedding",
        F.when(F.col("doc_id") % 200 == 0, F.col("project")).alias("project")), 64)
    index = _index(spark, d)
    return index.search(queries, K, index.probes_for(queries, K))


@query("vector_index_full", with_views(
    "SELECT query_id, project, name, similarity, rank FROM vector_hits", *HITS))
def vector_index_full(spark, d):
    """The index with all cells probed: the exact result."""
    return _index(spark, d).search(_queries(spark, d), K, MAX_CELLS)


@query("topk_per_query", """
    SELECT user_id AS query_id, event_type AS project, 'ev_' || event_id AS name, value
             AS similarity, row_number() OVER (PARTITION BY user_id ORDER BY value DESC,
             event_type, 'ev_' || event_id) AS rank
    FROM events QUALIFY rank <= 5""")
def topk_per_query(spark, d):
    rows = V.events(spark, d).select(
        F.col("user_id").alias("query_id"), F.col("event_type").alias("project"),
        F.concat(F.lit("ev_"), F.col("event_id").cast("string")).alias("name"),
        F.col("value").alias("similarity"))
    return N.top_k(rows, K)


@query("similarity_threshold_search", with_views("""
    SELECT query_id, project, name, similarity, row_number() OVER (
             PARTITION BY query_id ORDER BY similarity DESC, project, name) AS rank
    FROM cosines WHERE similarity > 0.3 QUALIFY rank <= 5""",
    "vectors", "search_queries", "cosines"))
def similarity_threshold_search(spark, d):
    return N.knn(_queries(spark, d), _vectors(spark, d), K, threshold=0.3)


_DISTINCT = """firsts AS (SELECT project, raw, min(name) AS name, any_value(embedding) AS embedding
             FROM vectors GROUP BY project, raw)"""


@query("near_duplicate_pairs", with_views("", "vectors").rstrip() + f""", {_DISTINCT}
    SELECT a.project AS project_a, a.name AS name_a, b.project AS project_b, b.name AS name_b,
           round(list_dot_product(a.embedding, b.embedding), 6) AS similarity
    FROM firsts a JOIN firsts b ON a.project = b.project AND a.name < b.name
    WHERE round(list_dot_product(a.embedding, b.embedding), 6) >= 0.4
    UNION ALL
    SELECT f.project, f.name, v.project, v.name, 1.0 FROM vectors v
    JOIN firsts f ON f.project = v.project AND f.raw = v.raw WHERE f.name <> v.name""")
def near_duplicate_pairs(spark, d):
    return N.near_duplicate_pairs(_vectors(spark, d), 0.4)


@query("hydrate_matches", with_views("""
    SELECT h.query_id, h.project, h.name, h.similarity, a.description, a.reliability_score,
           a.version
    FROM vector_hits h JOIN assets_flat a ON a.project = h.project AND a.name = h.name""",
    "assets_flat", *HITS))
def hydrate_matches(spark, d):
    matches = N.knn(_queries(spark, d), _vectors(spark, d), K)
    return search.hydrate(matches, summary(V.assets_flat(spark, d))).select(
        "query_id", *KEY, "similarity", "description", "reliability_score", "version")


# ---- keyword and hybrid ------------------------------------------------------------------

@query("keyword_filter", with_views("""
    SELECT project, name, 0.9::DOUBLE AS similarity FROM assets_flat
    WHERE (contains(lower(name), 'tion') OR contains(lower(description), 'tion'))
      AND lower(language) = 'en' AND list_contains(tags, 'short')""", "assets_flat"))
def keyword_filter(spark, d):
    return search.keyword_filter(
        V.assets_flat(spark, d), "TION", "EN", ["Short"]).select(*KEY, "similarity")


@query("keyword_search", with_views("""
    SELECT query_id, project, name, similarity FROM keyword_hits QUALIFY row_number() OVER (
      PARTITION BY query_id ORDER BY project, name) <= 5""",
    "assets_flat", "vectors", "search_queries", "keyword_hits"))
def keyword_search(spark, d):
    return search.keyword_matches(_queries(spark, d), V.assets_flat(spark, d), K)


def _phrases(documents):
    """The third and fourth word of every tenth document, as a text to look for."""
    words = F.split("text", " ")
    return documents.where((F.col("doc_id") % 10 == 0) & (F.size(words) >= 4)).select(
        F.col("doc_id").alias("query_id"), F.array_join(F.slice(words, 3, 2), " ").alias("text"),
        *[F.lit(None).cast(t).alias(c) for c, t in (
            ("project", "string"), ("language", "string"), ("tags", "array<string>"))])


@query("keyword_batch", with_views("""
    SELECT q.query_id, a.project, a.name, 0.9::DOUBLE AS similarity
    FROM (SELECT doc_id AS query_id, lower(w[3] || ' ' || w[4]) AS t
          FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)
          WHERE doc_id % 10 = 0 AND len(w) >= 4 AND w[3] || ' ' || w[4] <> '') q
    JOIN assets_flat a ON contains(lower(a.name), q.t) OR contains(lower(a.description), q.t)
    QUALIFY row_number() OVER (PARTITION BY q.query_id ORDER BY a.project, a.name) <= 5""",
    "assets_flat"))
def keyword_batch(spark, d):
    """As many texts as a tenth of the assets, against all of them."""
    return search.keyword_matches(
        _phrases(V.table(spark, d, "documents")), V.assets_flat(spark, d), K)


@query("tag_query", with_views("""
    SELECT q.query_id, a.project, a.name, 0.9::DOUBLE AS similarity
    FROM (SELECT query_id, CASE query_id % 3 WHEN 0 THEN 'long' WHEN 1 THEN 'fr' ELSE 'src3' END
            AS tag, project FROM search_queries) q
    JOIN assets_flat a ON (q.project IS NULL OR q.project = a.project)
      AND list_contains(a.tags, q.tag)
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY a.project, a.name) <= 5""",
    "assets_flat", "vectors", "search_queries"))
def tag_query(spark, d):
    queries = V.search_queries(spark, d).withColumn(
        "text", V.pick(["#LONG", "#fr", "#src3"], F.col("query_id") % 3))
    return search.keyword_matches(
        search.route_tags(queries), V.assets_flat(spark, d), K)


@query("hybrid_union", with_views("""
    SELECT query_id, project, name, max(similarity) AS similarity FROM (
      SELECT query_id, project, name, similarity FROM vector_hits
      UNION ALL SELECT * FROM (SELECT query_id, project, name, similarity FROM keyword_hits
        QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY project, name) <= 5))
    GROUP BY ALL""", "assets_flat", *HITS, "keyword_hits"))
def hybrid_union(spark, d):
    queries = _queries(spark, d)
    return search.hybrid_union(
        search.keyword_matches(queries, V.assets_flat(spark, d), K),
        N.knn(queries, _vectors(spark, d), K))


@query("hybrid_search", with_views("""
    SELECT query_id, project, name, similarity, rank FROM hybrid WHERE rank <= 5""", *HYBRID))
def hybrid_search(spark, d):
    return _hybrid(spark, d)


def _asking(queries):
    number = F.col("query_id")
    return queries.withColumn("text", F.concat(
        F.when(number % 2 == 0, "How To write ").otherwise("find "), number.cast("string")))


@query("generation_intent", with_views(f"""
    SELECT q.query_id, coalesce(max(h.similarity), 0) AS top_similarity,
           coalesce(max(h.similarity), 0) < 0.45 AND q.query_id % 2 = 0 AS wants_draft
    FROM search_queries q LEFT JOIN vector_hits h ON h.query_id = q.query_id
    GROUP BY q.query_id""", *HITS))
def generation_intent(spark, d):
    queries = _queries(spark, d)
    best = N.knn(queries, _vectors(spark, d), K)
    return search.generation_intent(
        _asking(queries).select("query_id", "text"), best).drop("text")


@query("search_rerank_draft", with_views(f"""
    SELECT query_id, project, name, similarity, rank FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY
               CASE position WHEN 2 THEN 0 WHEN 0 THEN 1 ELSE 2 + position END) AS rank
      FROM (SELECT *, row_number() OVER (
              PARTITION BY query_id ORDER BY similarity DESC, project, name) - 1 AS position
            FROM cosines QUALIFY position < 15)) WHERE rank <= 5
    UNION ALL
    SELECT q.query_id, coalesce(q.project, 'default'), 'draft_' || q.query_id, 0.4, 0
    FROM search_queries q JOIN (
      SELECT query_id, similarity AS s, row_number() OVER (
               PARTITION BY query_id ORDER BY similarity DESC, project, name) AS n,
             count(*) OVER (PARTITION BY query_id) AS size FROM cosines
      ) t ON t.query_id = q.query_id AND t.n = CASE WHEN size > 2 THEN 3 ELSE 1 END
    WHERE t.s < 0.45 AND q.query_id % 2 = 0""", "vectors", "search_queries", "cosines"))
def search_rerank_draft(spark, d):
    """Three times as many results, re-ordered by replies, with drafts for weak ones."""
    asking = _asking(_queries(spark, d))
    matches = search.hybrid_search(
        asking, V.assets_flat(spark, d), _vectors(spark, d), 3 * K)
    replies = asking.select("query_id", F.lit("I pick [2, 0, 99, 2].").alias("reply"))
    drafts = asking.select("query_id", F.concat(
        F.lit("draft_"), F.col("query_id").cast("string")).alias("name"))
    return ranking.rerank_and_draft(asking, matches, replies, drafts, K)
