"""Batch search: many queries against many assets, the best k per query.

A query row holds query_id, text, embedding, project, language and tags; null
means "any". Similarity is 0.9 for a keyword hit and the cosine for a vector
hit; an asset found both ways takes the larger.
"""

from pyspark.sql import DataFrame, functions as F

from stacklore import constants as K
from stacklore.functions.pieces import piece_filter, text_pieces
from stacklore.functions.text import wants_generation
from stacklore.operators.catalogue import KEY, has_all_tags
from stacklore.operators.vectors import knn, top_k
from stacklore.session import cut_lineage

SAMPLED = 64
MANY = 2_000_000
SLICE_KEYS = 256
_FILTERS = ["text", "project", "language", "tags"]


def keyword_filter(catalogue: DataFrame, text=None, language=None, tags=None,
                   project=None) -> DataFrame:
    """Hits of one query: a literal, case-insensitive part of name or description."""
    rows = catalogue
    if text:
        needle = F.lit(text.lower())
        rows = rows.where(F.lower("name").contains(needle)
                          | F.lower("description").contains(needle))
    if language:
        rows = rows.where(F.lower("language") == language.lower())
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.where(has_all_tags("tags", tags)).withColumn(
        "similarity", F.lit(K.KEYWORD_SIMILARITY))


def route_tags(queries: DataFrame) -> DataFrame:
    """A query ``#tag`` is a tag filter, not a text."""
    is_tag = F.coalesce(F.col("text").startswith("#"), F.lit(False))
    tag = F.array(F.substring("text", 2, 1 << 30))
    return queries.withColumn(
        "tags", F.when(is_tag, F.concat(F.coalesce(
            "tags", F.array().cast("array<string>")), tag)).otherwise(F.col("tags"))
    ).withColumn("text", F.when(~is_tag, F.col("text")))


def _described():
    return F.lower(F.concat_ws("\0", "name", "description")).alias("_described")


def piece_postings(catalogue: DataFrame) -> DataFrame:
    """(project, name, piece) for the pieces of each asset's text.

    Written as a table it is the index that ``keyword_matches`` can be given; without one
    the postings of the pieces in question are made as the texts are read.
    """
    return text_pieces(catalogue.select(*KEY, _described()), KEY, "_described")


def _postings(texts, index, pieces):
    """The postings of these pieces, a table of narrow rows; made ones hold few others too."""
    if index is not None:
        return index.join(pieces, "piece", "left_semi")
    return text_pieces(texts, KEY, "_described", piece_filter(pieces))


def _text_hits(specs, catalogue, index, k):
    """(spec, project, name) of the assets that hold the spec's text and fit its filters.

    Each text asks for its rarest piece in the postings, as narrow rows; the assets that
    have it are then met by key, where the whole text is looked for. Frequencies come from
    one in ``SAMPLED`` assets by hash: they choose the piece and so the cost, as every hit
    has all pieces of the text. Frequent pieces are keys of a plain join, which the skew
    join splits.

    All hits are alike, so the best k are the first ones by key. Where more than ``MANY``
    assets are to be met, the catalogue is gone through in slices in the order of its keys,
    and specs that have k hits ask no more; the first k hits of each spec are returned then.
    """
    specs = specs.withColumn("needle", F.lower("q_text"))
    pieces = cut_lineage(text_pieces(specs, ["spec"], "needle", whole=True), "pieces")
    texts = catalogue.select(*KEY, "language", "tags", _described())
    sample = F.pmod(F.xxhash64(*KEY), F.lit(SAMPLED)) == 0
    common = _postings(
        texts.where(sample), index if index is None else index.where(sample),
        pieces.select("piece").distinct()).groupBy("piece").agg(F.count("*").alias("n"))
    rarest = pieces.join(common, "piece", "left").groupBy("spec").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("least"))
    wanted = cut_lineage(specs.join(rarest, "spec").select(
        "spec", "least.*", "needle", *[f"q_{c}" for c in _FILTERS[1:]]), "asked")
    if (wanted.agg(F.sum("n")).first()[0] or 0) * SAMPLED <= MANY:
        return _hits_among(wanted, texts, index)
    texts = cut_lineage(texts, "texts")
    hits = None
    for part in _key_slices(texts):
        best = cut_lineage(top_k(_hits_among(
            wanted, texts.where(part), index if index is None else index.where(part)
        ).withColumn("similarity", F.lit(K.KEYWORD_SIMILARITY)), k, by=("spec",)).select(
            "spec", *KEY), "best")
        hits = best if hits is None else hits.unionByName(best)
        full = hits.groupBy("spec").agg(F.count("*").alias("hits")).where(F.col("hits") >= k)
        wanted = cut_lineage(wanted.join(full, "spec", "left_anti"), "asked")
    return hits


def _hits_among(wanted, texts, index):
    """The hits of the specs ``wanted`` in these texts."""
    rows = _postings(texts, index, wanted.select("piece").distinct())
    found = cut_lineage(rows.join(wanted.drop("n"), "piece").where(
        F.col("q_project").isNull() | (F.col("q_project") == F.col("project"))).drop("piece"),
        "candidates")
    return found.join(texts, KEY).where(
        F.col("_described").contains(F.col("needle")) & _fits()).select("spec", *KEY)


def _key_slices(rows):
    """Conditions that cut rows by their keys, in order, each part three times all before it.

    The cuts come from the keys of least hash. Rows without project or name come first, as
    they do in the order of the best.
    """
    first = rows.select(*KEY).where("project is not null and name is not null").orderBy(
        F.xxhash64(*KEY)).limit(SLICE_KEYS).collect()
    keys = sorted(tuple(r) for r in first)
    cuts = [keys[len(keys) // part] for part in (64, 16, 4)] if keys else []

    def after(key):
        project, name = F.col("project"), F.col("name")
        return F.coalesce((project > key[0]) | ((project == key[0]) & (name > key[1])), F.lit(False))

    for low, high in zip([None, *cuts], [*cuts, None]):
        yield (F.lit(True) if low is None else after(low)) & (
            F.lit(True) if high is None else ~after(high))


def _fits():
    """Whether an asset (project, language, tags) passes the filters q_project, ..."""
    return (
        F.col("q_project").isNull() | (F.col("q_project") == F.col("project"))
    ) & (
        F.col("q_language").isNull() | (F.lower("q_language") == F.lower("language"))
    ) & (
        F.col("q_tags").isNull() | (F.size(F.array_except(
            F.transform("q_tags", F.lower), F.transform("tags", F.lower))) == 0)
    )


def _filter_hits(specs, catalogue):
    """(spec, project, name) for specs without a text, met by their first filter value."""
    specs = specs.withColumn("q_probe", F.coalesce(
        F.when(F.length("q_project") > 0, F.concat(F.lit("project:"), "q_project")),
        F.when(F.length("q_language") > 0, F.concat(F.lit("language:"), F.lower("q_language"))),
        F.concat(F.lit("tag:"), F.lower(F.get("q_tags", 0)))))
    keys = F.concat(
        F.array(F.concat(F.lit("project:"), "project"),
                F.concat(F.lit("language:"), F.lower("language"))),
        F.transform(F.array_distinct(F.transform("tags", F.lower)),
                    lambda t: F.concat(F.lit("tag:"), t)),
    )
    # Plain explode would add a filter that works the keys out a second time.
    offered = catalogue.select(*KEY, "language", "tags", keys.alias("_keys")).withColumn(
        "q_probe", F.explode_outer("_keys")).drop("_keys")
    return offered.join(specs, "q_probe").where(_fits()).select("spec", *KEY)


def keyword_matches(queries: DataFrame, catalogue: DataFrame, k, index=None) -> DataFrame:
    """Best k keyword hits per query, as (query_id, project, name, similarity).

    Equal filters are evaluated once. Texts are found by their rarest piece, in ``index`` (the
    stored ``piece_postings`` of the catalogue) or in the catalogue itself, other filters by
    one of their values, so queries and assets meet in equi-joins of narrow rows and not in a
    cross join. Each task keeps its best k before the last shuffle.
    """
    text, project, language, tags = (F.col(c) for c in _FILTERS)
    spec = F.xxhash64(*[F.coalesce(c, F.lit("\0")) for c in (
        F.lower(text), project, F.lower(language), F.array_join(F.transform(tags, F.lower), "\1"))])
    asked = queries.select("query_id", *_FILTERS).where(
        (F.length(text) > 0) | (F.length(project) > 0) | (F.length(language) > 0)
        | (F.size(tags) > 0)).withColumn("spec", spec)
    # Written out, its size is known, and a small one is broadcast to the assets.
    specs = cut_lineage(asked.groupBy("spec").agg(
        *[F.any_value(c).alias(f"q_{c}") for c in _FILTERS]), "specs")
    has_text = F.coalesce(F.length("q_text") > 0, F.lit(False))
    hits = _text_hits(specs.where(has_text), catalogue, index, k)
    if not specs.where(~has_text).isEmpty():
        hits = hits.unionByName(_filter_hits(specs.where(~has_text), catalogue))
    best = top_k(hits.withColumn("similarity", F.lit(K.KEYWORD_SIMILARITY)), k,
                 by=("spec",)).drop("rank")
    return asked.select("query_id", "spec").join(best, "spec").drop("spec")


def hybrid_union(keyword: DataFrame, vector: DataFrame) -> DataFrame:
    cols = ["query_id", *KEY, "similarity"]
    return keyword.select(*cols).unionByName(vector.select(*cols)).groupBy(
        "query_id", *KEY).agg(F.max("similarity").alias("similarity"))


def hybrid_search(queries: DataFrame, catalogue: DataFrame, vectors: DataFrame, k) -> DataFrame:
    """Best k assets per query over both legs.

    The best k of each leg are enough: an asset in the final k has its score
    from one leg, and fewer than k assets can stand before it there.
    """
    queries = cut_lineage(route_tags(queries), "queries")  # read several times
    keyword = keyword_matches(queries, catalogue, k)
    vector = knn(queries.where("embedding is not null"), vectors, k)
    return top_k(hybrid_union(keyword, vector), k)


def hydrate(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Catalogue columns of the matches, in one join.

    The matches are written first: their size is then known, so few of them are
    broadcast and the catalogue is not shuffled.
    """
    return cut_lineage(matches, "matches").join(catalogue, KEY)


def generation_intent(queries: DataFrame, best: DataFrame) -> DataFrame:
    """Queries whose best match is weak and whose words ask for new code."""
    top = best.groupBy("query_id").agg(F.max("similarity").alias("top_similarity"))
    return queries.join(top, "query_id", "left").withColumn(
        "top_similarity", F.coalesce("top_similarity", F.lit(0.0))
    ).withColumn("wants_draft", (F.col("top_similarity") < K.WEAK_MATCH_BELOW)
                 & F.coalesce(wants_generation("text"), F.lit(False)))
