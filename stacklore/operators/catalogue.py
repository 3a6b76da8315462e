"""The catalogue as tables: admit, version, merge, delete, look up, compare."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from stacklore import constants as K, schemas
from stacklore.functions.text import project_or_default
from stacklore.operators.scan import CHUNK, with_neighbour, with_running_sum
from stacklore.session import cut_lineage

KEY = ["project", "name"]
HASH = ["project", "code_hash"]


# ---- lookups and listings --------------------------------------------------

def get_by_name(catalogue: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per requested key, with status ``not_found`` where it is absent."""
    found = catalogue.select(*KEY, "verification_status", "version")
    return keys.join(found, KEY, "left").withColumn(
        "verification_status", F.coalesce("verification_status", F.lit("not_found")))


def get_by_hash(catalogue: DataFrame, hashes: DataFrame) -> DataFrame:
    return catalogue.join(hashes.select(*HASH).distinct(), HASH, "left_semi")


def has_all_tags(tags, wanted):
    """All wanted tags are there, in any case; no wanted tags is always true."""
    lowered = F.transform(tags, F.lower)
    return reduce(lambda test, tag: test & F.array_contains(lowered, tag.lower()),
                  wanted or [], F.lit(True))


def list_assets(catalogue: DataFrame, project=None, tags=None, limit=50) -> DataFrame:
    rows = catalogue.where(has_all_tags("tags", tags))
    if project:
        rows = rows.where(F.col("project") == project)
    return rows.orderBy(F.desc("updated_at"), *KEY).limit(limit)


def latest_assets(catalogue: DataFrame, limit=10) -> DataFrame:
    return catalogue.orderBy(F.desc("created_at"), *KEY).limit(limit)


def summary(catalogue: DataFrame) -> DataFrame:
    """What a search returns: everything but code, tests and vectors."""
    return catalogue.drop("code", "test_code", "embedding")


def scan(catalogue: DataFrame) -> DataFrame:
    return catalogue.withColumn("project", project_or_default("project"))


# ---- saves -----------------------------------------------------------------

def version_history(log: DataFrame, width=CHUNK) -> DataFrame:
    """Version of every save: one more whenever the hash differs from the one before.

    Pass a narrow log. Its rows are written once between the two scans, which read
    their input twice each.
    """
    rows = with_neighbour(log, KEY, "seq", F.col("code_hash"), "_before", width=width)
    rows = cut_lineage(rows.withColumn(
        "is_new_version", ~F.col("code_hash").eqNullSafe(F.col("_before"))).drop("_before"),
        "versions")
    return with_running_sum(
        rows, KEY, "seq", F.col("is_new_version").cast("int"), "version", width=width
    ).withColumn("version", F.col("version").cast("int"))


def current_state(log: DataFrame, width=CHUNK) -> DataFrame:
    """The last save of each key, with its version.

    Versions come from the narrow columns, written once, and so does the last save of a
    key; only then are the wide rows touched.
    """
    narrow = cut_lineage(log.select(*KEY, "seq", "code_hash"), "log")
    versions = version_history(narrow, width).groupBy(*KEY).agg(
        F.max("version").alias("version"))
    return latest_per_key(log).join(versions, KEY).select(*log.columns, "version")


def history_intervals(log: DataFrame, width=CHUNK) -> DataFrame:
    """Every version with the time it became current and the time it was archived.

    The end of version n is the start of version n + 1, so the two meet in an
    equi-join on unique keys: no window over a whole key.
    """
    versions = version_history(log.select(*KEY, "seq", "ts", "code_hash"), width)
    starts = versions.where("is_new_version").select(
        *KEY, "version", "code_hash", F.col("ts").alias("started_at"))
    ends = starts.select(
        *KEY, (F.col("version") - 1).alias("version"), F.col("started_at").alias("archived_at"))
    return starts.join(ends, [*KEY, "version"], "left")


def as_of_state(log: DataFrame, at, width=CHUNK) -> DataFrame:
    at = F.lit(at).cast("timestamp")
    intervals = history_intervals(log, width)
    return intervals.where(
        (F.col("started_at") <= at)
        & (F.col("archived_at").isNull() | (F.col("archived_at") > at)))


def dedupe_first_seen(log: DataFrame) -> DataFrame:
    """First save of a (project, hash) wins; later ones name the winner.

    The winner is a partial aggregate of one small row per hash. It is joined
    back by hash; a hash with a third of all rows is split by the skew join.
    """
    winners = log.groupBy(*HASH).agg(
        F.min(F.struct("seq", "name")).alias("_first"))
    return log.join(winners, HASH).select(
        *log.columns,
        (F.col("seq") == F.col("_first.seq")).alias("accepted"),
        F.when(F.col("seq") != F.col("_first.seq"), F.col("_first.name")).alias("duplicate_of"),
    )


def dedupe_probe(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Reject incoming saves whose content the project already holds."""
    held = catalogue.groupBy(*HASH).agg(F.min("name").alias("duplicate_of"))
    return incoming.join(held, HASH, "left").withColumn(
        "accepted", F.col("duplicate_of").isNull())


def duplicate_groups(catalogue: DataFrame) -> DataFrame:
    """Hashes held more than once: size, first save and its name.

    Members are rows of ``dedupe_first_seen``; a list per group could outgrow a row.
    """
    return (
        catalogue.groupBy(*HASH)
        .agg(F.count("*").alias("copies"), F.min(F.struct("seq", "name")).alias("_first"))
        .where("copies > 1")
        .select(*HASH, "copies", F.col("_first.seq").alias("first_seq"),
                F.col("_first.name").alias("first_name"))
    )


def merge_upsert(catalogue: DataFrame, incoming: DataFrame):
    """Merge saves into the catalogue.

    Returns ``(current, history)``. A changed hash starts a new version and
    moves the old row to the history; an equal hash refreshes the metadata.
    ``call_count`` and ``created_at`` survive every save. Of several saves of a
    key the last by ``seq`` counts, or any one of them without that column.

    The keys that arrive are written first: rows of other keys pass by unchanged,
    and only the rest of the catalogue meets the new rows.
    """
    fields = [c for c in catalogue.columns if c not in KEY]
    one_each = "seq" in incoming.columns
    incoming = latest_per_key(incoming) if one_each else incoming.dropDuplicates(KEY)
    keys = cut_lineage(incoming.select(*KEY), "arriving")
    old = catalogue.join(keys, KEY, "left_semi").select(*KEY, F.struct(*fields).alias("old"))
    new = incoming.select(
        *KEY, F.struct(*[c for c in incoming.columns if c not in KEY]).alias("new"))
    both = new.join(old, KEY, "left").withColumn(
        "action",
        F.when(F.col("old").isNull(), "insert")
        .when(F.col("old.code_hash").eqNullSafe(F.col("new.code_hash")), "refresh")
        .otherwise("new_version"),
    )
    arriving = set(incoming.columns)

    def merged(name):
        old_value = F.col(f"old.{name}")
        if name == "version":
            step = F.when(F.col("action") == "new_version", 1).otherwise(0)
            return F.coalesce(old_value + step, F.lit(1)).cast("int")
        if name == "call_count":
            return F.coalesce(old_value, F.lit(0)).cast("long")
        new_value = F.col(f"new.{name}") if name in arriving else F.lit(None)
        if name == "created_at":
            return F.coalesce(old_value, new_value)
        if name not in arriving:
            return old_value
        return new_value

    untouched = catalogue.join(keys, KEY, "left_anti").withColumn("action", F.lit("keep"))
    current = both.select(*KEY, *[merged(c).alias(c) for c in fields], "action").unionByName(
        untouched)
    stamp = F.col("new.updated_at") if "updated_at" in arriving else F.current_timestamp()
    history = both.where(F.col("action") == "new_version").select(
        *KEY, "old.*", stamp.alias("archived_at"))
    return current, history


def latest_per_key(log: DataFrame) -> DataFrame:
    """One save per key, the last one by ``seq``, which is unique within a key.

    The last seq is a partial aggregate of narrow rows; texts are met once, by key and
    seq, which no hot key can crowd.
    """
    last = log.groupBy(*KEY).agg(F.max("seq").alias("seq"))
    return log.join(last, [*KEY, "seq"], "left_semi")


def delete_and_archive(catalogue: DataFrame, keys: DataFrame, stamp):
    """Returns ``(live, archived)``; removed rows carry the archive stamp."""
    keys = keys.select(*KEY).distinct()
    live = catalogue.join(keys, KEY, "left_anti")
    archived = catalogue.join(keys, KEY, "left_semi").withColumn(
        "archived_at", F.lit(stamp).cast("timestamp"))
    return live, archived


def verdict_merge(catalogue: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Set status, report, reliability and time; a field not given stays.

    Of several verdicts for a key the latest by ``updated_at`` counts, and of equal times the
    one whose plain fields come last in order.
    """
    given = [c for c in verdicts.columns if c not in KEY]
    plain = [c for c, t in verdicts.dtypes if c in given and c != "updated_at"
             and not t.startswith(("map", "variant", "array", "struct"))]
    latest = verdicts.groupBy(*KEY).agg(F.max_by(F.struct(*given), F.struct(
        *[c for c in given if c == "updated_at"], *plain)).alias("_new"))
    new = latest.select(*KEY, *[F.col(f"_new.{c}").alias(f"_new_{c}") for c in given])
    joined = catalogue.join(new, KEY, "left")
    for c in given:
        joined = joined.withColumn(
            c, F.coalesce(f"_new_{c}", c) if c in catalogue.columns else F.col(f"_new_{c}"))
    return joined.drop(*[f"_new_{c}" for c in given])


def count_calls(catalogue: DataFrame, calls: DataFrame) -> DataFrame:
    """Add one to ``call_count`` per call of a key; unknown keys change nothing."""
    counts = calls.groupBy(*KEY).agg(F.count("*").alias("_calls"))
    return catalogue.join(counts, KEY, "left").withColumn(
        "call_count", F.col("call_count") + F.coalesce("_calls", F.lit(0))).drop("_calls")


# ---- comparisons -----------------------------------------------------------

def catalogue_mirror_diff(catalogue: DataFrame, mirror: DataFrame) -> DataFrame:
    """State of every key: only_catalogue, only_mirror, changed or same."""
    left = catalogue.select(*KEY, F.col("code_hash").alias("catalogue_hash"), F.lit(1).alias("_l"))
    right = mirror.select(*KEY, F.col("code_hash").alias("mirror_hash"), F.lit(1).alias("_r"))
    return left.join(right, KEY, "full").select(
        *KEY, "catalogue_hash", "mirror_hash",
        F.when(F.col("_r").isNull(), "only_catalogue")
        .when(F.col("_l").isNull(), "only_mirror")
        .when(F.col("catalogue_hash").eqNullSafe(F.col("mirror_hash")), "same")
        .otherwise("changed").alias("state"),
    )


def restore_union(catalogue: DataFrame, restored: DataFrame) -> DataFrame:
    """All (project, name, hash) rows of both sides, each once, with their origin.

    Union, intersection and difference come from one aggregation.
    """
    key = [*KEY, "code_hash"]
    sides = catalogue.select(*key, F.lit(True).alias("_here")).unionByName(
        restored.select(*key, F.lit(False).alias("_here")))
    return sides.groupBy(*key).agg(
        F.when(~F.max("_here"), "restored").when(F.min("_here"), "current")
        .otherwise("both").alias("origin"))


def vector_desync(catalogue: DataFrame, vectors: DataFrame) -> DataFrame:
    """Keys that only one of catalogue and vectors holds."""
    left = catalogue.select(*KEY, F.lit(True).alias("in_catalogue"))
    right = vectors.select(*KEY, F.lit(True).alias("in_vectors"))
    return left.join(right, KEY, "full").na.fill(
        False, ["in_catalogue", "in_vectors"]).where("not (in_catalogue and in_vectors)")


def stale_embeddings(catalogue: DataFrame, embeddings: DataFrame, model, dimension) -> DataFrame:
    """Assets without a vector, or with one of another model or dimension."""
    held = embeddings.select(*KEY, "model", "dimension")
    return catalogue.select(*KEY).join(held, KEY, "left").withColumn(
        "reason",
        F.when(F.col("model").isNull() & F.col("dimension").isNull(), "missing")
        .when(F.col("model") != model, "model")
        .when(F.col("dimension") != dimension, "dimension"),
    ).where("reason is not null")


def schema_evolve(old: DataFrame, new_schema=schemas.ASSETS) -> DataFrame:
    """Bring an older table to the present schema: common columns, then defaults."""
    spark = old.sparkSession
    known = [f.name for f in new_schema if f.name in old.columns]
    rows = spark.createDataFrame([], new_schema).unionByName(
        old.select(*known), allowMissingColumns=True)
    defaults = {k: v for k, v in schemas.ASSET_DEFAULTS.items() if k in new_schema.names}
    return rows.na.fill(defaults)


def draft_filter(catalogue: DataFrame, project=None) -> DataFrame:
    rows = catalogue.where(F.col("description").contains(K.DRAFT_MARK))
    return rows.where(F.col("project") == project) if project else rows
