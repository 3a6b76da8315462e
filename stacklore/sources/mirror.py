"""The mirror: the catalogue as files that people can read and edit.

Two layouts hold the same data. The bulk layout is a metadata table (JSON
lines by project) and a code table (by project and language), and is what a large
catalogue is exported to. The tree layout is one code file and one metadata file
per asset, ``projects/{project}/functions/{language}/{name}.{ext}`` and
``projects/{project}/metadata/{name}.json``, for catalogues that people edit.

Metadata may hold fields of any name. Those of ``schemas.MIRROR_METADATA`` are columns, all
others are read into ``extra``, a map of variants, and written back beside the columns.
"""

from pyspark.sql import DataFrame, functions as F, types as T

from stacklore.functions.replies import whole_json
from stacklore import schemas
from stacklore.functions.text import code_hash, extension
from stacklore.operators.catalogue import KEY
from stacklore.sources import tree

_META = r"^projects/([^/]+)/metadata/[^/]*\.json\z"
_PATH = r"^projects/([^/]+)/functions/([^/]+)/([^/]+)\.([^./]+)$"


def mirror_export(catalogue: DataFrame, path):
    """Write metadata (without vectors) and code below ``path``."""
    write_metadata(catalogue, path)
    write_code(catalogue, path)


def write_metadata(catalogue: DataFrame, path):
    lists = [c for c in ("tags", "dependencies") if c in catalogue.columns]
    meta = catalogue.withColumns(
        {**{c: F.to_json(c) for c in lists}, "folder": F.col("folder")
            if "folder" in catalogue.columns else F.col("project")})
    _by_folder(meta.select(metadata_json(meta).alias("value"), "folder")).text(f"{path}/metadata")


def metadata_json(rows: DataFrame, pretty=False):
    """Column: all columns but vectors as a JSON object, the fields of ``extra`` beside them.

    A field of ``extra`` that has the name of a column gives way to the column.
    """
    columns = [c for c in rows.columns if c not in ("embedding", "extra", "folder")]
    options = {"pretty": str(pretty).lower()}
    base = F.to_json(F.struct(*columns), options)
    if "extra" not in rows.columns:
        return base
    others = F.map_filter("extra", lambda k, _: ~k.isin(*columns))
    more = F.to_json(others, options)
    edge = 2 if pretty else 1  # the brace and, if pretty, the line end beside it
    return F.when(F.coalesce(F.size(others), F.lit(0)) <= 0, base).when(
        ~base.contains(":"), more).otherwise(F.concat(
            F.left(base, F.length(base) - edge), F.lit(",\n" if pretty else ","),
            F.substr(more, F.lit(edge + 1))))


def write_code(catalogue: DataFrame, path):
    _by_folder(catalogue.select(
        *KEY, F.lower("language").alias("language"), extension("language").alias("extension"),
        "code", F.col("project").alias("folder"),
    )).option("compression", "zstd").parquet(f"{path}/code")


def _by_folder(rows: DataFrame):
    """A writer with few files per folder; folders too large for a task are split."""
    return rows.hint("rebalance", "folder").write.partitionBy("folder")


def mirror_write_tree(catalogue: DataFrame, path):
    """Write the tree layout below ``path``; files that are there are replaced.

    Rows without project go to ``default``. Of rows that share a key, the one whose JSON and
    code sort last stays. A null code writes no code file; one of another language, written
    before, stays where it is and is read no more. See ``tree`` for how a failed task, a lost
    executor or an interrupted driver leaves only whole assets.
    """
    named = catalogue.withColumn("project", F.coalesce("project", F.lit("default"))) \
        .withColumn("name", F.coalesce("name", F.lit("unknown")))
    if "folder" not in named.columns:
        named = named.withColumn("folder", F.col("project"))
    place = F.concat(F.lit("projects/"), tree.file_name("folder"))
    language = _language_folder()
    pairs = named.select(
        F.concat(place, F.lit("/functions/"), tree.file_name(language), F.lit("/"),
                 tree.file_name("name"), F.lit("."), extension(language)).alias("code_target"),
        F.col("code"),
        F.concat(place, F.lit("/metadata/"), tree.file_name("name"), F.lit(".json"))
        .alias("meta_target"),
        metadata_json(named, pretty=True).alias("meta"))
    tree.write_pairs(pairs.groupBy("meta_target").agg(
        F.max(F.struct("meta", "code", "code_target")).alias("_last")).select(
        "_last.code_target", "_last.code", "meta_target", "_last.meta"), path)


def _language_folder():
    return F.lower(F.coalesce("language", F.lit("python")))


def mirror_read(spark, path) -> DataFrame:
    """Read the bulk layout back; code of the code table wins over metadata."""
    # The folder is read as text: a project called 007 keeps its name.
    lines = spark.read.schema("value string, folder string").text(f"{path}/metadata")
    meta = records(lines.where("trim(value) <> ''"), schemas.MIRROR_METADATA).withColumn(
        "project", F.coalesce("project", "folder")).drop("folder")
    code = spark.read.parquet(f"{path}/code").select(*KEY, "language", "code")
    return mirror_join(meta, code)


def records(texts: DataFrame, fields) -> DataFrame:
    """JSON objects of the column ``value`` as columns ``fields``, the rest in ``extra``.

    ``extra`` maps names to variants; of a name given twice, the last counts. It is empty
    where there are no other fields and where the text is no JSON object.
    """
    every = F.from_json("value", "map<string,variant>")
    others = texts.withColumns({"_fields": F.from_json("value", fields), "_every": F.map_entries(
        F.map_filter(every, lambda k, _: ~k.isin(*fields.names)))})
    names = F.col("_every")["key"]
    last = F.filter("_every", lambda e, i: ~F.array_contains(
        F.slice(names, i + 2, F.size(names) + 1), e["key"]))
    none = F.from_json(F.lit("{}"), "map<string,variant>")
    return others.select(
        *texts.drop("value").columns, "_fields.*",
        F.coalesce(F.map_from_entries(last), none).alias("extra"))


def mirror_read_tree(spark, path) -> DataFrame:
    """Read the tree layout of every project.

    Code is looked for in the folder that holds the metadata, whatever project that names;
    ``folder`` is kept beside ``project``. Files whose names start with ``_`` or ``.`` are
    passed over, as in any folder Spark reads; ``mirror_write_tree`` escapes such names.
    """
    places = tree.listed(spark, path)
    texts = tree.contents(spark, places.where(F.col("place").rlike(_META)), path).select(
        F.col("content").cast("string").alias("value"),
        F.regexp_extract("place", _META, 1).alias("_place"))
    meta = (
        records(texts, schemas.MIRROR_METADATA).withColumnRenamed("_place", "folder")
        .withColumn("project", F.coalesce("project", "folder"))
        .where("name is not null").withColumn("_file", tree.file_name("name"))
        .withColumn("_kind", F.lower(tree.file_name(_language_folder())))
    )
    files = tree.contents(spark, places.where(F.col("place").rlike(_PATH)), path)
    code = files.select(
        F.regexp_extract("place", _PATH, 1).alias("folder"),
        F.regexp_extract("place", _PATH, 3).alias("_file"),
        F.lower(F.regexp_extract("place", _PATH, 2)).alias("_kind"),
        F.regexp_extract("place", _PATH, 4).alias("extension"),
        F.decode("content", "UTF-8").alias("code"))
    return mirror_join(meta, code, ["folder", "_file", "_kind"]).drop("_file", "_kind")


def mirror_join(meta: DataFrame, code: DataFrame, on=KEY) -> DataFrame:
    """Metadata with the code of its file, and the hash of what was really read.

    Both meet by ``on``, and by language and extension where ``code`` has these.
    """
    meta = meta.withColumn("language", F.coalesce("language", F.lit("python")))
    # Hashes are made before the join, so a caller that wants no code has none shuffled.
    files = code.select(
        *[F.col(c).alias(f"_on{i}") for i, c in enumerate(on)], F.col("code").alias("_file_code"),
        code_hash("code").alias("_file_hash"), F.col("code").isNotNull().alias("_from_file"),
        *([F.lower("language").alias("_language")] if "language" in code.columns else []),
        *([F.col("extension").alias("_extension")] if "extension" in code.columns else []))
    match = [F.col(c) == F.col(f"_on{i}") for i, c in enumerate(on)]
    # Language and extension tell few rows of a key apart. They are compared in an order, which
    # is no key of the join: rows then lie by ``on``, and a later join by it shuffles no texts.
    if "_language" in files.columns:
        match += _alike(F.lower("language"), F.col("_language"))
    if "_extension" in files.columns:
        match += _alike(extension("language"), F.col("_extension"))
    joined = meta.withColumn("_own_hash", code_hash("code")).join(files, match, "left")
    from_file = F.coalesce("_from_file", F.lit(False))
    read = joined.withColumn("code", F.coalesce("_file_code", "code")).withColumn(
        "code_from_file", from_file).withColumn(
        "code_hash", F.when(from_file, F.col("_file_hash")).otherwise(F.col("_own_hash")))
    return decode_lists(read).drop(
        "_language", "_extension", "_file_code", "_file_hash", "_own_hash", "_from_file",
        *[f"_on{i}" for i in range(len(on))])


def _alike(a, b):
    return [a <= b, a >= b]


def decode_lists(rows: DataFrame) -> DataFrame:
    """Lists that may be JSON lists or JSON text holding one become arrays."""
    for c in ("tags", "dependencies"):
        if c in rows.columns:
            rows = rows.withColumn(c, F.coalesce(
                json_list(c), F.array().cast("array<string>")))
    return rows


def json_list(c):
    return F.from_json(F.col(c), "array<string>")


def json_decode(rows: DataFrame, column, kind="array<string>") -> DataFrame:
    """Decode a JSON text column; what cannot be read stays in ``{column}_raw``."""
    parsed = F.from_json(whole_json(F.col(column)), kind)
    failed = F.col("_parsed").isNull() & (F.length(column) > 0)
    return (
        rows.withColumn("_parsed", parsed)
        .withColumn(f"{column}_raw", F.when(failed, F.col(column)))
        .withColumn(column, F.col("_parsed")).drop("_parsed")
    )
