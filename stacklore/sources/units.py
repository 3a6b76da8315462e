"""Functions and methods of source files, one row each."""

from pyspark.sql import DataFrame, functions as F

from stacklore.functions import facts as P
from stacklore.functions.text import code_hash
from stacklore.operators.catalogue import KEY

MIN_LINES = 3


def code_units(files: DataFrame, prefix="") -> DataFrame:
    """Units of ``files`` (file_id, code): name, qualified name, code and lines.

    A method appears under its own name and as ``Class.method``. The parser
    returns line numbers only; the text is sliced here.
    """
    units = files.select("file_id", "code", F.explode(P.unit_facts("code")).alias("u")).where(
        ((F.col("u.kind") == "function") & (F.col("u.detail") == "function"))
        | (F.col("u.kind") == "method"))
    qualified = F.when(F.col("u.kind") == "method",
                       F.concat("u.detail", F.lit("."), "u.name")).otherwise(F.col("u.name"))
    length = F.col("u.end_lineno") - F.col("u.lineno") + 1
    return units.select(
        "file_id", qualified.alias("unit"),
        F.concat(F.lit(prefix), F.lower(F.replace(qualified, F.lit("."), F.lit("_"))))
        .alias("name"),
        length.alias("lines"),
        F.array_join(F.slice(F.split("code", "\r\n|\n|\r"), F.col("u.lineno"), length), "\n")
        .alias("code"),
    )


def registrable(units: DataFrame) -> DataFrame:
    """Without constructors and units of fewer than three lines."""
    return units.where(~F.col("name").endswith("__init__") & (F.col("lines") >= MIN_LINES))


def unit_change_scan(units: DataFrame, stored: DataFrame) -> DataFrame:
    """skip (hash as stored), update or new per unit."""
    known = stored.select(*KEY, F.col("code_hash").alias("stored_hash"))
    return units.withColumn("code_hash", code_hash("code")).join(known, KEY, "left").withColumn(
        "action",
        F.when(F.col("stored_hash").isNull(), "new")
        .when(F.col("code_hash") == F.col("stored_hash"), "skip")
        .otherwise("update"))
