"""Result files of automated builds."""

from pyspark.sql import DataFrame, functions as F

from stacklore import schemas


def ci_results_read(spark, path) -> DataFrame:
    """All readable results below ``path``; broken records are left out."""
    rows = spark.read.schema(schemas.CI_RESULT).option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.where(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
