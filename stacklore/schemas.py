"""Declared schemas of the catalogue tables and of the files that mirror them."""

from pyspark.sql import types as T

FINGERPRINT = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("os", "os_release", "os_version", "python_version",
              "python_implementation", "cpu_arch", "execution_driver", "timestamp")
])

ASSETS = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("dependencies", T.ArrayType(T.StringType())),
    T.StructField("test_code", T.StringType()),
    T.StructField("reliability_score", T.DoubleType()),
    T.StructField("call_count", T.LongType()),
    T.StructField("code_hash", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("verification_status", T.StringType()),
    T.StructField("env_fingerprint", FINGERPRINT),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

# What a column holds when an older table does not have it.
ASSET_DEFAULTS = {
    "project": "default",
    "description": "",
    "language": "python",
    "test_code": "",
    "reliability_score": 1.0,
    "call_count": 0,
    "version": 1,
    "verification_status": "pending",
}

# Mirror metadata: lists and records arrive as JSON or as JSON text, so both are read as text.
MIRROR_METADATA = T.StructType([
    T.StructField("project", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("code", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("language", T.StringType()),
    T.StructField("tags", T.StringType()),
    T.StructField("dependencies", T.StringType()),
    T.StructField("test_code", T.StringType()),
    T.StructField("reliability_score", T.DoubleType()),
    T.StructField("call_count", T.LongType()),
    T.StructField("code_hash", T.StringType()),
    T.StructField("version", T.IntegerType()),
    T.StructField("verification_status", T.StringType()),
    T.StructField("env_fingerprint", T.StringType()),
    T.StructField("test_metrics", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
])

CI_RESULT = T.StructType([
    T.StructField("os", T.StringType()),
    T.StructField("node", T.StringType()),
    T.StructField("python", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("_corrupt_record", T.StringType()),
])

FACTS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("detail", T.StringType()),
    T.StructField("size", T.IntegerType()),
    T.StructField("params", T.IntegerType()),
    T.StructField("flag", T.BooleanType()),
    T.StructField("lineno", T.IntegerType()),
    T.StructField("end_lineno", T.IntegerType()),
]))
