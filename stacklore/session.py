"""Session settings and the shared scratch folder."""

import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_SETTINGS = {
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Source texts are long: small Arrow batches keep Python workers small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
}

# What the jobs expect of a cluster, beside its own sizes. Skewed joins are split
# even where that costs a shuffle, and streaming state lives outside the heap.
CLUSTER_SETTINGS = {
    **LOCAL_SETTINGS,
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def local_session(cpus="*", partitions=8, memory="8g", **extra):
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("stacklore")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in {**LOCAL_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark, label="run"):
    """A new folder below the one that the cluster shares for checkpoints.

    All folders of an application lie in ``stacklore/{application id}``. Its results may
    still read them, so whoever started the application removes that one folder when the
    results are stored elsewhere.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        # Only a session whose executors live in the driver may use a folder of this machine.
        if not spark.sparkContext.master.startswith("local") or \
                spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="run-")
        spark.sparkContext.setCheckpointDir(base)
    run = spark.sparkContext.applicationId
    return f"{base.rstrip('/')}/stacklore/{run}/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label="step"):
    """Write a table to the scratch folder and read it back.

    Iterative jobs call this once per round: the plan stays short, and a lost
    executor costs a re-read of the files and no re-run of earlier rounds.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(rows, per_task=10_000, most=10_000):
    """The rows dealt over tasks of about ``per_task`` rows, ``most`` tasks at most.

    For narrow rows before work that is dear by the row: their files are small and read by a
    few tasks, however many rows they hold.
    """
    return rows.repartition(min(max(1, -(-rows.count() // per_task)), most))
