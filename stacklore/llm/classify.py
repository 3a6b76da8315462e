"""What the text classifiers share: bounded training samples and scoring by batches."""

import numpy as np
from pyspark.sql import Window, functions as F

from stacklore.llm.common import typed

PARTS = 64


def sample_ids(labelled, label, per_class):
    """Up to ``per_class`` ids of each label, the smallest by hash: (doc_id, label, weight).

    ``weight`` is the rows of the class over the rows taken, so the sample still stands
    for the class shares of all rows. No task ranks a whole class.
    """
    rows = labelled.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy(
        "doc_id").agg(F.max(label).alias("label"))
    # First within PARTS parts of a class, then among at most PARTS * per_class rows.
    rows = rows.withColumn("_hash", F.xxhash64("doc_id")).withColumn(
        "_part", F.pmod(F.xxhash64("_hash"), F.lit(PARTS)))

    def smallest(taken, *keys):
        order = Window.partitionBy(*keys).orderBy("_hash", "doc_id")
        return taken.withColumn("_rank", F.row_number().over(order)).filter(
            F.col("_rank") <= per_class)

    taken = smallest(smallest(rows, "label", "_part"), "label")
    sizes = rows.groupBy("label").agg(F.count("*").alias("_n"))
    return taken.join(F.broadcast(sizes), "label").select(
        "doc_id", "label",
        (F.col("_n") / F.least(F.col("_n"), F.lit(per_class))).alias("weight"))


def fit_on_sample(docs, ids, features, fit, size):
    """Fit a model on the texts of ``ids`` in one task and return it as bytes.

    ``features`` turns an Arrow column of texts into one array of feature numbers per
    text, ``fit`` turns those lists with labels and weights into an array. Rows that share
    an id train as one text, the smallest, so the rows are bounded by the sample even where
    one id fills the table; the model is bounded by ``size`` numbers.
    """
    def run(batches):
        found, labels, weights = [], [], []
        for batch in batches:
            found += features(batch.column("text"))
            labels += batch.column("label").to_pylist()
            weights += batch.column("weight").to_pylist()
        import pyarrow as pa

        model = fit(found, np.array(labels, np.float32), np.array(weights, np.float32))
        yield pa.RecordBatch.from_arrays(
            [pa.array([np.asarray(model, np.float32).tobytes()], pa.binary())], ["model"])

    texts = typed(docs, "doc_id", "text").filter(F.col("text").isNotNull()).join(
        F.broadcast(ids), "doc_id").groupBy("doc_id", "label", "weight").agg(
        F.min("text").alias("text"))
    row = texts.repartition(1).sortWithinPartitions("doc_id", "text").select(
        "text", "label", "weight").mapInArrow(run, "model binary").first()
    return np.frombuffer(row["model"], np.float32) if row else np.zeros(size, np.float32)


def score_texts(docs, score, model):
    """(doc_id, text is read, score) for every row; ``model`` is broadcast once."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            values = score(batch.column("text"), held.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(values, pa.float64())], ["doc_id", "score"])

    return typed(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double")


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
