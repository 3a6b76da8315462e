"""Token counts as delta-maintained rollups.

A store is a folder of batches. Each batch brings changes: inserted, deleted or revised
documents with their token counts. ``commit`` turns them into signed rows: an insert adds, a
delete takes back what the document counts now, a revision does both. Totals by source,
language and tokenizer version are sums of the signed rows of all batches, so no batch is
ever counted again, and a batch's own rollup is a handful of rows.

Commits are idempotent: a batch is a folder named by its id, its rollup is written last and
its success file marks the commit. A batch that is committed is skipped, one that broke off
is overwritten. Within a batch the last change of a document wins by ``seq``.

Cases: a null or empty text has 0 tokens and still counts as a document. Null source or
language is a group of its own. Rows without id are counted under a null id as one
document; of repeated rows of an id in a batch one counts. Deleting or revising an unknown
document takes nothing back. Other columns are ignored. An empty batch commits no rows.
"""

import base64

from pyspark.sql import DataFrame, functions as F

from stacklore.llm.common import typed
from stacklore.session import cut_lineage

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Pre-tokenisation of the byte-level vocabulary; fixed by it.
PATTERN = (r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s")
TOKENIZERS = ("words-1", "byte-bpe-50k")
KEYS = ["source", "lang", "tokenizer"]
SIGNED = "doc_id long, source string, lang string, tokenizer string, n_docs long, n_tokens long"


def _encoder(path):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def counted(docs, vocabulary=VOCABULARY) -> DataFrame:
    """doc_id, source, lang, tokenizer and n_tokens of every row under every tokenizer."""
    def run(batches):
        import pyarrow as pa

        encoder = _encoder(vocabulary)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            # bytes.split cuts at the six ASCII white-space characters.
            words = [len(t.encode("utf-8", "replace").split()) for t in texts]
            pieces = [len(encoder.encode_ordinary(t)) for t in texts]
            for name, n in zip(TOKENIZERS, (words, pieces)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("source"), batch.column("lang"),
                     pa.array([name] * len(n), pa.string()), pa.array(n, pa.int64())],
                    ["doc_id", *KEYS, "n_tokens"])

    return typed(docs, "doc_id", "source", "lang", "text").mapInArrow(
        run, "doc_id long, source string, lang string, tokenizer string, n_tokens long")


def _exists(spark, path):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _batches(spark, store):
    """Ids of committed batches, in name order."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store}/rollups")
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = sorted(f.getPath().getName() for f in files.listStatus(folder))
    return [n for n in names if _exists(spark, f"{store}/rollups/{n}/_SUCCESS")]


def current(spark, store, changes=None) -> DataFrame:
    """What every document, or every document of ``changes``, counts now.

    That is the sum of its signed rows; rows of other documents drop out before the sum.
    """
    done = _batches(spark, store)
    if not done:
        return spark.createDataFrame([], SIGNED)
    signed = spark.read.schema(SIGNED).parquet(*[f"{store}/deltas/{b}" for b in done])
    if changes is not None:
        touched = changes.select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t"))
        signed = signed.join(touched, F.col("doc_id").eqNullSafe(F.col("_d"))
                             & (F.col("tokenizer") == F.col("_t")), "left_semi")
    return signed.groupBy("doc_id", *KEYS).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
        "n_docs <> 0 OR n_tokens <> 0")


def commit(store, batch_id, changes) -> bool:
    """Add one batch; False if it has been committed before.

    ``changes``: op (insert, delete, revise), seq, doc_id, source, lang, tokenizer, n_tokens.
    """
    spark = changes.sparkSession
    if batch_id in _batches(spark, store):
        return False
    last = F.max_by(F.struct("op", "source", "lang", "n_tokens"), F.struct(
        "seq", "op", "n_tokens")).alias("x")
    changes = changes.groupBy("doc_id", "tokenizer").agg(last).select(
        "doc_id", "tokenizer", "x.*")
    changes = cut_lineage(changes, "tokens-changes")
    # Every change takes back what its document counted so far, if anything.
    old = cut_lineage(current(spark, store, changes), "tokens-old")
    back = old.select(
        "doc_id", *KEYS, (-F.col("n_docs")).alias("n_docs"), (-F.col("n_tokens")).alias("n_tokens"))
    known = old.select(F.col("doc_id").alias("_d"), F.col("tokenizer").alias("_t")).distinct()
    there = changes.filter("op = 'insert'").unionByName(changes.filter("op = 'revise'").join(
        known, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("tokenizer") == F.col("_t")),
        "left_semi"))
    add = there.select("doc_id", *KEYS, F.lit(1).cast("long").alias("n_docs"),
                       F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"))
    add.unionByName(back).write.mode("overwrite").parquet(f"{store}/deltas/{batch_id}")
    spark.read.schema(SIGNED).parquet(f"{store}/deltas/{batch_id}").groupBy(*KEYS).agg(
        F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).write.mode(
        "overwrite").parquet(f"{store}/rollups/{batch_id}")
    return True


def totals(spark, store) -> DataFrame:
    """Documents and tokens by source, language and tokenizer over all committed batches."""
    done = _batches(spark, store)
    if not done:
        return spark.createDataFrame([], SIGNED).drop("doc_id")
    return spark.read.schema(SIGNED).parquet(*[f"{store}/rollups/{b}" for b in done]).groupBy(
        *KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")).filter(
        "n_docs <> 0")


def change(op, rows, seq=0) -> DataFrame:
    """Counted rows as changes of one kind."""
    return rows.select(F.lit(op).alias("op"), F.lit(seq).cast("long").alias("seq"), "doc_id",
                       *KEYS, "n_tokens")
