"""Keyed tables that micro-batches merge into, as files in buckets of their keys.

A commit appends the new rows of the keys that it changes to the buckets of those keys;
of several rows of a key the one of the latest commit counts. A reader takes the files of
the buckets it asks for and no others. A bucket with ``compact_after`` pieces is rewritten
as one, so a read meets few pieces however many batches came before.

Every commit adds one small file that lists all live pieces and the last batch of every
writer. It is written aside and renamed, so a commit is there as a whole or not at all:
pieces of a failed batch are in no list and never read, a batch that a writer sends again
is known, and of two writers that commit the same version at once the second one fails and
its stream starts the batch anew. The file system must refuse to rename onto an existing
file, as HDFS and local ones do.
"""

import json
import uuid

from pyspark.sql import DataFrame, functions as F, types as T

BUCKETS, COMPACT_AFTER = 64, 8
VERSION, BUCKET = "_version", "_bucket"


class KeyedLog:
    """``tables`` maps the name of each table to its key columns, which are never null."""

    def __init__(self, spark, path, tables, buckets=BUCKETS, compact_after=COMPACT_AFTER):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), tables
        self.buckets, self.compact_after = buckets, compact_after

    # ---- commits ----

    def _at(self, path):
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def _names(self, path):
        fs, there = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []

    def head(self):
        """The latest commit: its version, the writers' last batches, schemas and pieces."""
        versions = [n for n in self._names(f"{self.path}/commits") if n.endswith(".json")]
        if not versions:
            return {"version": 0, "writers": {}, "schemas": {}, "pieces": {}}
        fs, there = self._at(f"{self.path}/commits/{max(versions)}")
        stream = fs.open(there)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, head):
        # Zeros in front keep names in the order of versions.
        name = f"{self.path}/commits/{head['version']:020d}.json"
        fs, aside = self._at(f"{self.path}/aside/{uuid.uuid4().hex}")
        stream = fs.create(aside)
        stream.write(bytearray(json.dumps(head).encode()))
        stream.close()
        _, there = self._at(name)
        fs.mkdirs(there.getParent())
        if fs.exists(there) or not fs.rename(aside, there):
            raise RuntimeError(f"another writer has committed version {head['version']}")

    def done(self, writer, batch_id):
        """Whether this batch of the writer, or a later one, is committed."""
        return self.head()["writers"].get(writer, -1) >= batch_id

    def commit(self, writer, batch_id, changes):
        """Append ``changes``, new rows by table with one row per key, as one commit."""
        head = self.head()
        if head["writers"].get(writer, -1) >= batch_id:
            return
        head["version"] += 1
        for table, rows in changes.items():
            self._write(head, table, rows, replace=False)
        head["writers"][writer] = batch_id
        self._publish(head)
        self.compact()

    def compact(self):
        """Rewrite the buckets of too many pieces, as a commit of its own."""
        head = self.head()
        full = {table: [int(b) for b, p in pieces.items() if len(p) >= self.compact_after]
                for table, pieces in head["pieces"].items()}
        if not any(full.values()):
            return
        head["version"] += 1
        for table, buckets in full.items():
            if buckets:
                self._write(head, table, self._latest(head, table, buckets), replace=True)
        self._publish(head)

    def _write(self, head, table, rows, replace):
        stored = rows if replace else rows.withColumn(VERSION, F.lit(head["version"]).cast("long"))
        schema = json.loads(stored.schema.json())
        known = head["schemas"].setdefault(table, schema)
        if [(f["name"], f["type"]) for f in known["fields"]] != [
                (f["name"], f["type"]) for f in schema["fields"]]:
            raise ValueError(f"the columns of {table} are not those of its first commit")
        folder = f"{self.path}/pieces/{head['version']}-{uuid.uuid4().hex}/{table}"
        # Buckets that outgrow a task are split, small ones share one.
        stored.withColumn(BUCKET, self._bucket(table)).hint("rebalance", BUCKET).write.partitionBy(
            BUCKET).parquet(folder)
        pieces = head["pieces"].setdefault(table, {})
        for name in self._names(folder):
            if name.startswith(f"{BUCKET}="):
                number = name.split("=")[1]
                pieces[number] = ([] if replace else pieces.get(number, [])) + [
                    f"{folder.removeprefix(self.path)}/{name}"]

    # ---- reads ----

    def _bucket(self, table):
        return F.pmod(F.xxhash64(*self.tables[table]), F.lit(self.buckets)).cast("int")

    def buckets_of(self, table, rows):
        """The buckets that hold the keys of ``rows``; at most as many numbers as buckets."""
        return [r[0] for r in rows.select(self._bucket(table)).distinct().collect()]

    def read(self, table, buckets=None) -> DataFrame:
        """The current rows of these buckets, or None as long as the table has no commit."""
        head = self.head()
        return self._latest(head, table, buckets).drop(VERSION) if table in head["schemas"] else None

    def _latest(self, head, table, buckets) -> DataFrame:
        wanted = head["pieces"].get(table, {})
        wanted = [wanted[b] for b in (wanted if buckets is None else map(str, buckets)) if b in wanted]
        schema = T.StructType.fromJson(head["schemas"][table])
        paths = [self.path + p for pieces in wanted for p in pieces]
        if not paths:
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(*paths)
        if all(len(pieces) == 1 for pieces in wanted):
            return rows
        keys = self.tables[table]
        last = rows.groupBy(*keys).agg(F.max(VERSION).alias(VERSION))
        return rows.join(last, [*keys, VERSION], "left_semi").select(*schema.names)
