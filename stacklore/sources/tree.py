"""One code file and one metadata file per asset, written by all tasks at once.

Files are written in two steps, so that a task that fails or runs twice leaves no half asset:

1. Every task attempt writes its files into a folder of its own below ``{path}/staging/{job}``
   with a list of what they are for. When all tasks are done, a marker that names the attempts
   that count is written: from here on the job is decided.
2. A second Spark job moves the files to their places, the code of an asset before its
   metadata. A move that was done before is passed over, so lost executors only repeat work,
   and ``finish`` ends what an interrupted driver left. What has no marker is never moved.

Folders are listed and files are read by tasks as well; the driver holds no list of files.

Tasks open files through pyarrow, so the path must be one that it knows (a folder that all
executors mount, hdfs, s3, gs). One writer at a time may work on a tree.
"""

import json
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from stacklore.session import cut_lineage, spread

MOVES = "code_file string, code_target string, meta_file string, meta_target string"
MARKER = "committed.json"
NAME_BYTES = 200
LISTED_ROWS = 10_000
READ_FILES, READ_BYTES = 2_000, 4 << 20


def file_name(name):
    """Column: the file name of an asset or project, without extension.

    Names stay as they are, apart from what a file system or a reader of folders would take
    otherwise: slashes and zero bytes, ``_`` or ``.`` in front (readers pass such files over),
    the empty name, and ``%`` before two hexadecimal digits. These are escaped with ``%``.
    Names over 200 bytes keep 40 characters and get their hash.
    """
    name = F.col(name) if isinstance(name, str) else name
    safe = F.regexp_replace(name, "%(?=[0-9A-Fa-f]{2})", "%25")
    for sign, code in (("/", "%2F"), ("\\", "%5C"), (":", "%3A"), ("\0", "%00")):
        safe = F.replace(safe, F.lit(sign), F.lit(code))
    safe = F.when(safe.startswith("_"), F.concat(F.lit("%5F"), F.substring(safe, 2, 2**31 - 1))) \
        .when(safe.startswith("."), F.concat(F.lit("%2E"), F.substring(safe, 2, 2**31 - 1))) \
        .when(safe == "", F.lit("%FF")).otherwise(safe)
    return F.when(F.octet_length(safe) > NAME_BYTES, F.concat(
        F.left(safe, F.lit(40)), F.lit("~"), F.sha2(name, 256))).otherwise(safe)


def write_pairs(rows: DataFrame, path):
    """Write pairs of files below ``path``.

    ``rows``: code_target and meta_target (paths below ``path``), code and meta (texts).
    A null code writes no code file. Targets must be unique.
    """
    spark = rows.sparkSession
    finish(spark, path)
    spark.dataSource.register(PairFiles)
    rows.select("code_target", "code", "meta_target", "meta").write.format("pair_files") \
        .option("staging", f"{_qualified(spark, path)}/staging/{uuid.uuid4().hex}") \
        .mode("append").save()
    finish(spark, path)


def finish(spark, path):
    """Move the files of every decided job to their places."""
    base = _qualified(spark, path)
    hadoop, there = _hadoop(spark, f"{base}/staging")
    if not hadoop.exists(there):
        return
    jobs = [s.getPath().toString() for s in hadoop.listStatus(there)]
    for job in jobs:
        if not hadoop.exists(_hadoop(spark, f"{job}/{MARKER}")[1]):
            continue
        system, inner = file_system(job)
        with system.open_input_stream(f"{inner}/{MARKER}") as marker:
            attempts = json.loads(marker.readall())
        if attempts:
            lists = spark.read.schema(MOVES).json([f"{job}/{a}/moves.json" for a in attempts])
            lists.repartition(max(len(attempts), spark.sparkContext.defaultParallelism)) \
                .mapInArrow(_mover(base), "moved long").agg(F.sum("moved")).collect()
        hadoop.delete(_hadoop(spark, job)[1], True)


def listed(spark, path) -> DataFrame:
    """``place``, the path below ``path``, of every metadata and code file of the tree.

    The list is written out once. As in any folder Spark reads, files whose names start with
    ``_`` or ``.`` are passed over.
    """
    base = _qualified(spark, path)
    hadoop, there = _hadoop(spark, f"{base}/projects")
    if not hadoop.exists(there):
        raise FileNotFoundError(f"no projects below {path}")

    def inside(folders):
        """What lies in the folders, each listed by a task of its own."""
        return spread(folders.select("place"), 1).mapInArrow(
            _lister(base), "place string, is_file boolean")

    projects = inside(spark.createDataFrame([("projects",)], "place string")).where("not is_file")
    parts = cut_lineage(inside(cut_lineage(projects, "projects")).where("not is_file"), "parts")
    kinds = inside(parts.where(F.col("place").endswith("/functions"))).where("not is_file")
    folders = cut_lineage(parts.where(F.col("place").endswith("/metadata")).unionByName(kinds), "folders")
    name = F.substring_index("place", "/", -1)
    hidden = r"^(?!_metadata|_common_metadata)(_[^=]*\z|\.)|\._COPYING_\z"
    return cut_lineage(inside(folders).where("is_file").where(~name.rlike(hidden)).select("place"), "files")


def contents(spark, places: DataFrame, path) -> DataFrame:
    """``place`` and ``content``, the bytes of the file there."""
    return spread(places.select("place"), READ_FILES).mapInArrow(
        _reader(_qualified(spark, path)), "place string, content binary")


def _lister(base):
    def entries(batches):
        system, inner = file_system(base)
        for batch in batches:
            for place in batch.column("place").to_pylist():
                found = system.get_file_info(files.FileSelector(f"{inner}/{place}"))
                for at in range(0, len(found), LISTED_ROWS):
                    part = found[at:at + LISTED_ROWS]
                    yield pa.record_batch({
                        "place": pa.array([f"{place}/{f.base_name}" for f in part], pa.string()),
                        "is_file": pa.array([f.type == files.FileType.File for f in part])})

    return entries


def _reader(base):
    def read(batches):
        system, inner = file_system(base)
        for batch in batches:
            place, held, size = [], [], 0
            for one in batch.column("place").to_pylist():
                with system.open_input_stream(f"{inner}/{one}", compression=None) as file:
                    held.append(file.readall())
                place.append(one)
                size += len(held[-1])
                if size >= READ_BYTES:
                    yield _texts(place, held)
                    place, held, size = [], [], 0
            if place:
                yield _texts(place, held)

    return read


def _texts(place, held):
    return pa.record_batch({"place": pa.array(place, pa.string()), "content": pa.array(held, pa.binary())})


def _hadoop(spark, path):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def _qualified(spark, path):
    hadoop, there = _hadoop(spark, path)
    return hadoop.makeQualified(there).toString().rstrip("/")


def file_system(uri):
    """(file system, path in it) of a qualified path."""
    if uri.startswith("file:"):
        return files.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return files.FileSystem.from_uri(uri)


def _mover(base):
    def move(batches):
        system, inner = file_system(base)
        made = set()
        for batch in batches:
            moved = 0
            for row in batch.to_pylist():
                for kind in ("code", "meta"):
                    if row[f"{kind}_file"] is not None:
                        moved += _move(system, f"{inner}/{row[f'{kind}_file']}",
                                       f"{inner}/{row[f'{kind}_target']}", made)
            yield pa.record_batch({"moved": pa.array([moved], pa.int64())})

    return move


def _move(system, staged, target, made):
    """1 if the file was moved now, 0 if an earlier attempt had done it."""
    folder = target.rsplit("/", 1)[0]
    if folder not in made:
        system.create_dir(folder, recursive=True)
        made.add(folder)
    try:
        system.move(staged, target)
        return 1
    except FileNotFoundError:
        if system.get_file_info(target).type == files.FileType.File:
            return 0
        raise


@dataclass
class Staged(WriterCommitMessage):
    attempt: str


class PairFiles(DataSource):
    """The first step: files in folders of their task attempts."""

    @classmethod
    def name(cls):
        return "pair_files"

    def schema(self):
        return "code_target string, code string, meta_target string, meta string"

    def writer(self, schema, overwrite):
        return PairWriter(self.options["staging"])


def _rows(batch, most=64):
    """The rows of a batch as Python values, few at a time."""
    for at in range(0, batch.num_rows, most):
        yield from batch.slice(at, most).to_pylist()


class PairWriter(DataSourceArrowWriter):
    def __init__(self, staging):
        self.staging = staging

    def write(self, iterator):
        attempt = uuid.uuid4().hex
        system, inner = file_system(self.staging)
        folder = f"{inner}/{attempt}"
        system.create_dir(folder, recursive=True)
        below = "/".join(self.staging.rsplit("/", 2)[1:])
        count = 0
        with system.open_output_stream(f"{folder}/moves.json") as moves:
            for batch in iterator:
                for row in _rows(batch):
                    line = {"code_target": row["code_target"], "meta_target": row["meta_target"]}
                    for kind in ("code", "meta"):
                        if row[kind] is not None:
                            staged = f"{count}.{kind}"
                            with system.open_output_stream(f"{folder}/{staged}") as out:
                                out.write(row[kind].encode("utf-8", "replace"))
                            line[f"{kind}_file"] = f"{below}/{attempt}/{staged}"
                    moves.write((json.dumps(line) + "\n").encode())
                    count += 1
        return Staged(attempt)

    def commit(self, messages):
        system, inner = file_system(self.staging)
        system.create_dir(inner, recursive=True)
        with system.open_output_stream(f"{inner}/{MARKER}.part") as out:
            out.write(json.dumps([m.attempt for m in messages if m is not None]).encode())
        system.move(f"{inner}/{MARKER}.part", f"{inner}/{MARKER}")

    def abort(self, messages):
        system, inner = file_system(self.staging)
        if system.get_file_info(inner).type == files.FileType.Directory:
            system.delete_dir(inner)
