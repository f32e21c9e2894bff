"""Files as records: a writer of one file a record, manifests of folders with an order-free digest, and copies made on the executors."""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched
from stat import S_ISDIR, S_ISREG

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import BinaryType, StructType

from ..session import temporary, written

#: Bytes moved at a time; hex digits of a leaf's bucket in a folder's digest, taken off two at a time on the way to the root.
CHUNK, DIGITS = 1 << 20, 8
#: Bytes that a task of a copy is dealt, about; files of a folder that are told of at a time.
TASK_BYTES, LISTED = 1 << 28, 2000


def file_system(path: str):
    """The file system of a path or uri, and the path in it."""
    from pyarrow import fs

    if "://" not in path:
        return fs.LocalFileSystem(), path.removeprefix("file:")
    return fs.FileSystem.from_uri(path)


def _moved(fs, source: str, target: str) -> None:
    """Move a whole file into place; one that is there is replaced."""
    if fs.type_name == "local":
        os.replace(source, target)
    else:
        fs.move(source, target)


# One file a record -------------------------------------------------------------------------------


@dataclass
class Done(WriterCommitMessage):
    files: int


class RecordFiles(DataSource):
    """Format `record_files`: rows (name string, value string or binary) as files in one flat folder, a file a row.

    A task writes its files to a hidden folder and moves each into place when it has written all: no half-written file is ever
    seen, and a task that runs again, after a failure or twice at a time, puts the same files in the same places. Rows that
    share a name replace each other. Rows with a null name are an error; a null value is an empty file.
    """

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name string, value binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordFilesWriter(self.options["path"], overwrite)


class RecordFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.job = path, uuid.uuid4().hex
        fs, root = file_system(path)
        if overwrite and fs.get_file_info(root).type.name == "Directory":
            fs.delete_dir_contents(root)

    def write(self, rows: Iterator[Row]) -> Done:
        fs, root = file_system(self.path)
        staged = f"{root}/_staged-{self.job}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}"
        fs.create_dir(staged, recursive=True)
        names: list[str] = []
        for row in rows:
            if row["name"] is None or os.path.basename(row["name"]) != row["name"] or row["name"] in ("", ".", ".."):
                raise ValueError(f"not the name of a file: {row['name']!r}")
            value = row["value"] or b""
            with fs.open_output_stream(f"{staged}/{len(names)}") as out:
                out.write(value.encode() if isinstance(value, str) else bytes(value))
            names.append(row["name"])
        for i, name in enumerate(names):
            _moved(fs, f"{staged}/{i}", f"{root}/{name}")
        return Done(len(names))

    def _clear(self) -> None:
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        if fs.get_file_info(f"{root}/_staged-{self.job}").type.name != "NotFound":
            fs.delete_dir(f"{root}/_staged-{self.job}")

    def commit(self, messages: list[Done | None]) -> None:
        self._clear()
        fs, root = file_system(self.path)
        with fs.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(sum(m.files for m in messages if m)).encode())

    def abort(self, messages: list[Done | None]) -> None:
        self._clear()


def write_files(df: DataFrame, path: str, mode: str = "append") -> None:
    """df (name, value) as one flat folder of files; see RecordFiles."""
    df.sparkSession.dataSource.register(RecordFiles)
    df.select("name", F.col("value").cast(BinaryType())).write.format("record_files").mode(mode).save(path)


# Manifests ---------------------------------------------------------------------------------------


def entries(path: str) -> Iterator[tuple[str, int, bool]]:
    """Name, length and whether it is a folder, of what lies in a folder, hidden or not, in any order. Local folders are read entry by entry;
    other file systems give a folder's list at once."""
    fs, root = file_system(path)
    if fs.type_name != "local":
        from pyarrow.fs import FileSelector

        yield from ((f.base_name, f.size or 0, not f.is_file) for f in fs.get_file_info(FileSelector(root, allow_not_found=True)))
    elif os.path.isdir(root):
        with os.scandir(root) as found:
            for f in found:
                try:
                    s = f.stat()
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
                if S_ISREG(s.st_mode) or S_ISDIR(s.st_mode):
                    yield f.name, s.st_size if S_ISREG(s.st_mode) else 0, S_ISDIR(s.st_mode)


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path, file (the path below the folder), length of all files below a folder but hidden ones (names that begin with _ or .), empty files
    included. Folders are listed on the executors, level by level; a folder that is not there has no files. A task holds LISTED files of a
    local folder, however many that has."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, file in zip(part["path"], part["file"], strict=True):
                shown = ((f"{path}/{name}", f"{file}{name}", length, folder) for name, length, folder in entries(path) if name[0] not in "._")
                for rows in batched(shown, LISTED):
                    yield pd.DataFrame(rows, columns=["path", "file", "length", "folder"]).astype({"length": "int64", "folder": bool})

    level = spark.createDataFrame([(folder.rstrip("/"), "")], "path string, file string")
    with temporary(spark) as keep:
        found = spark.createDataFrame([], "path string, file string, length long")
        while True:
            many = max(1, min(spark.sparkContext.defaultParallelism, level.count()))
            held = keep(written(level.repartition(many).mapInPandas(run, "path string, file string, length long, folder boolean"), "listed"))
            found = found.unionByName(held.where("not folder").drop("folder"))
            level = held.where("folder").select("path", F.concat("file", F.lit("/")).alias("file"))
            if level.isEmpty():
                return found


def _opened(path: str):
    fs, at = file_system(path)
    return fs.open_input_stream(at)


def file_digest(path: str) -> str:
    """Hexadecimal SHA-256 of a file, read in pieces."""
    digest = hashlib.sha256()
    with _opened(path) as f:
        while part := f.read(CHUNK):
            digest.update(part)
    return digest.hexdigest()


def _dealt(files: DataFrame) -> DataFrame:
    """Files over tasks of about TASK_BYTES each, whatever their sizes."""
    many = files.agg(F.ceil(F.coalesce(F.sum("length"), F.lit(0)) / F.lit(TASK_BYTES)).alias("n")).first()["n"]
    return files.repartition(max(files.sparkSession.sparkContext.defaultParallelism, int(many)), F.xxhash64("path"))


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """file (path below the folder), size, digest (SHA-256) of every file; files of any size are read in pieces, on the executors."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part[["file", "size"]].assign(digest=[file_digest(p) for p in part["path"]])

    files = listed(spark, folder).withColumn("size", F.col("length"))
    return _dealt(files).mapInPandas(run, "file string, size long, digest string")


def folder_pointer(files: DataFrame) -> DataFrame:
    """One row for a manifest: digest, size and files of the whole folder.

    The digest is the root of a tree that does not depend on the order of files: leaves are hashes of `file:digest`, each level
    hashes the sorted hashes that share all but the last two of its digits, so no group has more than 256 members but the lowest
    (a share of 16^-8 of all files). An empty folder has the hash of nothing.
    """
    level = files.select(F.sha2(F.concat("file", F.lit(":"), "digest"), 256).alias("h"), F.col("size").alias("s"), F.lit(1).cast("long").alias("n"))
    level = level.withColumn("k", F.substring("h", 1, DIGITS))
    for digits in range(DIGITS, 0, -2):
        level = level.groupBy("k").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256).alias("h"), F.sum("s").alias("s"), F.sum("n").alias("n"))
        level = level.withColumn("k", F.substring("k", 1, digits - 2))
    root = F.sha2(F.array_join(F.sort_array(F.collect_list("h")), ""), 256)
    return level.agg(root.alias("digest"), F.coalesce(F.sum("s"), F.lit(0)).alias("size"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def manifest_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """file, change (added, removed, changed), old_digest, new_digest of what differs between two manifests."""
    side = lambda m, n: m.select("file", F.col("digest").alias(f"{n}_digest"))
    both = side(old, "old").join(side(new, "new"), "file", "full").where(~F.col("old_digest").eqNullSafe(F.col("new_digest")))
    change = F.when(F.col("old_digest").isNull(), "added").when(F.col("new_digest").isNull(), "removed").otherwise("changed")
    return both.select("file", change.alias("change"), "old_digest", "new_digest")


# Copies ------------------------------------------------------------------------------------------


def copy_file(source: str, target: str) -> tuple[str, bool]:
    """(digest, whether it was copied): a file that is there with the same content stays; else it is written beside and moved into place."""
    digest = file_digest(source)
    fs, at = file_system(target)
    info = fs.get_file_info(at)
    if info.is_file and file_digest(target) == digest:
        return digest, False
    beside = f"{os.path.dirname(at)}/_copy-{uuid.uuid4().hex}"
    fs.create_dir(os.path.dirname(at), recursive=True)
    with _opened(source) as f, fs.open_output_stream(beside) as out:
        while part := f.read(CHUNK):
            out.write(part)
    _moved(fs, beside, at)
    return digest, True


def copy_folder(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Copy all files below a folder on the executors; file, size, digest, copied, verified of each.

    An interrupted copy goes on where it stopped: what is there with the same digest stays. Every file is read back and compared.
    The rows are computed when they are read; reading them again copies nothing again. Hidden files are left out.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, file, size in zip(part["path"], part["file"], part["length"], strict=True):
                digest, copied = copy_file(path, f"{target}/{file}")
                yield pd.DataFrame({"file": [file], "size": [size], "digest": [digest], "copied": [copied], "verified": [file_digest(f"{target}/{file}") == digest]})

    return _dealt(listed(spark, source)).mapInPandas(run, "file string, size long, digest string, copied boolean, verified boolean")
