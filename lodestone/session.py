"""Session defaults, making this package importable in Python workers, and tables of a run in the folder that all share."""

from __future__ import annotations

import atexit
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from pathlib import Path
from threading import get_ident

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Rows of an Arrow batch of texts, wherever this package deals texts to Python; bytes of it, where its rows are long (one row at least).
BATCH_ROWS, BATCH_BYTES = 500, 8 << 20


def session(master: str = "local[*]", **conf: str) -> SparkSession:
    """A session with adaptive execution, Arrow and UTC; conf overrides any of it."""
    own = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS),
        "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(os.cpu_count() or 8),
        "spark.ui.enabled": "false",
    }
    return SparkSession.builder.master(master).config(map=own | conf).getOrCreate()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts: keep a worker's batch at a few MB, however many rows a task has and however long they are. One
    value for all operators, so that lazy plans agree."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package, wherever the driver was started from, and deal them small batches."""
    small_batches(spark)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    return spark


def spread(df: DataFrame) -> DataFrame:
    """A table read over all cores, before work on whole texts: what is smaller than a file split for each core would be read by few
    tasks, often by one. Larger tables stay as they are."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    small = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < cores * split
    return df.repartition(cores) if small else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only where all run in one process may it be
    unset; then a temporary folder of this machine serves."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", named)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


# Tables of a run ---------------------------------------------------------------------------------

#: Tables that are still there, of all runs of this process; what is left of them goes when the driver ends.
_TABLES: dict[str, tuple] = {}


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes with temporary(), or when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    _TABLES[path] = get_ident(), sc._jvm, sc._jsc.hadoopConfiguration()
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back; a lost executor costs no recomputation."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._table = path  # for temporary() and replaced()
    return out


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """new, where it no longer needs the table old was read from; that goes, if it is one of ours."""
    if getattr(old, "_table", None) in _TABLES:
        remove(old._table)
    return new


def remove(path: str) -> None:
    """Delete a table that is no longer read."""
    _, jvm, conf = _TABLES.pop(path)
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def release(spark: SparkSession) -> None:
    """Shuffle files go when their plans are collected as garbage: between large steps, don't leave that to chance.

    The scheduler holds its last job until the next one, so an empty one runs first.
    """
    gc.collect()
    spark.range(1).write.format("noop").mode("overwrite").save()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread writes inside go at the end, also after an error, but for those given to the function that this yields. What
    is returned must not read others."""
    before, kept = set(_TABLES), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._table)
        return df

    try:
        yield keep
    finally:
        for path in [p for p, (thread, *_) in list(_TABLES.items()) if thread == get_ident() and p not in before and p not in kept]:
            remove(path)
    release(spark)


@atexit.register
def _remove_all() -> None:
    for path in list(_TABLES):
        with suppress(Exception):  # the JVM may have gone first
            remove(path)
