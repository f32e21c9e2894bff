"""Writers: record tables, histories, transcript files."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import files


def write_records(df: DataFrame, path: str, fmt: str = "json", partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*partition_by) if partition_by else w).format(fmt).save(path)


def write_history(df: DataFrame, path: str, run: str) -> None:
    """Statistics or alerts of a run beside those of other runs, in place of what an earlier attempt of the same run wrote.

    The rows are written to a hidden folder first, which then takes the place of the run's folder: a failure before that leaves
    the earlier attempt's rows, and a retry after it leaves one row a figure.
    """
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    staged = f"{path}/_staged-{uuid4().hex}"
    df.drop("run").write.json(staged)
    name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(run)
    source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in (staged, f"{path}/run={name}"))
    fs = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(target, True)
    if not fs.rename(source, target):
        raise OSError(f"{staged} could not be moved to {target}")


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All runs of a history, with `run` as the text that it was written under."""
    found = spark.read.json(path).schema
    fields = [T.StructField("run", T.StringType()) if f.name == "run" else f for f in found.fields]
    return spark.read.schema(T.StructType(fields)).json(path)


def snapshot(df: DataFrame, path: str, run: str) -> None:
    """A version of a table in a folder of its own."""
    df.write.mode("overwrite").parquet(f"{path}/run_id={run}")


def transcript_text() -> Column:
    """A transcript file's text, of a record (title, video_id, url, transcript)."""
    rule = "=" * 80
    return F.concat(F.lit("Video: "), "title", F.lit("\nVideo ID: "), "video_id", F.lit("\nURL: "), "url", F.lit(f"\n{rule}\n\n"), "transcript")


def write_transcripts(df: DataFrame, path: str, name: Column) -> None:
    """A text file for each record in one flat folder."""
    files.write_files(df.select(name.alias("name"), transcript_text().alias("value")), path)
