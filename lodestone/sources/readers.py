"""Readers of landed records. Fetching from the network is not part of the library: pages, feeds and transcripts are read from
where they were landed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas


def read_records(spark: SparkSession, path: str, schema: str, glob: str = "*.json", lines: bool = False) -> DataFrame:
    """JSON files of one record, or an array of records, each; unreadable ones come with _corrupt_record.

    Such a file is read by one task, whole. lines: files of a record a line, of any size, which are split over tasks.
    """
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE").option("pathGlobFilter", glob).json(path)


def read_pages(spark: SparkSession, path: str, glob: str = "handbook_*.json") -> DataFrame:
    return read_records(spark, path, schemas.PAGE, glob)


def read_posts(spark: SparkSession, path: str, glob: str = "blog_*.json") -> DataFrame:
    return read_records(spark, path, schemas.POST, glob)


def read_cleaned(spark: SparkSession, path: str, glob: str = "cleaned_*.json") -> DataFrame:
    """Cleaned documents; records without content but with a full_text (transcripts) use that."""
    schema = f"{schemas.CLEANED}, full_text string, source string"
    return read_records(spark, path, schema, glob).withColumn("content", F.coalesce("content", "full_text"))


def read_transcripts(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    return read_records(spark, path, schemas.TRANSCRIPT, glob)


def read_chunks(spark: SparkSession, path: str, glob: str = "chunks_*.json") -> DataFrame:
    """Chunk files, arrays of chunks or single ones, with the file's name."""
    return read_records(spark, path, schemas.CHUNK, glob).withColumn("file", F.col("_metadata.file_name"))


def read_feed(spark: SparkSession, path: str, row: str = "entry") -> DataFrame:
    """Entries of landed feeds (XML), those without fields included."""
    return spark.read.format("xml").option("rowTag", row).schema(schemas.FEED_ENTRY).load(path)


def transcript_header(text: Column) -> tuple[Column, Column, Column, Column]:
    """title, video_id, url and body of a transcript file's text."""
    of = lambda name: F.regexp_extract(text, rf"(?m)^{name}: ([^\r\n]*)", 1)
    return of("Video"), of("Video ID"), of("URL"), F.regexp_extract(text, r"(?s)\n={80}\r?\n\r?\n?(.*)$", 1)


def read_transcript_texts(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt")
    names = ("title", "video_id", "url", "transcript")
    return rows.select(*[c.alias(n) for n, c in zip(names, transcript_header(F.col("value")), strict=True)])
