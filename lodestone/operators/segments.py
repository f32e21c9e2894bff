"""Timed segments: cleaning, merging in time, transcript totals. Rows are (video_id, id, start, end, text, speaker)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def clean_segments(segments: DataFrame, meeting: bool = False) -> DataFrame:
    return segments.withColumn("text", (T.clean_meeting_text if meeting else T.clean_transcript_text)(F.col("text")))


def _merged(segments: DataFrame, key: str, order: str, apart: Column) -> DataFrame:
    """Runs of rows that `apart` (over _end, the end of the row before) does not cut: first fields, last end, texts joined."""
    w = Window.partitionBy(key).orderBy(order)
    rows = segments.withColumn("_end", F.lag("end").over(w))
    rows = rows.withColumn("_run", F.sum(F.when(F.col("_end").isNull() | apart, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in segments.columns if c not in (key, order, "end", "text")]
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")
    out = rows.groupBy(key, "_run").agg(
        F.min(order).alias(order), *[F.min_by(c, order).alias(c) for c in others], F.max_by("end", order).alias("end"), texts.alias("text")
    )
    return out.select(*segments.columns)


def merge_contiguous(segments: DataFrame, key: str = "video_id", order: str = "id") -> DataFrame:
    """Merge while a segment starts exactly where the one before ends."""
    return _merged(segments, key, order, F.col("start") != F.col("_end"))


def merge_near(segments: DataFrame, max_gap: float = 2.0, key: str = "video_id", order: str = "id") -> DataFrame:
    """Merge while the gap to the one before is at most max_gap seconds (overlaps merge too, speakers are not compared)."""
    return _merged(segments, key, order, F.col("start") - F.col("_end") > max_gap)


def segment_statistics(segments: DataFrame, key: str = "video_id") -> DataFrame:
    """total_segments, total_words, avg_segment_duration, missing_values of each transcript."""
    return segments.groupBy(key).agg(
        F.count(F.lit(1)).alias("total_segments"),
        F.sum(T.word_count(F.col("text"))).alias("total_words"),
        F.coalesce(F.avg(F.col("end") - F.col("start")), F.lit(0.0)).alias("avg_segment_duration"),
        F.count_if(T.strip(F.coalesce("text", F.lit(""))) == "").alias("missing_values"),
    )


def _joined(order: str) -> Column:
    return F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), " ")


def transcript_totals(segments: DataFrame, key: str = "video_id", order: str = "id") -> DataFrame:
    """Cleaned and contiguously merged transcripts: segment_count, word_count (of the segments), full_text (cleaned once more)."""
    rows = merge_contiguous(clean_segments(segments), key, order)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("segment_count"), F.sum(T.word_count(F.col("text"))).alias("word_count"), _joined(order).alias("full_text"))
    return out.withColumn("full_text", T.clean_transcript_text(F.col("full_text")))


def meeting_totals(segments: DataFrame, max_gap: float = 2.0, key: str = "video_id", order: str = "id") -> DataFrame:
    """Cleaned and nearly merged meetings: segment_count, full_text and its word_count."""
    rows = merge_near(clean_segments(segments, meeting=True), max_gap, key, order)
    out = rows.groupBy(key).agg(F.count(F.lit(1)).alias("segment_count"), _joined(order).alias("full_text"))
    return out.withColumn("word_count", T.word_count(F.col("full_text")))


def process_transcripts(transcripts: DataFrame) -> DataFrame:
    """transcript_totals for records with a `segments` array; an empty array has zero counts, a null one null counts and text: such a record is
    told apart and stops no other."""
    rows = transcripts.select("video_id", F.posexplode("segments").alias("id", "s"))
    rows = rows.where("s is not null").select("video_id", "id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.text").alias("text"))
    out = transcripts.select("video_id", F.col("segments").isNotNull().alias("_has")).join(transcript_totals(rows), "video_id", "left")
    filled = lambda c, nothing: F.when(F.col("_has"), F.coalesce(c, F.lit(nothing))).alias(c)
    return out.select("video_id", filled("segment_count", 0), filled("word_count", 0), filled("full_text", ""))
