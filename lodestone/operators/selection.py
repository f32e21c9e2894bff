"""Selecting posts and videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import word_count

#: Keywords that mark a post as relevant, wherever they occur in its title, summary or tags.
KEYWORDS = (
    "onboarding", "culture", "remote", "handbook", "values",
    "team", "workflow", "process", "engineering", "devops",
    "collaboration", "communication", "transparency", "iteration",
    "efficiency", "results", "diversity", "inclusion", "belong",
    "career", "growth", "learning", "development", "hiring",
)


def is_relevant(title: Column, summary: Column, tags: Column | None = None, keywords: tuple[str, ...] = KEYWORDS) -> Column:
    """Any keyword as a substring of the lower-cased title, summary or a tag (array of strings)."""
    any_of = "|".join(f"\\Q{k}\\E" for k in keywords)
    hit = lambda c: F.coalesce(F.lower(c).rlike(any_of), F.lit(False))
    out = hit(title) | hit(summary)
    return out if tags is None else out | F.coalesce(F.exists(tags, hit), F.lit(False))


def select_posts(feed: DataFrame, most: int, position: str, relevant: str) -> DataFrame:
    """The whole feed if it is small enough, else relevant posts in feed order, topped up with others."""
    return feed.orderBy(F.col(relevant).desc(), position).limit(most)


def posts(entries: DataFrame, contents: DataFrame, source: str = "blog") -> DataFrame:
    """Post records of feed entries with a link whose fetched content (link, content) has 100 characters or more."""
    rows = entries.where("link is not null and link != ''").join(contents, "link").where("length(content) >= 100")
    text = lambda c: F.coalesce(c, F.lit(""))
    tags = F.transform("tags", lambda t: text(t["term"]))
    return rows.select(
        "content",
        F.struct(
            F.coalesce("title", F.lit("Untitled")).alias("title"), F.col("link").alias("url"), text("published").alias("published"), text("updated").alias("updated"),
            text("author").alias("author"), F.coalesce(tags, F.array().cast("array<string>")).alias("categories"),
            F.substring(text("summary"), 1, 500).alias("summary"), F.lit(source).alias("source"),
        ).alias("metadata"),
        F.struct(F.length("content").cast("long").alias("content_length"), word_count(F.col("content")).cast("long").alias("word_count"), is_relevant(F.col("title"), F.col("summary"), tags).alias("is_relevant")).alias("processing"),
    )


def pending_videos(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Videos to transcribe: not private, id given, not in done; a missing title becomes `Unknown Title`."""
    rows = listing.where("video_id is not null").withColumn("title", F.coalesce("title", F.lit("Unknown Title")))
    return rows.where("title != '[Private video]'").join(done.select("video_id"), "video_id", "left_anti")


def video_status(listing: DataFrame, done: DataFrame, failed: DataFrame) -> DataFrame:
    """status (skipped, successful, failed, pending) and n over a listing; what is done counts as successful."""
    rows = listing.withColumn("title", F.coalesce("title", F.lit("Unknown Title")))
    rows = rows.join(done.select("video_id", F.lit(True).alias("_done")), "video_id", "left").join(failed.select("video_id", F.lit(True).alias("_bad")), "video_id", "left")
    status = F.when(F.col("video_id").isNull() | (F.col("title") == "[Private video]"), "skipped").when(F.col("_done"), "successful").when(F.col("_bad"), "failed").otherwise("pending")
    return rows.groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))
