"""Batch drivers: from landed records to tables, with summaries; environment checks and delivery of alerts."""

from __future__ import annotations

import logging
from collections.abc import Callable
from urllib.parse import urljoin

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import urls
from ..operators import chunking, crawl, html, reports, segments, selection, validation
from ..session import temporary, written
from ..sources import fetching, files, readers, writers

log = logging.getLogger("lodestone")


def observed(df: DataFrame, step: str) -> tuple[DataFrame, Observation]:
    """df that counts its rows on the way: the count is there once an action has run, without another pass."""
    seen = Observation(step)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def log_step(step: str, status: str, **figures: object) -> None:
    log.info("%s: %s %s", step, status, " ".join(f"{k}={v}" for k, v in figures.items()))


def clean_pages(spark: SparkSession, source: str, target: str, glob: str = "handbook_*.json") -> dict:
    """Landed pages, cleaned; valid ones are written to target. Returns the summary."""
    pages = readers.read_pages(spark, source, glob).select(F.col("metadata.url").alias("url"), "metadata", "content")
    with temporary(spark) as keep:
        cleaned, seen = observed(reports.cleaned_documents(pages, "url", "content", ("metadata",)), "clean")
        cleaned = written(cleaned, "cleaned")  # cleaned once, read by the records, the summary and the list of failures
        record = cleaned.where("is_valid").select(
            "content", "metadata",
            F.struct("original_length", "cleaned_length", F.lit("lodestone").alias("processor"), "word_count").alias("processing"),
        )
        writers.write_records(record, target, "parquet")
        failed = keep(written(reports.failed_documents(cleaned, "url"), "failed"))
        out = reports.cleaning_summary(cleaned).first().asDict() | {"failed_urls": failed}
    log_step("clean", "done", rows=seen.get["rows"])
    return out


def chunk_pages(spark: SparkSession, source: str, target: str, settings: Settings | None = None) -> dict:
    """Cleaned documents, cut to overlapping chunks that are written to target. Returns the summary."""
    s = settings or Settings()
    docs = spark.read.parquet(source).select(F.col("metadata.url").alias("url"), "content")
    chunks = chunking.chunk_records(docs, "url", "content", "url", "recursive", s.chunk_tokens, s.chunk_overlap, s.min_chunk_tokens)
    writers.write_records(chunks, target, "parquet")
    stats = chunking.chunk_statistics(docs, spark.read.parquet(target), "url")
    return reports.chunk_summary(stats).first().asDict()


def check_environment(spark: SparkSession, folders: list[str]) -> dict[str, bool]:
    """Whether each folder was there; missing ones are made, on whatever file system they name."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = {}
    for f in folders:
        path = jvm.org.apache.hadoop.fs.Path(f)
        fs = path.getFileSystem(conf)
        out[f] = bool(fs.exists(path))
        if not out[f]:
            fs.mkdirs(path)
    return out


def publish(spark: SparkSession, source: str, target: str) -> dict:
    """Copy a folder between file systems on the executors. Returns files, copied (not there before), failed (differ when read back), and
    the pointer of the copy: digest and size."""
    with temporary(spark):
        told = written(files.copy_folder(spark, source, target), "copied")
        out = told.agg(F.count(F.lit(1)).alias("files"), F.count_if("copied").alias("copied"), F.count_if(~F.col("verified")).alias("failed")).first().asDict()
        pointer = files.folder_pointer(told).first()
    log_step("publish", "done", **out)
    return out | {"digest": pointer["digest"], "size": pointer["size"]}


# Ingestion ---------------------------------------------------------------------------------------


def fetch_posts(spark: SparkSession, feed: str, target: str, opener: fetching.Opener = fetching.open_url, most: int | None = 20, rate: float = 2.0) -> dict:
    """A landed feed's posts, at most `most` of them (None: all), fetched and written to target. Returns total, successful, failed, relevant, and
    the failed posts (title, url)."""
    entries = readers.read_feed(spark, feed).withColumn("position", F.monotonically_increasing_id())
    with temporary(spark) as keep:
        if most is not None:
            relevant = selection.is_relevant(F.col("title"), F.col("summary"), F.transform("tags", lambda t: t["term"]))
            entries = selection.select_posts(entries.withColumn("_relevant", relevant), most, "position", "_relevant").drop("_relevant")
        entries = written(entries, "entries")
        fetched = fetching.fetch(entries.select(F.col("link").alias("url")).where("url != ''"), opener=opener, rate=rate)
        contents = fetched.where("html is not null").select(F.col("url").alias("link"), html.post_content(F.col("html")).alias("content"))
        writers.write_records(selection.posts(entries, contents), target, "parquet")
        posts = spark.read.parquet(target)
        made = posts.agg(F.count(F.lit(1)).alias("n"), F.count_if("processing.is_relevant").alias("r")).first()
        failed = entries.join(posts.select(F.col("metadata.url").alias("link")), "link", "left_anti")
        failed = keep(written(failed.select(F.coalesce("title", F.lit("Unknown")).alias("title"), F.coalesce("link", F.lit("Unknown")).alias("url")), "failed"))
        total = entries.count()
    log_step("posts", "done", total=total, successful=made["n"])
    return {"total": total, "successful": made["n"], "failed": total - made["n"], "relevant": made["r"], "failed_posts": failed}


def crawl_sections(spark: SparkSession, base: str, sections: list[str], target: str, opener: fetching.Opener = fetching.open_url, most: int = 50, rate: float = 1.0, rounds: int | None = None) -> dict:
    """Pages of all sections, crawled at once: each section first in first out from its start over the links found, until `most` of its pages
    were read; written to target (url, html, error, scraped_at, section, title, content, start, round).

    A round fetches as many of each section's queue as it still lacks. Pages that fail don't count, and come again if a later page
    links to them; a page that two sections reach is read once (see crawl_together). Returns pages, failed, the failed urls (a table)
    and pages by section.
    """
    numbered = spark.createDataFrame([(i, urljoin(base, s)) for i, s in enumerate(sections)], "start int, page string")

    def visit(pages: DataFrame, r: int) -> DataFrame:
        got = fetching.fetch(pages.select(F.col("page").alias("url")), opener=opener, rate=rate).join(pages.withColumnRenamed("page", "url"), "url")
        got.select(
            "url", "html", "error", "scraped_at", urls.section(F.col("url")).alias("section"), html.title(F.col("html")).alias("title"),
            F.when(F.col("html").isNotNull(), html.content(F.col("html"))).alias("content"), "start",
        ).write.mode("overwrite").parquet(f"{target}/round={r}")
        read = spark.read.parquet(f"{target}/round={r}").where("html is not null")
        return read.select("start", F.col("url").alias("page"))

    def links(pages: DataFrame, r: int) -> DataFrame:
        read = spark.read.parquet(f"{target}/round={r}").select("start", F.col("url").alias("page"), "section", html.hrefs(F.col("html")).alias("hrefs"))
        found = pages.join(read, ["start", "page"]).select("start", "position", "section", "page", F.posexplode("hrefs").alias("number", "href"))
        found = found.withColumn("link", urls.absolute_url(F.col("page"), F.col("href")))
        return found.where(urls.is_followed(F.col("link"), base) & (urls.section(F.col("link")) == F.col("section"))).select("start", "position", "number", "link")

    with temporary(spark) as keep:
        read = crawl.crawl_together(numbered, links, most, visit, rounds)
        by_start = {r["start"]: r["n"] for r in read.groupBy("start").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a section
        tried = spark.read.parquet(target)
        failed = keep(written(tried.where("html is null").select("url", "error").join(read.select(F.col("page").alias("url")), "url", "left_anti").dropDuplicates(["url"]), "failed"))
        out = {"pages": sum(by_start.values()), "failed": failed.count(), "failed_urls": failed, "by_section": {s: by_start.get(i, 0) for i, s in enumerate(sections)}}
    log_step("crawl", "done", pages=out["pages"], failed=out["failed"])
    return out


def clean_transcripts(spark: SparkSession, source: str, target: str, glob: str = "*.json") -> dict:
    """Landed transcripts, cleaned, merged and written to target. Returns total, successful and failed (unreadable, or without segments)."""
    records = readers.read_transcripts(spark, source, glob)
    good = F.col("_corrupt_record").isNull() & F.col("segments").isNotNull()
    with temporary(spark):
        records = written(records.withColumn("_good", good).drop("_corrupt_record"), "transcripts")
        told = segments.process_transcripts(records.where("_good"))
        out = records.where("_good").select("title", "video_id", "url").join(told, "video_id")
        writers.write_records(out, target, "parquet")
        total, successful = records.agg(F.count(F.lit(1)), F.count_if("_good")).first()
    log_step("transcripts", "done", total=total, successful=successful)
    return {"total": total, "successful": successful, "failed": total - successful}


def process_videos(spark: SparkSession, listing: DataFrame, target: str, download: Callable[[str], bytes | None] | None, model: Callable[[], Callable[[list[bytes]], list[fetching.Heard]]]) -> dict:
    """Videos of a listing (position, video_id, title) that are neither private nor done: downloaded, transcribed and written to target.

    download(video_id) gives the bytes of a recording or None, on the executors; without it, only what was landed in target/audio (a file
    named by video_id) is heard. target/audio keeps recordings, target/texts has a transcript text each, named by position and title,
    target/records the records of each run. What a run before left is not done again: recordings are not downloaded, texts not
    heard twice. Returns successful, failed, skipped.
    """
    there = check_environment(spark, [f"{target}/audio", f"{target}/texts"])
    nothing = lambda schema: spark.createDataFrame([], schema)
    with temporary(spark) as keep:
        done = readers.read_transcript_texts(spark, f"{target}/texts") if there[f"{target}/texts"] else nothing("video_id string")
        done = written(done.select("video_id"), "done")
        todo = selection.pending_videos(listing, done).select("position", "title", "video_id", F.concat(F.lit("https://www.youtube.com/watch?v="), "video_id").alias("url"))
        todo = written(todo, "todo")
        audio = lambda: files.listed(spark, f"{target}/audio").select(F.col("file").alias("video_id"))

        if download is not None:

            def fetch(parts):
                for part in parts:
                    for v in part["video_id"]:  # a recording a batch
                        yield part[["video_id"]][part["video_id"] == v].head(1).assign(value=[download(v)])

            missing = todo.select("video_id").distinct().join(audio(), "video_id", "left_anti")
            got = missing.mapInPandas(fetch, "video_id string, value binary").where("value is not null")
            files.write_files(got.withColumnRenamed("video_id", "name"), f"{target}/audio")
        heard = fetching.recordings(spark, f"{target}/audio").withColumnRenamed("file", "video_id").join(todo, "video_id")
        heard = written(fetching.transcribe(heard, model).where("transcript != ''"), "heard")
        writers.write_transcripts(heard, f"{target}/texts", urls.numbered_file_name(F.col("position"), F.col("title")))
        heard.drop("position").write.mode("append").json(f"{target}/records")
        failed = keep(written(todo.join(heard.select("video_id"), "video_id", "left_anti"), "failed"))
        rows = selection.video_status(listing, done.unionByName(heard.select("video_id")), failed.select("video_id")).collect()  # a row a status
    status = {r["status"]: r["n"] for r in rows}
    log_step("videos", "done", **status)
    return {k: status.get(k, 0) for k in ("successful", "failed", "skipped")} | {"failed_videos": failed.select("title", "url")}


# Validation --------------------------------------------------------------------------------------


def validate_records(spark: SparkSession, records: DataFrame, history: str, run: str, record: str = "record", key: str = "video_id") -> dict[str, DataFrame]:
    """errors (key, errors) of JSON records (text), the run's statistics, added to the history, and the anomalies since the run before."""
    errors = records.select(key, validation.validation_errors(F.col(record)).alias("errors"))
    held = records.select(key, F.explode(validation.segments_of(F.col(record))).alias("s"))
    flat = held.select(F.lit(run).alias("run"), F.col("s.text").alias("text"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    statistics = segments.segment_statistics(flat, "run").drop("run")
    writers.write_history(statistics, history, run)
    runs = writers.read_history(spark, history)
    anomalies = validation.run_anomalies(runs, "run", validation.THRESHOLDS).where(F.col("run") == run)
    return {"errors": errors, "statistics": runs.where(F.col("run") == run), "anomalies": anomalies.withColumn("message", validation.anomaly_message(F.col("metric"), F.col("change")))}


# Alerts ------------------------------------------------------------------------------------------


def deliver(alert: DataFrame, senders: list[Callable[[str], None]]) -> bool:
    """Hand an alert's message, if there is one, to every sender; one that fails does not stop the others."""
    row = alert.first()
    if row is None:
        return False
    for send in senders:
        try:
            send(row["message"])
        except Exception:
            log.exception("an alert could not be sent")
    return True


def report_failure(step: str, error: Exception, senders: list[Callable[[str], None]]) -> None:
    for send in senders:
        try:
            send(f"Pipeline Error in step '{step}':\n{error}")
        except Exception:
            log.exception("an alert could not be sent")
