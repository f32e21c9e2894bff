"""Queries over readers, writers and drivers: rows of the test tables are landed in the shared folder as a source would land them, read
or run from there, and compared with SQL over the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunking
from ..session import fresh_path, spread, written
from ..sources import fetching, files, readers, writers
from . import drivers
from .registry import CHUNKS_SQL, CLEANED_SQL, EXACT, INSIDE_SQL, QUOTA, ROUNDS, SEGMENTS_SQL, STARTS, link_graph, query, segments_view, sql_merged, sql_rounds, sql_transcript, sql_words, table

#: Records of an array that lands in one file.
BLOCK = 500
LANDED = "*.txt"


def landed(rows: DataFrame, name: str, value: Column | None = None, opening: str = "[", closing: str = "]", between: str = ",", block: int = BLOCK) -> str:
    """A folder with the rows as files of about `block` records each: JSON arrays, or value between opening and closing."""
    path = fresh_path(rows.sparkSession, name)
    many = max(1, -(-rows.count() // block))
    one = F.to_json(F.struct(*rows.columns)) if value is None else value
    texts = rows.select(one.alias("value")).withColumn("block", F.pmod(F.xxhash64("value"), F.lit(many)))
    whole = F.concat(F.lit(opening), F.array_join(F.collect_list("value"), between), F.lit(closing))
    texts.groupBy("block").agg(whole.alias("value")).write.partitionBy("block").text(path)
    return path


# Readers -----------------------------------------------------------------------------------------


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.struct("url", F.concat(F.lit("Page "), "page_id").alias("title"), F.lit("2024-01-01").alias("scraped_at"), F.length("html").cast("long").alias("content_length"), F.lit("s").alias("section"))
    return table(spark, sf_dir, "pages").select(F.col("html").alias("content"), meta.alias("metadata"), F.lit("").alias("html"))


@query("SELECT url, 'Page ' || page_id AS title, length(html) AS content_length, md5(html) AS content, false AS corrupt FROM pages")
def landed_pages(spark, sf_dir):
    got = readers.read_pages(spark, landed(page_records(spark, sf_dir), "pages"), LANDED)
    return got.select("metadata.url", "metadata.title", "metadata.content_length", F.md5("content").alias("content"), F.col("_corrupt_record").isNotNull().alias("corrupt"))


@query(f"SELECT 'http://b/' || doc_id AS url, md5(text) AS content, lang AS first, len([lang, source]) AS categories, {sql_words('text')} AS word_count, doc_id % 2 = 0 AS relevant FROM documents")
def landed_posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    meta = F.struct(F.concat(F.lit("http://b/"), "doc_id").alias("url"), F.array("lang", "source").alias("categories"))
    rows = d.select(F.col("text").alias("content"), meta.alias("metadata"), F.struct(T.word_count(F.col("text")).cast("long").alias("word_count"), (F.col("doc_id") % 2 == 0).alias("is_relevant")).alias("processing"))
    got = readers.read_posts(spark, landed(rows, "posts"), LANDED)
    return got.select("metadata.url", F.md5("content").alias("content"), F.col("metadata.categories")[0].alias("first"), F.size("metadata.categories").alias("categories"), "processing.word_count", F.col("processing.is_relevant").alias("relevant"))


@query("SELECT 'u' || doc_id AS url, md5(text) AS content FROM documents")
def landed_cleaned(spark, sf_dir):
    """Every second record has its text as a transcript's full_text."""
    d = table(spark, sf_dir, "documents")
    even = F.col("doc_id") % 2 == 0
    rows = d.select(F.when(even, F.col("text")).alias("content"), F.when(~even, F.col("text")).alias("full_text"), F.struct(F.concat(F.lit("u"), "doc_id").alias("url")).alias("metadata"))
    got = readers.read_cleaned(spark, landed(rows, "cleaned"), LANDED)
    return got.select("metadata.url", F.md5("content").alias("content"))


def transcript_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = segments_view(spark, sf_dir).select("video_id", F.struct("id", "start", "end", "text", "speaker").alias("s"))
    rows = rows.groupBy("video_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))
    return rows.select(F.concat(F.lit("Talk "), "video_id").alias("title"), "video_id", F.concat(F.lit("http://v/"), "video_id").alias("url"), "segments")


@query(f'SELECT video_id, id, "start", "end", text, speaker FROM ({SEGMENTS_SQL})')
def landed_transcripts(spark, sf_dir):
    got = readers.read_transcripts(spark, landed(transcript_records(spark, sf_dir), "transcripts", block=50), LANDED)
    return got.select("video_id", F.inline("segments")).select("video_id", "id", "start", "end", "text", "speaker")


@query(f"SELECT doc_id || '_' || pos AS chunk_id, md5(chunk) AS content, pos AS chunk_index, 'part' AS file FROM ({CHUNKS_SQL})")
def landed_chunks(spark, sf_dir):
    rows = chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text")
    rows = rows.select(F.concat_ws("_", "doc_id", "pos").alias("chunk_id"), F.col("chunk").alias("content"), F.struct(F.col("pos").alias("chunk_index")).alias("metadata"))
    got = readers.read_chunks(spark, landed(rows, "chunks"), LANDED)
    return got.select("chunk_id", F.md5("content").alias("content"), "metadata.chunk_index", F.substring("file", 1, 4).alias("file"))


def feed_of_parts(spark: SparkSession, sf_dir: str) -> str:
    part = table(spark, sf_dir, "part")
    entry = F.concat(F.lit("<entry><title>"), "p_name", F.lit("</title><link>http://p/"), "p_partkey", F.lit("</link><tags><term>"), F.when(F.col("p_partkey") % 3 == 0, "culture").otherwise("x"), F.lit("</term></tags></entry>"))
    return landed(part.select("p_partkey", "p_name"), "feed", entry, "<feed>", "</feed>", "")


@query("SELECT 'http://p/' || p_partkey AS link, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'culture' ELSE 'x' END AS tag, NULL::varchar AS summary FROM part")
def landed_feed(spark, sf_dir):
    got = readers.read_feed(spark, feed_of_parts(spark, sf_dir))
    return got.select("link", "title", F.col("tags")[0]["term"].alias("tag"), "summary")


@query(f"""SELECT 'Talk ' || video_id AS title, video_id, 'http://v/' || video_id AS url, string_agg(text, ' ' ORDER BY id) AS transcript FROM ({SEGMENTS_SQL}) GROUP BY video_id""")
def transcript_files(spark, sf_dir):
    """Transcript texts, a file each in one folder, written and read back."""
    rows = transcript_records(spark, sf_dir).withColumn("transcript", F.array_join(F.col("segments")["text"], " "))
    path = fresh_path(spark, "texts")
    writers.write_transcripts(rows, path, F.concat("video_id", F.lit(".txt")))
    return readers.read_transcript_texts(spark, path)


@query("SELECT 'docs' AS run, lang AS name, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'pages/1', 'all', count(*) FROM pages")
def statistics_history(spark, sf_dir):
    """Statistics of two runs, one of them written again after an attempt over half its rows: a row a figure stays."""
    path = fresh_path(spark, "history")
    d, count = table(spark, sf_dir, "documents"), F.count(F.lit(1)).alias("n")
    writers.write_history(d.where("doc_id % 2 = 0").groupBy(F.col("source").alias("name")).agg(count), path, "docs")
    writers.write_history(table(spark, sf_dir, "pages").groupBy(F.lit("all").alias("name")).agg(count), path, "pages/1")
    writers.write_history(d.groupBy(F.col("lang").alias("name")).agg(count), path, "docs")
    return writers.read_history(spark, path).select("run", "name", "n")


@query("SELECT n_nationkey, n_name, v AS run_id FROM nation, (SELECT unnest([1, 2]) AS v) WHERE v = 1 OR n_nationkey < 10")
def snapshots(spark, sf_dir):
    """Two versions of a table, copied to another folder, read back together."""
    path = fresh_path(spark, "versions")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    writers.snapshot(nation, path, "1")
    writers.snapshot(nation.where("n_nationkey < 10"), path, "2")
    copy = fresh_path(spark, "copy")
    drivers.publish(spark, path, copy)
    return spark.read.parquet(copy).select("n_nationkey", "n_name", "run_id")


def document_files(spark: SparkSession, sf_dir: str, version: int) -> str:
    """A folder with a file a document; in the second version every tenth has one more line, every seventh is gone, every ninth has a copy."""
    d = table(spark, sf_dir, "documents").select(F.concat("doc_id", F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).alias("value"), "doc_id")
    if version == 2:
        d = d.withColumn("value", F.when(F.col("doc_id") % 10 == 0, F.concat("value", F.lit("\nmore"))).otherwise(F.col("value"))).where("doc_id % 7 != 0")
        d = d.unionByName(d.where("doc_id % 9 = 0").withColumn("name", F.concat(F.lit("copy-"), "name")))
    path = fresh_path(spark, f"files-{version}")
    files.write_files(d, path)
    return path


FILES_1 = "SELECT doc_id || '.txt' AS file, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, ''))) AS size FROM documents"
_CHANGED = "SELECT doc_id, coalesce(text, '') || CASE WHEN doc_id % 10 = 0 THEN chr(10) || 'more' ELSE '' END AS text FROM documents WHERE doc_id % 7 <> 0"
FILES_2 = f"SELECT p || doc_id || '.txt' AS file, sha256(text) AS digest, octet_length(encode(text)) AS size FROM ({_CHANGED}), (SELECT unnest(['', 'copy-']) AS p) WHERE p = '' OR doc_id % 9 = 0"


@query(f"""SELECT file, CASE WHEN a.digest IS NULL THEN 'added' WHEN b.digest IS NULL THEN 'removed' ELSE 'changed' END AS change, a.digest AS old_digest, b.digest AS new_digest
 FROM ({FILES_1}) a FULL JOIN ({FILES_2}) b USING (file) WHERE a.digest IS DISTINCT FROM b.digest""")
def version_changes(spark, sf_dir):
    """What differs between two versions of a folder, by their manifests."""
    old, new = (written(files.manifest(spark, document_files(spark, sf_dir, v)), "manifest") for v in (1, 2))
    return files.manifest_diff(old, new)


def sql_pointer(rows: str) -> str:
    level = f"SELECT sha256(file || ':' || digest) AS h, size AS s, 1 AS n FROM ({rows})"
    level = f"SELECT substr(h, 1, {files.DIGITS}) AS k, * FROM ({level})"
    for digits in range(files.DIGITS, 0, -2):
        level = f"SELECT substr(k, 1, {digits - 2}) AS k, sha256(string_agg(h, '' ORDER BY h)) AS h, sum(s) AS s, sum(n) AS n FROM ({level}) GROUP BY k"
    return f"SELECT sha256(string_agg(h, '' ORDER BY h)) AS digest, sum(s)::bigint AS size, sum(n)::bigint AS files FROM ({level})"


@query(f"SELECT 1 AS version, * FROM ({sql_pointer(FILES_1)}) UNION ALL SELECT 2, * FROM ({sql_pointer(FILES_2)})")
def version_pointers(spark, sf_dir):
    """Digest, size and number of files of two versions of a folder; the second is told of a copy of it."""
    first = files.folder_pointer(files.manifest(spark, document_files(spark, sf_dir, 1)))
    copy = fresh_path(spark, "copy")
    told = drivers.publish(spark, document_files(spark, sf_dir, 2), copy)
    second = files.folder_pointer(files.manifest(spark, copy))
    if second.first()["digest"] != told["digest"]:
        raise ValueError("the copy differs")
    return first.withColumn("version", F.lit(1)).unionByName(second.withColumn("version", F.lit(2)))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL")
def partitioned_records(spark, sf_dir):
    """Records written as JSON in folders by language, and read back with it."""
    path = fresh_path(spark, "records")
    writers.write_records(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), path, "json", ("lang",))
    return spark.read.json(path).groupBy("lang", "source").agg(F.count(F.lit(1)).alias("n"))


# Drivers -----------------------------------------------------------------------------------------


@query(f"""SELECT 'u' || doc_id AS url, content, word_count, cleaned_length FROM ({CLEANED_SQL}) WHERE is_valid""")
def cleaned_pages(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    rows = d.select(F.col("text").alias("content"), F.struct(F.concat(F.lit("u"), "doc_id").alias("url")).alias("metadata"))
    target = fresh_path(spark, "cleaned")
    drivers.clean_pages(spark, landed(rows, "raw"), target, LANDED)
    return spark.read.parquet(target).select("metadata.url", "content", F.col("processing.word_count").alias("word_count"), F.col("processing.cleaned_length").alias("cleaned_length"))


@query(f"SELECT count(*) AS documents, sum(n)::bigint AS chunks, avg(n) AS average_chunks FROM (SELECT d.doc_id, count(c.doc_id) AS n FROM documents d LEFT JOIN ({CHUNKS_SQL}) c ON c.doc_id = d.doc_id GROUP BY d.doc_id)")
def chunked_pages(spark, sf_dir):
    source, target = fresh_path(spark, "clean"), fresh_path(spark, "chunked")
    rows = table(spark, sf_dir, "documents").select(F.struct(F.col("doc_id").cast("string").alias("url")).alias("metadata"), F.col("text").alias("content"))
    rows.write.parquet(source)
    return spark.createDataFrame([drivers.chunk_pages(spark, source, target)], "documents long, chunks long, average_chunks double")


def mirrored(rows: DataFrame) -> str:
    """A mirror of pages (url, html): a folder with a file a url, named by the url's digest, written over all cores."""
    path = fresh_path(rows.sparkSession, "mirror")
    files.write_files(spread(rows).select(F.concat(F.md5("url"), F.lit(".html")).alias("name"), F.col("html").alias("value")), path)
    return path


@query("SELECT url, CASE WHEN min(page_id) % 5 <> 0 THEN md5(min(html)) END AS html, min(page_id) % 5 = 0 AS failed FROM pages GROUP BY url HAVING min(page_id) % 7 <> 1")
def fetched_pages(spark, sf_dir):
    """Urls that were not seen, each fetched once from a mirror of four fifths of the pages; those that fail have an error."""
    pages = table(spark, sf_dir, "pages")
    one = pages.groupBy("url").agg(F.min("page_id").alias("page_id"), F.min("html").alias("html"))
    mirror = mirrored(one.where("page_id % 5 != 0"))
    out = fetching.fetch(pages, one.where("page_id % 7 = 1"), fetching.mirror(mirror), attempts=1, rate=0)
    return out.select("url", F.md5("html").alias("html"), F.col("error").isNotNull().alias("failed"))


@query("""SELECT 'http://p/' || p_partkey AS url, p_name AS title, CASE WHEN p_partkey % 3 = 0 THEN 'culture' ELSE 'x' END AS tag, p_partkey % 3 = 0 AS is_relevant,
 'A post of some words, at http://p/' || p_partkey || '. ' || trim(repeat('More words. ', 10)) AS content FROM part WHERE p_partkey % 5 <> 0""")
def fetched_posts(spark, sf_dir):
    """A feed's posts, all of them, fetched, projected and written; those that can't be fetched are left out."""
    target = fresh_path(spark, "posts")
    url = F.concat(F.lit("http://p/"), "p_partkey").alias("url")
    html = F.concat(F.lit("<body><article>A post of some words, at http://p/"), "p_partkey", F.lit(". " + "More words. " * 10 + "</article></body>")).alias("html")
    mirror = mirrored(table(spark, sf_dir, "part").where("p_partkey % 5 != 0").select(url, html))
    drivers.fetch_posts(spark, feed_of_parts(spark, sf_dir), target, fetching.mirror(mirror), None, 0)
    return spark.read.parquet(target).select("metadata.url", "metadata.title", F.col("metadata.categories")[0].alias("tag"), "processing.is_relevant", "content")


SECTION_OF = "(SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM pages)"


@query(f"SELECT 'http://h/' || section || '/' || page AS url, 'Page ' || page AS title, section, start, round FROM ({sql_rounds(INSIDE_SQL, 'page % 10 <> 3')}) r JOIN {SECTION_OF} s ON s.page_id = r.page")
def crawled_sections(spark, sf_dir):
    """Sections of the pages' link graph crawled at once from a mirror that lacks every tenth page, each up to a number of pages."""
    edges = link_graph(spark, sf_dir).where("src_section = dst_section")
    at = lambda section, page: F.concat(F.lit("http://h/"), section, F.lit("/"), page.cast("string"))
    sections = table(spark, sf_dir, "pages").select(F.col("page_id").alias("src"), F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("section"))
    hrefs = edges.groupBy("src").agg(F.array_sort(F.collect_set(F.struct("dst", "dst_section"))).alias("d"))
    anchors = F.array_join(F.transform("d", lambda d: F.concat(F.lit('<a href="'), at(d["dst_section"], d["dst"]), F.lit('">x</a>'))), "")
    html = F.concat(F.lit("<title>Page "), F.col("src").cast("string"), F.lit("</title><main>text</main>"), F.coalesce(anchors, F.lit("")))
    pages = sections.join(hrefs, "src", "left").where("src % 10 != 3").select(at(F.col("section"), F.col("src")).alias("url"), html.alias("html"))
    starts = {r["src"]: r["section"] for r in sections.where(F.col("src").isin([p for _, p in STARTS])).collect()}  # a row a start
    target = fresh_path(spark, "crawl")
    paths = [f"{starts.get(p, '')}/{p}" for _, p in STARTS]
    drivers.crawl_sections(spark, "http://h/", paths, target, fetching.mirror(mirrored(pages)), QUOTA, 0, ROUNDS)
    return spark.read.parquet(target).where("html is not null").select("url", "title", "section", "start", "round")


HEARD_SQL = "SELECT conv_id, count(*) AS n, string_agg(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' '), ' ' ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id"


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id and value: each conversation as captions (WebVTT), a cue of nine seconds and a half a turn."""
    at = lambda s, ms: F.format_string(f"%02d:%02d:%02d.{ms}", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
    begin = F.col("turn") * 10
    text = F.trim(F.regexp_replace("text", "[ \\t\\n\\r\\f\\x0B]+", " "))
    cue = F.concat(at(begin, "000"), F.lit(" --> "), at(begin + 9, "500"), F.lit("\n"), text)
    cues = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").cast("string").alias("video_id")).agg(F.sort_array(F.collect_list(F.struct("turn", cue.alias("cue")))).alias("c"))
    return cues.select("video_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.col("c")["cue"], "\n\n"), F.lit("\n")).alias("value"))


@query(f"SELECT conv_id::varchar AS video_id, n AS segments, transcript FROM ({HEARD_SQL})")
def transcribed(spark, sf_dir):
    """Landed recordings (captions of the conversations), read as bytes and heard in batches."""
    path = fresh_path(spark, "recordings")
    files.write_files(captions(spark, sf_dir).withColumnRenamed("video_id", "name"), path)
    heard = fetching.transcribe(fetching.recordings(spark, path), fetching.captions)
    return heard.select(F.col("file").alias("video_id"), F.size("segments").cast("long").alias("segments"), "transcript")


def video_run(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """Videos named after the conversations, of which every seventh recording is missing and every eleventh private; done in two runs, the second
    of which finds what the first could not. Returns the folder and what the second run says."""
    held = captions(spark, sf_dir)
    target = fresh_path(spark, "videos")
    number = F.col("video_id").cast("int")
    listing = held.select(number.alias("position"), "video_id", F.when(number % 11 == 0, "[Private video]").otherwise(F.concat(F.lit("Talk: "), "video_id")).alias("title"))
    land = lambda rows: files.write_files(rows.withColumnRenamed("video_id", "name"), f"{target}/audio")
    land(held.where("video_id % 7 != 0 and video_id % 2 = 0"))
    drivers.process_videos(spark, listing, target, None, fetching.captions)
    land(held.where("video_id % 7 != 0 and video_id % 2 = 1"))
    return target, drivers.process_videos(spark, listing, target, None, fetching.captions)


@query(f"SELECT conv_id::varchar AS video_id, 'Talk: ' || conv_id AS title, 'https://www.youtube.com/watch?v=' || conv_id AS url, transcript FROM ({HEARD_SQL}) WHERE conv_id % 7 <> 0 AND conv_id % 11 <> 0")
def video_texts(spark, sf_dir):
    """The transcripts of two runs over recordings, read from their files."""
    return readers.read_transcript_texts(spark, f"{video_run(spark, sf_dir)[0]}/texts").select("video_id", "title", "url", "transcript")


@query("""SELECT count(*) FILTER (c % 7 <> 0 AND c % 11 <> 0) AS successful, count(*) FILTER (c % 7 = 0 AND c % 11 <> 0) AS failed, count(*) FILTER (c % 11 = 0) AS skipped
 FROM (SELECT DISTINCT conv_id AS c FROM conversations)""")
def video_summary(spark, sf_dir):
    """What the second run says of all videos: texts of the first count, recordings that are missing still have failed."""
    out = video_run(spark, sf_dir)[1]
    return spark.createDataFrame([{k: out[k] for k in ("successful", "failed", "skipped")}], "successful long, failed long, skipped long")


_SHIFTED = f"""SELECT video_id, id, "start" + CASE WHEN video_id::bigint % 2 = 1 THEN 0.25 ELSE 0 END AS "start", "end", speaker, {sql_transcript('text')} AS text FROM ({SEGMENTS_SQL})"""


@query(f"""SELECT video_id, title, segments, word_count, {sql_transcript('full_text')} AS full_text FROM (SELECT video_id, 'Talk ' || video_id AS title, count(*) AS segments, sum({sql_words('text')})::bigint AS word_count,
 string_agg(text, ' ' ORDER BY id) AS full_text FROM ({sql_merged(_SHIFTED, EXACT)}) GROUP BY video_id)""")
def cleaned_transcripts(spark, sf_dir):
    """Transcripts landed, cleaned, merged and written, with their texts; in every second record no segment begins where one ends."""
    target = fresh_path(spark, "cleaned")
    shift = F.when(F.col("video_id") % 2 == 1, 0.25).otherwise(0.0)
    source = landed(transcript_records(spark, sf_dir).withColumn("segments", F.transform("segments", lambda s: s.withField("start", s["start"] + shift))), "raw", block=50)
    drivers.clean_transcripts(spark, source, target, LANDED)
    return spark.read.parquet(target).select("video_id", "title", F.col("segment_count").alias("segments"), "word_count", "full_text")


@query(f"""WITH a AS (SELECT '1' AS run, * FROM ({SEGMENTS_SQL}) WHERE CAST(video_id AS bigint) % 2 = 0 UNION ALL SELECT '2', * FROM ({SEGMENTS_SQL})),
s AS (SELECT run, count(*) AS total_segments, sum({sql_words('text')}) AS total_words, avg("end" - "start") AS avg_segment_duration FROM a GROUP BY run),
p AS (SELECT unnest([{{'metric': 'total_segments', 'now': x.total_segments::double, 'was': y.total_segments::double, 'most': 0.4::double}}, {{'metric': 'total_words', 'now': x.total_words::double, 'was': y.total_words::double, 'most': 0.4::double}},
 {{'metric': 'avg_segment_duration', 'now': x.avg_segment_duration, 'was': y.avg_segment_duration, 'most': 0.3::double}}], recursive := true) FROM s x, s y WHERE x.run = '2' AND y.run = '1')
SELECT metric, 'Anomaly detected in ' || metric || ': Changed by ' || printf('%.1f%%', abs(now - was) / was * 100) AS message FROM p WHERE abs(now - was) / was > most""")
def validated_runs(spark, sf_dir):
    """Two runs of validation, the second over twice the records: statistics kept in a history, and what moved too far."""
    rows = transcript_records(spark, sf_dir).select("video_id", F.to_json(F.struct("title", "video_id", "segments")).alias("record"))
    history = fresh_path(spark, "history")
    drivers.validate_records(spark, rows.where("video_id % 2 = 0"), history, "1")
    return drivers.validate_records(spark, rows, history, "2")["anomalies"].select("metric", "message")
