"""Queries over the test tables for every operator, each with the same in DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import bias, chunking, crawl, html, reports, sampling, segments, selection, validation
from ..session import spread
from ..streaming import sessions as streams
from .corpus import chunk_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose texts are worked on.
TEXTS = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in TEXTS else df


# SQL forms of scalar functions -------------------------------------------------------------------

W = r"[^\p{L}\p{N}_]"
ENDS = "' '||chr(10)||chr(13)||chr(9)||chr(11)||chr(12)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sub(x: str, pattern: str, to: str, flags: str = "g") -> str:
    return f"regexp_replace({x}, {quoted(pattern)}, {quoted(to)}, '{flags}')"


def sql_strip_tags(x: str) -> str:
    return sub(sub(sub(x, "<[^>]+>", ""), "&[a-zA-Z]+;", " "), "&#[0-9]+;", " ")


def sql_spaces(x: str) -> str:
    return sub(sub(f"replace({x}, chr(9), ' ')", " +", " "), r" +([.,!?;:])", r"\1")


def sql_lines(x: str) -> str:
    return f"regexp_replace({x}, '\\n\\s*\\n+', chr(10)||chr(10), 'g')"


def sql_special(x: str) -> str:
    return sub(x, r"""[^\p{L}\p{N}_\s.,!?;:\-'"()\[\]{}/@#$%&*+=]""", "")


def sql_clean(x: str) -> str:
    return f"trim({sql_special(sql_lines(sql_spaces(f'strip_accents({sql_strip_tags(x)})')))}, {ENDS})"


def sql_words(x: str) -> str:
    return f"len(regexp_extract_all({x}, '\\S+'))"


def sql_without(x: str, words) -> str:
    for w in words:
        for _ in range(2):
            x = sub(x, rf"(^|{W})(?:{w})($|{W})", r"\1\2", "gi")
    return x


def sql_patterns(x: str, second: str) -> str:
    for p in (T.TIMESTAMPS, second, r"\s+", "[♪|#@&*]", "<[^>]+>", T.URLS, r"\n+"):
        x = sub(x, p, " ")
    return x


def sql_replace(x: str, artefacts) -> str:
    for a in artefacts:
        x = f"replace({x}, {quoted(a)}, '')"
    return x


def sql_transcript(x: str) -> str:
    x = sql_replace(sql_patterns(sql_without(x, T.FILLERS), T.BRACKETED), T.ARTEFACTS)
    return sub(f"trim(translate({x}, '|01', 'IOl'), {ENDS})", r"\s+", " ")


def sql_meeting(x: str) -> str:
    x = sql_replace(sql_patterns(x, r"^[^\n]*?:\s"), T.MEETING_ARTEFACTS)
    x = sql_without(sql_without(x, T.MEETING_FILLERS), T.TRANSITIONS)
    return f"trim({sub(f"translate({x}, '|01', 'IOl')", chr(92) + 's+', ' ')}, {ENDS})"


# Text --------------------------------------------------------------------------------------------

CLEANED_SQL = f"""SELECT doc_id, lang, coalesce(length(text), 0) AS original_length, content, length(content) AS cleaned_length,
 {sql_words('content')} AS word_count, length(content) >= 50 AND len(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+')) >= 5 AS is_valid
 FROM (SELECT *, {sql_clean("coalesce(text, '')")} AS content FROM documents)"""


@query(f"SELECT doc_id, content, original_length, cleaned_length, word_count, is_valid FROM ({CLEANED_SQL})")
def clean_text_docs(spark, sf_dir):
    return reports.cleaned_documents(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"SELECT page_id, {sql_clean('html')} AS content FROM pages")
def clean_text_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.clean_text(F.col("html")).alias("content"))


@query(f"""SELECT page_id, md5({sql_strip_tags('html')}) AS tags, md5({sql_spaces('html')}) AS spaces, md5({sql_lines('html')}) AS lines, md5({sql_special('html')}) AS special FROM pages""")
def text_steps(spark, sf_dir):
    h = F.col("html")
    steps = {"tags": T.strip_tags(h), "spaces": T.collapse_spaces(h), "lines": T.collapse_blank_lines(h), "special": T.drop_special(h)}
    return table(spark, sf_dir, "pages").select("page_id", *[F.md5(c).alias(n) for n, c in steps.items()])


def _sql_mojibake(x: str) -> str:
    for a, b in T.MOJIBAKE:
        x = f"replace({x}, {quoted(a)}, {quoted(b)})"
    return x


BROKEN = "Ã©tÃ© â€œxâ€ itâ€™s Ã "


@query(f"SELECT doc_id, {_sql_mojibake(f'{quoted(BROKEN)} || text')} AS fixed FROM documents")
def fix_mojibake(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.fix_mojibake(F.concat(F.lit(BROKEN), "text")).alias("fixed"))


@query(f"SELECT doc_id, length(text) // 4 AS tokens, {sql_words('text')} AS words FROM documents")
def text_sizes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"), T.word_count(F.col("text")).alias("words"))


@query(f"SELECT doc_id FROM ({CLEANED_SQL}) WHERE is_valid")
def valid_docs(spark, sf_dir):
    return reports.cleaned_documents(table(spark, sf_dir, "documents"), "doc_id", "text").where("is_valid").select("doc_id")


@query(f"""SELECT lang, count(*) AS total, count(*) FILTER (is_valid) AS successful, count(*) FILTER (NOT is_valid) AS failed,
 coalesce(avg(word_count) FILTER (is_valid), 0) AS average_words FROM ({CLEANED_SQL}) GROUP BY lang""")
def cleaning_summary(spark, sf_dir):
    return reports.cleaning_summary(reports.cleaned_documents(table(spark, sf_dir, "documents"), "doc_id", "text", ("lang",)), ("lang",))


@query(f"SELECT doc_id FROM ({CLEANED_SQL}) WHERE NOT is_valid")
def failed_docs(spark, sf_dir):
    return reports.failed_documents(reports.cleaned_documents(table(spark, sf_dir, "documents"), "doc_id", "text"), "doc_id")


@query(f"SELECT conv_id, turn, {sql_transcript('text')} AS content FROM conversations")
def transcript_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_transcript_text(F.col("text")).alias("content"))


@query(f"SELECT doc_id, {sql_meeting('text')} AS content FROM documents")
def meeting_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_meeting_text(F.col("text")).alias("content"))


# Chunks ------------------------------------------------------------------------------------------


def sql_chunks(x: str, level: int = 0) -> str:
    """The recursive chunker as nested list_reduce, one level a separator."""
    a, e, w, i, f, y = (f"{n}{level}" for n in "aewify")
    none, strip = "[]::varchar[]", lambda v: f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"
    flush = f"CASE WHEN {a}.k <> '' THEN list_append({a}.o, {strip(a + '.k')}) ELSE {a}.o END"
    if level < len(chunking.SEPARATORS):
        sep = quoted(chunking.SEPARATORS[level]).replace("\n", "'||chr(10)||'")
        cut = f"string_split({x}, {sep})"
        parts = f"list_transform({cut}, lambda {w}, {i}: {{'o': {none}, 'k': CASE WHEN {i} < len({cut}) THEN {w} || {sep} ELSE {w} END}})"
        step = f"""CASE WHEN length({a}.k || {e}.k) < 3204 THEN {{'o': {a}.o, 'k': {a}.k || {e}.k}}
          WHEN length({e}.k) >= 3204 THEN {{'o': list_concat({flush}, {sql_chunks(e + '.k', level + 1)}), 'k': ''}}
          ELSE {{'o': {flush}, 'k': {e}.k}} END"""
        least = 400
    else:
        parts = f"list_transform(regexp_extract_all({x}, '\\S+'), lambda {w}: {{'o': {none}, 'k': {w}}})"
        both = f"CASE WHEN {a}.k = '' THEN {e}.k ELSE {a}.k || ' ' || {e}.k END"
        step = f"CASE WHEN length({both}) < 3204 THEN {{'o': {a}.o, 'k': {both}}} ELSE {{'o': {flush}, 'k': {e}.k}} END"
        least = 1
    filled = f"list_reduce(list_prepend({{'o': {none}, 'k': ''}}, {parts}), lambda {a}, {e}: {step})"
    end = f"CASE WHEN length({y}.k) >= {least} THEN list_append({y}.o, {strip(y + '.k')}) ELSE {y}.o END"
    return f"list_reduce([{{'o': {none}, 'k': ''}}, {filled}], lambda {f}, {y}: {{'o': {end}, 'k': ''}}).o"


def sql_overlapped(rows: str) -> str:
    """Rows (doc_id, pos, chunk) with the neighbours' words."""
    return f"""SELECT doc_id, pos, CASE WHEN b IS NULL THEN '' ELSE array_to_string(list_slice(b, greatest(1, len(b) - nb + 1), len(b)), ' ') || ' ' END || chunk
      || CASE WHEN n IS NULL THEN '' ELSE ' ' || array_to_string(list_slice(n, 1, na), ' ') END AS chunk
     FROM (SELECT *, CASE WHEN n IS NULL THEN 15 ELSE 8 END AS nb, CASE WHEN b IS NULL THEN 15 ELSE 7 END AS na FROM (
       SELECT doc_id, pos, chunk, lag(w) OVER (PARTITION BY doc_id ORDER BY pos) AS b, lead(w) OVER (PARTITION BY doc_id ORDER BY pos) AS n
       FROM (SELECT *, regexp_extract_all(chunk, '\\S+') AS w FROM ({rows}))))"""


def sql_exploded(source: str, text: str) -> str:
    return f"SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT doc_id, {sql_chunks(text)} AS c FROM ({source}))"


CHUNKS_SQL = sql_exploded("documents", "text")


@query(CHUNKS_SQL)
def chunk_recursive(spark, sf_dir):
    return chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "pos", "chunk")


@query("""SELECT doc_id, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT doc_id,
 list_transform(list_reduce(list_prepend({'o': []::varchar[], 'k': '', 's': 0}, list_append(list_transform(regexp_extract_all(text, '\\S+'), lambda w: {'o': []::varchar[], 'k': w, 's': length(w) // 4}), {'o': []::varchar[], 'k': '', 's': 100000})),
  lambda a, x: CASE WHEN a.s + x.s > 800 AND a.k <> '' THEN {'o': list_append(a.o, a.k), 'k': x.k, 's': x.s}
   WHEN a.k = '' THEN {'o': a.o, 'k': x.k, 's': x.s} ELSE {'o': a.o, 'k': a.k || ' ' || x.k, 's': a.s + x.s} END).o, lambda z: z) AS c FROM documents)""")
def chunk_simple(spark, sf_dir):
    return chunking.exploded(table(spark, sf_dir, "documents"), "doc_id", "text", "fixed").select("doc_id", "pos", "chunk")


RECORDS_SQL = f"""SELECT doc_id, doc_id || '_' || pos AS chunk_id, chunk AS content, pos AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks,
 'recursive' AS chunk_method, 800 AS chunk_size, 150 AS chunk_overlap, length(chunk) // 4 AS estimated_tokens, length(chunk) AS character_count, {sql_words('chunk')} AS word_count
 FROM ({sql_overlapped(CHUNKS_SQL)})"""


@query(RECORDS_SQL)
def chunk_overlap(spark, sf_dir):
    return chunking.chunk_records(table(spark, sf_dir, "documents"), "doc_id", "text")


STATS_SQL = f"""SELECT d.doc_id, coalesce(n, 0) AS n_chunks, coalesce(m, 0) AS mean_words FROM documents d
 LEFT JOIN (SELECT doc_id, count(*) AS n, avg(word_count) AS m FROM ({RECORDS_SQL}) GROUP BY doc_id) c ON c.doc_id = d.doc_id"""


@query(STATS_SQL)
def chunk_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return chunking.chunk_statistics(docs, chunking.chunk_records(docs, "doc_id", "text"), "doc_id")


@query(f"SELECT count(*) AS documents, sum(n_chunks)::bigint AS chunks, avg(n_chunks) AS average_chunks FROM ({STATS_SQL})")
def chunk_summary(spark, sf_dir):
    return reports.chunk_summary(chunk_stats(spark, sf_dir))


@query(f"""SELECT lang, count(*) AS chunks, sum({sql_words('chunk')})::bigint AS words, max(length(chunk)) AS largest
 FROM ({sql_overlapped(sql_exploded(f"SELECT doc_id, content FROM ({CLEANED_SQL}) WHERE is_valid", 'content'))}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) GROUP BY lang""")
def chunk_report_by_language(spark, sf_dir):
    return chunk_report(table(spark, sf_dir, "documents"))


# Segments ----------------------------------------------------------------------------------------

SEGMENTS_SQL = """SELECT CAST(conv_id AS varchar) AS video_id, CAST(turn AS int) AS id, CAST(turn * 10 AS double) AS "start",
 CAST(turn * 10 AS double) + CASE length(text) % 4 WHEN 0 THEN 10.0::double WHEN 1 THEN 8.5::double WHEN 2 THEN 6.0::double ELSE 0.0::double END AS "end", text, role AS speaker FROM conversations"""


def segments_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    start = (F.col("turn") * 10).cast("double")
    length = F.element_at(F.array(*[F.lit(x) for x in (10.0, 8.5, 6.0, 0.0)]), F.length("text") % 4 + 1)
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("id"), start.alias("start"), (start + length).alias("end"), "text", F.col("role").alias("speaker"))


def sql_merged(rows: str, apart: str) -> str:
    return f"""SELECT video_id, min(id) AS id, min_by("start", id) AS "start", max_by("end", id) AS "end", string_agg(text, ' ' ORDER BY id) AS text, min_by(speaker, id) AS speaker
     FROM (SELECT *, sum(CASE WHEN e IS NULL OR {apart} THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS r
       FROM (SELECT *, lag("end") OVER (PARTITION BY video_id ORDER BY id) AS e FROM ({rows}))) GROUP BY video_id, r"""


EXACT, NEAR = '"start" <> e', '"start" - e > 2'


@query(sql_merged(SEGMENTS_SQL, EXACT))
def merge_exact(spark, sf_dir):
    return segments.merge_contiguous(segments_view(spark, sf_dir))


@query(sql_merged(SEGMENTS_SQL, NEAR))
def merge_gap(spark, sf_dir):
    return segments.merge_near(segments_view(spark, sf_dir))


SEGMENT_STATS_SQL = f"""SELECT video_id, count(*) AS total_segments, sum({sql_words('text')})::bigint AS total_words, avg("end" - "start") AS avg_segment_duration,
 count(*) FILTER (trim(text, {ENDS}) = '') AS missing_values FROM ({SEGMENTS_SQL}) GROUP BY video_id"""


@query(SEGMENT_STATS_SQL)
def segment_stats(spark, sf_dir):
    return segments.segment_statistics(segments_view(spark, sf_dir))


def _sql_cleaned_segments(clean) -> str:
    return f"""SELECT video_id, id, "start", "end", speaker, {clean('text')} AS text FROM ({SEGMENTS_SQL})"""


@query(f"""SELECT video_id, segment_count, word_count, {sql_transcript('full_text')} AS full_text FROM (SELECT video_id, count(*) AS segment_count, sum({sql_words('text')})::bigint AS word_count,
 string_agg(text, ' ' ORDER BY id) AS full_text FROM ({sql_merged(_sql_cleaned_segments(sql_transcript), EXACT)}) GROUP BY video_id)""")
def transcript_totals(spark, sf_dir):
    return segments.transcript_totals(segments_view(spark, sf_dir))


@query(f"""SELECT *, {sql_words('full_text')} AS word_count FROM (SELECT video_id, count(*) AS segment_count, string_agg(text, ' ' ORDER BY id) AS full_text
 FROM ({sql_merged(_sql_cleaned_segments(sql_meeting), NEAR)}) GROUP BY video_id)""")
def meeting_totals(spark, sf_dir):
    return segments.meeting_totals(segments_view(spark, sf_dir))


# Validation --------------------------------------------------------------------------------------


@query(f"""WITH told AS (SELECT video_id, id, 0 AS k, 'Segment ' || id || ' missing field: text' AS m FROM ({SEGMENTS_SQL}) WHERE id % 3 = 1
 UNION ALL SELECT video_id, id, 1, 'Segment ' || id || ' has invalid time range' FROM ({SEGMENTS_SQL}) WHERE "start" >= "end")
SELECT video_id, string_agg(m, '; ' ORDER BY id, k) AS errors FROM told GROUP BY video_id
UNION ALL SELECT DISTINCT video_id, '' FROM ({SEGMENTS_SQL}) WHERE video_id NOT IN (SELECT video_id FROM told)""")
def validate_segments(spark, sf_dir):
    text = F.when(F.col("id") % 3 != 1, F.col("text")).alias("text")  # a null field is left out of the JSON
    rows = segments_view(spark, sf_dir).select("video_id", F.struct("id", "start", "end", text).alias("s"))
    records = rows.groupBy("video_id").agg(F.sort_array(F.collect_list("s")).alias("segments")).withColumn("title", F.lit("t"))
    record = F.to_json(F.struct("title", "video_id", "segments"))
    return records.select("video_id", F.array_join(validation.validation_errors(record), "; ").alias("errors"))


@query("""SELECT event_id, array_to_string(list_filter(['k', 'v'], lambda f: NOT list_contains(json_keys(props), f)), ',') AS missing FROM events""")
def missing_keys(spark, sf_dir):
    told = validation.missing_fields(F.col("props"), ("k", "v"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(told, lambda m: F.replace(m, F.lit("Missing required field: "), F.lit(""))), ",").alias("missing"))


@query("SELECT 'OBJECT<' || string_agg(DISTINCT k || ': ' || CASE WHEN json_type(props, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' ELSE json_type(props, '$.' || k) END, ', ') || '>' AS schema, count(DISTINCT event_id) AS records, 0::bigint AS broken FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events)")
def props_schema(spark, sf_dir):
    """The schema that all events' properties have together."""
    return validation.inferred_schema(table(spark, sf_dir, "events"), "props")


_FOUND = "CASE WHEN json_type(p, '$.' || k) IN ('UBIGINT', 'BIGINT') THEN 'BIGINT' WHEN json_type(p, '$.' || k) = 'VARCHAR' THEN 'STRING' ELSE json_type(p, '$.' || k) END"


@query(f"""WITH r AS (SELECT props AS p FROM events UNION ALL SELECT '{{"k": "' || event_type || '", "user": ' || user_id || ', "late": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'null' END || '}}' FROM events WHERE event_id % 10 = 0),
f AS (SELECT k AS field, replace({_FOUND}, 'NULL', 'VOID') AS found, count(*) AS records FROM (SELECT p, unnest(json_keys(p)) AS k FROM r) GROUP BY 1, 2), t AS (SELECT * FROM (VALUES ('k', 'BIGINT'), ('user', 'BIGINT'), ('tags', 'ARRAY<STRING>')) v(field, stored))
SELECT field, stored, found, coalesce(records, 0) AS records, CASE WHEN found IS NULL THEN 'missing' WHEN stored IS NULL THEN 'new' WHEN stored <> found THEN 'retyped' WHEN records < (SELECT count(*) FROM r) THEN 'partial' ELSE 'same' END AS status FROM t FULL JOIN f USING (field)""")
def props_drift(spark, sf_dir):
    """Events' properties, and those of a later version for every tenth, against a stored schema."""
    e = table(spark, sf_dir, "events")
    later = F.concat(F.lit('{"k": "'), "event_type", F.lit('", "user": '), "user_id", F.lit(', "late": '), F.when(F.col("event_id") % 2 == 0, "true").otherwise("null"), F.lit("}"))
    rows = e.select("props").unionByName(e.where("event_id % 10 = 0").select(later.alias("props")))
    return validation.schema_drift(rows, "props", "k bigint, user bigint, tags array<string>")


@query(f"""SELECT count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, true AS passed FROM (SELECT is_valid AS ok FROM ({CLEANED_SQL}))""")
def validity_gate(spark, sf_dir):
    return validation.validity_gate(reports.cleaned_documents(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"""SELECT run, metric, abs(now - was) / was AS change FROM (
 SELECT run, unnest([{', '.join(f"{{'metric': '{m}', 'now': {m}::double, 'was': (lag({m}) OVER (ORDER BY run))::double, 'most': {x}::double}}" for m, x in validation.THRESHOLDS.items())}], recursive := true)
 FROM (SELECT *, CAST(video_id AS bigint) AS run FROM ({SEGMENT_STATS_SQL}))) WHERE was <> 0 AND abs(now - was) / was > most""")
def run_anomalies(spark, sf_dir):
    runs = segments.segment_statistics(segments_view(spark, sf_dir)).withColumn("run", F.col("video_id").cast("long"))
    return validation.run_anomalies(runs, "run")


CHOPPED_SQL = "SELECT doc_id, unnest(c) AS content, generate_subscripts(c, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text || chr(10) || ' ' || chr(9) || chr(10), chr(10)) AS c FROM documents)"


@query(f"SELECT doc_id, pos, 'Empty content in ' || doc_id || ', chunk ' || pos AS message FROM ({CHOPPED_SQL}) WHERE trim(content, {ENDS}) = ''")
def empty_content(spark, sf_dir):
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat("text", F.lit("\n \t\n")), "\n")).alias("pos", "content"))
    return validation.empty_chunks(lines, "doc_id", "pos", "content")


BAD_SEGMENTS = f"""SELECT 'Segment ' || id || ' of ' || video_id AS m FROM ({SEGMENTS_SQL}) WHERE "start" >= "end" """


@query(f"SELECT m AS message, row_number() OVER (ORDER BY m) AS number, count(*) OVER () AS total FROM ({BAD_SEGMENTS})")
def anomaly_report(spark, sf_dir):
    """All anomalies in order, a row each."""
    bad = segments_view(spark, sf_dir).where("start >= `end`")
    return reports.anomaly_list(bad.select(F.concat(F.lit("Segment "), "id", F.lit(" of "), "video_id").alias("message")))


@query(f"SELECT count(*) AS anomaly_count, list(m ORDER BY m) AS anomalies FROM ({BAD_SEGMENTS} AND video_id::bigint % 10 = 0)")
def anomaly_summary(spark, sf_dir):
    """The report of some records' anomalies in one row, whole."""
    bad = segments_view(spark, sf_dir).where("start >= `end` and video_id % 10 = 0")
    return reports.anomaly_report(bad.select(F.concat(F.lit("Segment "), "id", F.lit(" of "), "video_id").alias("message")), most=None)


@query(f"""SELECT count(*) AS n, 'Data Pipeline Anomalies Detected:' || chr(10) || chr(10) || array_to_string(list('- ' || m ORDER BY m)[:1000], chr(10)) || CASE WHEN count(*) > 1000 THEN chr(10) || '... and ' || (count(*) - 1000) || ' more' ELSE '' END AS message
 FROM (SELECT 'Segment ' || id || ' of ' || video_id AS m FROM ({SEGMENTS_SQL}) WHERE "start" >= "end") HAVING count(*) > 0""")
def alert_message(spark, sf_dir):
    bad = segments_view(spark, sf_dir).where("start >= `end`")
    return validation.alert_message(bad.select(F.concat(F.lit("Segment "), "id", F.lit(" of "), "video_id").alias("message")))


# Bias and fairness -------------------------------------------------------------------------------

_TERMS = ", ".join(quoted(t) for t in bias.TERMS)


def _sql_terms(rows: str, key: str) -> str:
    return f"""SELECT k.{key}, t.term, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT {key} FROM ({rows})) k CROSS JOIN (SELECT unnest([{_TERMS}]) AS term) t
     LEFT JOIN (SELECT {key}, w AS term, count(*) AS n FROM (SELECT {key}, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+')) AS w FROM ({rows})) GROUP BY ALL) c
     ON c.{key} IS NOT DISTINCT FROM k.{key} AND c.term = t.term"""


@query(_sql_terms("documents", "source"))
def term_frequency(spark, sf_dir):
    return bias.term_frequency(table(spark, sf_dir, "documents"), F.col("text"), ["source"])


@query(_sql_terms("SELECT conv_id, text FROM conversations WHERE conv_id % 3 <> 0 UNION ALL SELECT DISTINCT conv_id, 'He said she and the guys, a man' FROM conversations WHERE conv_id % 3 = 0", "conv_id"))
def transcript_bias(spark, sf_dir):
    """A third of the records have a whole text, which counts instead of their segments."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("segments"))
    whole = bias.transcript_text(F.when(F.col("conv_id") % 3 == 0, F.lit("He said she and the guys, a man")), F.col("segments"))
    return bias.term_frequency(c, whole, ["conv_id"])


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY ALL")
def speaker_balance(spark, sf_dir):
    return bias.speaker_balance(table(spark, sf_dir, "conversations"), "conv_id", "role")


FAIRNESS_SQL = """SELECT d.doc_id, d.lang, d.source, l.quality AS y_true, CASE WHEN d.n_chars >= 400 AND l.toxic = 0 THEN 1 ELSE 0 END AS y_pred
 FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""
FEATURES = ["lang", "source"]


def fairness_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    rows = d.join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.select("doc_id", "lang", "source", F.col("quality").alias("y_true"), ((F.col("n_chars") >= 400) & (F.col("toxic") == 0)).cast("int").alias("y_pred"))


def _sql_features(rows: str) -> str:
    return " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value, count(*) AS n FROM ({rows}) GROUP BY {f}" for f in FEATURES)


def _sql_distribution(rows: str) -> str:
    return f"SELECT feature, value, n, n / sum(n) OVER (PARTITION BY feature) * 100 AS percent FROM ({_sql_features(rows)})"


def _sql_ratio(rows: str) -> str:
    return f"SELECT feature, sum(n)::bigint AS total, count(*) AS distinct_values, max(n) / min(n) AS ratio FROM ({_sql_features(rows)}) GROUP BY feature"


@query(_sql_distribution(FAIRNESS_SQL))
def distribution(spark, sf_dir):
    return bias.distribution(fairness_view(spark, sf_dir), FEATURES)


@query(_sql_ratio(FAIRNESS_SQL))
def imbalance(spark, sf_dir):
    return bias.imbalance(fairness_view(spark, sf_dir), FEATURES)


_MEASURES = "count(*) AS n, avg((y_true = y_pred)::int) AS accuracy, avg((y_pred = 1)::int) AS selection_rate"


@query(" UNION ALL ".join([*(f"SELECT '{f}' AS feature, {f} AS value, {_MEASURES} FROM ({FAIRNESS_SQL}) GROUP BY {f}" for f in FEATURES), f"SELECT 'overall', NULL, {_MEASURES} FROM ({FAIRNESS_SQL})"]))
def fairness_metrics(spark, sf_dir):
    return bias.fairness_metrics(fairness_view(spark, sf_dir), "y_true", "y_pred", FEATURES)


_PICKED = f"SELECT * FROM ({FAIRNESS_SQL}) WHERE y_pred = 1"


@query(f"""SELECT b.feature, b.value, b.n AS n_before, coalesce(a.n, 0) AS n_after, rb.ratio AS ratio_before, ra.ratio AS ratio_after, rb.ratio - ra.ratio AS improvement
 FROM ({_sql_features(FAIRNESS_SQL)}) b LEFT JOIN ({_sql_features(_PICKED)}) a USING (feature, value) JOIN ({_sql_ratio(FAIRNESS_SQL)}) rb USING (feature) JOIN ({_sql_ratio(_PICKED)}) ra USING (feature)""")
def fairness_report(spark, sf_dir):
    v = fairness_view(spark, sf_dir)
    return bias.fairness_report(v, v.where("y_pred = 1"), FEATURES)


# Sampling ----------------------------------------------------------------------------------------


def _sql_oversampled(columns: list[str], target: str) -> str:
    by = ", ".join(columns)
    return f"""SELECT doc_id, {by}, unnest(generate_series(0, CASE WHEN n >= t THEN 0 ELSE (t - n) // n + CASE WHEN i < (t - n) % n THEN 1 ELSE 0 END END)) AS copy FROM (
     SELECT doc_id, {by}, n, {target} AS t, row_number() OVER (PARTITION BY {by} ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i
     FROM (SELECT doc_id, {by}, count(*) OVER (PARTITION BY {by}) AS n FROM documents))"""


@query(_sql_oversampled(["lang"], "max(n) OVER ()"))
def oversample_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.oversample(d, "lang", "doc_id")


@query(f"SELECT lang, count(*) AS n FROM ({_sql_oversampled(['lang'], '(SELECT count(*) // count(DISTINCT lang) FROM documents)')}) GROUP BY lang")
def oversample_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return sampling.oversample(d, "lang", "doc_id", "equal").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(_sql_oversampled(["lang", "source"], "max(n) OVER ()"))
def oversample_composite(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.oversample_groups(d, ["lang", "source"], "doc_id")


@query("""SELECT doc_id, lang, source FROM (SELECT *, count(*) OVER (PARTITION BY lang, source) AS n, count(*) OVER () AS total,
 row_number() OVER (PARTITION BY lang, source ORDER BY md5('42:' || doc_id), doc_id) AS i FROM documents)
 WHERE i <= greatest(1, least(CAST(trunc(200.0::double * (n / total)) AS bigint), n))""")
def stratified_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    return sampling.stratified_sample(d, 200, ["lang", "source"], "doc_id")


@query()
def smote(spark, sf_dir):
    return sampling.smote(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"), "label", "embedding", "vec_id")


# Selection, pages, urls --------------------------------------------------------------------------

_KEY = "|".join(selection.KEYWORDS)


@query("""SELECT p_partkey, p_name FROM (SELECT p_partkey, p_name, regexp_matches(lower(p_name), 'ring|bolt') AS r FROM part) ORDER BY r DESC, p_partkey LIMIT 50""")
def relevant_topk(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("_r", selection.is_relevant(F.col("p_name"), F.lit(""), None, ("ring", "bolt")))
    return selection.select_posts(p, 50, "p_partkey", "_r").select("p_partkey", "p_name")


@query(f"""SELECT doc_id, regexp_matches(lower(substr(text, 1, 60)), '{_KEY}') OR regexp_matches(lower(text), '{_KEY}') OR regexp_matches(lower(source), '{_KEY}') AS relevant FROM documents""")
def relevance(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", selection.is_relevant(F.substring("text", 1, 60), F.col("text"), F.array("source")).alias("relevant"))


@query(f"""SELECT 'doc/' || doc_id AS url, text AS content, substr(text, 1, 40) AS title, source AS author, [lang] AS categories, substr(text, 1, 500) AS summary, length(text) AS content_length, {sql_words('text')} AS word_count,
 regexp_matches(lower(text), '{_KEY}') AS is_relevant FROM documents WHERE length(text) >= 100""")
def posts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("link", F.concat(F.lit("doc/"), "doc_id"))
    none = F.lit(None).cast("string")
    entries = d.select(F.substring("text", 1, 40).alias("title"), "link", F.col("text").alias("summary"), none.alias("published"), none.alias("updated"), F.col("source").alias("author"), F.array(F.struct(F.col("lang").alias("term"))).alias("tags"))
    out = selection.posts(entries, d.select("link", F.col("text").alias("content")))
    meta, proc = [f"metadata.{c}" for c in ("url", "title", "author", "categories", "summary")], [f"processing.{c}" for c in ("content_length", "word_count", "is_relevant")]
    return out.select("content", *meta, *proc)


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    title = F.when(F.col("p_partkey") % 11 == 0, "[Private video]").when(F.col("p_partkey") % 13 != 0, F.col("p_name"))
    return p.select(F.when(F.col("p_partkey") % 17 != 0, F.col("p_partkey").cast("string")).alias("video_id"), title.alias("title"))


LISTING_SQL = """SELECT CASE WHEN p_partkey % 17 <> 0 THEN CAST(p_partkey AS varchar) END AS video_id,
 CASE WHEN p_partkey % 11 = 0 THEN '[Private video]' WHEN p_partkey % 13 <> 0 THEN p_name END AS title FROM part"""


@query(f"""SELECT video_id, coalesce(title, 'Unknown Title') AS title FROM ({LISTING_SQL}) WHERE video_id IS NOT NULL AND coalesce(title, '') <> '[Private video]'
 AND video_id NOT IN (SELECT CAST(p_partkey AS varchar) FROM part WHERE p_partkey % 3 = 0)""")
def pending_videos(spark, sf_dir):
    done = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.col("p_partkey").cast("string").alias("video_id"))
    return selection.pending_videos(listing(spark, sf_dir), done)


@query(f"""SELECT CASE WHEN video_id IS NULL OR title = '[Private video]' THEN 'skipped' WHEN video_id::bigint % 3 = 0 THEN 'successful' WHEN video_id::bigint % 5 = 0 THEN 'failed' ELSE 'pending' END AS status, count(*) AS n FROM ({LISTING_SQL}) GROUP BY 1""")
def video_status(spark, sf_dir):
    keys = lambda n: table(spark, sf_dir, "part").where(f"p_partkey % {n} = 0").select(F.col("p_partkey").cast("string").alias("video_id"))
    return selection.video_status(listing(spark, sf_dir), keys(3), keys(5))


def _sql_content(x: str) -> str:
    x = f"regexp_extract({x}, '(?s)<article[^>]*>(.*?)</article>', 1)"
    for tag in html.LEFT_OUT:
        x = f"regexp_replace({x}, '(?s)<{tag}\\b.*?</{tag}>', chr(10), 'g')"
    x = f"regexp_replace(regexp_replace({x}, '(?s)<!--.*?-->', chr(10), 'g'), '<[^>]+>', chr(10), 'g')"
    for entity, sign in (("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "'\"'"), ("&nbsp;", "chr(160)"), ("&#39;", "''''"), ("&amp;", "'&'")):
        x = f"replace({x}, '{entity}', {sign})"
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l, {ENDS})), lambda l: l <> ''), chr(10))"


def variants(df: DataFrame, column: str, **more: Column) -> DataFrame:
    """page_id, kind and html: every page as it is (kind `own`), and once more for each variant of it."""
    kinds = F.array(F.struct(F.lit("own").alias("kind"), F.col(column).alias("html")), *(F.struct(F.lit(k).alias("kind"), v.alias("html")) for k, v in more.items()))
    return df.select("page_id", F.inline(kinds))


@query(f"SELECT page_id, 'own' AS kind, {_sql_content('html')} AS content FROM pages UNION ALL SELECT page_id, 'main', 'Main' || chr(10) || 'part' FROM pages")
def page_content(spark, sf_dir):
    """Every page as it is, and once more with a <main>, which comes before <article>."""
    pages = table(spark, sf_dir, "pages")
    main = F.concat(F.lit("<main><nav>x</nav> Main<p>part</p></main>"), F.col("html"))
    return variants(pages, "html", main=main).select("page_id", "kind", html.content(F.col("html")).alias("content"))


@query(f"SELECT page_id, {_sql_content('html')} AS content FROM pages")
def article_content(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", html.article_content(F.col("html")).alias("content"))


@query(f"""SELECT page_id, unnest(['own', 'main']) AS kind, {_sql_content('html')} AS content FROM pages UNION ALL SELECT page_id, 'class', 'Inner' FROM pages
 UNION ALL SELECT page_id, 'role', 'Role' FROM pages UNION ALL SELECT page_id, 'none', NULL FROM pages""")
def post_content(spark, sf_dir):
    """Every page as it is, with a <main> behind which its article still comes first; and posts with a class before a <main>, with a
    role alone, and without any content."""
    held = variants(
        table(spark, sf_dir, "pages"), "html", main=F.concat(F.lit("<main>Main</main>"), F.col("html")),
        **{"class": F.lit("<body><main>Main</main><div class='a content b'>Inner</div></body>")}, role=F.lit('<body>text<div role="main">Role</div></body>'), none=F.lit("<p>no body</p>"),
    )
    return held.select("page_id", "kind", html.post_content(F.col("html")).alias("content"))


@query("""SELECT page_id, 'own' AS kind, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages UNION ALL SELECT page_id, 'heading', 'Head ' || page_id FROM pages
 UNION ALL SELECT page_id, 'none', 'Untitled' FROM pages""")
def page_title(spark, sf_dir):
    """Every page as it is, and once more with a heading alone, and with neither title nor heading."""
    head = F.concat(F.lit("<h1 class='x'> Head <b>"), F.col("page_id").cast("string"), F.lit("</b></h1>"))
    return variants(table(spark, sf_dir, "pages"), "html", heading=head, none=F.lit("<p>none</p>")).select("page_id", "kind", html.title(F.col("html")).alias("title"))


@query("""SELECT DISTINCT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS link FROM (
 SELECT page_id, url, unnest(regexp_extract_all(html, '<a[^>]*href="([^"]*)"', 1)) AS h FROM pages) WHERE h LIKE '/%'
 AND NOT regexp_matches(lower(url[1:0] || h), '#|\\.pdf|\\.zip|mailto:|javascript:')
UNION SELECT page_id, CASE WHEN regexp_matches(url, '^[a-z]+://[^/?#]*/') THEN regexp_extract(url, '^([^?#]*/)', 1) ELSE regexp_extract(url, '^([^?#]*)', 1) || '/' END || 'side.html' FROM pages
UNION SELECT page_id, 'https://other.org/x' FROM pages""")
def page_links(spark, sf_dir):
    """Each page's own links, and a relative one, one to another host, and three that are not followed."""
    more = '<a href="side.html">s</a><a class="b" href="https://other.org/x">o</a><a href="#top">t</a><a href="file.PDF">p</a><a href="mailto:x@y">m</a>'
    return html.links(table(spark, sf_dir, "pages").withColumn("html", F.concat("html", F.lit(more))))


@query("SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section, substr(md5(url), 1, 8) AS file_id FROM pages")
def url_section(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.section(F.col("url")).alias("section"), U.file_id(F.col("url")).alias("file_id"))


VIDEO_URLS = (
    ("https://www.youtube.com/watch?v=abcdefghijk&t=3", "abcdefghijk"),
    ("https://youtube.com/watch?t=3&v=a%20b", "a b"),
    ("https://youtube.com/watch?x=1", None),
    ("https://youtube.com/shorts/xyz", "xyz"),
    ("https://youtu.be/short1?si=2", "short1"),
    (" abcdefghij1 ", "abcdefghij1"),
    ("https://example.com/watch?v=1", None),
    ("", None),
)


@query("SELECT * FROM (VALUES " + ", ".join(f"({quoted(u)}, {'NULL' if v is None else quoted(v)})" for u, v in VIDEO_URLS) + ") t(url, video) UNION ALL SELECT url, NULL FROM pages")
def video_id(spark, sf_dir):
    rows = spark.createDataFrame([(u,) for u, _ in VIDEO_URLS], "url string").unionByName(table(spark, sf_dir, "pages").select("url"))
    return rows.select("url", U.video_id(F.col("url")).alias("video"))


@query(r"""SELECT doc_id, printf('%03d_', doc_id) || substr(trim(regexp_replace(text, '[^\p{L}\p{N} _-]', '', 'g'), ' '), 1, 100) || '.txt' AS name FROM documents""")
def safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", U.numbered_file_name(F.col("doc_id"), F.col("text")).alias("name"))


LINKS_SQL = """SELECT e.src, s.section AS src_section, e.dst, d.section AS dst_section FROM (
 SELECT page_id AS src, 2 * page_id + 1 AS dst FROM pages UNION SELECT page_id, 2 * page_id + 2 FROM pages UNION SELECT page_id, (page_id * 7 + 3) % (SELECT count(*) FROM pages) FROM pages) e
 JOIN (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM pages) s ON e.src = s.page_id
 JOIN (SELECT page_id, regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section FROM pages) d ON e.dst = d.page_id"""


def link_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", U.section(F.col("url")).alias("section"))
    i = F.col("page_id")
    edges = p.select(i.alias("src"), F.explode(F.array(2 * i + 1, 2 * i + 2, (i * 7 + 3) % max(1, p.count()))).alias("dst")).distinct()
    side = lambda n: p.select(i.alias(n), F.col("section").alias(f"{n}_section"))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


@query(f"""WITH RECURSIVE g AS ({LINKS_SQL}), r(page) AS (SELECT 1::bigint UNION SELECT g.dst FROM r JOIN g ON g.src = r.page AND g.src_section = g.dst_section)
 SELECT page FROM r""")
def crawl_bfs(spark, sf_dir):
    return crawl.crawl(link_graph(spark, sf_dir), 1).select("page")


#: Three crawls at once, two of them in one section where pages are contested; pages of each, rounds of all.
STARTS, QUOTA, ROUNDS = ((0, 1), (1, 2), (2, 11)), 40, 6


def sql_rounds(links: str, readable: str = "true") -> str:
    """start, page, position, round of a crawl of STARTS over links (src, dst), a round a step: queues q, pages taken t, pages read s."""
    parts = [f"g AS ({links})", "q1 AS (SELECT s::integer AS s, page::bigint AS page, 0 AS found, 0 AS parent, 0::bigint AS number FROM (VALUES " + ", ".join(map(str, STARTS)) + ") v(s, page))", "s0 AS (SELECT 0 AS s, 0::bigint AS page, 0 AS position, 0 AS round WHERE false)"]
    for r in range(1, ROUNDS + 1):
        parts += [
            f"k{r} AS MATERIALIZED (SELECT q.s, q.page, row_number() OVER (PARTITION BY q.s ORDER BY found, parent, number, page) AS rank, coalesce(d.done, 0) AS done FROM q{r} q LEFT JOIN (SELECT s, count(*) AS done FROM s{r - 1} GROUP BY s) d ON d.s = q.s)",
            f"t{r} AS MATERIALIZED (SELECT s, page, rank, done FROM (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s) AS i FROM k{r} WHERE rank + done <= {QUOTA}) WHERE i = 1)",
            f"f{r} AS MATERIALIZED (SELECT s, page, (row_number() OVER (PARTITION BY s ORDER BY rank) + done)::integer AS position, {r} AS round FROM t{r} WHERE {readable})",
            f"s{r} AS MATERIALIZED (SELECT * FROM s{r - 1} UNION ALL SELECT * FROM f{r})",
            f"""q{r + 1} AS MATERIALIZED (SELECT s, page, min(o).a AS found, min(o).b AS parent, min(o).c AS number FROM (
  SELECT s, page, {{'a': found, 'b': parent, 'c': number}} AS o FROM q{r} WHERE NOT EXISTS (SELECT 1 FROM t{r} t WHERE t.s = q{r}.s AND t.page = q{r}.page)
  UNION ALL SELECT f.s, g.dst, {{'a': {r}, 'b': f.position, 'c': g.dst}} FROM f{r} f JOIN g ON g.src = f.page) WHERE page NOT IN (SELECT page FROM s{r}) GROUP BY s, page)""",
        ]
    return "WITH " + ",\n".join(parts) + f"\nSELECT s AS start, page, position, round FROM s{ROUNDS}"


INSIDE_SQL = f"SELECT DISTINCT src, dst FROM ({LINKS_SQL}) WHERE src_section = dst_section"


@query(sql_rounds(INSIDE_SQL))
def crawl_quota(spark, sf_dir):
    """Several sections crawled at once, each up to a number of pages."""
    starts = spark.createDataFrame(STARTS, "start int, page long")
    return crawl.crawl_sections(link_graph(spark, sf_dir), starts, QUOTA, ROUNDS)


@query("SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
def unseen_urls(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    return crawl.unseen(p, p.where("page_id % 2 = 0"))


# Reports, streams --------------------------------------------------------------------------------

STAGES_SQL = f"""SELECT 'documents' AS stage, count(*) AS n FROM documents UNION ALL SELECT 'pages', count(*) FROM pages UNION ALL SELECT 'conversations', count(*) FROM conversations
 UNION ALL SELECT 'chunks', count(*) FROM ({CHUNKS_SQL})"""


def _stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = {n: table(spark, sf_dir, n) for n in ("documents", "pages", "conversations")}
    return reports.stage_counts(held | {"chunks": chunking.exploded(held["documents"], "doc_id", "text")})


@query(STAGES_SQL)
def pipeline_stats(spark, sf_dir):
    return _stages(spark, sf_dir)


@query(f"SELECT bool_and(n > 0) AS all_present, sum(n)::bigint AS total FROM ({STAGES_SQL})")
def stage_validity(spark, sf_dir):
    return reports.stage_validity(_stages(spark, sf_dir))


@query(f"SELECT count(*) AS total, count(*) FILTER (c <> '') AS successful, count(*) FILTER (c = '') AS failed, count(*) FILTER (regexp_matches(lower(c), '{_KEY}')) AS relevant FROM (SELECT {_sql_content('html')} AS c FROM pages)")
def fetch_summary(spark, sf_dir):
    c = table(spark, sf_dir, "pages").select(html.content(F.col("html")).alias("c"))
    return reports.fetch_summary(c, F.col("c") != "", selection.is_relevant(F.col("c"), F.lit("")))


@query("""SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n, sum(value) AS total FROM (
 SELECT *, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s
 FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events)) GROUP BY user_id, s""")
def event_sessions(spark, sf_dir):
    out = streams.sessions(table(spark, sf_dir, "events"))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")}).withColumn("total", F.col("total"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return streams.windowed_counts(table(spark, sf_dir, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))
