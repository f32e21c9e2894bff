"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, checked to be the same bytes for every record that shares the digest;
exact record headers are stored separately, one row a record. Records are rebuilt by joining the two on the digest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path

#: The base32 alphabet of RFC 4648 and the date that records carry (one date, so that reruns agree).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
RECORD_DATE = "2024-01-01T00:00:00Z"
CRLF = "\r\n"
#: For urls with signs that a header line can't hold: the escape itself, first, then those signs; and the line that says so.
ESCAPES = (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"))
ESCAPED = "X-Target-URI-Encoding: percent" + CRLF
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(hex40: Column) -> Column:
    """Bare upper-case base32 of a 160-bit hex digest: five hex digits are four base32 digits."""
    parts = []
    for g in range(8):
        v = F.conv(F.substring(hex40, 5 * g + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(BASE32), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write_archive(pages: DataFrame, path: str, min_revisit_bytes: int = 0, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write pages as an archive: path/payloads (sha256, payload; each once) and path/headers (one row a record).

    The payload is the html in UTF-8, null as empty. Among records with equal payloads of at least min_revisit_bytes the
    largest key is the response and the others are revisits that refer to it; smaller payloads are all responses. Null url: no
    target line; a url with CR or LF is percent-encoded in the header, which says so, and decoded when read. Null keys sort below all others. Rows
    that repeat the largest key of their payload are all responses. Record ids hold the key, or `none`, and a hash of the url and
    the payload, so that rows that share a key have ids of their own unless they are equal. A payload that very many records share is one
    row; joins against it rely on the splitting of skewed partitions. A digest shared by different bytes stops the job. An empty table
    gives an empty archive; other columns are ignored.
    """
    body = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b"").cast("binary"))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.select("key", "url", "payload", F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes"))
    thin = rows.drop("payload")
    # Each payload once: of equal digests, any whole value, which moves the bytes once; lengths and a second digest must agree.
    stored = rows.groupBy("sha256").agg(
        F.any_value("payload").alias("payload"), F.min("bytes").alias("least"), F.max("bytes").alias("most"), F.min("sha1").alias("first"), F.max("sha1").alias("last"), F.count(F.lit(1)).alias("records"),
    )
    same = (F.col("least") == F.col("most")) & (F.col("first") == F.col("last"))
    stored = stored.select("sha256", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("different payloads share "), F.col("sha256"))).cast("binary")).alias("payload"), "records")
    stored.write.option("compression", "zstd").parquet(f"{path}/payloads")
    # The largest key and its record's id; null keys come last.
    record_id = F.concat(F.lit("<urn:lodestone:page:"), F.coalesce(F.col("key").cast("string"), F.lit("none")), F.lit(":"), F.hex(F.xxhash64("url", F.isnull("url"), "sha256")), F.lit(">"))
    thin = thin.withColumn("id", record_id)
    owner = thin.groupBy("sha256").agg(F.max(F.struct(F.col("key").isNotNull().alias("has"), "key", "id")).alias("owner"))
    recs = thin.join(owner, "sha256")
    is_owner = F.col("key").eqNullSafe(F.col("owner.key"))
    revisit = (F.col("bytes") >= min_revisit_bytes) & ~is_owner
    sha1 = F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1")))
    kind = F.when(revisit, "revisit").otherwise("response")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat_ws(
        "",
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", kind),
        line("WARC-Record-ID", F.col("id")),
        line("WARC-Date", F.lit(RECORD_DATE)),
        F.when(F.col("url").rlike("[\r\n]"), F.concat(line("WARC-Target-URI", reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, F.col("url"))), F.lit(ESCAPED))).when(F.col("url").isNotNull(), line("WARC-Target-URI", F.col("url"))),
        line("WARC-Payload-Digest", sha1),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(REVISIT_PROFILE)), line("WARC-Refers-To", F.col("owner.id")))),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("bytes").cast("string"))),
        F.lit(CRLF),
    )
    recs.select("sha256", head.alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Records rebuilt: header, payload (whole, for revisits too), and the header's fields."""
    headers = spark.read.parquet(f"{path}/headers")
    payloads = spark.read.parquet(f"{path}/payloads").select("sha256", "payload")
    field = lambda name: F.regexp_extract("header", f"\\r\\n{name}: ([^\\r\\n]*)", 1)
    plain = reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), ESCAPES[::-1], field("WARC-Target-URI"))
    target = F.when(F.col("header").contains(ESCAPED), plain).when(F.col("header").contains("\r\nWARC-Target-URI: "), field("WARC-Target-URI"))
    number = lambda name: F.regexp_extract("header", f"\\r\\n{name}: <urn:lodestone:page:(-?[0-9]+):", 1).try_cast("long")
    return headers.join(payloads, "sha256").select(
        "sha256", "header", "payload",
        number("WARC-Record-ID").alias("key"), target.alias("url"), field("WARC-Type").alias("record_type"),
        F.regexp_extract("header", "\\r\\nWARC-Payload-Digest: sha1:([^\\r\\n]*)", 1).alias("payload_digest"), number("WARC-Refers-To").alias("refers_to"),
    )


def record_of(header: Column, record_type: Column, payload: Column) -> Column:
    """A whole WARC record as bytes: header, block (empty for revisits), two line ends."""
    end = F.lit((CRLF * 2).encode()).cast("binary")
    block = F.when(record_type == "revisit", F.lit(b"").cast("binary")).otherwise(payload)
    return F.concat(F.encode(header, "UTF-8"), block, end)


def record_bytes(records: DataFrame) -> DataFrame:
    return records.select("key", record_of(F.col("header"), F.col("record_type"), F.col("payload")).alias("record"))


def archive_round_trip(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write the archive to the shared folder, read it back, and describe every record from what was read.

    Each record's bytes are rebuilt, and its block is cut out of them by its own header: a block whose length or digest differs from what
    the header says (of revisits: a payload whose digest does) stops the job.
    """
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archive(pages, path, min_revisit_bytes)
    got = read_archive(spark, path).withColumn("record", record_of(F.col("header"), F.col("record_type"), F.col("payload")))
    said = F.regexp_extract("header", "\\r\\nContent-Length: ([0-9]+)\\r\\n", 1).cast("int")
    begin = F.octet_length(F.encode("header", "UTF-8"))
    got = got.withColumn("block", F.substring("record", begin + 1, said)).withColumn("whole", F.octet_length("record") == begin + said + 4)
    body = F.when(F.col("record_type") == "revisit", F.col("payload")).otherwise(F.col("block"))
    fine = F.col("whole") & (base32_of_hex(F.sha1(body)) == F.col("payload_digest"))
    return got.select(
        F.col("key").alias("page_id"), F.octet_length(body).cast("long").alias("payload_bytes"),
        F.when(fine, F.col("payload_digest")).otherwise(F.raise_error("a record does not match its header")).alias("payload_digest"),
        "record_type", "refers_to",
    )


def archive_sql() -> str:
    """archive_round_trip over a table `pages`, every payload counting, as DuckDB SQL."""
    digit = lambda g, shift: f"substr('{BASE32}', ((CAST('0x' || substr(h, {5 * g + 1}, 5) AS integer) >> {shift}) & 31) + 1, 1)"
    digest = " || ".join(digit(g, shift) for g in range(8) for shift in (15, 10, 5, 0))
    return f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, CAST(strlen(body) AS bigint) AS payload_bytes, {digest} AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p"""
