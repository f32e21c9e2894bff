"""URL rules decided by a Bloom filter cascade.

A rule is a host (which stands for its subdomains too) and a path prefix. A url has a few candidate keys: each suffix of its
host at a label border with each path prefix of a length that rules have. The distinct candidate keys of the whole corpus are
the key universe. Level 1 of a cascade encodes the listed keys of the universe, level 2 the unlisted keys that level 1 lets
pass, level 3 the listed keys that level 2 lets pass, and so on until nothing passes wrongly. A key of the universe is listed
exactly if the first level that rejects it is an even one, so each url is judged by a few bit tests and no join. Level 1 is
sized so that about as many unlisted keys pass as are listed; each further level lets half of what it should not hold
pass. So filters grow with the listed keys and the logarithm of the universe, not with the corpus.
"""

from __future__ import annotations

import math
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix64, temporary, written

#: Bits of the smallest filter.
LEAST_BITS = 64
#: The rules of the query.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; null or no `://`: empty."""
    h = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(h, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; null or no `://`: empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host.lower(), slash + path


def suffixes_of(host: Column, host_labels: int) -> Column:
    """The host and its suffixes at label borders, of host_labels labels at most, the most that any rule has: a longer one can't equal a
    rule, and a host of very many labels costs no more than a short one."""
    labels = F.reverse(F.slice(F.reverse(F.split(host, r"\.")), 1, max(1, host_labels)))
    n = F.size(labels)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))


def candidate_keys(suffixes: Column, path: Column, path_lengths: list[int]) -> Column:
    """Keys `host suffix + path prefix` of a url, longest first (equal lengths: the longer host first)."""
    held = F.filter(F.array(*map(F.lit, path_lengths)).cast("array<int>"), lambda k: k <= F.length(path))

    def with_prefix(k: Column) -> Column:
        return F.transform(suffixes, lambda s: F.struct((-F.length(s) - k).alias("n"), (-F.length(s)).alias("h"), F.concat(s, F.substring(path, F.lit(1), k)).alias("key")))

    return F.transform(F.array_sort(F.flatten(F.transform(held, with_prefix))), lambda x: x["key"])


class Bloom:
    """A filter for so many keys that lets about the share `rate` of all others pass."""

    def __init__(self, keys: int, rate: float, salt: int):
        self.hashes = max(1, round(-math.log2(rate)))
        self.bits = max(LEAST_BITS, 64 * math.ceil(keys * self.hashes / math.log(2) / 64))
        self.salt = salt
        self.words = np.zeros(self.bits // 64, np.uint64)

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        with np.errstate(over="ignore"):
            a = mix64(h.astype(np.uint64) + np.uint64(self.salt * 2 + 1))
            b = mix64(a) | np.uint64(1)
            return [(a + np.uint64(i) * b) % np.uint64(self.bits) for i in range(self.hashes)]

    def has(self, h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for at in self.places(h):
            ok &= (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return ok


def _filled(bloom: Bloom, hashes: DataFrame) -> Bloom:
    """Set the bits of all keys; words are OR-ed in the cluster, and what comes back is no larger than the filter."""

    def words(batches):
        own = np.zeros_like(bloom.words)
        for b in batches:
            for at in bloom.places(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)):
                np.bitwise_or.at(own, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
        at = np.flatnonzero(own)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own[at].view(np.int64))], ["at", "word"])

    found = hashes.mapInArrow(words, "at long, word long").groupBy("at").agg(F.bit_or("word").alias("word")).toArrow()
    bloom.words[found.column("at").to_numpy()] = found.column("word").to_numpy().view(np.uint64)
    return bloom


class Cascade:
    """levels[0] encodes listed keys, levels[1] unlisted ones that pass it, and so on."""

    def __init__(self, levels: list[Bloom]):
        self.levels = levels

    def has(self, h: np.ndarray) -> np.ndarray:
        listed = np.zeros(len(h), bool)
        left = np.arange(len(h))
        for i, level in enumerate(self.levels):
            ok = level.has(h[left])
            listed[left[~ok]] = i % 2 == 1
            left = left[ok]
        listed[left] = len(self.levels) % 2 == 1
        return listed


def build_cascade(universe: DataFrame) -> Cascade:
    """universe: distinct keys as (h long, listed boolean), complete, no listed key with the hash of an unlisted one. Exact for these keys."""
    with temporary(universe.sparkSession):
        levels, pool = [], universe
        n = {r["listed"]: r["n"] for r in universe.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        rate = min(0.5, max(1, n.get(True, 0)) / max(1, n.get(False, 0)))
        while n.get(len(levels) % 2 == 0, 0):
            turn = len(levels) % 2 == 0
            level = _filled(Bloom(n[turn], rate if not levels else 0.5, len(levels)), pool.where(F.col("listed") == turn).select("h"))
            levels.append(level)

            def passing(batches, level=level, turn=turn):
                for b in batches:
                    keep = (b.column(1).to_numpy(zero_copy_only=False) == turn) | level.has(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
                    yield b.filter(pa.array(keep))

            pool = written(pool.mapInArrow(passing, "h long, listed boolean"), "cascade")
            n = {r["listed"]: r["n"] for r in pool.groupBy("listed").agg(F.count(F.lit(1)).alias("n")).collect()}
        return Cascade(levels)


def rule_table(spark: SparkSession, rules: DataFrame | tuple[tuple[str, str], ...]) -> DataFrame:
    """k (host, lower-cased in A-Z, and path), host, path, verdict of rules (rule, verdict), a row a rule. A rule that is given twice has the
    verdict of the last in a list, and in a table, which has no order, blocks if any says so. Null rules are left out."""
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([(r, v, i) for i, (r, v) in enumerate(rules)], "rule string, verdict string, nth long")
    else:
        rules = rules.select("rule", "verdict", F.when(F.col("verdict") == "block", 1).otherwise(0).cast("long").alias("nth"))
    host = F.translate(F.regexp_extract("rule", "(?s)^([^/]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = rules.where("rule is not null").select(host.alias("host"), F.regexp_extract("rule", "(?s)^[^/]*(.*)$", 1).alias("path"), "verdict", "nth")
    rows = rows.groupBy("host", "path").agg(F.max_by("verdict", "nth").alias("verdict"))
    return rows.withColumn("k", F.concat("host", "path"))


def _seed(keys: DataFrame) -> int:
    """The first seed under which no unlisted key of keys (k, listed) has the hash of a listed one."""
    for seed in count():
        if keys.groupBy(F.xxhash64("k", F.lit(seed)).alias("h")).agg(F.min("listed").alias("a"), F.max("listed").alias("b")).where("a != b").isEmpty():
            return seed


def filter_urls(pages: DataFrame, rules: DataFrame | tuple[tuple[str, str], ...] = RULES, key: str = "page_id") -> DataFrame:
    """key, host, path, rule, verdict for every row of pages (columns key and url; others are ignored).

    rules: a table (rule, verdict), of any length, or a short list. The longest fitting rule gives the verdict; without one the
    cascade does: a key that is not listed is allowed. Which keys of the corpus are listed is told once, by a join when the cascades
    are built; urls are judged by the cascades alone, which every task holds: some bits for each listed key that occurs. Null urls and urls
    without `://` have empty host and path, which no rule fits. Urls of any length are read whole. Repeated rows stay. An empty
    table gives no rows; without rules, all urls are allowed.
    """
    spark = pages.sparkSession
    with temporary(spark):
        listed = written(rule_table(spark, rules), "rules")
        labels = listed.agg(F.max(F.size(F.split("host", r"\."))).alias("n")).first()["n"] or 1
        lengths = sorted(r["n"] for r in listed.select(F.length("path").alias("n")).distinct().collect())  # as many as paths have lengths
        rows = pages.select(F.col(key), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
        rows = rows.withColumn("suffixes", suffixes_of(F.col("host"), labels))
        rows = rows.withColumn("keys", candidate_keys(F.col("suffixes"), F.col("path"), lengths) if lengths else F.array().cast("array<string>")).drop("suffixes")
        told = listed.select("k", F.lit(True).alias("listed"), (F.col("verdict") == "block").alias("block"))
        told = told.groupBy("k").agg(F.max("listed").alias("listed"), F.max("block").alias("block"))
        universe = rows.select(F.explode("keys").alias("k")).distinct().join(told, "k", "left")
        universe = written(universe.select("k", F.coalesce("listed", F.lit(False)).alias("listed"), F.coalesce("block", F.lit(False)).alias("block")), "universe")
        seed = _seed(universe)
        hashed = F.xxhash64("k", F.lit(seed)).alias("h")
        fits = build_cascade(universe.select(hashed, "listed"))
        blocks = build_cascade(universe.where("listed").select(hashed, F.col("block").alias("listed")))
        shared = spark.sparkContext.broadcast((fits, blocks))

    def judge(batches):
        fits, blocks = shared.value
        for b in batches:
            h = b.column("hashes")
            flat, offsets = h.flatten().to_numpy(zero_copy_only=False).view(np.uint64), h.offsets.to_numpy()
            offsets = offsets - offsets[0]
            hit = np.flatnonzero(fits.has(flat))
            at = np.searchsorted(hit, offsets[:-1])
            first = hit[np.minimum(at, max(len(hit) - 1, 0))] if len(hit) else np.zeros(len(at), int)
            found = (at < len(hit)) & (first < offsets[1:]) if len(hit) else np.zeros(len(at), bool)
            bad = np.zeros(len(at), bool)
            if found.any():
                bad[found] = blocks.has(flat[first[found]])
            place = np.where(found, first - offsets[:-1] + 1, 0).astype("int32")
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column("host"), b.column("path"), b.column("keys"), pa.array(place), pa.array(np.where(bad, "block", "allow"))],
                [key, "host", "path", "keys", "place", "verdict"],
            )

    kind = dict(rows.dtypes)[key]
    out = rows.withColumn("hashes", F.transform("keys", lambda k: F.xxhash64(k, F.lit(seed))))
    out = out.mapInArrow(judge, f"{key} {kind}, host string, path string, keys array<string>, place int, verdict string")
    return out.select(key, "host", "path", F.when(F.col("place") > 0, F.get("keys", F.col("place") - 1)).alias("rule"), "verdict")


def filter_sql(rules: tuple[tuple[str, str], ...] = RULES) -> str:
    """The same over a table `pages`, as DuckDB SQL."""
    hits = []
    for (host, path), verdict in ((split_rule(r), v) for r, v in rules):
        h, p = host.replace("'", "''"), path.replace("'", "''")
        hits.append(f"SELECT '{h}' AS rh, '{p}' AS rp, '{verdict}' AS rv")
    return f"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
s AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM u),
t AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM s),
r AS ({" UNION ALL ".join(hits)}),
m AS (SELECT page_id, host, path, list({{'n': length(rh) + length(rp), 'h': length(rh), 'rule': rh || rp, 'v': rv}}
  ORDER BY length(rh) + length(rp) DESC, length(rh) DESC) AS hit
  FROM t JOIN r ON (t.host = rh OR ends_with(t.host, '.' || rh)) AND starts_with(t.path, rp) GROUP BY ALL)
SELECT t.page_id, t.host, t.path, hit[1].rule AS rule, coalesce(hit[1].v, 'allow') AS verdict
FROM t LEFT JOIN m USING (page_id, host, path)"""


