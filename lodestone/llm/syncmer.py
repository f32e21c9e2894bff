"""Document fingerprints from closed syncmers, in DataFrame functions only.

A text is read as tokens: of each run of non-blank characters, in turn, capitals with the small letters behind them, small letters,
digits, signs, or one letter of a script without cases, 16 of a kind at most; small letters also end behind q, x, j or z, and digits
behind a 0. So runs of any length are cut alike, by what stands there: what follows moves no cut, and a change only those up to the
next end. Of all runs of K tokens those are
chosen whose smallest inner run of S tokens, by hash, lies at the run's start or
end. Whether a run is chosen depends on its own tokens alone, so a passage yields the same anchors wherever it stands. A
fingerprint is all anchors, each with the number of the token that it starts at, and the likeness of two fingerprints is the
share of distinct anchors they have in common.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sql_hash import xxh64

K, S = 4, 2
CAPITAL, SMALL, SIGN = r"[\p{Lu}\p{Lt}]", r"[\p{Ll}\p{Lm}\p{M}]", r"[^\p{L}\p{N}\p{M}\x20\x09-\x0D]"
TOKENS = rf"{CAPITAL}{{0,16}}{SMALL}{{0,15}}?[qxjz]|{CAPITAL}{{0,16}}{SMALL}{{1,16}}|{CAPITAL}{{1,16}}|\p{{N}}{{0,15}}?0|\p{{N}}{{1,16}}|\p{{Lo}}|{SIGN}{{1,16}}"
#: Rows of a range of ids, and ranges at most (their borders are one array of longs); beyond both, ranges grow.
BUCKET, RANGES = 2000, 1 << 15


def with_sketch(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with the anchors of a text column, in its order: out (hashes) and out_at (numbers of the tokens they start at).

    No token: empty. No run chosen, or fewer than K tokens: one hash of all of them, at 0. Each step is a projection of its
    own, so that the arrays that lambdas read are made once a row.
    """
    inner = K - S + 1
    df = df.withColumn("_t", F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(TOKENS), F.lit(0)))
    t = F.col("_t")
    hashes = F.transform(F.sequence(F.lit(0), F.size(t) - S), lambda i: F.xxhash64(*[F.get(t, i + j) for j in range(S)]))
    df = df.withColumn("_h", F.when(F.size(t) >= K, hashes))
    h = F.col("_h")

    def anchor(first: Column, i: Column) -> Column:
        at = [first, *[F.get(h, i + j) for j in range(1, inner)]]
        edge = (at[0] <= F.least(*at[1:])) | (at[-1] <= F.least(*at[:-1]))
        return F.when((i <= F.size(h) - inner) & edge, F.xxhash64(first, *[F.get(h, i + j) for j in (*range(S, inner - 1, S), inner - 1)]))

    df = df.withColumn("_a", F.transform(h, anchor))
    a = F.col("_a")
    df = df.withColumn("_at", F.filter(F.transform(a, lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())).withColumn("_a", F.array_compact("_a"))
    chosen = F.coalesce(F.size(a) > 0, F.lit(False))
    all_of = F.when(F.size(t) > 0, F.array(F.xxhash64(F.array_join(t, " ")))).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn(out, F.when(chosen, a).otherwise(all_of))
    at_all = F.when(F.size(t) > 0, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return df.withColumn(f"{out}_at", F.when(chosen, F.col("_at")).otherwise(at_all)).drop("_t", "_h", "_a", "_at")


def likeness(a: Column, b: Column) -> Column:
    """Of the distinct anchors of both fingerprints together, the share that both hold (0 to 1); both empty: 1."""
    shared, both = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(shared / both)


def as_string(sketch: Column, at: Column) -> Column:
    """16 lowercase hex digits of the hash and 8 of the token's number an anchor, in the text's order."""
    return F.lower(F.array_join(F.zip_with(sketch, at, lambda x, i: F.concat(F.lpad(F.hex(x), 16, "0"), F.lpad(F.hex(i), 8, "0"))), ""))


def range_of(number: Column, borders: list[int]) -> Column:
    """How many borders (ascending) lie below the number, by binary search."""
    held = F.array(*map(F.lit, borders)).cast("array<bigint>")
    here = lambda s: F.floor((s["lo"] + s["hi"]) / 2).cast("int")

    def step(s: Column, _: Column) -> Column:
        above = (s["lo"] < s["hi"]) & (F.get(held, here(s)) < number)
        return F.struct(F.when(above, here(s) + 1).otherwise(s["lo"]).alias("lo"), F.when(above, s["hi"]).otherwise(F.when(s["lo"] < s["hi"], here(s)).otherwise(s["hi"])).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(borders)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(borders).bit_length() + 1)), start, step)["lo"]


def with_next(docs: DataFrame, carried: list[str], bucket: int = BUCKET, ranges: int = RANGES, made: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """docs with next_<c> for each carried column, from the next row by descending doc_id (ties by text); after the last, the first.
    made adds columns, that may be carried, to rows when they are dealt to their ranges.

    Ids are dealt to ranges by approximate quantiles, which only balance them; the first row of a range is also sent to the range
    above it, as what follows its last row. Null ids come last, in the lowest range. Rows that share one id share its range.
    """
    n = docs.select("doc_id").count()
    many = max(1, min(ranges, -(-n // bucket)))
    shares = F.array(*(F.lit(i / many) for i in range(1, many)))
    borders = docs.agg(F.percentile_approx("doc_id", shares, F.lit(20 * many)).alias("q")).first()["q"] if many > 1 else []
    cell = range_of(F.col("doc_id").cast("long"), sorted(set(borders or []))) if borders else F.lit(0)
    cell = F.coalesce(F.when(F.col("doc_id").isNotNull(), cell), F.lit(0))
    rows = docs.withColumn("_b", cell).withColumn("_s", F.lit(0))
    top = {r["_b"]: r["top"] for r in docs.select("doc_id").withColumn("_b", cell).groupBy("_b").agg(F.max("doc_id").alias("top")).collect()}  # a row a range
    heads = sorted(top)
    if top and top[heads[-1]] is not None:
        follows = {b: heads[(i + 1) % len(heads)] for i, b in enumerate(heads)}
        by_range = lambda values: F.get(F.array(*(F.lit(values.get(b)).cast("long") for b in range(heads[-1] + 1))), F.col("_b"))
        first = rows.where(F.col("doc_id") == by_range(top)).withColumn("_b", by_range(follows).cast("int")).withColumn("_s", F.lit(1))
    else:  # only null ids: one range, which begins again after its end
        first = rows.withColumn("_s", F.lit(1)).orderBy("text").limit(1)
    order = Window.partitionBy("_b").orderBy("_s", F.col("doc_id").desc_nulls_last(), F.col("text").asc_nulls_last())
    out = rows.unionByName(first)
    if made is not None:  # once, where the ranges are dealt to; the window over them needs no further exchange
        out = made(out.repartition("_b"))
    for c in carried:
        out = out.withColumn(f"next_{c}", F.lead(c).over(order))
    return out.where("_s = 0").drop("_b", "_s")


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint of every text, of its edit (second half from the next document) and their likenesses, a row a row of docs.

    Null texts count as empty. Other columns are ignored; repeated rows stay. An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if rows.isEmpty():
        return rows.sparkSession.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    # Anchors are made after the exchange, which then carries texts alone, and carried on to the row before.
    rows = with_next(rows, ["text", "sketch"], made=lambda dealt: with_sketch(dealt, "text", "sketch"))
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half)))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), "sketch", "sketch_at", "next_sketch", "edited")
    rows = with_sketch(rows, "edited", "edited_sketch").drop("edited")
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", as_string(F.col("sketch"), F.col("sketch_at")).alias("fingerprint"), as_string(F.col("edited_sketch"), F.col("edited_sketch_at")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )


def fingerprint_sql() -> str:
    """fingerprint_edits over a table `documents`, as DuckDB SQL."""
    signed = lambda h: f"CASE WHEN {h} >= 9223372036854775808::uhugeint THEN ({h}::hugeint - 18446744073709551616::hugeint)::bigint ELSE {h}::bigint END"
    bytes_of = lambda h: " || ".join(f"substr(lpad(hex({h}::ubigint), 16, '0'), {i}, 2)" for i in range(15, 0, -2))
    tokens = xxh64("SELECT w, hex(encode(w)) AS x FROM (SELECT DISTINCT unnest(ws) AS w FROM tok)", "x", "42::uhugeint", "h")
    pairs = xxh64("SELECT a, b, hex(encode(b)) AS x, w.h AS seed FROM (SELECT DISTINCT a, b FROM p) JOIN w ON w.w = a", "x", "seed", "h")
    first = xxh64(f"SELECT a, b, {bytes_of('a')} AS x, {bytes_of('b')} AS y FROM (SELECT DISTINCT a, b FROM chosen)", "x", "42::uhugeint", "g")
    both = xxh64("SELECT * FROM first_hash", "y", "g", "h")
    whole = xxh64("SELECT r, k, hex(encode(array_to_string(ws, ' '))) AS x FROM tok WHERE len(ws) > 0 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.r = tok.r AND c.k = tok.k)", "x", "42::uhugeint", "h")
    share = lambda a, b: f"CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::double ELSE len(list_intersect({a}, {b}))::double / len(list_distinct(list_concat({a}, {b}))) END"
    return f"""WITH base AS (SELECT row_number() OVER (ORDER BY doc_id DESC NULLS LAST, coalesce(text, '')) AS r, doc_id, coalesce(text, '') AS text FROM documents),
nx AS (SELECT *, length(text) AS n, coalesce(lead(text) OVER (ORDER BY r), first_value(text) OVER (ORDER BY r)) AS nt, CASE WHEN r = count(*) OVER () THEN 1 ELSE r + 1 END AS nr FROM base),
ed AS (SELECT *, substr(text, 1, n - n // 2) || substr(nt, 1, n // 2) AS edited FROM nx),
tok AS (SELECT r, k, regexp_extract_all(t, '{TOKENS}') AS ws
  FROM (SELECT r, 0 AS k, text AS t FROM ed UNION ALL SELECT r, 1, edited FROM ed)),
w AS (SELECT w, h FROM ({tokens})),
p AS (SELECT r, k, i, ws[i + 1] AS a, ws[i + 2] AS b FROM (SELECT r, k, ws, unnest(generate_series(0, len(ws) - 2)) AS i FROM tok WHERE len(ws) >= {K})),
q AS (SELECT a, b, h FROM ({pairs})),
o AS (SELECT r, k, i, h, {signed('h')} AS s FROM p JOIN q USING (a, b)),
e AS (SELECT r, k, i, h AS a, lead(h, 2) OVER v AS b, s AS s0, lead(s) OVER v AS s1, lead(s, 2) OVER v AS s2 FROM o WINDOW v AS (PARTITION BY r, k ORDER BY i)),
chosen AS (SELECT r, k, i, a, b FROM e WHERE s2 IS NOT NULL AND (s0 <= least(s1, s2) OR s2 <= least(s0, s1))),
first_hash AS ({first}),
z AS (SELECT a, b, h FROM ({both})),
anchors AS (SELECT r, k, i, h::ubigint AS h FROM chosen JOIN z USING (a, b) UNION ALL SELECT r, k, 0, h::ubigint FROM ({whole})),
f AS (SELECT r, k, list_distinct(list(h)) AS hs, string_agg(lower(lpad(hex(h), 16, '0') || lpad(hex(i::ubigint), 8, '0')), '' ORDER BY i) AS fp FROM anchors GROUP BY r, k),
y AS (SELECT ed.*, coalesce(a.hs, []) AS ha, coalesce(b.hs, []) AS hb, coalesce(c.hs, []) AS hc, coalesce(a.fp, '') AS fa, coalesce(b.fp, '') AS fb
  FROM ed LEFT JOIN f a ON a.r = ed.r AND a.k = 0 LEFT JOIN f b ON b.r = ed.r AND b.k = 1 LEFT JOIN f c ON c.r = ed.nr AND c.k = 0)
SELECT doc_id, n AS n_chars, sha256(edited) AS edited_sha256, fa AS fingerprint, fb AS edited_fingerprint, {share('ha', 'hb')} AS near_edited, {share('ha', 'hc')} AS near_next FROM y"""
