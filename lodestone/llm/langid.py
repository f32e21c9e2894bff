"""Language identification by rank-order profiles.

A profile is the TOP most frequent letter n-grams (1 to 3 letters, word borders included) in order of frequency. A document's own
profile is compared to each language's: an n-gram counts the difference of its two ranks, or TOP where the language lacks it; the
language with the smallest sum wins.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, plus, small_batches, written

TOP = 300
#: Languages whose profiles a task holds at once; more are compared block by block.
BLOCK = 5000
#: Score (1 less the share of the largest possible distance) from which a text counts as written in a learned language. Measured on
#: sf0.1: all 10,000 documents lie at 0.37 or above, 5 characters long ones too; texts of 100 random letters or more at 0.24 or below,
#: texts in scripts that no profile has at 0.
LEAST_SCORE = 0.25
#: Letters of texts counted at once, and n-grams held by a task before it passes counts on.
SLICE_CHARS, HELD = 200_000, 1_000_000
UNDETERMINED = "und"
NONE = 0x1FFFFF  # beyond all code points: marks the places that a shorter n-gram does not use


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Lower-cased code point of each letter, 0 for all else."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ch.lower()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all n-grams of all texts, and the text's number of each; sorted by that number."""
    raw = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "replace"), np.uint32)
    size = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    doc = np.append(np.repeat(np.arange(len(texts)), size), len(texts) - 1)
    c = _letters()[raw].astype(np.int64)
    keep = (c != 0) | np.r_[True, c[:-1] != 0]
    c, doc = c[keep], doc[keep]
    is_letter = c != 0
    one = np.flatnonzero(is_letter)  # never the first or the last place: both are borders
    two = np.flatnonzero(is_letter | np.r_[is_letter[1:], False])[: len(c)]
    two = two[two + 1 < len(c)]
    own = np.where(is_letter[two], two, two + 1)
    codes = (NONE << 42 | NONE << 21 | c[one], NONE << 42 | c[two] << 21 | c[two + 1], c[one - 1] << 42 | c[one] << 21 | c[one + 1])
    owner = np.concatenate([doc[one], doc[own], doc[one]])
    o = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[o], owner[o]


def slices(texts: list[str | None]):
    """(first, last) bounds of runs of texts with about SLICE_CHARS letters."""
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t or "") > SLICE_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t or "")
    if texts:
        yield lo, len(texts)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    o = np.argsort(codes, kind="stable")
    codes, n = codes[o], n[o]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.add.reduceat(n, first)


def _count(batches):
    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    def rows():
        for lang, (codes, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(n)], ["lang", "code", "n"])

    for b in batches:
        texts, langs = b.column("text").to_pylist(), np.array(b.column("lang").to_pylist(), object)
        for lo, hi in slices(texts):
            for lang in sorted(set(langs[lo:hi])):
                codes, _ = ngrams([t or "" for t, x in zip(texts[lo:hi], langs[lo:hi], strict=True) if x == lang])
                if len(codes):
                    codes = np.sort(codes)
                    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
                    new = codes[first], np.diff(np.append(first, len(codes)))
                    held[lang] = _summed(*(np.concatenate(x) for x in zip(held[lang], new, strict=True))) if lang in held else new
        if sum(len(c) for c, _ in held.values()) > HELD:
            yield from rows()
            held.clear()
    yield from rows()


class Profiles:
    def __init__(self, ranks: dict[str, list[int]]):
        """ranks: n-gram codes of each language in order."""
        self.langs = sorted(ranks)
        self.codes = np.unique(np.array([c for x in ranks.values() for c in x], np.int64))
        self.rank = np.full((len(self.codes) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.rank[np.searchsorted(self.codes, np.array(ranks[lang], np.int64)), j] = np.arange(len(ranks[lang]))

    def judge(self, codes: np.ndarray) -> tuple[str, float]:
        """Language and score (1 less the share of the largest possible distance) of a document with these n-grams."""
        if not len(codes) or not self.langs:
            return UNDETERMINED, 0.0
        codes = np.sort(codes)
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        n = np.diff(np.append(first, len(codes)))
        top = codes[first[np.argsort(-n, kind="stable")[:TOP]]]
        at = np.minimum(np.searchsorted(self.codes, top), len(self.codes) - 1)
        rank = self.rank[np.where(self.codes[at] == top, at, len(self.codes))]
        apart = np.where(rank < 0, TOP, np.abs(rank - np.arange(len(top))[:, None])).sum(0)
        best = int(apart.argmin())
        return self.langs[best], 1.0 - float(apart[best]) / (TOP * len(top))


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def learn_profiles(docs: DataFrame) -> DataFrame:
    """Profiles (lang, code, place) of all values of lang, from every document outside the held-out fold (crc32 of doc_id mod 4 is 2).

    Null lang or text is not learned from; a null doc_id is in the learned fold. Ties between n-grams go to the smaller code.
    """
    small_batches(docs.sparkSession)
    rows = docs.where(~held_out(docs.doc_id) & docs.lang.isNotNull() & docs.text.isNotNull()).select("text", "lang")
    counts = rows.mapInArrow(_count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return written(counts.withColumn("place", place).where(F.col("place") <= TOP).select("lang", "code", "place"), "profiles")


def _blocks(profiles: DataFrame):
    """Profiles of BLOCK languages at a time, so that neither the driver nor a task holds more."""
    blocks = max(1, -(-profiles.select("lang").distinct().count() // BLOCK))
    for i in range(blocks):
        own = profiles if blocks == 1 else profiles.where(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == i)
        found: dict[str, list[tuple[int, int]]] = {}
        for r in own.collect():
            found.setdefault(r["lang"], []).append((r["place"], r["code"]))
        if found or blocks == 1:
            yield Profiles({lang: [c for _, c in sorted(x)] for lang, x in found.items()})


def with_language(docs: DataFrame, profiles: DataFrame, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (0 to 1). Null texts and texts without a letter: `und` and 0; so are all if nothing was
    learned. Ties go to the smaller language. Whole texts of any length are read; repeated rows and other columns stay."""
    small_batches(docs.sparkSession)
    out = docs.drop("lang_pred", "score")
    schema = plus(out.schema, lang_pred="string", score="double")
    for n, block in enumerate(_blocks(profiles)):
        shared = docs.sparkSession.sparkContext.broadcast(block)  # TOP n-grams a language, BLOCK languages at most

        def run(batches, shared=shared, again=n > 0):
            p = shared.value
            for b in batches:
                texts = b.column(text).to_pylist()
                got = []
                for lo, hi in slices(texts):
                    codes, owner = ngrams([t or "" for t in texts[lo:hi]])
                    ends = np.searchsorted(owner, np.arange(hi - lo + 1))
                    got += [p.judge(codes[a:z]) for a, z in zip(ends[:-1], ends[1:], strict=True)]
                cols = dict(zip(b.schema.names, b.columns, strict=True))
                if again:  # the nearest of this block or of those before
                    before = zip(cols["lang_pred"].to_pylist(), cols["score"].to_pylist(), strict=True)
                    got = [min(x, y, key=lambda z: (-z[1], z[0])) for x, y in zip(before, got, strict=True)]
                cols |= {"lang_pred": pa.array([g[0] for g in got], pa.string()), "score": pa.array([g[1] for g in got], pa.float64())}
                yield pa.RecordBatch.from_arrays([cols[c] for c in schema.names], schema.names)

        out = (written(out, "languages") if n else out).mapInArrow(run, schema)
    return out


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs; learned from the rows outside the held-out fold. An empty table
    gives no rows; other columns are ignored."""
    out = with_language(docs.select("doc_id", "text"), learn_profiles(docs))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """docs without the rows that are in no learned language: null text, no letter, or n-grams whose ranks lie further from every profile
    than least allows (letter noise, other scripts).

    All rows with letters stay if no language could be learned. Texts of any length are read whole; repeated rows and all columns
    stay, whatever their names. An empty table gives no rows.
    """
    docs, names = guarded(docs, "doc_id", "text", "lang")
    profiles = learn_profiles(docs)
    if profiles.isEmpty():
        out = docs.where(F.regexp_like("text", F.lit(r"\p{L}")))
    else:
        out = with_language(docs, profiles).where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return out.select(*docs.columns).toDF(*names)


def language_sql() -> str:
    """identify_languages over a table `documents`, as DuckDB SQL: the fold's CRC-32 bit by bit, n-grams, ranks and distances."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, lang, coalesce(xor(list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) % 4 = 2, false) AS held_out FROM documents),
w AS (SELECT r, list_concat(list_concat([0], list_transform(string_split(w, ''), lambda c: unicode(CASE WHEN length(lower(c)) = 1 THEN lower(c) ELSE c END))), [0]) AS p FROM (SELECT r, unnest(regexp_extract_all(text, '\\p{{L}}+')) AS w FROM d)),
i AS (SELECT r, p, unnest(generate_series(1, len(p) - 1)) AS k FROM w),
g AS (SELECT r, {NONE}::bigint * 4398046511104 + {NONE}::bigint * 2097152 + p[k + 1] AS code FROM i WHERE k < len(p) - 1 UNION ALL SELECT r, {NONE}::bigint * 4398046511104 + p[k]::bigint * 2097152 + p[k + 1] FROM i
  UNION ALL SELECT r, p[k]::bigint * 4398046511104 + p[k + 1]::bigint * 2097152 + p[k + 2] FROM i WHERE k < len(p) - 1),
n AS (SELECT r, code, count(*) AS n FROM g GROUP BY r, code),
profile AS (SELECT lang, code, k FROM (SELECT lang, code, row_number() OVER (PARTITION BY lang ORDER BY sum(n) DESC, code) - 1 AS k FROM n JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY lang, code) WHERE k < {TOP}),
own AS (SELECT r, code, k FROM (SELECT r, code, row_number() OVER (PARTITION BY r ORDER BY n DESC, code) - 1 AS k FROM n) WHERE k < {TOP}),
apart AS (SELECT o.r, l.lang, sum(CASE WHEN p.k IS NULL THEN {TOP} ELSE abs(p.k - o.k) END) AS apart, count(*) AS grams FROM own o CROSS JOIN (SELECT DISTINCT lang FROM profile) l LEFT JOIN profile p ON p.lang = l.lang AND p.code = o.code GROUP BY o.r, l.lang),
best AS (SELECT r, arg_min(lang, (apart, lang)) AS lang, min(apart) AS apart, max(grams) AS grams FROM apart GROUP BY r)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, CASE WHEN best.lang IS NULL THEN 0.0::double ELSE 1.0::double - apart::double / ({TOP} * grams) END AS score FROM d LEFT JOIN best USING (r)"""
