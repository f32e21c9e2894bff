"""Quality classifier from weak labels.

Overlapping heuristics vote good, bad or nothing on each document. Expectation-maximisation over the counts of vote patterns (of
all documents) estimates how each labeller votes on good and on bad documents, hence the posterior of each pattern; the
posteriors then train a linear scorer on hashed words and word shapes. Longer runs without blanks count by their pieces, so that
every character takes part.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, plus, small_batches

BAD, GOOD, NONE = 0, 1, 2
#: Labellers: bounds of a measure, (bad below, good from, good to, bad above); between them a labeller does not vote.
LABELLERS = {
    "letters": (0.75, 0.85, 1.01, 2.0),  # letters of non-blank characters
    "capitals": (-1.0, 0.0, 0.12, 0.30),  # capitals of letters
    "symbols": (-1.0, 0.0, 0.01, 0.05),  # signs other than . , ; : ! ? ' " ( ) - of non-blank characters
    "variety": (2.0, 3.0, 1e9, 1e9),  # different words by the square root of all
    "lines": (-1.0, 0.0, 0.10, 0.30),  # repeated lines of all
    "short words": (0.08, 0.15, 0.70, 0.90),  # words of three characters or fewer
    "word length": (2.5, 3.5, 7.0, 9.0),
    "shouting": (-1.0, 0.0, 0.01, 0.10),  # words that end in !! or ??
    "stutter": (-1.0, 0.0, 0.01, 0.05),  # words equal to the one before
    "bare signs": (-1.0, 0.0, 0.02, 0.10),  # words without letter or digit
}
#: Words (lines) from which a share of words (lines) says anything.
LEAST_WORDS, LEAST_LINES = 20, 4
#: Prior weight of a labeller being right, as a share of all documents.
RIGHT = 0.05
#: Hashed features; documents that the scorer is trained on; passes over them.
BUCKETS, TRAIN, PASSES = 1 << 14, 4000, 150
#: Characters of a run without blanks above which it is cut into pieces; characters of a piece on average.
LONG, PIECE = 64, 8
#: Columns of the result.
RESULTS = ("weak", "score", "keep")
PLAIN_SIGNS = ".,;:!?'\"()-’“”¿¡"


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """Bits of each code point: 1 letter, 2 capital, 4 sign, 8 not blank."""
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isspace():
            continue
        table[cp] = 8 | ch.isalpha() | 2 * ch.isupper() | 4 * (not ch.isalnum() and ch not in PLAIN_SIGNS)
    return table


def measures(texts: list[str]) -> np.ndarray:
    """A row of measures (in the order of LABELLERS) for each text; NaN where there is too little to tell."""
    out = np.full((len(texts), len(LABELLERS)), np.nan)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)
    if len(cps):
        kinds = _classes()[cps]
        full = np.flatnonzero(size)
        at = (np.cumsum(size) - size)[full]
        count = [np.add.reduceat(((kinds >> b) & 1).astype(np.int64), at) for b in range(4)]
        with np.errstate(all="ignore"):
            out[full, 0] = count[0] / count[3]
            out[full, 1] = np.where(count[0] >= LEAST_WORDS, count[1] / count[0], np.nan)
            out[full, 2] = count[2] / count[3]
    for i, t in enumerate(texts):
        words = t.split()
        n = len(words)
        if n >= LEAST_WORDS:
            counts = Counter(words)
            bare = sum(c for w, c in counts.items() if len(w) < 4 and not any(map(str.isalnum, w)))
            length = np.fromiter(map(len, words), np.int64, n)
            out[i, 3] = len(counts) / math.sqrt(n)
            out[i, 5] = ((length <= 3).sum() - bare) / n
            out[i, 6] = length.mean()
            out[i, 7] = (t.count("!! ") + t.count("?? ")) / n
            out[i, 8] = sum(map(str.__eq__, words, words[1:])) / n
            out[i, 9] = bare / n
        lines = [x for x in t.split("\n") if x and not x.isspace()]
        if len(lines) >= LEAST_LINES:
            out[i, 4] = 1 - len(set(lines)) / len(lines)
    return out


def votes(texts: list[str]) -> np.ndarray:
    """Vote pattern of each text as a number in base 3."""
    m = measures(texts)
    bounds = np.array(list(LABELLERS.values()))
    with np.errstate(invalid="ignore"):
        bad = (m < bounds[:, 0]) | (m > bounds[:, 3])
        good = (m >= bounds[:, 1]) & (m <= bounds[:, 2])
    return np.where(bad, BAD, np.where(good, GOOD, NONE)) @ 3 ** np.arange(len(bounds))


def label_model(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """(posterior of good by pattern, table [labeller, class, vote] of vote probabilities, prior of good) by expectation-maximisation."""
    k = len(LABELLERS)
    patterns = np.array(sorted(counts), np.int64)
    n = np.array([counts[p] for p in patterns.tolist()], float)
    vote = patterns[:, None] // 3 ** np.arange(k) % 3
    good, bad = (vote == GOOD).sum(1), (vote == BAD).sum(1)
    post = (good + 1.0) / (good + bad + 2.0) if len(n) else np.zeros(0)
    post = np.where(bad >= 2, np.minimum(post, 0.3), post)
    table, prior = np.full((k, 2, 3), 1 / 3), 0.5
    for _ in range(rounds if len(n) else 0):
        for c, weight in ((BAD, n * (1 - post)), (GOOD, n * post)):
            for v in range(3):
                table[:, c, v] = (weight[:, None] * (vote == v)).sum(0)
            # No vote says nothing; a labeller is held to be right more often than not, by a share of all votes.
            table[:, c, NONE] = 0
            table[:, c, c] += RIGHT * n.sum() + 2
            table[:, c, 1 - c] += 0.1 * RIGHT * n.sum() + 0.2
            table[:, c] /= table[:, c].sum(1, keepdims=True)
        prior = min(0.99, max(0.01, float((n * post).sum() / n.sum())))
        odds = np.full(len(n), math.log(prior / (1 - prior)))
        for j in range(k):
            says = vote[:, j] != NONE
            odds[says] += np.log(table[j, GOOD, vote[says, j]]) - np.log(table[j, BAD, vote[says, j]])
        new = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
        moved = float(np.abs(new - post).max())
        post = new
        if moved < 1e-6:
            break
    out = np.full(3**k, prior)
    out[patterns] = post
    return out, table, prior


@lru_cache(maxsize=200_000)
def _buckets(word: str, inside: bool = False) -> tuple[int, int]:
    """Buckets of a word (or of a piece inside a long run) and of its shape (runs of one kind of character)."""
    shape = []
    for ch in word:
        kind = "A" if ch.isupper() else "a" if ch.isalpha() else "0" if ch.isdigit() else ch
        if not shape or shape[-1] != kind:
            shape.append(kind)
    length = "\x03" if inside else "" if len(word) < 16 else "+"
    return xxhash.xxh32_intdigest("\x03" * inside + word) % BUCKETS, xxhash.xxh32_intdigest("\x00" + "".join(shape) + length) % BUCKETS


def pieces(run: str) -> list[str]:
    """A run without blanks of more than LONG characters, cut after pairs of characters whose hash says so and at LONG at the latest.

    Cuts depend on what stands there alone, so a change moves only those next to it; the pieces together are the run.
    """
    cps = np.frombuffer(run.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    cuts = np.flatnonzero(mix64(cps[:-1] << np.uint64(32) | cps[1:]) % np.uint64(PIECE) == 0) + 2
    out, at = [], 0
    for cut in [*cuts.tolist(), len(run)]:
        while at < cut:
            out.append(run[at : min(cut, at + LONG)])
            at = min(cut, at + LONG)
    return out


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (square roots of counts, scaled to length 1) of a text."""
    words = text.split()
    counts = Counter(words)
    sums: Counter[int] = Counter()
    for w, c in counts.items():
        if len(w) <= LONG:
            a, b = _buckets(w)
            sums[a] += c
            sums[b] += c
            continue
        for piece, m in Counter(pieces(w)).items():
            a, b = _buckets(piece, True)
            sums[a] += c * m
            sums[b] += c * m
    repeated = 1 - len(counts) / max(1, len(words))
    stutter = sum(map(str.__eq__, words, words[1:])) / max(1, len(words))
    sums[xxhash.xxh32_intdigest("\x02%d" % min(10, int(stutter * 20 + 0.9))) % BUCKETS] += len(words)
    sums[xxhash.xxh32_intdigest("\x01%d" % int(repeated * 10)) % BUCKETS] += len(words)
    at = np.fromiter(sums, np.int64, len(sums))
    x = np.sqrt(np.fromiter(sums.values(), float, len(sums)))
    return at, x / max(1e-9, float(np.sqrt((x * x).sum())))


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weights (the last one is the bias) of a logistic scorer for posteriors, full-batch with step sizes by coordinate."""
    w = np.zeros(BUCKETS + 1)
    if not rows:
        return w
    at = np.concatenate([r[0] for r in rows])
    x = np.concatenate([r[1] for r in rows])
    own = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    y = np.array([r[2] for r in rows])
    seen = np.full(BUCKETS + 1, 1e-8)
    for _ in range(PASSES):
        z = np.bincount(own, x * w[at], len(rows)) + w[-1]
        gap = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) / len(rows)
        g = np.bincount(at, x * gap[own], BUCKETS + 1)
        g[-1] = gap.sum()
        g[:-1] += 1e-6 * w[:-1]
        seen += g * g
        w -= 0.5 * g / np.sqrt(seen)
    return w


def score_quality(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without text, with weak (posterior of the votes), score (of the linear scorer, 0 to 1) and keep (score of 0.5 or more).

    Votes and their model cover all rows; the scorer is trained on about TRAIN different rows (the smallest hashes of key and text, each
    once, so neither null nor repeated keys weigh more). Null texts count as empty; texts without a word score 0. Texts of any length are
    read whole. Repeated rows and other columns stay; columns that are named like the results are kept as `<name>_before`. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)

    def count(batches):
        sums: Counter[int] = Counter()
        for b in batches:
            sums.update(votes([t or "" for t in b.column(0).to_pylist()]).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), pa.array(list(sums.values()), pa.int64())], ["pattern", "n"])

    found = docs.select(text).mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).collect()  # 3^labellers at most
    counts = {r["pattern"]: r["n"] for r in found}
    posterior, _, _ = label_model(counts)
    total = sum(counts.values())

    def train(batches):
        for b in batches:
            texts = [t or "" for t in b.column(0).to_pylist()]
            got = [features(t) for t in texts]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.list_(pa.int64())), pa.array([g[1] for g in got], pa.list_(pa.float64())), pa.array(posterior[votes(texts)] if texts else [], pa.float64())], ["at", "x", "y"])

    # Of different rows, however often each is repeated: the rate follows their number, so copies don't take the sample's place.
    mark = F.pmod(F.xxhash64(key, text, F.lit("quality")), F.lit(1 << 30))
    different = docs.select(mark.alias("_mark")).agg(F.approx_count_distinct("_mark", 0.01)).first()[0]
    sample = docs.select(text, mark.alias("_mark")).where(F.col("_mark") < int((1 << 30) * min(1.0, TRAIN / max(1, different))))
    sample = sample.dropDuplicates(["_mark"]).select(text).mapInArrow(train, "at array<long>, x array<double>, y double")
    rows = sorted(((np.array(r["at"], np.int64), np.array(r["x"]), float(r["y"])) for r in sample.collect()), key=lambda r: (r[2], len(r[0]), r[0].tolist(), r[1].tolist()))
    shared = spark.sparkContext.broadcast((posterior, fit(rows)))  # 3^labellers and BUCKETS numbers

    def judge(batches):
        post, w = shared.value
        for b in batches:
            texts = [t or "" for t in b.column(at_text).to_pylist()]
            score = []
            for t in texts:
                at, x = features(t)
                score.append(1 / (1 + math.exp(-max(-40.0, min(40.0, float(x @ w[at]) + w[-1])))) if t.strip() else 0.0)
            yield pa.RecordBatch.from_arrays([*[c for i, c in enumerate(b.columns) if i != at_text], pa.array(post[votes(texts)] if texts else [], pa.float64()), pa.array(score, pa.float64()), pa.array([s >= 0.5 for s in score], pa.bool_())], schema.names)

    own = docs.withColumnsRenamed({c: f"{c}_before" for c in RESULTS if c != text})
    at_text = own.columns.index(text)
    schema = plus(own.drop(text).schema, weak="double", score="double", keep="boolean")
    return own.mapInArrow(judge, schema)
