"""Retrieval chunks: recursive and fixed-size splitting, overlap with neighbours, chunk records and statistics."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Callable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import token_estimate, word_count

SEPARATORS = ("\n\n", "\n", ". ", " ")
#: Characters of chunks that a task holds before it passes them on, about.
HELD = 1 << 20


def _packed(sizes: list[int], limit: int) -> list[tuple[int, int, bool]]:
    """Greedy runs (first, after last, whether one part alone exceeds) of parts whose sizes sum to less than limit."""
    total = [0, *accumulate(sizes)]
    runs, at = [], 0
    while at < len(sizes):
        to = bisect_left(total, total[at] + limit, at + 1) - 1  # the last sum below the limit
        runs.append((at, max(to, at + 1), to == at))
        at = max(to, at + 1)
    return runs


def recursive_chunks(text: str, tokens: int = 800, least: int = 100, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most tokens (four characters each), cut at the coarsest separator that serves.

    What is left at the end of a level is kept only if it has `least` tokens; at the level of words it is always kept.
    """
    limit = 4 * (tokens + 1)
    if not separators:
        words = text.split()
        return [" ".join(words[a:b]) for a, b, _ in _packed([len(w) + 1 for w in words], limit + 1)]
    first, rest = separators[0], separators[1:]
    parts = [p + first for p in text.split(first)]
    parts[-1] = parts[-1][: -len(first)]
    runs = _packed([len(p) for p in parts], limit)
    out: list[str] = []
    for a, b, over in runs:
        piece = "".join(parts[a:b])
        if over:
            out += recursive_chunks(piece, tokens, least, rest)
        elif b < len(parts) or len(piece) >= 4 * least and piece:
            if piece:
                out.append(piece.strip())
    return out


def fixed_chunks(text: str, tokens: int = 800) -> list[str]:
    """Runs of words whose costs (a quarter of a word's characters, rounded down) sum to at most tokens."""
    words = text.split()
    return [" ".join(words[a:b]) for a, b, _ in _packed([len(w) // 4 for w in words], tokens + 1)]


def overlapped(chunks: list[str], overlap: int = 150) -> list[str]:
    """Each chunk joined to the neighbouring words of the chunks before and after it.

    The ends take overlap / 10 words of their one neighbour; others take half of that from each side, rounded up from the one before
    and down from the one after.
    """
    if overlap == 0:
        return chunks
    words = [c.split() for c in chunks]
    out = []
    for i, chunk in enumerate(chunks):
        inner = 0 < i < len(chunks) - 1
        if i:
            n = math.ceil(overlap / (20 if inner else 10))
            chunk = " ".join(words[i - 1][max(0, len(words[i - 1]) - n) :]) + " " + chunk
        if i < len(chunks) - 1:
            chunk += " " + " ".join(words[i + 1][: overlap // (20 if inner else 10)])
        out.append(chunk)
    return out


def chunk_batches(b: pa.RecordBatch, keys: list[str], cut: Callable[[str | None], list[str]], overlap: int = 0, held: int = HELD) -> Iterator[pa.RecordBatch]:
    """A batch (keys and a text) as batches of keys, pos, total_chunks, chunk. Texts are taken out one at a time and chunks passed on by about
    `held` characters, so that a task holds few MB besides the batch, however long its texts are."""
    at, pos, total, out, size = [], [], [], [], 0
    for i, t in enumerate(b.column(len(keys))):
        chunks = cut(t.as_py())
        at += [i] * len(chunks)
        pos += range(len(chunks))
        total += [len(chunks)] * len(chunks)
        out += overlapped(chunks, overlap)
        size += sum(map(len, chunks))
        if at and (size >= held or i + 1 == b.num_rows):
            cols = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(pos, pa.int32()), pa.array(total, pa.int32()), pa.array(out, pa.string())], [*keys, "pos", "total_chunks", "chunk"])
            at, pos, total, out, size = [], [], [], [], 0


def exploded(docs: DataFrame, key: str | tuple[str, ...], text: str, method: str = "recursive", tokens: int = 800, least: int = 100, overlap: int = 0) -> DataFrame:
    """The key columns, pos, total_chunks and chunk of every chunk; null and empty texts give none. One pass over each text, in Arrow batches."""
    keys = [key] if isinstance(key, str) else list(key)
    own = docs.select(*keys, text)

    def cut(t: str | None) -> list[str]:
        return (recursive_chunks(t, tokens, least) if method == "recursive" else fixed_chunks(t, tokens)) if t else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from chunk_batches(b, keys, cut, overlap)

    schema = StructType([*own.schema.fields[: len(keys)], *StructType.fromDDL("pos int, total_chunks int, chunk string").fields])
    return own.mapInArrow(run, schema)


def chunk_records(docs: DataFrame, key: str, text: str, url: str | None = None, method: str = "recursive", tokens: int = 800, overlap: int = 150, least: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """chunk_id, content and figures of every chunk after overlap, and the columns to keep. Documents without chunks have no row."""
    names = list(dict.fromkeys([key, *([url] if url else []), *keep]))
    rows = exploded(docs, tuple(names), text, method, tokens, least, overlap)
    name = F.coalesce(F.col(url or key).cast("string"), F.lit("unknown"))
    return rows.select(
        key, *[c for c in keep if c != key], F.concat_ws("_", name, F.col("pos")).alias("chunk_id"), F.col("chunk").alias("content"), F.col("pos").alias("chunk_index"), "total_chunks",
        F.lit(method).alias("chunk_method"), F.lit(tokens).alias("chunk_size"), F.lit(overlap).alias("chunk_overlap"),
        token_estimate(F.col("chunk")).alias("estimated_tokens"), F.length("chunk").alias("character_count"), word_count(F.col("chunk")).alias("word_count"),
    )


def chunk_statistics(docs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """key, n_chunks, mean_words of every document, those without chunks included."""
    per = chunks.groupBy(key).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("word_count").alias("mean_words"))
    return docs.select(key).join(per, key, "left").select(key, F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("mean_words", F.lit(0.0)).alias("mean_words"))
