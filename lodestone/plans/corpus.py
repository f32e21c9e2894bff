"""The corpus pipeline end to end as one lazy plan: clean, keep valid texts, chunk with overlap, report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..operators.chunking import chunk_records
from ..operators.reports import cleaned_documents


def prepared_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Chunk records of the cleaned, valid documents, with the columns to keep."""
    s = settings or Settings()
    cleaned = cleaned_documents(docs, key, text, keep).where("is_valid").select(key, *keep, "content")
    return chunk_records(cleaned, key, "content", None, "recursive", s.chunk_tokens, s.chunk_overlap, s.min_chunk_tokens, keep)


def chunk_report(docs: DataFrame, by: str = "lang") -> DataFrame:
    """by, chunks, their words and the largest, over the prepared chunks of all documents."""
    return prepared_chunks(docs, keep=(by,)).groupBy(by).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("word_count").alias("words"), F.max("character_count").alias("largest")
    )
