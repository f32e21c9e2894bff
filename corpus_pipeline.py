"""A corpus pipeline of five stages over `documents`; each is written as Parquet and read again as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import langid, mixing, piece_codec, simhash, suffix_dedup
from lodestone.llm.common import documents, replaced, temporary, written
from lodestone.llm.queries import tokenizer_file


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages stay.

    Null texts, texts without a letter and texts whose n-gram ranks lie too far from every profile (letter noise, other scripts)
    go. Null lang is not learned from; without any, all texts with letters stay. Long texts are read whole; repeated rows are judged
    alike; an empty table stays empty; all columns stay, whatever their names.
    """
    return langid.keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (shingles of five words, similarity of 0.8 or more) the smallest doc_id stays.

    Null and blank texts are equal to each other. Texts of fewer than five words are one shingle. Long texts count whole. Of repeated
    rows one stays; of rows that share the doc_id that stays, the one with the smallest hash of its text; rows without doc_id
    all stay. An empty table stays empty; all columns stay, whatever their names.
    """
    return simhash.one_of_each(docs, k=5, similarity=0.8)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that start twice or more in all texts are taken out of the texts, wherever they are.

    A character that loses some of its bytes goes whole. Null texts stay null; shorter texts lose nothing; texts of any length are
    read whole; repeated rows and rows without doc_id repeat each other like any. An empty table stays empty; all rows and columns stay,
    whatever their names.
    """
    return suffix_dedup.deduplicated_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them, up to three times.

    Null or blank texts have no size and go. A null source is one of its own. Every row takes its own decision, also where doc_ids are
    null or repeated; equal rows share theirs evenly. An empty table stays empty; all columns stay, whatever their names.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as ids, and the texts that these ids decode to.

    Null texts count as empty, which has no ids. Texts of any length are encoded whole; repeated rows stay. An empty table stays
    empty. Columns named ids or decoded are kept as ids_before and decoded_before.
    """
    return piece_codec.encode_documents(docs, tokenizer_file())


STAGES = [
    ("language", identify),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mix", mix),
    ("encode", encode),
]

#: Profiles, suffix arrays and merges are iterative; SQL has no form of them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. Tables of a stage go when its result is written, and that when the next one is."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        with temporary(spark) as keep:
            docs = replaced(docs, keep(written(stage(spark, docs, sf_dir), f"stage-{name}")))
    return docs
