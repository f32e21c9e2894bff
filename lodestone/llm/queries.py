"""Registered queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import spread
from . import alignment, ann, hyperminhash, langid, mixing, piece_codec, quality, simhash, suffix_dedup, syncmer, url_filter, warc, yinyang
from .common import documents


def tokenizer_file(name: str = "piece_bpe_32k.model") -> str:
    """A model that the queries use; installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark, sf_dir):
    out = mixing.mix_sources(documents(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op2_nearest(spark, sf_dir):
    return ann.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_language_id(spark, sf_dir):
    return langid.identify_languages(documents(spark, sf_dir))


def op4_suffix_dedup(spark, sf_dir):
    return suffix_dedup.repeat_report(documents(spark, sf_dir))


def op5_syncmers(spark, sf_dir):
    return syncmer.fingerprint_edits(documents(spark, sf_dir))


def op6_url_filter(spark, sf_dir):
    return url_filter.filter_urls(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op7_piece_codec(spark, sf_dir):
    return piece_codec.token_digests(documents(spark, sf_dir), tokenizer_file())


def op8_simhash(spark, sf_dir):
    out = simhash.simhash_components(documents(spark, sf_dir), k=4, radius=4)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_quality(spark, sf_dir):
    return quality.score_quality(documents(spark, sf_dir).select("doc_id", "text"))


def op10_warc(spark, sf_dir):
    return warc.archive_round_trip(spread(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op11_yinyang(spark, sf_dir):
    return yinyang.cluster_report(spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12_alignment(spark, sf_dir):
    return alignment.align(documents(spark, sf_dir), ("bytes", tokenizer_file("byte_bpe_50k.json")), ("pieces", tokenizer_file()))


def op13_hyperminhash(spark, sf_dir):
    return hyperminhash.near_components(documents(spark, sf_dir))


def queries():
    return {
        "op1_mix_sources": op1_mix_sources,
        "op2_nearest": op2_nearest,
        "op3_language_id": op3_language_id,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_syncmers": op5_syncmers,
        "op6_url_filter": op6_url_filter,
        "op7_piece_codec": op7_piece_codec,
        "op8_simhash": op8_simhash,
        "op9_quality": op9_quality,
        "op10_warc": op10_warc,
        "op11_yinyang": op11_yinyang,
        "op12_alignment": op12_alignment,
        "op13_hyperminhash": op13_hyperminhash,
    }


def oracle_sql():
    return {
        "op3_language_id": langid.language_sql(),
        "op4_suffix_dedup": suffix_dedup.repeat_sql(),
        "op5_syncmers": syncmer.fingerprint_sql(),
        "op6_url_filter": url_filter.filter_sql(),
        "op8_simhash": simhash.components_sql(),
        "op10_warc": warc.archive_sql(),
        "op11_yinyang": yinyang.cluster_sql(),
        "op13_hyperminhash": hyperminhash.components_sql(),
    }
