"""Helpers shared by the training-data operators: tables of a run, batches of texts, small numeric tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import _TABLES, fresh_path, release, remove, replaced, small_batches, spread, temporary, written  # noqa: F401  for all operators

WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def gathered(batches, rows: int = 8192):
    """Batches of numbers joined to about so many rows, which vectorised steps need to be worth their calls."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= rows:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def word_count(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+`; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds): hash values that look uniform."""
    x = np.asarray(x).astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return x


def plus(schema: T.StructType, **columns: str) -> T.StructType:
    """A copy of schema with columns at its end (StructType.add changes the schema that it is called on)."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(", ".join(f"{k} {v}" for k, v in columns.items())).fields])


def guarded(docs: DataFrame, *used: str) -> tuple[DataFrame, list[str]]:
    """docs with all columns but those used under neutral names, which clash with none of an operator's own, and the old names."""
    return docs.toDF(*[c if c in used else f"_own_{i}" for i, c in enumerate(docs.columns)]), docs.columns
