"""Summaries of pipeline stages, a row each."""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, is_valid_text, word_count
from ..session import temporary, written


def cleaned_documents(docs: DataFrame, key: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, content, original_length, cleaned_length, word_count, is_valid of every document."""
    rows = docs.select(key, *keep, F.col(text).alias("_raw"), clean_text(F.col(text)).alias("content"))
    return rows.select(
        key, *keep, "content", F.coalesce(F.length("_raw"), F.lit(0)).alias("original_length"), F.length("content").alias("cleaned_length"),
        word_count(F.col("content")).alias("word_count"), is_valid_text(F.col("content")).alias("is_valid"),
    )


def cleaning_summary(cleaned: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """total, successful, failed and mean words of the successful (0 if none)."""
    grouped = cleaned.groupBy(*by) if by else cleaned.groupBy()
    return grouped.agg(
        F.count(F.lit(1)).alias("total"), F.count_if("is_valid").alias("successful"), F.count_if(~F.col("is_valid")).alias("failed"),
        F.coalesce(F.avg(F.when(F.col("is_valid"), F.col("word_count"))), F.lit(0.0)).alias("average_words"),
    )


def failed_documents(cleaned: DataFrame, key: str) -> DataFrame:
    return cleaned.where(~F.col("is_valid")).select(key)


def chunk_summary(stats: DataFrame) -> DataFrame:
    """Totals and the average number of chunks over all documents, those without chunks included."""
    return stats.agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chunks").alias("chunks"), F.coalesce(F.avg("n_chunks"), F.lit(0.0)).alias("average_chunks"))


def fetch_summary(rows: DataFrame, ok: Column, relevant: Column | None = None) -> DataFrame:
    out = [F.count(F.lit(1)).alias("total"), F.count_if(ok).alias("successful"), F.count_if(~ok).alias("failed")]
    return rows.agg(*out, *([F.count_if(relevant).alias("relevant")] if relevant is not None else []))


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """stage, n for each stage; one scan a stage, no joins."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("stage"), "n") for name, df in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def stage_validity(counts: DataFrame) -> DataFrame:
    """Whether all stages have rows, and their sum."""
    return counts.agg(F.bool_and(F.col("n") > 0).alias("all_present"), F.sum("n").alias("total"))


def first_messages(anomalies: DataFrame, message: str, most: int | None) -> DataFrame:
    """One row: n (of all anomalies) and the first `most` messages in order (None: all). anomaly_list has them as rows."""
    total = anomalies.agg(F.count(F.lit(1)).alias("n")).withColumn("m", F.lit(None).cast("string"))
    told = anomalies.select(F.lit(0).cast("long").alias("n"), F.col(message).alias("m"))
    told = told if most is None else told.orderBy("m").limit(most)
    return total.unionByName(told).agg(F.sum("n").alias("n"), F.sort_array(F.collect_list("m")).alias("messages"))


def numbered(rows: DataFrame, *order: str, name: str = "number") -> DataFrame:
    """rows with a running number, from 1, in an order over all of them (ties in any): each range of the order is numbered by itself, and
    begins where those before it end. The driver holds a count a range."""
    spark = rows.sparkSession
    with temporary(spark) as keep:
        held = keep(written(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "numbered"))
    counts = sorted((r["_part"], r["n"]) for r in held.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect())
    before = [(p, upto - n) for (p, n), upto in zip(counts, accumulate(n for _, n in counts))]
    begins = spark.createDataFrame(before, "_part int, _before long")
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return held.withColumn(name, place).join(F.broadcast(begins), "_part").withColumn(name, F.col(name) + F.col("_before")).drop("_part", "_before")


def anomaly_list(anomalies: DataFrame, message: str = "message") -> DataFrame:
    """message, number, total: every anomaly in order, a row each."""
    total = anomalies.agg(F.count(F.lit(1)).alias("total"))  # one row
    return numbered(anomalies.select(F.col(message).alias("message")), "message").join(F.broadcast(total))


def anomaly_report(anomalies: DataFrame, message: str = "message", most: int | None = 1000) -> DataFrame:
    """anomaly_count of all, and the first `most` messages in order (None: all, in one row)."""
    return first_messages(anomalies, message, most).select(F.col("n").alias("anomaly_count"), F.col("messages").alias("anomalies"))
