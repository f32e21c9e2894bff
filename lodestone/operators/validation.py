"""Validation of records and runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..schemas import REQUIRED, REQUIRED_IN_SEGMENT, SEGMENT
from ..schemas import parsed as parsed_ddl
from ..session import temporary, written
from .reports import first_messages

#: Relative change of a run's figure from which it is an anomaly.
THRESHOLDS = {"total_segments": 0.4, "total_words": 0.4, "avg_segment_duration": 0.3, "missing_values": 2.0}


def parsed(record: Column) -> Column:
    """A JSON text as a variant: parsed once, whatever is asked of it. Null where it is no JSON (an object that repeats a key is none)."""
    return F.try_parse_json(record)


def _lacking(value: Column, required: tuple[str, ...], opening: Column) -> Column:
    """Messages for required keys that an object (variant) lacks, in order; a null value counts as present."""
    return F.array_compact(F.array(*(F.when(F.try_variant_get(value, f"$.{k}", "variant").isNull(), F.concat(opening, F.lit(k))) for k in required)))


def missing_fields(record: Column, required: tuple[str, ...] = REQUIRED) -> Column:
    """Messages for required keys that a JSON object (text) lacks."""
    return _lacking(parsed(record), required, F.lit("Missing required field: "))


def _segments(record: Column) -> Column:
    return F.try_variant_get(parsed(record), "$.segments", "array<variant>")


def segment_errors(record: Column, required: tuple[str, ...] = REQUIRED_IN_SEGMENT) -> Column:
    """Messages for each segment of a JSON record (text): missing fields in order, then a start that is not before the end."""

    def of(s: Column, i: Column) -> Column:
        told = _lacking(s, required, F.concat(F.lit("Segment "), i.cast("string"), F.lit(" missing field: ")))
        number = lambda name: F.try_variant_get(s, f"$.{name}", "double")
        wrong = F.when(number("start") >= number("end"), F.array(F.concat(F.lit("Segment "), i.cast("string"), F.lit(" has invalid time range"))))
        return F.concat(told, F.coalesce(wrong, F.array().cast("array<string>")))

    return F.coalesce(F.flatten(F.transform(_segments(record), of)), F.array().cast("array<string>"))


def segments_of(record: Column) -> Column:
    """The segments of a JSON record (text) as an array of structs; a field of another type is null, not the record."""
    fields = [x.split() for x in SEGMENT.replace("`", "").split(", ")]
    return F.transform(_segments(record), lambda s: F.struct(*(F.try_variant_get(s, f"$.{n}", t).alias(n) for n, t in fields)))


def validation_errors(record: Column) -> Column:
    return F.concat(missing_fields(record), segment_errors(record))


def inferred_schema(rows: DataFrame, record: str) -> DataFrame:
    """One row: the schema that all JSON texts of a column have together (objects merged, types widened), records, and how many are no JSON."""
    v = parsed(F.col(record))
    return rows.agg(F.schema_of_variant_agg(v).alias("schema"), F.count(record).alias("records"), F.count_if(F.col(record).isNotNull() & v.isNull()).alias("broken"))


def found_fields(rows: DataFrame, record: str) -> DataFrame:
    """field, type, records: in how many JSON objects (text) a field of that type stands."""
    fields = rows.select(parsed(F.col(record)).alias("_v")).where("_v is not null")
    each = fields.lateralJoin(fields.sparkSession.tvf.variant_explode(F.col("_v").outer())).where("key is not null")
    return each.groupBy(F.col("key").alias("field"), F.schema_of_variant("value").alias("type")).agg(F.count(F.lit(1)).alias("records"))


def schema_drift(rows: DataFrame, record: str, stored: str) -> DataFrame:
    """field, stored, found, records, status: what JSON texts have against a stored schema (DDL).

    status: same; retyped (another type than stored); partial (the stored type, but not in every record); new (not stored); missing (in no
    record). A field with several types has a row for each. Null texts, and what is no JSON, are no records.
    """
    spark = rows.sparkSession
    held = spark.createDataFrame([(f.name, f.dataType.simpleString().upper()) for f in parsed_ddl(stored).fields], "field string, stored string")
    all_ = rows.agg(F.count_if(parsed(F.col(record)).isNotNull()).alias("_all"))  # one row
    found = found_fields(rows, record).withColumnRenamed("type", "found")
    out = held.join(found, "field", "full").join(F.broadcast(all_))
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.col("stored").isNull(), "new").when(F.col("stored") != F.col("found"), "retyped")
        .when(F.col("records") < F.col("_all"), "partial").otherwise("same")
    )
    return out.select("field", "stored", "found", F.coalesce("records", F.lit(0)).alias("records"), status.alias("status"))


def validity_gate(results: DataFrame, valid: str = "is_valid") -> DataFrame:
    """Counts of valid and invalid rows; reading them stops the job if more are invalid than valid."""
    out = results.agg(F.count_if(F.col(valid)).alias("valid"), F.count_if(~F.col(valid)).alias("invalid"))
    return out.withColumn("passed", F.when(F.col("invalid") <= F.col("valid"), True).otherwise(F.raise_error("more invalid records than valid ones").cast("boolean")))


def run_anomalies(runs: DataFrame, order: str, thresholds: dict[str, float] | None = None) -> DataFrame:
    """order, metric, change of each figure that moved by more than its threshold since the run before (which was not 0).

    Runs are sorted by ranges of their order; the last run of each range, a row a range, is what the first of the next one follows.
    """
    limits = thresholds or THRESHOLDS
    spark = runs.sparkSession
    with temporary(spark) as keep:
        rows = keep(written(runs.select(order, *limits).repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "runs"))
    # struct: a null order comes first, as it does in the sorting
    last = rows.groupBy("_part").agg(F.max_by(F.struct(*limits), F.struct(F.col(order).isNotNull(), order)).alias("_last"))
    held = sorted(last.collect())
    follows = [(b["_part"], a["_last"]) for a, b in zip(held, held[1:])]
    border = spark.createDataFrame(follows, last.schema)
    w = Window.partitionBy("_part").orderBy(order)
    rows = rows.withColumn("_was", F.lag(F.struct(*limits)).over(w)).join(F.broadcast(border), "_part", "left").withColumn("_was", F.coalesce("_was", "_last"))
    pairs = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("now"), F.col("_was")[m].cast("double").alias("was"), F.lit(float(x)).alias("most")) for m, x in limits.items()])
    rows = rows.select(order, F.inline(pairs)).where("was is not null and was != 0")
    return rows.withColumn("change", F.abs(F.col("now") - F.col("was")) / F.col("was")).where("change > most").select(order, "metric", "change")


def percent(share: Column) -> Column:
    """A share as a percentage of one decimal, exact halves to the even digit (the JVM's formats round decimal digits, and halves up)."""

    @F.pandas_udf("string")
    def f(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else f"{x * 100:.1f}%")

    return f(share)


def anomaly_message(metric: Column, change: Column) -> Column:
    return F.concat(F.lit("Anomaly detected in "), metric, F.lit(": Changed by "), percent(change))


def empty_chunks(chunks: DataFrame, name: str, index: str, content: str) -> DataFrame:
    """Rows with blank content, with a message."""
    return chunks.where(strip(F.coalesce(content, F.lit(""))) == "").select(name, index, F.format_string("Empty content in %s, chunk %s", F.col(name).cast("string"), F.col(index).cast("string")).alias("message"))


def alert_message(anomalies: DataFrame, message: str = "message", title: str = "Data Pipeline Anomalies Detected", most: int | None = 1000) -> DataFrame:
    """One row with a bulleted message of the first `most` anomalies in order (None: all, in one row), and how many more there are; none if
    there are none. A message is bounded; reports.anomaly_list has all of them as rows."""
    out = first_messages(anomalies, message, most).where("n > 0")
    listed = F.array_join(F.transform("messages", lambda m: F.concat(F.lit("- "), m)), "\n")
    left = F.col("n") - F.size("messages")
    more = F.when(left > 0, F.concat(F.lit("\n... and "), left.cast("string"), F.lit(" more"))).otherwise("")
    return out.select("n", F.concat(F.lit(f"{title}:\n\n"), listed, more).alias("message"))
