"""Term frequencies, distributions and fairness figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import WORD_CHARS

#: The terms that are counted by default.
TERMS = (
    "he", "she", "him", "her", "man", "woman", "guys", "girls",
    "black", "white", "asian", "indian", "latino", "gay", "straight",
    "disabled", "handicapped", "crazy", "insane", "old", "young",
)


def term_frequency(docs: DataFrame, text: Column, keys: list[str], terms: tuple[str, ...] = TERMS) -> DataFrame:
    """keys, term, n for every combination of keys and every term, zeros included.

    Single-word terms: one pass over the words of a text (word tokens equal whole-word matches), counts before the shuffle.
    Terms of more words are matched as they stand.
    """
    single = [t for t in terms if not set(t) & set(" -'")]
    other = [t for t in terms if t not in single]
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, f"[^{WORD_CHARS}]+"), lambda w: w.isin(single))
    pairs = F.map_from_entries(F.transform(F.array_distinct(words), lambda t: F.struct(t, F.size(F.filter(words, lambda w: w == t)))))
    got = docs.select(*keys, pairs.alias("_m"), low.alias("_t"))
    edge = f"[{WORD_CHARS}]"
    import re

    counts = [F.sum(F.coalesce(F.try_element_at("_m", F.lit(t)), F.lit(0))).alias(t) for t in single]
    counts += [F.sum(F.regexp_count("_t", F.lit(f"(?<!{edge}){re.escape(t)}(?!{edge})"))).alias(t) for t in other]
    wide = got.groupBy(*keys).agg(*counts)
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(t).alias("term"), F.col(f"`{t}`").cast("long").alias("n")) for t in terms])))


def transcript_text(full_text: Column, segments: Column) -> Column:
    """The whole text, or the segments' texts joined."""
    return F.coalesce(full_text, F.array_join(F.transform(segments, lambda s: F.coalesce(s["text"], F.lit(""))), " "))


def speaker_balance(segments: DataFrame, key: str, speaker: str = "speaker") -> DataFrame:
    return segments.groupBy(key, speaker).agg(F.count(F.lit(1)).alias("n"))


def _by_feature(df: DataFrame, features: list[str], measures: list[Column]) -> DataFrame:
    """measures by each feature alone, all in one pass over grouping sets: columns feature, value, ..."""
    sets = df.select(*[F.col(f).cast("string").alias(f) for f in features], *[c for c in df.columns if c not in features])
    out = sets.groupingSets([[F.col(f)] for f in features], *[F.col(f) for f in features]).agg(F.grouping_id().alias("_g"), *measures)
    k = len(features)
    name = F.element_at(F.create_map(*[x for i, f in enumerate(features) for x in (F.lit(((1 << k) - 1) ^ (1 << (k - 1 - i))), F.lit(f))]), F.col("_g").cast("int"))
    return out.withColumn("feature", name).withColumn("value", F.coalesce(*[F.col(f) for f in features])).drop("_g", *features)


def distribution(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, value, n, percent (of all rows; nulls count there only)."""
    rows = _by_feature(df.select(*features), features, [F.count(F.lit(1)).alias("n")])
    from pyspark.sql import Window

    total = F.sum("n").over(Window.partitionBy("feature"))
    return rows.withColumn("percent", F.col("n") / total * 100).where("value is not null").select("feature", "value", "n", "percent")


def imbalance(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, total, distinct_values, ratio of the largest to the smallest count (infinite without values)."""
    rows = _by_feature(df.select(*features), features, [F.count(F.lit(1)).alias("n")])
    own = F.when(F.col("value").isNotNull(), F.col("n"))
    out = rows.groupBy("feature").agg(F.sum("n").alias("total"), F.count(own).alias("distinct_values"), (F.max(own) / F.min(own)).alias("ratio"))
    return out.withColumn("ratio", F.coalesce("ratio", F.lit(float("inf"))))


def fairness_report(before: DataFrame, after: DataFrame, features: list[str]) -> DataFrame:
    """feature, value, counts before and after, ratios, improvement (unrounded)."""
    b, a = distribution(before, features), distribution(after, features)
    counts = b.select("feature", "value", F.col("n").alias("n_before")).join(a.select("feature", "value", F.col("n").alias("n_after")), ["feature", "value"], "full")
    ratio = lambda df, name: imbalance(df, features).select("feature", F.col("ratio").alias(name))
    out = counts.join(ratio(before, "ratio_before"), "feature", "left").join(ratio(after, "ratio_after"), "feature", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return out.select("feature", "value", zero("n_before"), zero("n_after"), "ratio_before", "ratio_after", (F.col("ratio_before") - F.col("ratio_after")).alias("improvement"))


def fairness_metrics(df: DataFrame, y_true: str, y_pred: str, features: list[str]) -> DataFrame:
    """feature, value, n, accuracy, selection_rate by group; feature `overall` for all rows."""
    measures = [
        F.count(F.lit(1)).alias("n"),
        F.avg((F.col("_t") == F.col("_p")).cast("int")).alias("accuracy"),
        F.avg((F.col("_p") == 1).cast("int")).alias("selection_rate"),
    ]
    rows = df.select(*features, F.col(y_true).alias("_t"), F.col(y_pred).alias("_p"))
    out = _by_feature(rows, features, measures).select("feature", "value", "n", "accuracy", "selection_rate")
    whole = rows.agg(*measures).select(F.lit("overall").alias("feature"), F.lit(None).cast("string").alias("value"), "n", "accuracy", "selection_rate")
    return out.unionByName(whole)


def term_table(spark: SparkSession, terms: tuple[str, ...] = TERMS) -> DataFrame:
    return spark.createDataFrame([(t,) for t in terms], "term string")
