"""Oversampling, stratified samples and synthetic minority rows. Rows are ranked by a hash of a seed and their key, so samples
do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..session import temporary, written
from .neighbours import CELL, nearest_in_class

SEED = 42


def rank_hash(key: Column, seed: int = SEED) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))


#: Parts of a class by the first hex digits of the hash; only the one that the limit falls into is sorted.
DIGITS = 3


def _same(columns: list[str]) -> list[Column]:
    return [F.col(c).eqNullSafe(F.col(f"_k_{c}")) for c in columns]


def _flagged(rows: DataFrame, columns: list[str], key: str, want: str) -> DataFrame:
    """rows with _first: whether the row is among the `want` (a column, one value a class) first of its class by the hash.

    Counts by the hash's first digits tell which part of a class the limit falls into; rows before it are in, rows after it are
    out, and only that part is ranked. So no task sorts a class.
    """
    rows = rows.withColumn("_h", rank_hash(F.col(key))).withColumn("_d", F.conv(F.substring("_h", 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy(*columns, "_d").agg(F.count(F.lit(1)).alias("_c"), F.max(want).alias("_w"))
    upto = F.sum("_c").over(Window.partitionBy(*columns).orderBy("_d"))  # 16^DIGITS rows a class at most
    border = counts.withColumn("_upto", upto).where("_upto >= _w and _upto - _c < _w")
    border = border.select(*[F.col(c).alias(f"_k_{c}") for c in columns], F.col("_d").alias("_at"), (F.col("_w") - F.col("_upto") + F.col("_c")).alias("_left"))
    rows = rows.join(border, _same(columns), "left").drop(*[f"_k_{c}" for c in columns])
    clear = rows.where("_at is null or _d != _at").withColumn("_first", F.coalesce(F.col("_d") < F.col("_at"), F.col(want) > 0))
    place = F.row_number().over(Window.partitionBy(*columns).orderBy("_h", key))
    ranked = rows.where("_d = _at").withColumn("_first", place <= F.col("_left"))
    return clear.unionByName(ranked).drop("_h", "_d", "_at", "_left")


def _oversampled(df: DataFrame, columns: list[str], key: str, strategy: str | int) -> DataFrame:
    """Each row as often as its class needs: copies are dealt evenly in the order of the hash. Adds `copy` (0: the row itself)."""
    counts = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    if not isinstance(strategy, int):
        most, total, classes = counts.agg(F.max("_n"), F.sum("_n"), F.count(F.lit(1))).first()
        strategy = (total // classes if classes else 0) if strategy == "equal" else most or 0
    rows = df.join(counts.select(*[F.col(c).alias(f"_k_{c}") for c in columns], "_n"), _same(columns)).drop(*[f"_k_{c}" for c in columns])
    target = F.lit(strategy).cast("long")
    small = _flagged(rows.where(F.col("_n") < target).withColumn("_odd", (target - F.col("_n")) % F.col("_n")), columns, key, "_odd")
    extra = F.floor((target - F.col("_n")) / F.col("_n")) + F.when(F.col("_first"), 1).otherwise(0)
    small = small.withColumn("copy", F.explode(F.sequence(F.lit(0), extra.cast("int"))))
    return rows.where(F.col("_n") >= target).withColumn("copy", F.lit(0)).select(*df.columns, "copy").unionByName(small.select(*df.columns, "copy"))


def oversample(df: DataFrame, column: str, key: str, strategy: str | int = "auto") -> DataFrame:
    """Classes of a column brought up to the largest (`auto`), to the mean over all rows (`equal`) or to a number; larger ones
    stay. Rows with a null class go."""
    if strategy == "equal":
        # The mean is over all rows, nulls included.
        n, k = df.agg(F.count(F.lit(1)), F.count_distinct(column)).first()
        strategy = n // k if k else 0
    return _oversampled(df.where(F.col(column).isNotNull()), [column], key, strategy)


def oversample_groups(df: DataFrame, columns: list[str], key: str, strategy: str | int = "auto") -> DataFrame:
    """The same for combinations of columns, nulls being values of their own; without columns, df with copy 0."""
    return _oversampled(df, columns, key, strategy) if columns else df.withColumn("copy", F.lit(0))


def stratified_sample(df: DataFrame, size: int, columns: list[str], key: str) -> DataFrame:
    """From each stratum int(size x its share) rows, at least one and at most all; without columns, min(size, all) rows."""
    if not columns:
        return df.orderBy(rank_hash(F.col(key)), key).limit(size)
    strata = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    total = strata.agg(F.sum("_n")).first()[0] or 1
    take = F.greatest(F.lit(1), F.least((F.lit(float(size)) * (F.col("_n") / F.lit(total))).cast("long"), F.col("_n")))
    strata = strata.select(*[F.col(c).alias(f"_k_{c}") for c in columns], take.alias("_take"))
    rows = df.join(strata, _same(columns)).drop(*[f"_k_{c}" for c in columns])
    return _flagged(rows, columns, key, "_take").where("_first").select(*df.columns)


def _filling(df: DataFrame, columns: list[str]) -> dict[str, object]:
    """What fills each column: the mean of numbers, of others the most frequent value (ties to the smaller). One pass for each kind."""
    numbers = [c for c in columns if isinstance(df.schema[c].dataType, NumericType)]
    others = [c for c in columns if c not in numbers]
    out = df.agg(*(F.avg(c).alias(c) for c in numbers)).first().asDict() if numbers else {}
    if others:
        values = F.array(*(F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in others))
        counts = df.select(F.inline(values)).where("v is not null").groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
        most = {r["c"]: r["v"] for r in counts.groupBy("c").agg(F.min_by("v", F.struct(-F.col("n"), "v")).alias("v")).collect()}  # a row a column
        out |= {c: most.get(c) for c in others}
    return out


def smote(df: DataFrame, target: str, features: str, key: str, k: int = 5, cell: int = CELL) -> DataFrame:
    """df and synthetic rows of every smaller class, up to the largest class's count; columns as in df.

    A synthetic row lies between a row and one of its k nearest of the same class at a seeded fraction; its key is null. Other columns
    of all rows become what the table has most often (ties to the smaller value) or, of numbers, its mean. Only rows that get copies look
    for neighbours, exactly, by the index of neighbours.py. Rows with null class or features, or a null or non-finite number in
    these, go; so do rows without key. An empty table stays empty.
    """
    with temporary(df.sparkSession) as keep:
        out, _ = synthesised(df, target, features, key, k, cell)
        filled = _filling(df, [c for c in df.columns if c not in (key, features, target)])
        for c, v in filled.items():
            out = out.withColumn(c, F.lit(v).cast(df.schema[c].dataType if isinstance(v, str) else "double"))
        return keep(written(out.select(*df.columns), "smote"))


def synthesised(df: DataFrame, target: str, features: str, key: str, k: int, cell: int) -> tuple[DataFrame, list[DataFrame]]:
    """key, features and target of all rows and the synthetic ones, and how many rows each was compared with in each wave."""
    x = F.col(features).cast("array<double>")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    base = df.where(F.col(target).isNotNull() & F.col(key).isNotNull() & fine).select(F.col(key).alias("id"), x.alias("x"), F.col(target).alias("y"))
    base = written(base, "base")
    grown = written(_oversampled(base.select("id", "y"), ["y"], "id", "auto").where("copy > 0").select("id", "copy"), "grown")
    points = base.select("id", "x", F.col("y").cast("string").alias("c"))
    small = points.join(points.join(grown, "id", "left_semi").select("c").distinct(), "c", "left_semi")
    near, compared = nearest_in_class(small, grown, k, cell)
    near = near.withColumn("i", F.row_number().over(Window.partitionBy("s").orderBy("d", "id")))
    near = near.groupBy("s").agg(F.sort_array(F.collect_list(F.struct("i", F.col("x").alias("o")))).alias("m"))  # k rows each
    unit = lambda name: F.pmod(F.xxhash64("id", "copy", F.lit(name)), F.lit(1 << 30)) / (1 << 30)
    made = grown.join(base.dropDuplicates(["id"]), "id").join(near.withColumnRenamed("s", "id"), "id", "left")
    other = F.when(F.size("m") > 0, F.element_at("m", (F.floor(unit("which") * F.size("m")) + 1).cast("int"))["o"]).otherwise(F.col("x"))
    made = made.select("y", "x", other.alias("o"), unit("where").alias("t"))
    made = made.select(F.lit(None).cast(dict(base.dtypes)["id"]).alias("id"), F.zip_with("x", "o", lambda a, c: a + F.col("t") * (c - a)).alias("x"), "y")
    out = base.unionByName(made).select(F.col("id").alias(key), F.col("x").alias(features), F.col("y").alias(target))
    return out, compared
