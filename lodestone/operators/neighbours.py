"""Exact nearest neighbours inside classes: a partition of each large class around pivots, whose cells are visited best first."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

#: Rows of a cell aimed at and of a piece of a cell; cells of all classes together, about, which every task holds.
CELL, PIECE, CELLS = 2000, 8000, 1 << 13
#: Cells of a row that asks, nearest first, after which a wave ends; rows that stream past a piece in one task.
WAVES, PAST = (1, 8, 64), 1 << 14


def distances(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Squared distances of rows x to one point."""
    gap = x - to
    return (gap * gap).sum(1)


def _matrix(column) -> np.ndarray:
    return np.stack(column.to_numpy(zero_copy_only=False)) if len(column) else np.zeros((0, 1))


def _ordered(cells: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells (pivots, radii) by the least distance that a row in them can have, and these: a row of another cell lies beyond the border to
    its pivot, and within the radius of it."""
    pivots, radii = cells
    away = np.sqrt(distances(pivots, x))
    home = int(away.argmin())
    apart = np.sqrt(distances(pivots, pivots[home]))
    border = np.divide(away**2 - away[home] ** 2, 2 * apart, out=np.zeros(len(away)), where=apart > 0)
    least = np.maximum(np.maximum(away - radii, border), 0.0) * (1 - 1e-9)
    least[home] = 0.0
    order = np.argsort(least, kind="stable")
    return order, least[order]


def _past(k: int):
    """Rows (c, cell, piece, part, asks, id, x, seen), sorted: those of a piece of a cell, then those that ask, a batch at a time. The k nearest of
    each in the piece (s, d, id, x), and a row without id for how many it was compared with."""

    def run(batches):
        key, ids, held, rows = None, [], [], None
        for b in batches:
            keys = list(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True))
            asks = b.column("asks").to_pylist()
            found = []
            x, names, seen = b.column("x").to_pylist(), b.column("id").to_pylist(), b.column("seen").to_pylist()
            for i, here in enumerate(keys):
                if here != key:
                    key, ids, held, rows = here, [], [], None
                if not asks[i]:
                    ids.append(names[i]), held.append(x[i])
                    continue
                if not ids:
                    continue
                if rows is None:
                    rows = np.array(held, float)
                d = distances(rows, np.array(x[i], float))
                few = np.flatnonzero(d <= seen[i])
                few = [j for j in few.tolist() if ids[j] != names[i]]
                if len(few) > k:
                    kth = np.partition(d[few], k - 1)[k - 1]
                    few = sorted((j for j in few if d[j] <= kth), key=lambda j: (d[j], ids[j]))[:k]
                found += [(names[i], float(d[j]), ids[j], held[j], None) for j in few] + [(names[i], None, None, None, len(ids))]
            if found:
                kinds = [b.column("id").type, pa.float64(), b.column("id").type, pa.list_(pa.float64()), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], ["s", "d", "id", "x", "compared"])

    return run


def nearest_in_class(points: DataFrame, asked: DataFrame, k: int, cell: int = CELL) -> tuple[DataFrame, list[DataFrame]]:
    """(s, d, id, x): for each row that asks its k nearest others of its class by squared distance d, ties to the smaller id; and for each
    wave (s, compared). points: id, x (array<double>, of one length in a class), c (the class, a string). asked: id of those points that ask.

    Classes of more than `cell` rows are partitioned around pivots, points with the smallest hashes; every row belongs to its nearest
    pivot. A row visits its own cell, the next few, more, the rest, as far as they can hold a nearer one than its k-th so far, so the
    result is exact. A task holds a piece of a cell; those that ask stream past it, at most PAST of them. Both read tables of the
    caller's temporary().
    """
    spark = points.sparkSession
    kind = dict(points.dtypes)["id"]
    sizes = {r["c"]: r["n"] for r in points.groupBy("c").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell).collect()}  # of more than a cell each
    total = sum(sizes.values())
    many = {c: max(1, min(-(-n // cell), CELLS * n // total)) for c, n in sizes.items()}
    pivots: dict[str, np.ndarray] = {}
    if many:
        mark = F.xxhash64("id", F.lit("pivot"))
        wanted = spark.createDataFrame(list(many.items()), "c string, m long")
        place = F.row_number().over(Window.partitionBy("c").orderBy("mark", "id"))
        share = wanted.join(spark.createDataFrame(list(sizes.items()), "c string, n long"), "c")
        # Of a class only the smallest hashes are ranked, eight times as many as needed.
        near = points.withColumn("mark", F.pmod(mark, F.lit(1 << 30))).join(F.broadcast(share), "c").where(F.col("mark") < F.col("m") * 8 * F.lit(float(1 << 30)) / F.col("n") + 64)
        told = near.withColumn("i", place).where("i <= m").select("c", "x").collect()  # CELLS rows, about
        for c in many:
            mine = np.unique(np.array([r["x"] for r in told if r["c"] == c], float), axis=0)
            if len(mine) > 1:
                pivots[c] = mine
    shared = spark.sparkContext.broadcast(pivots)

    def deal(batches):
        for b in batches:
            c, x = b.column("c").to_pylist(), b.column("x")
            at, away = np.zeros(len(c), np.int32), np.zeros(len(c))
            for name in set(c) & set(shared.value):
                mine = np.flatnonzero([y == name for y in c])
                p, own = shared.value[name], _matrix(x.take(pa.array(mine)))
                for lo in range(0, len(mine), 256):
                    d = ((own[lo : lo + 256, None] - p) ** 2).sum(2)
                    at[mine[lo : lo + 256]], away[mine[lo : lo + 256]] = d.argmin(1), d.min(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), x, b.column("c"), pa.array(at), pa.array(np.sqrt(away))], ["id", "x", "c", "cell", "away"])

    dealt = written(points.select("id", "x", "c").mapInArrow(deal, f"id {kind}, x array<double>, c string, cell int, away double"), "dealt")
    pieces = written(dealt.groupBy("c", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PIECE)).cast("int").alias("pieces"), F.max("away").alias("radius")), "pieces")
    cells: dict[str, tuple] = {}
    if pivots:
        radii = {(r["c"], r["cell"]): r["radius"] for r in pieces.where(F.col("c").isin(list(pivots))).collect()}  # a row a cell
        cells = {c: (p, np.array([radii.get((c, i), 0.0) for i in range(len(p))]) * (1 + 1e-9)) for c, p in pivots.items()}
    balls = spark.sparkContext.broadcast(cells)

    def reach(first: int, upto: int):
        def run(batches):
            for b in batches:
                which, where = [], []
                for i, (c, x, seen) in enumerate(zip(b.column("c").to_pylist(), b.column("x").to_pylist(), b.column("seen").to_pylist(), strict=True)):
                    if c in balls.value:
                        order, least = _ordered(balls.value[c], np.array(x, float))
                        found = order[first:upto][least[first:upto] ** 2 <= seen]
                    else:
                        found = np.zeros(int(first == 0), np.int64)
                    which.append(np.full(len(found), i)), where.append(found)
                at = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array((np.concatenate(where) if where else np.zeros(0)).astype(np.int32))], ["id", "x", "c", "seen", "cell"])

        return run

    asking = written(dealt.join(asked.select("id").distinct(), "id", "left_semi").select("id", "x", "c").withColumn("seen", F.lit(float("inf"))), "asking")
    schema = f"s {kind}, d double, id {kind}, x array<double>"
    best, compared, first = spark.createDataFrame([], schema), [], 0
    most = max((len(p) for p in pivots.values()), default=1)
    order = Window.partitionBy("s").orderBy("d", "id")
    for upto in (*WAVES, most):
        if first >= most:
            break
        visits = written(asking.mapInArrow(reach(first, upto), f"id {kind}, x array<double>, c string, seen double, cell int"), "visits")
        first = upto
        if visits.isEmpty():  # cells are in order: who reaches none now reaches none later
            break
        plan = pieces.join(visits.groupBy("c", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAST)).cast("int").alias("parts")), ["c", "cell"])
        split = lambda n: F.pmod(F.xxhash64("id", F.lit(n)), F.col(n)).cast("int")
        each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = dealt.join(plan, ["c", "cell"]).withColumn("piece", split("pieces")).withColumn("part", each("parts")).withColumns({"asks": F.lit(False), "seen": F.lit(0.0)})
        asks = visits.join(plan, ["c", "cell"]).withColumn("part", split("parts")).withColumn("piece", each("pieces")).withColumn("asks", F.lit(True))
        names = ["c", "cell", "piece", "part", "asks", "id", "x", "seen"]
        both = own.select(*names).unionByName(asks.select(*names)).repartition(*names[:4]).sortWithinPartitions(*names[:6])
        found = written(both.mapInArrow(_past(k), f"{schema}, compared long"), "found")
        compared.append(found.where("id is null").select("s", "compared"))
        best = best.unionByName(found.where("id is not null").drop("compared")).withColumn("i", F.row_number().over(order))
        best = written(best.where(F.col("i") <= k), "best")
        now = best.where(F.col("i") == k).select(F.col("s").alias("id"), F.col("d").alias("now"))
        best = best.drop("i")
        asking = written(asking.join(now, "id", "left").select("id", "x", "c", F.coalesce("now", "seen").alias("seen")), "asking")
    return best, compared
