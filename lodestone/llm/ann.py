"""Approximate nearest neighbours by cosine: stable projections and a kd-tree.

Unit vectors are projected to DIMS Gaussian coordinates; the squared ratio of projected to true distance follows a chi-square
law with DIMS degrees. A kd-tree over projections, fitted on a bounded sample, deals all rows to cells, whose boxes are those of
their rows. Queries visit cells best first, in waves: the nearest cell, the next few, more, the rest. After each wave a query's k-th
neighbour is known better, and it drops out as soon as no cell's box could hold a projection close enough. Inside a cell, rows
are taken in the order of their projected distance and verified on the original vectors until the test holds: a nearer vector
would have been projected closer than what is left with probability CONFIDENCE.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, temporary, written

#: By a measured curve: with fewer dimensions or more confidence more rows are verified for the same recall (README has figures).
DIMS, SEED, CONFIDENCE = 32, 20240117, 0.88
#: Rows of the sample that the kd-trees are fitted on, about; rows of a cell aimed at; numbers of a piece of a cell; rows of a leaf.
SAMPLE, CELL, PIECE, LEAF = 100_000, 4096, 1 << 20, 32
#: Cells of all trees together, about, which every task holds; beyond CELL rows each, cells are searched in pieces.
CELLS = 1 << 13
#: Cells of a query, nearest first, after which a wave ends. Queries that stream past a piece in one task; those that it holds at a time.
WAVES, PAST, HELD = (1, 8, 64), 1 << 15, 64
FOUND = "query_id long, vec_id long, score double, verified long"


def chi_square_bound(p: float, dims: int) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p, by bisection of the closed form."""

    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dims // 2))

    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid) < p else (lo, mid)
    return hi


@lru_cache(maxsize=64)
def projection(width: int) -> np.ndarray:
    return np.random.default_rng([SEED, width]).standard_normal((width, DIMS))


def scaled(v: np.ndarray) -> np.ndarray:
    """Rows by the power of two that brings their largest component near 1, which changes no digit: squares neither vanish nor overflow."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(1))[1][:, None])


def dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sums of products along rows, component by component in order."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def unit(v: np.ndarray) -> np.ndarray:
    v = scaled(v)
    return v / np.sqrt((v * v).sum(1))[:, None]


def cosines(q: np.ndarray, rows: np.ndarray, squares: np.ndarray | None = None) -> np.ndarray:
    """Cosine of one vector with each row (scaled ones), in double precision; equal rows give equal values. squares: the rows' products
    with themselves."""
    squares = dot(rows, rows) if squares is None else squares
    return np.clip(dot(rows, q) / np.sqrt(squares * dot(q[None], q[None])), -1.0, 1.0)


class Cells:
    """A kd-tree of depth splits over projections: node i splits on axis[i] at at[i]; its leaves are cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros((1 << depth) - 1, np.int64)
        self.at = np.zeros((1 << depth) - 1)
        self._split(0, sample)

    def _split(self, node: int, rows: np.ndarray) -> None:
        if node >= len(self.axis):
            return
        axis = int(np.ptp(rows, axis=0).argmax()) if len(rows) else 0
        at = float(np.median(rows[:, axis])) if len(rows) else 0.0
        self.axis[node], self.at[node] = axis, at
        left = rows[:, axis] <= at
        self._split(2 * node + 1, rows[left])
        self._split(2 * node + 2, rows[~left])

    def home(self, rows: np.ndarray) -> np.ndarray:
        node = np.zeros(len(rows), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (rows[np.arange(len(rows)), self.axis[node]] > self.at[node])
        return node - len(self.axis)


def box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    gap = np.maximum(np.maximum(low - q, q - high), 0)
    return (gap * gap).sum(1)


class Piece:
    """Rows of a cell: vectors, their projections, and the boxes of leaves of LEAF rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, scaled(vectors)
        self.squares = dot(self.vectors, self.vectors)
        self.units = unit(self.vectors)
        self.points = self.units @ projection(vectors.shape[1])
        order, todo, leaves = np.arange(len(ids)), [(0, len(ids))], []
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                leaves.append((a, b))
                continue
            part = self.points[order[a:b]]
            axis = int(np.ptp(part, axis=0).argmax())
            mid = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(part[:, axis], mid)]
            todo += [(a, a + mid), (a + mid, b)]
        leaves.sort()
        self.order, self.leaves = order, np.array(leaves)
        self.low = np.minimum.reduceat(self.points[order], self.leaves[:, 0])
        self.high = np.maximum.reduceat(self.points[order], self.leaves[:, 0])

    def search(self, q_id: int, query: np.ndarray, seen: float, k: int, bound: float) -> tuple[list[tuple[float, int]], int]:
        """The k best (score, id) that the incremental search verifies, and how many rows it does. seen: a known squared distance of the
        k-th neighbour."""
        query = scaled(query[None])[0]
        one = unit(query[None])[0]
        at = one @ projection(len(query))
        near = self.leaves[box_distance(at, self.low, self.high) <= seen * bound + 1e-12]
        rows = np.concatenate([self.order[a:b] for a, b in near]) if len(near) else np.zeros(0, np.int64)
        rows = rows[self.ids[rows] != q_id]
        gap = self.points[rows] - at
        away = np.einsum("ij,ij->i", gap, gap)
        reach = away <= seen * bound + 1e-12
        rows, away = rows[reach], away[reach]
        order = np.argsort(away, kind="stable")
        rows, away = rows[order], away[order]
        cos, best, kth, i, step = np.zeros(len(rows)), np.zeros(0), seen, 0, LEAF
        while i < len(rows) and away[i] <= kth * bound + 1e-12:
            j = i + int(np.searchsorted(away[i : i + step], kth * bound + 1e-12, "right"))
            cos[i:j] = self.units[rows[i:j]] @ one
            best = np.sort(np.r_[best, cos[i:j]])[-k:]
            if len(best) == k:
                kth = min(kth, max(0.0, 2 - 2 * float(best[0])))
            i, step = j, step * 2
        if not i:
            return [], 0
        # Rounding may not decide: all that could be among the k best are measured exactly.
        few = rows[:i][cos[:i] >= (best[0] if len(best) == k else -2.0) - 1e-9]
        score = cosines(query, self.vectors[few], self.squares[few])
        top = np.lexsort((self.ids[few], -score))[:k]
        return list(zip(score[top].tolist(), self.ids[few][top].tolist(), strict=True)), i


def _past(k: int, bound: float):
    """Rows (width, cell, piece, part, query, id, vec, seen), sorted: those of a piece of a cell, then the queries that reach it, HELD at a time. What
    is found, and a row without vec_id for what each query verified."""

    def run(batches):
        key, ids, vecs, piece = None, [], [], None
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)])
            for lo, hi in zip(new.tolist(), [*new[1:].tolist(), b.num_rows], strict=True):
                here = tuple(int(c[lo]) for c in cols)
                if here != key:
                    key, ids, vecs, piece = here, [], [], None
                part = b.slice(lo, hi - lo)
                asks = part.column("query").to_numpy(zero_copy_only=False).astype(bool)
                own = int((~asks).sum())  # they come first
                number, vec = (part.column(c) for c in ("id", "vec"))
                width = here[0]
                if own:
                    ids.append(number[:own].to_numpy())
                    vecs.append(vec[:own].flatten().to_numpy().reshape(-1, width))
                if own == hi - lo or not ids:
                    continue
                if piece is None:
                    piece = Piece(np.concatenate(ids), np.concatenate(vecs))
                for s in range(own, hi - lo, HELD):
                    q = slice(s, min(s + HELD, hi - lo))
                    rows = []
                    asked = vec[q].flatten().to_numpy().reshape(-1, width)
                    for q_id, v, seen in zip(number[q].to_pylist(), asked, part.column("seen")[q].to_pylist(), strict=True):
                        found, verified = piece.search(q_id, v, seen, k, bound)
                        rows += [(q_id, i, score, None) for score, i in found] + [(q_id, None, None, verified)]
                    kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["query_id", "vec_id", "score", "verified"])

    return run


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, with rank; no list of all that was found is held."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and vec (doubles) of the rows that take part: vectors that are neither null nor zero, all components finite."""
    v = F.col(vector).cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("vec")).where(F.col("id").isNotNull() & fine)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding", confidence: float = CONFIDENCE) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose key is divisible by every, its k nearest others by cosine.

    Null, zero and non-finite vectors and rows without key take no part; vectors of different lengths are only compared with their
    own length. Ties go to the smaller key. Rows that repeat a key and a vector are one row. Fewer than k candidates: all of
    them. An empty table gives no rows. Every usable row is indexed; only the trees' borders come from a sample.
    """
    with temporary(vectors.sparkSession) as keep:
        best, _ = searched(vectors, k, every, key, vector, confidence)
        return keep(written(best.select("query_id", "rank", "vec_id", "score"), "nearest"))


def _trees(rows: DataFrame) -> dict[int, Cells]:
    """A tree for each width that needs more than one cell; depths by the width's share of all rows, so that all cells together are bounded."""
    sizes = {r["width"]: r["n"] for r in rows.groupBy("width").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CELL).collect()}  # of more than CELL rows each
    total = sum(sizes.values())
    depth = {w: min(math.ceil(math.log2(n / CELL)), int(math.log2(max(1.0, CELLS * n / total)))) for w, n in sizes.items()}
    if not any(depth.values()):
        return {}

    def project(batches):
        for b in batches:
            for w, vec in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array([w], pa.int32()), pa.array([(unit(vec.values.to_numpy()[None]) @ projection(w))[0]], pa.list_(pa.float64()))], ["width", "p"])

    # A sample of bounded size, the same in every run: small hashes of distinct rows.
    part = F.pmod(F.xxhash64("id", "vec", F.lit(SEED)), F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / total))
    large = rows.where(F.col("width").isin([w for w, d in depth.items() if d]) & part).select("width", "vec")
    found = large.mapInArrow(project, "width int, p array<double>").toArrow()
    width, points = found["width"].to_numpy(), found["p"].combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    held = {w: points[width == w] for w in sizes if depth[w]}
    return {w: Cells(x[np.lexsort(x.T)], depth[w]) for w, x in held.items()}


def searched(vectors: DataFrame, k: int, every: int, key: str, vector: str, confidence: float) -> tuple[DataFrame, list[DataFrame]]:
    """(query_id, vec_id, score, rank) of the k best found, and for each wave what its queries verified (query_id, verified). Both read tables
    of the caller's temporary()."""
    spark = vectors.sparkSession
    small_batches(spark)
    bound = chi_square_bound(confidence, DIMS)
    rows = written(usable(vectors, key, vector).distinct().withColumn("width", F.size("vec")), "vectors")
    trees = spark.sparkContext.broadcast(_trees(rows))  # CELLS cells at most, about

    def deal(batches):
        for b in batches:
            width = b.column("width").to_numpy()
            cell = np.zeros(len(width), np.int32)
            for w in np.unique(width).tolist():
                if w in trees.value:
                    at = np.flatnonzero(width == w)
                    v = b.column("vec").take(pa.array(at)).flatten().to_numpy().reshape(-1, w)
                    cell[at] = trees.value[w].home(unit(v) @ projection(w))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], ["id", "vec", "width", "cell"])

    dealt = written(rows.mapInArrow(deal, "id long, vec array<double>, width int, cell int"), "dealt")

    def box(batches):
        """The box of each cell's projections, of the rows of a task."""
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            width, cell = b.column("width").to_numpy(), b.column("cell").to_numpy()
            for w in np.unique(width).tolist():
                at = np.flatnonzero(width == w)
                p = unit(b.column("vec").take(pa.array(at)).flatten().to_numpy().reshape(-1, w)) @ projection(w)
                for c in np.unique(cell[at]).tolist():
                    x = p[cell[at] == c]
                    low, high = held.get((w, c), (np.full(DIMS, np.inf), np.full(DIMS, -np.inf)))
                    held[w, c] = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
        kinds = [pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64())]
        cols = zip(*((w, c, low, high) for (w, c), (low, high) in held.items()), strict=True) if held else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["width", "cell", "low", "high"])

    boxes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    if trees.value:
        large = dealt.where(F.col("width").isin(list(trees.value))).mapInArrow(box, "width int, cell int, low array<double>, high array<double>")
        side = lambda f, c: F.array(*(f(F.col(c)[i]) for i in range(DIMS))).alias(c)
        told = large.groupBy("width", "cell").agg(side(F.min, "low"), side(F.max, "high")).orderBy("width", "cell").collect()  # a row a cell
        for w in trees.value:
            mine = [r for r in told if r["width"] == w]
            boxes[w] = np.array([r["cell"] for r in mine]), np.array([r["low"] for r in mine]), np.array([r["high"] for r in mine])
    shared = spark.sparkContext.broadcast(boxes)

    def reach(first: int, upto: int):
        """Queries (id, vec, width, seen) with the cells that they visit between two numbers of their order."""

        def run(batches):
            for b in batches:
                which, cell = [], []
                for i, (w, seen) in enumerate(zip(b.column("width").to_pylist(), b.column("seen").to_pylist(), strict=True)):
                    if w not in shared.value:
                        cells = np.zeros(int(first == 0), np.int64)  # the only one
                    else:
                        names, low, high = shared.value[w]
                        away = box_distance((unit(b.column("vec")[i].values.to_numpy()[None]) @ projection(w))[0], low, high)
                        order = np.argsort(away, kind="stable")[first:upto]
                        cells = names[order[away[order] <= seen * bound + 1e-12]]
                    which.append(np.full(len(cells), i)), cell.append(cells)
                at = pa.array(np.concatenate(which) if which else np.zeros(0, np.int64))
                cells = pa.array((np.concatenate(cell) if cell else np.zeros(0)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), cells], ["id", "vec", "width", "seen", "cell"])

        return run

    # Cells that hold many rows (copies of a vector can't be told apart by splits) are searched in pieces, and a piece that many queries
    # reach by several tasks, each of a part of the queries.
    pieces = dealt.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) * F.col("width") / F.lit(PIECE)).cast("int").alias("pieces"))
    pieces = written(pieces, "pieces")
    asked = written(dealt.where(F.col("id") % every == 0).select("id", "vec", "width").withColumn("seen", F.lit(float("inf"))), "asked")  # no bound before k are found
    best = spark.createDataFrame([], "query_id long, vec_id long, score double, rank int")
    most = max((len(x[0]) for x in boxes.values()), default=1)
    verified, first = [], 0
    for upto in (*WAVES, most):
        if first >= most:
            break
        visits = written(asked.mapInArrow(reach(first, upto), "id long, vec array<double>, width int, seen double, cell int"), "visits")
        first = upto
        if visits.isEmpty():  # a query that reaches no cell now reaches none later: its cells are in order
            break
        parts = visits.groupBy("width", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PAST)).cast("int").alias("parts"))
        plan = pieces.join(parts, ["width", "cell"])
        split = lambda c: F.pmod(F.xxhash64("id", F.lit(c)), F.col(c)).cast("int")
        every_ = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        own = dealt.join(plan, ["width", "cell"]).withColumn("piece", split("pieces")).withColumn("part", every_("parts")).withColumn("query", F.lit(0)).withColumn("seen", F.lit(0.0))
        asks = visits.join(plan, ["width", "cell"]).withColumn("part", split("parts")).withColumn("piece", every_("pieces")).withColumn("query", F.lit(1))
        names = ["width", "cell", "piece", "part", "query", "id", "vec", "seen"]
        both = own.select(*names).unionByName(asks.select(*names)).repartition("width", "cell", "piece", "part").sortWithinPartitions(*names[:5], "id")
        found = written(both.mapInArrow(_past(k, bound), FOUND), "found")
        verified.append(found.where("vec_id is null").select("query_id", "verified"))
        best = written(_best(best.drop("rank").unionByName(found.where("vec_id is not null").drop("verified")), k), "best")
        known = best.where(F.col("rank") == k).select(F.col("query_id").alias("id"), (2 - 2 * F.col("score")).alias("now"))
        asked = written(asked.join(known, "id", "left").select("id", "vec", "width", F.coalesce(F.greatest("now", F.lit(0.0)), "seen").alias("seen")), "asked")
    return best, verified


def nearest_sql(k: int = 5, every: int = 50) -> str:
    """Exact nearest neighbours over a table `embeddings` of one width, as DuckDB SQL: what the search returns where it misses none."""
    return f"""WITH v AS (SELECT DISTINCT vec_id, CAST(embedding AS double[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id % {every} = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= {k}"""
