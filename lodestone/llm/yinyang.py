"""Exact k-means on integer vectors with Yinyang's group filter.

Centroids are put into groups once. Every vector keeps an upper bound of the distance to its own centroid and one lower bound a
group, of the distances to the group's other centroids. When centroids have moved, bounds move with them: a vector whose upper bound
lies below all lower bounds stays where it is; else the exact distance to its own centroid takes the bound's place, and of the groups
whose lower bound it does not lie below all centroids are scanned. Assignments equal those of a full scan, ties included.

A round is one pass over a table of vectors with their bounds, and sums over those that changed clusters; the driver holds k centroids.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, replaced, temporary, written

#: Integer components above this size have squared distances that no long holds; such vectors take no part.
LARGEST = 1 << 27
#: Integers up to here have products that doubles add up exactly, 64 of them.
EXACT = 1 << 22
#: Centroids of a group on average; a relative margin that covers the rounding of bounds.
GROUP, MARGIN = 10, 1e-9


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances (long) of integer rows v to integer rows c."""
    if max(np.abs(v).max(initial=0), np.abs(c).max(initial=0)) <= EXACT and v.shape[1] <= 64:
        a, b = v.astype(float), c.astype(float)
        return ((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)).astype(np.int64)
    return np.stack([((v - x) ** 2).sum(1) for x in c], 1) if len(c) else np.zeros((len(v), 0), np.int64)


def own_squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of each row of v to the same row of c."""
    return ((v - c) ** 2).sum(1)


def grouped(centroids: np.ndarray, size: int = GROUP) -> np.ndarray:
    """A group number for each centroid: a few rounds of k-means over the centroids themselves, from evenly spaced ones."""
    many = max(1, len(centroids) // size)
    points = centroids.astype(float)
    heads = points[np.linspace(0, len(points) - 1, many).astype(int)] if len(points) else points
    of = np.zeros(len(points), np.int64)
    for _ in range(5 if len(points) else 0):
        of = ((points[:, None] - heads) ** 2).sum(2).argmin(1)
        heads = np.stack([points[of == g].mean(0) if (of == g).any() else heads[g] for g in range(many)])
    return np.unique(of, return_inverse=True)[1].reshape(-1)


class Assigner:
    """Centroids of a round, how far they moved, and their groups."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None, group: np.ndarray):
        self.centroids, self.group = centroids, group
        self.members = [np.flatnonzero(group == g) for g in range(int(group.max(initial=-1)) + 1)]
        if before is not None:
            self.drift = np.sqrt(((centroids - before).astype(float) ** 2).sum(1)) * (1 + MARGIN)
            self.group_drift = np.array([self.drift[m].max() for m in self.members])

    def first(self, v: np.ndarray):
        """cluster, upper and lower bounds, scanned centroids, of vectors without bounds."""
        d = squared(v, self.centroids)
        cluster = d.argmin(1)
        rows = np.arange(len(v))
        upper = np.sqrt(d[rows, cluster].astype(float)) * (1 + MARGIN)
        other = d.astype(float)
        other[rows, cluster] = np.inf
        lower = np.stack([np.sqrt(other[:, m].min(1)) * (1 - MARGIN) for m in self.members], 1)
        return cluster, upper, lower, np.full(len(v), len(self.centroids))

    def again(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """The same after the centroids have moved."""
        cluster = cluster.copy()
        upper = upper + self.drift[cluster]
        lower = lower - self.group_drift
        scanned = np.zeros(len(v), np.int64)
        open_ = np.flatnonzero(upper >= lower.min(1))  # the others pass the global filter
        own = own_squared(v[open_], self.centroids[cluster[open_]])
        scanned[open_] = 1
        upper[open_] = np.sqrt(own.astype(float)) * (1 + MARGIN)
        reach = upper[open_, None] >= lower[open_]  # groups that may hold a nearer one, or one as near
        some = reach.any(1)
        open_, own, reach = open_[some], own[some], reach[some]
        if not len(open_):
            return cluster, upper, lower, scanned
        was = cluster[open_]
        best, least, seen = was.copy(), own.copy(), {}
        for g, members in enumerate(self.members):
            at = np.flatnonzero(reach[:, g])
            if not len(at):
                continue
            d = squared(v[open_[at]], self.centroids[members])
            scanned[open_[at]] += len(members)
            seen[g] = at, d
            j = d.argmin(1)
            near, c = d[np.arange(len(at)), j], members[j]
            better = (near < least[at]) | ((near == least[at]) & (c < best[at]))
            best[at[better]], least[at[better]] = c[better], near[better]
        for g, (at, d) in seen.items():
            other = d.astype(float)
            other[self.members[g][None, :] == best[at][:, None]] = np.inf
            lower[open_[at], g] = np.sqrt(other.min(1)) * (1 - MARGIN)
        # A centroid that was left is now one of its group's others, also where that group was not scanned.
        moved = np.flatnonzero(best != was)
        left = self.group[was[moved]]
        lower[open_[moved], left] = np.minimum(lower[open_[moved], left], np.sqrt(own[moved].astype(float)) * (1 - MARGIN))
        cluster[open_] = best
        upper[open_] = np.sqrt(least.astype(float)) * (1 + MARGIN)
        return cluster, upper, lower, scanned


def _matrix(column: pa.Array, width: int, kind: type = np.int64) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(-1, width)


def _pass(assigner: Assigner, width: int, bounded: bool):
    """Batches of (id, v), and of cluster, upper, lower where bounded: these again, with the cluster before and the scanned centroids so far."""

    def run(batches):
        groups = len(assigner.members)
        for b in gathered(batches):
            v = _matrix(b.column("v"), width)
            if bounded:
                was = b.column("cluster").to_numpy(zero_copy_only=False).astype(np.int64)
                cluster, upper, lower, scanned = assigner.again(v, was, b.column("upper").to_numpy(zero_copy_only=False), _matrix(b.column("lower"), groups, float))
                scanned = scanned + b.column("scanned").to_numpy(zero_copy_only=False)
            else:
                was = np.full(len(v), -1)
                cluster, upper, lower, scanned = assigner.first(v)
            bounds = pa.ListArray.from_arrays(np.arange(0, lower.size + 1, groups, dtype=np.int32), pa.array(lower.ravel()))
            cols = [b.column("id"), b.column("v"), pa.array(cluster.astype(np.int32)), pa.array(was.astype(np.int32)), pa.array(upper), bounds, pa.array(scanned.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(cols, ["id", "v", "cluster", "was", "upper", "lower", "scanned"])

    return run


STATE = "id long, v array<long>, cluster int, was int, upper double, lower array<double>, scanned long"


def _changes(width: int, k: int):
    """Of vectors that changed clusters: what each cluster's component sums and count (the last entry) change by, a row a cluster and task."""

    def run(batches):
        total = np.zeros((k, width + 1), np.int64)
        for b in gathered(batches):
            v = _matrix(b.column("v"), width)
            v = np.concatenate([v, np.ones((len(v), 1), np.int64)], 1)
            now, was = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "was"))
            np.add.at(total, now, v)
            held = was >= 0
            np.subtract.at(total, was[held], v[held])
        some = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(list(total[some]), pa.list_(pa.int64()))], ["cluster", "by"])

    return run


def integer_vectors(vectors: DataFrame, key: str, vector: str, width: int, scale: int) -> DataFrame:
    """id and v (integers floor(scale * x)) of rows whose vector has width components, all finite and at most LARGEST then."""
    v = F.col("_v")
    rows = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].cast("array<double>").alias("_v"))
    fits = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= F.lit(LARGEST / scale)))
    return rows.where((F.size(v) == width) & fits).select("id", F.transform(v, lambda x: F.floor(x * scale)).cast("array<long>").alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest hexadecimal SHA-256 of `seed:id`, in that order; ties (repeated ids) by their components."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = rows.where("id is not null").select("v", mark.alias("mark")).orderBy("mark", "v").limit(k).collect()
    return np.array([r["v"] for r in first], np.int64)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, key: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 256, seed: int = 2) -> tuple[DataFrame, list[list[int]]]:
    """(key, vector (integers), cluster, distance (squared, exact), scanned) of every usable vector, and the final centroids.

    Components become floor(scale * x). Centroids start as the vectors with the smallest hashes of `seed:key`. A round assigns every
    vector to the nearest centroid (ties: the smaller number) and replaces each centroid that has vectors by the floor of their
    componentwise mean; vectors are assigned once more after the last. scanned counts the distances computed for a vector.

    Vectors that are null, of another width, or hold null, non-finite or too large components take no part. Repeated rows count
    each; rows without key are clustered but are no first centroid; without any centroid, and for an empty table, no rows. Other
    columns are ignored.
    """
    spark = vectors.sparkSession
    rows = integer_vectors(vectors, key, vector, width, scale)
    with temporary(spark) as keep:
        rows = written(rows, "vectors")
        centroids = first_centroids(rows, k, seed)
        if not len(centroids):
            return keep(written(spark.createDataFrame([], f"`{key}` long, vector array<long>, cluster int, distance long, scanned long"), "clusters")), []
        group = grouped(centroids)
        state = replaced(rows, written(rows.mapInArrow(_pass(Assigner(centroids, None, group), width, False), STATE), "state"))
        sums = np.zeros((len(centroids), width + 1), np.int64)
        for _ in range(rounds):
            by = state.where("cluster != was").select("v", "cluster", "was").mapInArrow(_changes(width, len(centroids)), "cluster int, by array<long>")
            for r in by.select("cluster", F.posexplode("by").alias("at", "x")).groupBy("cluster", "at").agg(F.sum("x").alias("x")).collect():  # k times width rows
                sums[r["cluster"], r["at"]] += r["x"]
            before, held = centroids, sums[:, -1] > 0
            centroids = centroids.copy()
            centroids[held] = sums[held, :-1] // sums[held, -1:]
            step = _pass(Assigner(centroids, before, group), width, True)
            state = replaced(state, written(state.drop("was").mapInArrow(step, STATE), "state"))

        def told(batches):
            for b in gathered(batches):
                at = b.column("cluster").to_numpy(zero_copy_only=False)
                d = own_squared(_matrix(b.column("v"), width), centroids[at])
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), b.column("cluster"), pa.array(d), b.column("scanned")], [key, "vector", "cluster", "distance", "scanned"])

        out = keep(written(state.select("id", "v", "cluster", "scanned").mapInArrow(told, f"`{key}` long, vector array<long>, cluster int, distance long, scanned long"), "clusters"))
    return out, centroids.tolist()


def cluster_report(vectors: DataFrame, key: str = "vec_id", **kw) -> DataFrame:
    """key, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every usable vector (see cluster). Sums beyond a long are null."""
    spark = vectors.sparkSession
    out, centroids = cluster(vectors, key=key, **kw)
    marks = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids)]
    sums = [(r["cluster"], r["s"]) for r in out.groupBy("cluster").agg(F.try_sum("distance").alias("s")).collect()]  # k rows
    whole = sum(s for _, s in sums) if all(s is not None for _, s in sums) else None
    whole = None if whole is None or whole >= 1 << 63 else whole
    of = dict(sums)
    told = [(i, of.get(i), whole, m) for i, m in marks]
    held = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.drop("vector", "scanned").join(F.broadcast(held), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def cluster_sql(k: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, seed: int = 2) -> str:
    """cluster_report over a table `embeddings`, as DuckDB SQL: every round compares every vector with every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(CAST(embedding AS double[]), lambda x: floor({scale} * x)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {width} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x) OR abs(x::double) > {LARGEST / scale})) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, e) - 1 AS hugeint) AS c, e FROM (SELECT e, sha256('{seed}:' || vec_id) AS h FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k}))""",
    ]
    for i in range(rounds + 1):
        parts.append(f"""a{i} AS MATERIALIZED (SELECT r, min(CAST(list_inner_product(v.e, v.e) + list_inner_product(c.e, c.e) - 2 * list_inner_product(v.e, c.e) AS hugeint) * 1000 + c) AS m FROM v, c{i} c GROUP BY r)""")
        if i < rounds:
            parts.append(f"""n{i} AS (SELECT m % 1000 AS c, j, CAST(sum(e[j]::hugeint) AS hugeint) AS s, CAST(count(*) AS hugeint) AS n FROM a{i} JOIN v USING (r), range(1, {width + 1}) t(j) GROUP BY 1, 2),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::double ORDER BY j) AS e FROM n{i} GROUP BY c) n ON n.c = c.c)""")
    return "WITH " + ",\n".join(parts) + f""",
o AS (SELECT r, m % 1000 AS c, m // 1000 AS d FROM a{rounds})
SELECT vec_id, c::integer AS cluster, d::bigint AS distance, (sum(d) OVER (PARTITION BY o.c))::bigint AS cluster_inertia, (sum(d) OVER ())::bigint AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.e, lambda x: x::bigint), ',')) AS centroid_sha256 FROM o JOIN v USING (r) JOIN c{rounds} USING (c)"""
