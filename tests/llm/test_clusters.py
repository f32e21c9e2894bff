"""Yinyang clustering against plain k-means in whole numbers."""

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import yinyang

SCHEMA = "vec_id long, embedding array<double>, cluster string, v string, id string, upper string"


def plain(vectors, k, rounds, width, scale=256, seed=2):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and len(v) == width and all(x is not None and math.isfinite(x) and abs(x) <= yinyang.LARGEST / scale for x in v)]
    marked = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in marked[:k]]
    if not centroids:
        return []
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    assign = lambda: [min(range(len(centroids)), key=lambda j: (far(v, centroids[j]), j)) for _, v in kept]
    for _ in range(rounds):
        at = assign()
        for j in range(len(centroids)):
            own = [v for (_, v), a in zip(kept, at) if a == j]
            if own:
                centroids[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    return sorted(((i, a, far(v, centroids[a])) for (i, v), a in zip(kept, at)), key=repr)


def made(seed, n, width, centres):
    r = random.Random(seed)
    heads = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(centres)]
    return [(i, [c + r.gauss(0, 0.05) for c in r.choice(heads)]) for i in range(n)]


def odd(width):
    nan, inf = float("nan"), float("inf")
    return [(900, None), (901, []), (902, [0.5] * (width + 1)), (903, [None] + [0.1] * (width - 1)), (904, [nan] * width), (905, [inf] + [0.0] * (width - 1)),
            (906, [1e300] * width), (907, [0.0] * width), (907, [0.0] * width), (907, [-0.25] * width), (None, [0.25] * width), (908, [-1e-9] * width), (909, [yinyang.LARGEST / 256.0] * width)]


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in vectors], SCHEMA)


def got(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in df.collect()), key=repr)


def test_clusters_equal_plain_kmeans(spark):
    for seed, n, k, rounds, centres in ((1, 300, 25, 5, 12), (2, 60, 40, 3, 60), (3, 5, 8, 2, 2)):
        vectors = made(seed, n, 6, centres) + odd(6)
        out, centroids = yinyang.cluster(frame(spark, vectors).repartition(3), k=k, rounds=rounds, width=6)
        assert got(out) == plain(vectors, k, rounds, 6)
        assert len(centroids) == min(k, len([v for v in plain(vectors, k, 0, 6) if v[0] is not None]))


def test_ties_go_to_the_smaller_number(spark):
    vectors = [(i, [float(i % 3), 0.0]) for i in range(60)]
    out, _ = yinyang.cluster(frame(spark, vectors), k=12, rounds=4, width=2)
    assert got(out) == plain(vectors, 12, 4, 2)


def test_empty_tables(spark):
    assert yinyang.cluster_report(frame(spark, [(1, [0.0])]).limit(0)).collect() == []
    assert yinyang.cluster_report(frame(spark, odd(6))).collect() == []  # none of 64 components


def test_report_adds_up(spark):
    vectors = made(5, 200, 64, 20)
    rows = yinyang.cluster_report(frame(spark, vectors)).collect()
    want = plain(vectors, 40, 5, 64)
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in rows), key=repr) == want
    assert {r["inertia"] for r in rows} == {sum(d for *_, d in want)}
    for r in rows:
        assert r["cluster_inertia"] == sum(d for _, c, d in want if c == r["cluster"])


def test_filters_save_distances(spark):
    vectors = made(7, 3000, 16, 40)
    out, _ = yinyang.cluster(frame(spark, vectors), k=40, rounds=5, width=16)
    assert out.agg(F.avg("scanned")).first()[0] < 0.4 * 40 * 6  # a full scan computes all six times


def test_distances_are_exact():
    r = np.random.default_rng(1)
    for size in (100, yinyang.EXACT, yinyang.LARGEST):
        v, c = (r.integers(-size, size, (20, 64)) for _ in range(2))
        assert yinyang.squared(v, c).tolist() == [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
