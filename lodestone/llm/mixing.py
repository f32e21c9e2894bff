"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source has the same expected number of copies r = target / source size. floor(r) copies are
certain; the fraction is a probability. Probabilities are paired: word mass moves from one document to the other, in the
one direction or the other at random so that each keeps its expectation, until one of the two is 0 or 1. The mass of a
pair in words never changes. Pairing runs in bounded buckets of one source, and each bucket hands one residual
up a reduction tree (fan-in FAN) of its own source until one bucket is left. There what is still open is settled from large to small, each
against the pool of all smaller ones, so that a source's taken words miss its target by the smallest, if the pool can bear the
others. Rows that are equal in everything that counts are one unit, so neither a hot source nor a row repeated without end makes a
bucket large.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import guarded, mix64, temporary, word_count, written

#: Units in a bucket of the lowest level on average; buckets joined by a node of the tree; small units that the last node settles from large to small.
BUCKET_UNITS, FAN, TAIL = 2048, 64, 512
EPS = 1e-9
#: mark: a hash of all that tells units apart; seg: of the source; n: rows of the unit; certain: copies of all its rows that are certain.
NODE = "seg long, leaf long, leaves long, mark long, size long, p double, extra long"


def ranked_sources(per: DataFrame) -> DataFrame:
    """per (a row a source) with rank, from 0 in code-point order, null last; sorted by ranges, so that no task sees all."""
    dealt = per.withColumn("_last", F.isnull("source")).repartitionByRange(F.col("_last"), F.col("source"))
    dealt = written(dealt.withColumn("_part", F.spark_partition_id()), "sources")
    ends = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    before, total = [0] * (max(ends, default=0) + 1), 0
    for part in sorted(ends):
        before[part], total = total, total + ends[part]
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_last", "source")) - 1
    return dealt.withColumn("rank", place + F.get(F.array(*map(F.lit, before)), F.col("_part"))).drop("_last", "_part")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """source, source_size, units, target from (source, size). Sources in code-point order, null last, take the weights in turn.

    A target stops at max_repeats times its source's size; the excess is shared again by weight until none is above: the water level
    rises as long as caps lie below it, an aggregate over sources a step.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("units"))
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("rank") % len(weights) + 1).cast("int"))
    per = written(ranked_sources(per).withColumn("weight", weight).withColumn("cap", max_repeats * F.col("source_size")), "sources")
    total, level, full = None, 0.0, -1
    while True:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        r = per.agg(
            F.sum("source_size").alias("total"), F.count(F.when(capped, 1)).alias("full"),
            F.sum(F.when(capped, F.col("cap"))).alias("caps"), F.sum(F.when(~capped, F.col("weight"))).alias("weights"),
        ).first()
        total = (r["total"] or 0) * share
        if r["full"] == full or not r["weights"]:
            break
        full, level = r["full"], max(level, (total - (r["caps"] or 0.0)) / r["weights"])
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight")) if r["weights"] else F.col("cap")
    return per.select("source", "source_size", "units", target.alias("target"))


def pivot_rounds(seg: np.ndarray, size: np.ndarray, p: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Tournament of pivotal steps inside each segment (rows sorted by segment); at most one open row stays in each."""
    p = p.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    step = 0
    while len(open_) > 1:
        s = seg[open_]
        first = np.r_[True, s[1:] != s[:-1]]
        start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
        left = ((np.arange(len(s)) - start) % 2 == 0) & np.r_[s[1:] == s[:-1], False]
        i, j = open_[left], open_[np.flatnonzero(left) + 1]
        if not len(i):
            break
        a, b = size[i].astype(float), size[j].astype(float)
        up = np.minimum((1 - p[i]) * a, p[j] * b)  # words that can move to i
        down = np.minimum(p[i] * a, (1 - p[j]) * b)  # and to j
        with np.errstate(over="ignore"):
            h = mix64(mix64(key[i].astype(np.uint64)) + mix64(key[j].astype(np.uint64) ^ np.uint64(0x9E3779B97F4A7C15)) + np.uint64(salt * 1000 + step))
        moved = np.where((h >> np.uint64(11)) * 2.0**-53 * (up + down) < down, up, -down)
        p[i], p[j] = p[i] + moved / a, p[j] - moved / b
        for k in (i, j):
            p[k] = np.where(p[k] < EPS, 0.0, np.where(p[k] > 1 - EPS, 1.0, p[k]))
        step += 1
        open_ = open_[(p[open_] > 0) & (p[open_] < 1)]
    return p


def _coin(key: int, salt: int) -> float:
    """A number from 0 to 1 that depends on the unit alone."""
    return float(mix64(np.array([key]).astype(np.uint64) ^ np.uint64(0x5851F42D4C957F2D + salt))[0] >> np.uint64(11)) * 2.0**-53


def _downwards(rows: np.ndarray, size: np.ndarray, p: np.ndarray, key: np.ndarray, salt: int) -> None:
    """Open rows of one source, from large to small, until none is open: each is settled by its coin, and the words that this gives
    or takes are moved from or to the pool of all smaller open ones, in proportion to what they have or lack.

    So the largest are settled first and the last one left, the smallest, is the only one that can miss the target. If the pool can't
    bear one side of the coin, the other is taken; if neither, the one that misses less.
    """
    a = size[rows].astype(float)
    q = p[rows]
    for i in range(len(rows)):
        if q[i] < EPS or q[i] > 1 - EPS:
            continue
        rest = q[i + 1 :]
        pool = a[i + 1 :]
        up, down = (1 - q[i]) * a[i], q[i] * a[i]  # words that the pool gives if the unit is taken, or gets if it is not
        has, lacks = float((rest * pool).sum()), float(((1 - rest) * pool).sum())
        fine = (up <= has * (1 + EPS), down <= lacks * (1 + EPS))
        if fine[0] != fine[1]:
            taken = fine[0]
        elif not fine[0] and len(rest):
            taken = up - has < down - lacks
        else:
            taken = _coin(int(key[rows[i]]), salt) < q[i]
        if taken:
            rest *= max(0.0, 1 - up / has) if has > 0 else 0.0
        else:
            rest[:] = 1 - (1 - rest) * (max(0.0, 1 - down / lacks) if lacks > 0 else 0.0)
        q[i] = float(taken)
    p[rows] = np.round(q)


def settle(seg: np.ndarray, leaf: np.ndarray, last: np.ndarray, mark: np.ndarray, size: np.ndarray, p: np.ndarray, level: int) -> np.ndarray:
    """p after the pivotal steps of whole buckets (seg, leaf), rows in order of them. last: a bucket is its source's only one; there none stays open."""
    # The smallest of a last bucket wait for its end.
    bucket = np.cumsum(np.r_[True, (seg[1:] != seg[:-1]) | (leaf[1:] != leaf[:-1])]) - 1
    by = np.lexsort((mark, -size, bucket))
    p_, bucket, size, key = p[by], bucket[by], size[by], mark[by]
    end = np.r_[np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)]
    waits = last[by] & (end[bucket] - np.arange(len(bucket)) <= TAIL)
    p_[~waits] = pivot_rounds(bucket[~waits], size[~waits], p_[~waits], key[~waits], level)
    open_ = np.flatnonzero(last[by] & (p_ > EPS) & (p_ < 1 - EPS))
    for rows in np.split(open_, np.flatnonzero(np.diff(bucket[open_])) + 1) if len(open_) else ():
        _downwards(rows, size, p_, key, 7919 + level)
    out = np.empty_like(p_)
    out[by] = p_
    return out


def _node(level: int):
    """Batches sorted by (seg, leaf): each bucket's units with extra (the fraction's copy, where decided) and p (0 where decided)."""

    def out(cols):
        seg, leaf, leaves, mark, size, p, extra = cols
        p = settle(seg, leaf, leaves == 1, mark, size, p, level)
        done = (p < EPS) | (p > 1 - EPS)
        extra = extra + np.where(done, np.round(p), 0).astype(np.int64)
        fields = (seg, leaf // FAN, -(-leaves // FAN), mark, size, np.where(done, 0.0, p), extra)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in fields], [c.split()[0] for c in NODE.split(", ")])

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            size += b.num_rows
            if size < BUCKET_UNITS:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            same = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
            cut = int(np.flatnonzero(same)[0])  # the last bucket may go on
            held, size = [[x[cut:] for x in cols]], len(same) - cut
            if cut:
                yield out([x[:cut] for x in cols])
        if size:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def mixed_units(docs: DataFrame, size: Column | None, weights: tuple[float, ...], share: float, max_repeats: float) -> DataFrame:
    """A row a unit, which is all rows equal in doc_id, source, size and text: those, text_mark, mark, source_size, target, n (rows) and total (copies)."""
    words = (word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0))).cast("long")
    text = F.xxhash64("text", F.isnull("text")) if "text" in docs.columns else F.lit(0).cast("long")
    thin = docs.select("doc_id", "source", words.alias("size"), text.alias("text_mark"))
    with temporary(docs.sparkSession) as keep:
        units = written(thin.groupBy("doc_id", "source", "size", "text_mark").agg(F.count(F.lit(1)).alias("n")), "mix-units")  # texts are read once
        per = units.select("source", (F.col("size") * F.col("n")).alias("size"))
        targets = source_targets(per, weights, share, max_repeats).withColumnRenamed("source", "_source")
        r = F.when(F.col("source_size") > 0, F.least(F.lit(float(max_repeats)), F.col("target") / F.col("source_size"))).otherwise(0.0)
        told = units.join(targets, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
        copies = F.when(F.col("size") > 0, r * F.col("n")).otherwise(0.0)
        told = told.withColumn("copies", copies).withColumn("certain", F.floor(F.col("copies") + EPS).cast("long"))
        told = told.withColumn("mark", F.xxhash64("doc_id", F.isnull("doc_id"), "source", F.isnull("source"), "size", "text_mark"))
        told = keep(written(told, "mix-told"))
        leaves = F.ceil(F.col("units") / BUCKET_UNITS).cast("long")
        open_ = told.select(
            F.xxhash64("source", F.isnull("source")).alias("seg"), F.pmod(F.xxhash64("mark", F.lit("leaf")), leaves).alias("leaf"), leaves.alias("leaves"), "mark", "size",
            F.greatest(F.col("copies") - F.col("certain"), F.lit(0.0)).alias("p"), F.lit(0).cast("long").alias("extra"),
        ).where("p > 0")
        done, level = None, 0
        while True:
            made = open_.repartition("seg", "leaf").sortWithinPartitions("seg", "leaf").mapInArrow(_node(level), NODE)
            made = written(made, "mix-node")
            part = made.where("p = 0 and extra > 0").select("mark", "extra")
            done = part if done is None else done.unionByName(part)
            open_, level = made.where("p > 0"), level + 1
            if open_.isEmpty():
                break
        taken = done.groupBy("mark").agg(F.max("extra").alias("extra"))
        out = told.join(taken, "mark", "left").withColumn("total", F.col("certain") + F.coalesce("extra", F.lit(0)))
        return keep(written(out.select("doc_id", "source", "size", "text_mark", "source_size", "target", "n", "total"), "mix-done"))


def mix_sources(docs: DataFrame, size: Column | None = None, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.0, max_repeats: float = 3.0) -> DataFrame:
    """One row per row of docs (doc_id, source and text or an own size): doc_id, size, source_size, target, copies, taken.

    size: words by default. Null text: size 0 and taken 0. Null source: a source of its own, last in order. Null and repeated doc_ids
    are like any other; rows that are equal in id, source, size and text share their copies evenly. An empty table gives no rows.
    Columns besides these are ignored. A run with the same rows gives the same result, however they are partitioned.
    """
    units = mixed_units(docs, size, weights, share, max_repeats)
    rows = units.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = F.floor(F.col("total") / F.col("n")) + (F.col("_i") <= F.col("total") % F.col("n")).cast("long")
    rows = rows.select("doc_id", "size", "source_size", "target", copies.cast("long").alias("copies"))
    return rows.withColumn("taken", F.col("size") * F.col("copies"))


def mixed_documents(docs: DataFrame, **kw) -> DataFrame:
    """docs with each row repeated as often as the mix takes it (0: gone).

    Each row takes its own decision, also where ids are null or repeated. Rows equal in id, source and text share their unit's
    copies evenly, but for the few left over. An empty table gives no rows; all columns stay, whatever their names.
    """
    docs, names = guarded(docs, "doc_id", "source", "text")
    units = mixed_units(docs, None, **({"weights": (5, 2, 1), "share": 1.0, "max_repeats": 3.0} | kw))
    units = units.select(F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("text_mark").alias("_text"), "n", "total").where("total > 0")
    mark = F.xxhash64("text", F.isnull("text"))
    same = docs.doc_id.eqNullSafe(F.col("_id")) & docs.source.eqNullSafe(F.col("_source")) & (mark == F.col("_text"))
    # Both sides grow with the corpus: the same plan at every size, never a broadcast.
    out = docs.join(units.where("total % n = 0").hint("merge"), same).select(*docs.columns, F.expr("total div n").alias("_copies"))
    odd = units.where("total % n != 0")
    if not odd.isEmpty():
        # Rows that are equal in all columns count as one; along the others of their unit they take what is left over in turn.
        rows = docs.join(odd.hint("merge"), same).groupBy(*docs.columns, "_id", "_source", "_text", "n", "total").agg(F.count(F.lit(1)).alias("_m"))
        order = Window.partitionBy("_id", "_source", "_text").orderBy(*docs.columns).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        rows = rows.withColumn("_upto", F.sum("_m").over(order))
        left = F.least("_upto", F.expr("total % n")) - F.least(F.col("_upto") - F.col("_m"), F.expr("total % n"))
        out = out.unionByName(rows.select(*docs.columns, (F.col("_m") * F.expr("total div n") + left).alias("_copies")))
    out = out.where("_copies > 0")
    return out.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))).alias("_n")).drop("_n").toDF(*names)
