"""A Gray-order hierarchical index over 64-bit fingerprints, built and searched in the cluster.

Fingerprints are sorted by Gray rank, in which neighbours share long masked bit patterns. RUN neighbours form a node, which keeps the
bits on which all of them agree (mask and pattern); RUN nodes form a node above, until few enough are left for every task to hold. A
query walks down from there: it adds up the bits in which it differs from the patterns on its way, where each node only counts the bits
that those above it don't hold yet, and leaves a whole group as soon as the sum exceeds the radius. Inside a task a node's children
are indexed the same way with FAN children a node.

One order prunes by its leading bits alone. So the bits are rotated to ORDERS orders, each with another block of bits in front: of
two fingerprints that differ in r bits at most, one block holds r // ORDERS differences at most, and in the order that begins with that
block a query leaves a group as soon as its leading block alone differs in more. A query then visits a number of groups that
grows with the logarithm of their number.

Links are wanted for components only. Fingerprints first link to those of their own run; a node whose fingerprints all belong to
one component then is a group that the component's own fingerprints need not search, so a dense group of copies, however
large, is not searched pair by pair.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import gathered, temporary, written
from .components import connected_components

#: Children of a node in the cluster, and of a node inside a task; nodes that every task holds at most; orders of the bits.
RUN, FAN, TOP, ORDERS = 1024, 16, 4096, 3
#: Pairs held at once; label of a node whose fingerprints belong to several components.
HELD, MIXED = 1 << 20, np.iinfo(np.int64).min
ALL = ~np.uint64(0)
SIGN = np.uint64(1 << 63)
NODE = "space int, lo long, value long, same long, label long"
CHILDREN = f"{NODE}, children binary"
QUERY = "space int, lo long, fp long, label long, away int, ahead int"


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of x in the reflected Gray code: neighbours in that order share long masked patterns."""
    x = x.astype(np.uint64, copy=True)
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def gray_code(rank: np.ndarray) -> np.ndarray:
    """The number that has this place."""
    return rank ^ (rank >> np.uint64(1))


def place(x: np.ndarray) -> np.ndarray:
    """Gray ranks as longs in the same order."""
    return (gray_rank(x) ^ SIGN).view(np.int64)


def at_place(p: np.ndarray) -> np.ndarray:
    return gray_code(p.view(np.uint64) ^ SIGN)


def blocks(orders: int = ORDERS) -> list[tuple[int, int]]:
    """(rotation, bits) of the block that each order begins with."""
    size = [64 // orders + (i < 64 % orders) for i in range(orders)]
    return [(sum(size[:i]), s) for i, s in enumerate(size)]


def rotated(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by)) if by else x


def lead_mask(space: int, orders: int = ORDERS) -> np.uint64:
    bits = blocks(orders)[space][1]
    return np.uint64(((1 << bits) - 1) << (64 - bits))


def summary(value: np.ndarray, same: np.ndarray, label: np.ndarray, at: np.ndarray):
    """Pattern, mask and label (MIXED if there are several) of the groups that begin at `at`."""
    ones = np.bitwise_and.reduceat(value | ~same, at)
    zeros = np.bitwise_and.reduceat(~value | ~same, at)
    mask = np.bitwise_and.reduceat(same, at) & (ones | zeros)
    low = np.minimum.reduceat(label, at)
    return ones & mask, mask, np.where(low == np.maximum.reduceat(label, at), low, MIXED)


class GrayIndex:
    """Nodes over children in Gray order; level 0 are the children: fingerprints, or patterns of which the bits `same` hold."""

    def __init__(self, value: np.ndarray, same: np.ndarray | None = None, label: np.ndarray | None = None, held: np.uint64 = np.uint64(0)):
        same = np.full(len(value), ALL) if same is None else same
        label = np.arange(len(value)) if label is None else label
        self.value, masks, self.label = [value], [same], [label]
        while len(self.value[-1]) > FAN:
            v, m, l = summary(self.value[-1], masks[-1], self.label[-1], np.arange(0, len(self.value[-1]), FAN))  # noqa: E741
            self.value.append(v), masks.append(m), self.label.append(l)
        # What a node adds to the bits that those above it hold; held: the bits that were counted before.
        self.own = [m & ~np.repeat(masks[i + 1], FAN)[: len(m)] if i + 1 < len(masks) else m for i, m in enumerate(masks)]
        self.own[-1] = self.own[-1] & ~held

    def near(self, queries: np.ndarray, radius: int, label: np.ndarray | None = None, away: np.ndarray | None = None, ahead: np.ndarray | None = None, lead: np.uint64 = ALL, budget: int = 64):
        """(query number, child number, differences, differences in the leading block) within radius and budget, in parts.

        label: components of the queries; children and nodes of a query's own component are left out. away, ahead: differences
        that were counted above.
        """
        top = len(self.value[-1])
        step = max(1, HELD // (top * FAN * 4))
        for lo in range(0, len(queries), step):
            n = min(step, len(queries) - lo)
            q = np.repeat(np.arange(lo, lo + n), top)
            node = np.tile(np.arange(top), n)
            sums = np.zeros(len(q), np.int64) if away is None else away[q].astype(np.int64)
            front = np.zeros(len(q), np.int64) if ahead is None else ahead[q].astype(np.int64)
            for level in range(len(self.value) - 1, -1, -1):
                apart = (queries[q] ^ self.value[level][node]) & self.own[level][node]
                sums = sums + np.bitwise_count(apart)
                front = front + np.bitwise_count(apart & lead)
                keep = (sums <= radius) & (front <= budget)
                if label is not None:
                    keep &= self.label[level][node] != label[q]
                q, node, sums, front = q[keep], node[keep], sums[keep], front[keep]
                if level:
                    below = len(self.value[level - 1])
                    node = (node[:, None] * FAN + np.arange(FAN)).ravel()
                    q, sums, front = np.repeat(q, FAN), np.repeat(sums, FAN), np.repeat(front, FAN)
                    keep = node < below
                    q, node, sums, front = q[keep], node[keep], sums[keep], front[keep]
            yield q, node, sums, front


def local_labels(n: int, links) -> np.ndarray:
    """The smallest number reachable for each of n, links as (i, j) arrays in parts."""
    label = np.arange(n)
    for i, j in links:
        while True:
            a, b = label[i], label[j]
            apart = a != b
            if not apart.any():
                break
            lo, hi = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            np.minimum.at(label, hi, lo)
            while True:
                jumped = label[label]
                if (jumped == label).all():
                    break
                label = jumped
            i, j = i[apart], j[apart]
    return label


def own_links(fp: np.ndarray, radius: int, close=None, start: np.ndarray | None = None, lead: np.uint64 = ALL, budget: int = 64) -> np.ndarray:
    """Local labels of fingerprints in Gray order, all links within radius between them taken into account.

    Neighbours in the order link first; the index then leaves out what is in one component already. close: a further test on
    the pairs found; start: local labels that hold already; lead, budget: pairs that differ in more bits of lead are not searched for.
    """

    def tested(i, j):
        return (i, j) if close is None else close(i, j)

    def beside():
        for d in range(1, min(FAN, len(fp))):
            i = np.flatnonzero(np.bitwise_count(fp[d:] ^ fp[:-d]) <= radius)
            yield tested(i, i + d)

    label = local_labels(len(fp), beside() if start is None else chain([(np.arange(len(fp)), start)], beside()))
    if len(fp) <= FAN:
        return label
    index = GrayIndex(fp, label=label)
    for lo in range(0, len(fp), FAN * FAN):
        part = np.arange(lo, min(lo + FAN * FAN, len(fp)))
        found = [tested(part[i], j) for i, j, _, _ in index.near(fp[part], radius, label[part], lead=lead, budget=budget)]
        if any(len(i) for i, _ in found):
            label = local_labels(len(fp), [(np.arange(len(fp)), label), *found])
            index = GrayIndex(fp, label=label)
    return label


# In the cluster ----------------------------------------------------------------------------------


def _dealt(fps: DataFrame) -> DataFrame:
    """space, lo (place in the order), label: a row for each order of each fingerprint (fp, label), in order."""

    def run(batches):
        for b in batches:
            fp, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for space, (by, _) in enumerate(blocks()):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(fp), space, np.int32)), pa.array(place(rotated(fp.view(np.uint64), by))), pa.array(label)], ["space", "lo", "label"])

    rows = fps.select("fp", "label").mapInArrow(run, "space int, lo long, label long")
    return rows.repartitionByRange("space", "lo").sortWithinPartitions("space", "lo")


def _runs(batches, width: int, run: int):
    """Arrays of the first `width` columns for each run of so many rows at most of one space; rows come in order."""
    held: list[list[np.ndarray]] = []
    size = 0
    for b in batches:
        held.append([b.column(i).to_numpy(zero_copy_only=False) for i in range(width)])
        size += b.num_rows
        if size < 16 * run:
            continue
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cuts = _cuts(cols[0], run)
        for a, z in zip(cuts[:-2], cuts[1:-1], strict=True):
            yield [c[a:z] for c in cols]
        held, size = [[c[cuts[-2] :] for c in cols]], len(cols[0]) - cuts[-2]
    if size:
        cols = [np.concatenate(x) for x in zip(*held, strict=True)]
        cuts = _cuts(cols[0], run)
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            yield [c[a:z] for c in cols]


def _cuts(space: np.ndarray, run: int) -> list[int]:
    edge = [0, *(np.flatnonzero(space[1:] != space[:-1]) + 1).tolist(), len(space)]
    return [x for a, z in zip(edge[:-1], edge[1:], strict=True) for x in range(a, z, run)] + [len(space)]


def _home_links(radius: int, run: int):
    """Star links (a, b) between the labels of the components of each run."""

    def linked(batches):
        for space, lo, label in _runs(batches, 3, run):
            part = own_links(at_place(lo), radius, lead=lead_mask(int(space[0])), budget=radius // ORDERS)
            moved = part != np.arange(len(part))
            yield pa.RecordBatch.from_arrays([pa.array(label[part[moved]]), pa.array(label[moved])], ["a", "b"])

    return linked


def _packed(value: np.ndarray, same: np.ndarray, label: np.ndarray, lo: np.ndarray) -> bytes:
    return np.stack([value.view(np.int64), same.view(np.int64), label, lo]).tobytes()


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    value, same, label, lo = np.frombuffer(raw, np.int64).reshape(4, -1)
    return value.view(np.uint64), same.view(np.uint64), label, lo


def _node_rows(found):
    """A batch of node rows from (space, lo, value, same, label) arrays of each node's children."""
    rows = []
    for space, lo, value, same, label in found:
        v, m, l = summary(value, same, label, np.zeros(1, np.int64))  # noqa: E741
        rows.append((int(space[0]), int(lo[0]), int(v.view(np.int64)[0]), int(m.view(np.int64)[0]), int(l[0]), _packed(value, same, label, lo)))
        if len(rows) == 64:
            yield _batch(rows)
            rows = []
    if rows:
        yield _batch(rows)


def _batch(rows):
    kinds = (pa.int32(), *[pa.int64()] * 4, pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["space", "lo", "value", "same", "label", "children"])


def _leaf_nodes(run: int):
    """Nodes over runs of fingerprints."""
    return lambda batches: _node_rows((space, lo, at_place(lo), np.full(len(lo), ALL), label) for space, lo, label in _runs(batches, 3, run))


def _upper_nodes(run: int):
    """Nodes over runs of nodes."""
    return lambda batches: _node_rows((space, lo, value.view(np.uint64), same.view(np.uint64), label) for space, lo, value, same, label in _runs(batches, 5, run))


def _visits(space: int, index: GrayIndex, lo: np.ndarray, fp: np.ndarray, label: np.ndarray, away, ahead, radius: int):
    """Batches of query rows for the children that a query (rotated fingerprint) has to visit.

    Of two fingerprints the one that comes first in the order finds the other: children that end before the query are left out.
    """
    own = place(fp)
    after = np.append(lo[1:], np.iinfo(np.int64).max)
    last = np.append(np.zeros(max(0, len(lo) - 1), bool), True)  # what comes after the last child is not known here
    for q, child, sums, front in index.near(fp, radius, label, away, ahead, lead_mask(space), radius // ORDERS):
        keep = (after[child] > own[q]) | last[child]
        q, child, sums, front = q[keep], child[keep], sums[keep], front[keep]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(q), space, np.int32)), pa.array(lo[child]), pa.array(fp[q].view(np.int64)), pa.array(label[q]), pa.array(sums.astype(np.int32)), pa.array(front.astype(np.int32))],
            ["space", "lo", "fp", "label", "away", "ahead"],
        )


def _from_top(shared, radius: int):
    """Query rows of fingerprints (fp, label) for the children of the top nodes."""

    def run(batches):
        top = {s: (GrayIndex(v.view(np.uint64), m.view(np.uint64), l), lo) for s, (lo, v, m, l) in shared.value.items()}  # noqa: E741
        for b in gathered(batches):
            fp, label = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for space, (by, _) in enumerate(blocks()):
                if space in top:
                    index, lo = top[space]
                    yield from _visits(space, index, lo, rotated(fp.view(np.uint64), by), label, None, None, radius)

    return run


def _descend(radius: int, leaf: bool):
    """Rows of QUERY and children, in order of (space, lo), each node before its queries: query rows for the children, or links."""

    def run(batches):
        node = None
        for b in gathered(batches):
            space, lo, fp, label, away, ahead = (b.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            children = b.column(6)
            edge = np.flatnonzero(b.column(7).to_numpy(zero_copy_only=False) == 0).tolist()
            for a, z in zip([-1, *edge], [*edge, len(fp)], strict=True):
                if a >= 0:
                    value, same, own, place_ = _unpacked(children[a].as_py())
                    _, held, _ = summary(value, same, own, np.zeros(1, np.int64))
                    node = GrayIndex(value, same, own, held[0]), place_, own
                if z <= a + 1:
                    continue
                part = slice(a + 1, z)
                index, place_, own = node
                queries, of = fp[part].view(np.uint64), label[part]
                if not leaf:
                    yield from _visits(int(space[a + 1]), index, place_, queries, of, away[part], ahead[part], radius)
                    continue
                found = [np.unique(np.stack([of[q], own[child]]), axis=1) for q, child, _, _ in index.near(queries, radius, of, away[part], ahead[part], lead_mask(int(space[a + 1])), radius // ORDERS)]
                found = np.unique(np.concatenate(found, axis=1), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])

    return run


def _cross_links(fps: DataFrame, radius: int, run: int, most: int) -> DataFrame:
    """Links (a, b) between the labels of all fingerprints (fp, label) within radius that have different labels."""
    spark = fps.sparkSession
    levels = [written(_dealt(fps).mapInArrow(_leaf_nodes(run), CHILDREN), "nodes")]
    while levels[-1].count() > most:
        below = levels[-1].select("space", "lo", "value", "same", "label").repartitionByRange("space", "lo").sortWithinPartitions("space", "lo")
        levels.append(written(below.mapInArrow(_upper_nodes(run), CHILDREN), "nodes"))
    top: dict[int, list] = {}
    for r in sorted(levels[-1].select("space", "lo", "value", "same", "label").collect()):  # TOP rows at most
        top.setdefault(r["space"], []).append(r[1:])
    shared = spark.sparkContext.broadcast({s: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for s, rows in top.items()})
    queries = fps.select("fp", "label").mapInArrow(_from_top(shared, radius), QUERY)
    for level in reversed(range(len(levels))):
        nodes = levels[level].select("space", "lo", *(F.lit(0).cast(k).alias(c) for c, k in (("fp", "long"), ("label", "long"), ("away", "int"), ("ahead", "int"))), "children", F.lit(0).alias("kind"))
        rows = nodes.unionByName(queries.withColumns({"children": F.lit(None).cast("binary"), "kind": F.lit(1)}))
        rows = rows.repartition("space", "lo").sortWithinPartitions("space", "lo", "kind")
        queries = rows.mapInArrow(_descend(radius, level == 0), "a long, b long" if level == 0 else QUERY)
    return queries.distinct()


def fingerprint_links(fps: DataFrame, radius: int = 4, run: int = RUN, most: int = TOP) -> DataFrame:
    """Links (a, b) between representatives that join all fingerprints within radius of each other, directly or by others.

    fps: distinct fp (long) with rep (long, distinct). No pair within radius is lost; pairs inside a dense group are not listed one by one.
    """
    with temporary(fps.sparkSession) as keep:
        home = written(_dealt(fps.select("fp", F.col("rep").alias("label"))).mapInArrow(_home_links(radius, run), "a long, b long"), "home")
        parts = connected_components(home)
        told = fps.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("fp", F.coalesce("label", "rep").alias("label"))
        cross = _cross_links(written(told, "told"), radius, run, most)
        stars = parts.where("node != label").select(F.col("node").alias("a"), F.col("label").alias("b"))
        return keep(written(stars.unionByName(cross), "links"))
