"""Near-duplicates by HyperMinHash: compressed registers, banding, a collision-corrected estimate, exact verification.

The hashes of a document's distinct shingles are dealt to REGISTERS buckets by their leading bits. A register keeps of its bucket's
smallest hash the number of leading zeros and the BITS bits that follow them, 16 bits in all. Two neighbours folded to one (the
smaller hash of both), three such are a band. Documents with an equal band meet. There a pair is a candidate if the share of equal registers, corrected for registers that agree by
chance (which the sizes of the two sets tell), lies less than SPREAD standard deviations below the similarity asked for. Inside the
components of candidates, links are decided on full sets of shingles.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import replaced, small_batches, temporary, written
from .components import connected_components, merged_labels
from .gray import local_labels
from .simhash import exact_links, set_digest, shingle_set

#: Registers, bits behind the leading one, bands of three folded registers. Sets of a similarity of 0.85 share no band with a chance of
#: (1 - 0.85^3)^21, some 2 in 10^9.
REGISTERS, BITS, BANDS = 128, 10, 21
#: Bands of the first search: groups of near copies are joined by these, and have no news for the others.
FIRST = 6
#: Rows of a bucket that are searched together; standard deviations; rows of a bucket that are compared pair by pair.
BUCKET, SPREAD, SMALL = 1024, 6, 32
#: Bands of its own that tell a document where buckets of others are too large and mixed (it shares three of five with each partner).
ENOUGH = 14
#: Columns of four registers each.
NAMES = [f"w{i}" for i in range(REGISTERS // 4)]


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """A row of registers (16 bits; 0: empty) for each set of 64-bit hashes. Larger codes are smaller hashes."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    owner = np.repeat(np.arange(len(sets)), np.fromiter(map(len, sets), np.int64, len(sets)))
    place = (flat >> np.uint64(57)).astype(np.int64)
    rest = flat << np.uint64(7)
    zeros = 54 - np.frexp((rest >> np.uint64(11)).astype(float))[1].astype(np.int64)  # and one: 1 to 54
    behind = ((rest << (zeros - 1).astype(np.uint64)) >> np.uint64(63 - BITS)) & np.uint64((1 << BITS) - 1)
    code = (zeros << BITS) + ((1 << BITS) - 1 - behind.astype(np.int64))
    out = np.zeros(len(sets) * REGISTERS, np.uint16)
    np.maximum.at(out, owner * REGISTERS + place, code.astype(np.uint16))
    return out.reshape(len(sets), REGISTERS)


@lru_cache(maxsize=1)
def _chances() -> np.ndarray:
    """How likely the registers of disjoint sets are equal, of those that one of them has filled: by twice the logarithms (base 2) of their sizes."""
    rate = 2.0 ** (np.arange(0, 81) / 2) / REGISTERS
    zeros = np.arange(1, 55)[:, None]
    low = (2.0**-zeros * (1 + np.arange(1 << BITS) / (1 << BITS))).ravel()
    high = low + np.repeat(2.0 ** -zeros.ravel(), 1 << BITS) / (1 << BITS)
    each = np.exp(-rate[:, None] * low) - np.exp(-rate[:, None] * high)
    empty = np.exp(-rate)
    return (each @ each.T) / (1 - empty[:, None] * empty)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard similarity by the registers of rows a and b, corrected for chance, and how many registers tell it."""
    told = ((a != 0) | (b != 0)).sum(1)
    equal = ((a == b) & (a != 0)).sum(1)
    at = lambda n: np.clip(np.round(2 * np.log2(np.maximum(n, 1))).astype(int), 0, 80)
    chance = _chances()[at(size_a), at(size_b)]
    return (equal / np.maximum(told, 1) - chance) / (1 - chance), told


def close(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray, similarity: float) -> np.ndarray:
    share, told = estimate(a, b, size_a, size_b)
    return share >= similarity - SPREAD * np.sqrt(similarity * (1 - similarity) / np.maximum(told, 1))


def bucket_links(key: np.ndarray, rep: np.ndarray, label: np.ndarray, size: np.ndarray, regs: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Star links (rep, smallest rep) of what candidates join in each bucket (equal keys; whole buckets, sorted). Equal labels are joined already."""
    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    many = np.diff(np.append(start, len(key)))

    def links():
        small = np.repeat(many <= SMALL, many)
        bucket = np.repeat(np.arange(len(many)), many)
        for d in range(1, min(SMALL, len(key))):
            i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d]) & (label[d:] != label[:-d]))
            if len(i):
                i = i[close(regs[i], regs[i + d], size[i], size[i + d], similarity)]
                yield i, i + d
        for s, n in zip(start[many > SMALL].tolist(), many[many > SMALL].tolist(), strict=True):
            # A search from row to row: what is reached is not compared again, and a label is reached as a whole.
            own = label[s : s + n]
            left, reached = np.arange(s, s + n), []
            while len(left):
                if reached:
                    at = reached.pop()
                else:
                    at = int(left[0])
                    same = own[left - s] == label[at]
                    yield np.full(same.sum(), at), left[same]
                    reached += [x for x in left[same].tolist() if x != at]
                    left = left[~same]
                    if not len(left):
                        break
                near = left[close(regs[left], np.broadcast_to(regs[at], (len(left), REGISTERS)), size[left], np.full(len(left), size[at]), similarity)]
                if len(near):
                    found = np.isin(own[left - s], label[near])
                    yield np.full(len(near), at), near
                    reached += left[found].tolist()
                    left = left[~found]

    part = local_labels(len(key), links())
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, part, rep)
    root = least[part]
    return rep[root != rep], root[root != rep]


def _linked_buckets(similarity: float, run_rows: int):
    """Batches of (key, rep, label, n, bands ...), sorted by key: the links of each bucket; of a larger one than run_rows, of each run of so many."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        rows = 0

        def out(c):
            new = np.r_[True, c[0][1:] != c[0][:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            part = np.cumsum(new | ((np.arange(len(new)) - first) % run_rows == 0))
            regs = np.ascontiguousarray(np.stack(c[4:], 1)).view(np.uint16)
            a, b = bucket_links(part, c[1], c[2], c[3], regs, similarity)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            rows += batch.num_rows
            if rows < 1 << 14:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            first = int(np.flatnonzero(cols[0] == cols[0][-1])[0])
            cut = first + (len(cols[0]) - first) // run_rows * run_rows  # the last bucket may go on: its whole runs go now
            held, rows = [[x[cut:] for x in cols]], len(cols[0]) - cut
            if cut:
                yield out([x[:cut] for x in cols])
        if rows:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def with_registers(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, id, n (distinct shingles), d (digest of their set) and w0.. (four registers each) for docs (doc_id, id, text)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").to_pylist()]
            bands = registers(sets).view(np.int64)  # four registers each
            cols = [b.column("doc_id"), b.column("id"), pa.array(map(len, sets), pa.int64()), pa.array(map(set_digest, sets), pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(bands[:, i]) for i in range(len(NAMES)))], ["doc_id", "id", "n", "d", *NAMES])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "doc_id long, id long, n long, d long, " + ", ".join(f"{w} long" for w in NAMES))


def candidate_labels(classes: DataFrame, similarity: float, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Labels (rep, label) of candidate components: those that registers tell, and those that groups which are candidates as a whole join
    further. classes: rep, n and the registers.

    A bucket whose rows have one label holds no news. A larger one than `bucket` is searched in runs, each bucket's in the order of
    another band, which brings near copies together. Where all but a bucket's worth of rows have one label then, the others become
    candidates with it. Larger buckets still belong to passages that many texts share: partners in them also share half of their
    other bands, so a text with ENOUGH other bands (or half of those it has) is told by them; what has fewer, as the passage is
    most of it, is one candidate group with the bucket's largest label. So no pair is lost to a bucket's size.
    """
    linked = lambda rows: written(rows.mapInArrow(_linked_buckets(similarity, bucket), "a long, b long").distinct(), "links")
    labels = classes.select("rep", F.col("rep").alias("label"))

    def folded(i: int) -> Column:
        """Of registers 2 i and 2 i + 1 the larger code."""
        of = lambda j: F.shiftrightunsigned(F.col(f"w{j // 4}"), 16 * (j % 4)).bitwiseAND(F.lit(0xFFFF))
        return F.greatest(of(2 * i), of(2 * i + 1))

    def band(i: int) -> Column:
        three = [folded(3 * i + j) for j in range(3)]
        return F.when(three[0] + three[1] + three[2] != 0, F.xxhash64(F.lit(i), *three))

    def keyed(bands: range, labels: DataFrame | None) -> DataFrame:
        rows = classes.withColumn("label", F.col("rep")) if labels is None else classes.join(labels, "rep")
        return rows.select("rep", "label", F.explode(F.array_compact(F.array(*map(band, bands)))).alias("key"))

    def searched(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """labels after a search of all buckets of rows (rep, label, key), and the members of those that were too large for one."""
        sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        # The same plan at every size, never a broadcast: both sides grow with the corpus.
        hits = written(rows.join(sizes.where("lo != hi").select("key", "c").hint("merge"), "key"), "hits")
        fat = lambda x: x.join(classes.hint("merge"), "rep").select("key", "rep", "label", "n", *NAMES)
        found = linked(fat(hits.where(F.col("c") <= bucket)).repartition("key").sortWithinPartitions("key"))
        members = hits.where(F.col("c") > bucket).select("key", "rep", "label")
        if not members.isEmpty():
            order = F.get(F.array(*NAMES), F.pmod("key", F.lit(len(NAMES))).cast("int"))
            large = fat(members).withColumn("_o", order).repartitionByRange("key", "_o").sortWithinPartitions("key", "_o").drop("_o")
            found = found.unionByName(linked(large))
        return merged_labels(labels, found), members.select("key", "rep")

    labels, members = searched(keyed(range(FIRST), None), labels)
    labels, more = searched(keyed(range(FIRST, BANDS), labels), labels)
    members = members.unionByName(more)
    counts = members.join(labels, "rep").groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
    counts = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
    counts = written(counts.where("top.c < n").select("key", F.col("top.label").alias("b"), (F.col("n") - F.col("top.c")).alias("others")), "counts")

    def hubs(of: DataFrame) -> DataFrame:
        """Links of the members (key, rep) of some buckets to the label that most of their bucket has."""
        rows = of.join(counts.select("key", "b"), "key").join(labels, "rep").where("label != b")
        return written(rows.select(F.col("rep").alias("a"), "b").distinct(), "hubs")

    whole = hubs(members.join(counts.where(F.col("others") <= bucket).select("key"), "key", "left_semi"))
    wide = written(members.join(counts.where(F.col("others") > bucket).select("key"), "key", "left_semi"), "wide")
    if not wide.isEmpty():
        filled = sum(band(i).isNotNull().cast("int") for i in range(BANDS))
        lost = wide.groupBy("rep").agg(F.count(F.lit(1)).alias("lost"))
        own = classes.select("rep", filled.alias("all")).join(lost, "rep").withColumn("own", F.col("all") - F.col("lost"))
        few = own.where((F.col("own") < ENOUGH) & (F.col("own") * 2 < F.col("all"))).select("rep")
        whole = whole.unionByName(hubs(wide.join(few, "rep", "left_semi")))
    return labels, merged_labels(labels, whole)


def near_components(docs: DataFrame, k: int = 3, similarity: float = 0.85, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """key, n_shingles, component_id (the smallest key reachable over links, itself included) and kept for every row of docs.

    A set holds the distinct runs of k words (lower-cased in A-Z; fewer words: the whole sequence). Documents are linked where the
    shared shingles are that share of all shingles of both, or more. Null and blank texts have no shingles and no link. Texts are
    read whole. Repeated rows stay, and are linked by their equal sets; rows that share a key count each by its text. Rows with a null
    key link others, but get no component, and null as kept. Other columns are ignored. An empty table gives no rows.
    """
    with temporary(docs.sparkSession) as keep:
        number = docs[key].cast("long")
        texts = docs.select(number.alias("doc_id"), F.coalesce(number, F.xxhash64("text")).alias("id"), "text")
        every = written(with_registers(texts, k), "registers")
        least = [F.min(c).alias(c) for c in ("doc_id", "id", "n", *NAMES)]
        classes = written(every.where("n > 0").groupBy(F.col("d").alias("rep")).agg(*least), "classes")
        fps = replaced(every, keep(written(every.select("doc_id", "n", "d"), "sizes")))
        cores, labels = candidate_labels(classes.select("rep", "n", *NAMES), similarity, bucket)
        ids = classes.select("rep", "id", "doc_id")
        candidates = labels.join(cores.withColumnRenamed("label", "core"), "rep").join(ids, "rep").select(F.col("rep").alias("d"), F.col("id").alias("rep"), "label", "core")
        candidates = written(candidates, "candidates")
        # Texts of components of several sets, once; comparing them reads no others.
        several = candidates.groupBy("label").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
        asked = candidates.join(several, "label", "left_semi").select(F.col("rep").alias("id")).distinct()
        texts = written(texts.select("id", "text").join(asked.hint("merge"), "id", "left_semi"), "texts")
        links = exact_links(texts, candidates, k, similarity)
        labels = connected_components(links).withColumnRenamed("node", "rep")
        told = written(ids.join(labels, "rep", "left").select("rep", "doc_id", F.coalesce("label", "rep").alias("label")), "told")
        first = told.groupBy("label").agg(F.min("doc_id").alias("component_id"))
        told = keep(written(told.join(first, "label").select(F.col("rep").alias("d"), "component_id"), "told"))
    out = fps.join(told, "d", "left")
    component = F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).otherwise(F.col("doc_id"))
    return out.select(F.col("doc_id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col(key) == F.col("component_id"))


def components_sql(k: int = 3, percent: int = 85) -> str:
    """near_components over a table `documents`, as DuckDB SQL: all pairs that share a shingle, of all different sets."""
    return f"""WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS MATERIALIZED (SELECT r, list_sort(list_distinct(CASE WHEN len(w) >= {k} THEN list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM d),
c AS MATERIALIZED (SELECT r, len(s) AS n, min(r) OVER (PARTITION BY sha256(array_to_string(s, chr(10)))) AS rep FROM s),
u AS MATERIALIZED (SELECT r, n, unnest(s) AS x FROM s JOIN c USING (r) WHERE r = rep),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM u a JOIN u b ON a.x = b.x AND a.r <> b.r GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
p(a, b) AS (SELECT r, r FROM c WHERE r = rep UNION SELECT p.a, l.b FROM p JOIN l ON l.a = p.b),
m AS (SELECT p.a AS rep, min(d.doc_id) AS least FROM p JOIN c ON c.rep = p.b JOIN d ON d.r = c.r GROUP BY p.a),
o AS (SELECT doc_id, n AS n_shingles, CASE WHEN n = 0 THEN doc_id WHEN doc_id IS NOT NULL THEN least END AS component_id FROM d JOIN c USING (r) JOIN m USING (rep))
SELECT *, doc_id = component_id AS kept FROM o"""
