"""SimHash near-duplicates: fingerprints of word shingles, linked by the Gray-order hierarchical index of gray.py.

Components of fingerprints within a radius come from the index alone. Near-duplicates by similarity take the index for what lies
close, complete it with buckets of shared small shingle hashes for what a similarity of 0.8 can set further apart, and decide
links by the exact similarity of shingle sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, plus, small_batches, temporary, written
from .components import connected_components, merged_labels
from .gray import FAN, fingerprint_links, gray_rank, local_labels, own_links
from .sql_hash import xxh64

SEED = 42


# Fingerprints ------------------------------------------------------------------------------------


def shingle_hashes(text: str | None, k: int) -> list[int]:
    """XXH64 (seed 42) of each run of k words, words lower-cased in A-Z; the whole sequence if there are fewer; none: empty."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return []
    n = len(words)
    joined = b" ".join(words)
    if n <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, n) - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[k - 1 :] - 1).tolist(), strict=False)]


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each run of hashes (counts long): a bit is 1 if set in over half of the run; none: 0."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    n = counts[full]
    # Byte-wide counters: runs of 255 at most, then wide sums.
    parts = -(-n // 255)
    owner = np.repeat(np.arange(len(full)), parts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(parts) - parts, parts)
    bounds = np.repeat(np.cumsum(n) - n, parts) + nth * 255
    first = np.flatnonzero(nth == 0)
    lanes = np.uint64(0x0101010101010101)
    for j in range(8):
        lane = np.add.reduceat((hashes >> np.uint64(j)) & lanes, bounds)
        wide = np.add.reduceat(lane.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
        for byte in range(8):
            out[full] |= (wide[:, byte] * 2 > n).astype(np.uint64) << np.uint64(8 * byte + j)
    return out


def with_fingerprints(docs: DataFrame, k: int = 4, text: str = "text", out: str = "fp") -> DataFrame:
    """docs with a long column out that holds the fingerprint's 64 bits. Null or blank texts: 0."""

    def run(batches):
        for b in batches:
            hashes = [shingle_hashes(t, k) for t in b.column(text).to_pylist()]
            counts = np.fromiter(map(len, hashes), np.int64, len(hashes))
            flat = np.fromiter((h for hs in hashes for h in hs), np.uint64, int(counts.sum()))
            yield pa.RecordBatch.from_arrays([*[c for c, n in zip(b.columns, b.schema.names, strict=True) if n != text], pa.array(majority_bits(flat, counts).view(np.int64))], [*[n for n in b.schema.names if n != text], out])

    small_batches(docs.sparkSession)
    schema = plus(docs.drop(text).schema, **{out: "long"})
    return docs.mapInArrow(run, schema)


def simhash_components(docs: DataFrame, k: int = 4, radius: int = 4, key: str = "doc_id") -> DataFrame:
    """key, fp (long), component_id (the smallest key reachable over links, itself included) for every row of docs.

    Null and blank texts have the fingerprint 0 and link like any other. Rows with a null key link others but get a null
    component. Repeated rows stay; other columns are ignored. An empty table gives no rows.
    """
    with temporary(docs.sparkSession) as keep:
        fps = keep(written(with_fingerprints(docs.select(docs[key].cast("long").alias("doc_id"), F.col("text")), k), "fingerprints"))
        classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "classes")
        labels = connected_components(fingerprint_links(classes.select("fp", F.col("fp").alias("rep")), radius)).withColumnRenamed("node", "fp")
        told = written(classes.join(labels, "fp", "left").select("fp", "id", F.coalesce("label", "fp").alias("label")), "told")
        least = told.groupBy("label").agg(F.min("id").alias("component_id"))
        told = keep(written(told.join(least, "label").select("fp", "component_id"), "told"))
    out = fps.join(told, "fp")
    return out.select(F.col("doc_id").alias(key), "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def components_sql(k: int = 4, radius: int = 4) -> str:
    """doc_id, fingerprint and component_id over a table `documents`, as DuckDB SQL: every pair of fingerprints is compared."""
    hashed = xxh64("SELECT s, hex(encode(s)) AS x FROM (SELECT DISTINCT s FROM s)", "x", f"{SEED}::uhugeint", "h")
    bits = " + ".join(f"CASE WHEN 2 * sum((h >> {b}) & 1) > count(*) THEN {1 << b}::uhugeint ELSE 0::uhugeint END" for b in range(64))
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT r, unnest(CASE WHEN len(w) >= {k} THEN list_transform(generate_series(1, len(w) - {k - 1}), lambda i: array_to_string(w[i : i + {k - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
h AS (SELECT s, h::ubigint AS h FROM ({hashed})),
f AS (SELECT r, {bits} AS fp FROM s JOIN h USING (s) GROUP BY r),
t AS (SELECT doc_id, coalesce(fp, 0::uhugeint)::ubigint AS fp FROM d LEFT JOIN f USING (r)),
u AS (SELECT fp, min(doc_id) AS id FROM t GROUP BY fp),
l AS (SELECT a.fp AS a, b.fp AS b FROM u a JOIN u b ON a.fp <> b.fp AND bit_count((xor(a.fp, b.fp) >> 32)::bigint) + bit_count((xor(a.fp, b.fp) & 4294967295)::bigint) <= {radius}),
c(a, b) AS (SELECT fp, fp FROM u UNION SELECT c.a, l.b FROM c JOIN l ON l.a = c.b),
m AS (SELECT c.a AS fp, min(u.id) AS component_id FROM c JOIN u ON u.fp = c.b GROUP BY c.a)
SELECT doc_id, lpad(lower(hex(fp)), 16, '0') AS fingerprint, CASE WHEN doc_id IS NOT NULL THEN component_id END AS component_id FROM t JOIN m USING (fp)"""


# Near-duplicates by similarity -------------------------------------------------------------------

#: Words of 64 bits of a wide fingerprint; smallest shingle hashes that deal a text to buckets at first, and those that do where some of
#: the first have too large a bucket; how many of these must have a bucket of their own for a text to be told by them.
WORDS, KEYS, ALL_KEYS, ENOUGH = 8, 8, 24, 12
#: Rows of a bucket above which it is dealt again; standard deviations above the expected bits at which pairs are still candidates.
BUCKET, SPREAD = 1024, 5
#: Radius of the Gray-order index; members of a block that is compared exactly in one task.
CLOSE, BLOCK = 4, 512


def expected_bits(similarity: float, bits: int) -> float:
    """Bits in which texts with that share of common shingles differ on average."""
    return bits * float(np.arccos(2 * similarity / (1 + similarity))) / np.pi


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """The distinct shingle hashes of a text, sorted."""
    return np.unique(np.array(shingle_hashes(text, k), np.uint64))


def set_digest(shingles: np.ndarray) -> int:
    """One signed 64-bit hash of a whole set."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(shingles.tobytes())).view(np.int64))


def _wide(docs: DataFrame, k: int) -> DataFrame:
    """id, d (digest of the shingle set), w0.. (words of the set's fingerprint) and keys (smallest shingle hashes) for docs (id, text)."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column(1).to_pylist()]
            counts = np.fromiter(map(len, sets), np.int64, len(sets))
            flat = np.concatenate([np.zeros(0, np.uint64), *sets])
            words = [majority_bits(flat if w == 0 else mix64(flat + np.uint64(w)), counts) for w in range(WORDS)]
            keys = [x[:ALL_KEYS].view(np.int64) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(set_digest, sets), pa.int64()), *(pa.array(w.view(np.int64)) for w in words), pa.array(keys, pa.list_(pa.int64()))], ["id", "d", *(f"w{i}" for i in range(WORDS)), "keys"])

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "id long, d long, " + "".join(f"w{i} long, " for i in range(WORDS)) + "keys array<long>")


def exact_labels(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The smallest number reachable for each of sets (of distinct values) over pairs of that Jaccard similarity or more.

    A search from set to set: each reached one is compared with all that are not reached yet, so a group of near-copies costs
    little more than its size, and no pair that could join two components is left out.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, flat = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
    ends = np.cumsum(size)
    label = np.arange(len(sets))
    left = np.flatnonzero(size)
    flat_left = flat
    mark = np.zeros(len(values), bool)
    reached: list[int] = []
    while len(left):
        if reached:
            at = reached.pop()
        else:
            at = int(left[0])
            flat_left, left = flat_left[size[at] :], left[1:]
            if not len(left):
                break
        own = flat[ends[at] - size[at] : ends[at]]
        mark[own] = True
        common = np.add.reduceat(mark[flat_left], np.cumsum(size[left]) - size[left], dtype=np.int64)
        mark[own] = False
        near = common >= similarity * (size[left] + size[at] - common) - 1e-9
        if near.any():
            label[left[near]] = label[at]
            reached += left[near].tolist()
            flat_left, left = flat_left[np.repeat(~near, size[left])], left[~near]
    return label


def _exact_groups(k: int, similarity: float):
    """Batches of (group, d, text, pivot), sorted by group: star links (a, b) of the exact components of each group.

    What is linked to the group's pivot (a digest) has it as the star's centre. A text whose digest is not d belongs to another row of
    the same id and is left out.
    """

    def run(batches):
        group, held, pivot = None, {}, None

        def links(sets, pivot):
            ds = sorted(sets)
            label = exact_labels([sets[d] for d in ds], similarity)
            a = np.array(ds, np.int64)
            if pivot in sets:
                at = ds.index(pivot)
                label[label == label[at]] = at
            moved = label != np.arange(len(ds))
            return a[label[moved]], a[moved]

        for batch in batches:
            found = []
            for g, d, t, p in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if g != group:
                    found.append(links(held, pivot))
                    group, held, pivot = g, {}, p
                if d not in held:
                    x = shingle_set(t, k)
                    if set_digest(x) == d:
                        held[d] = x
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in links(held, pivot)], ["a", "b"])

    return run


def bucket_links(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, label: np.ndarray, wide: np.ndarray, radius: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links (rep, smallest rep) of the local components in each bucket; whole buckets, in any order.

    A link needs radius differing bits or fewer in fp, and most or fewer in fp and wide (more words of each fingerprint) together.
    Equal labels are linked already.
    """
    o = np.lexsort((gray_rank(fp), key))
    key, fp, rep, label, wide = key[o], fp[o], rep[o], label[o], wide[o]

    def close(i, j):
        ok = np.bitwise_count(fp[i] ^ fp[j]).astype(np.int64) + np.bitwise_count(wide[i] ^ wide[j]).sum(1) <= most
        return i[ok], j[ok]

    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.append(start, len(key)))

    def links():
        small = np.repeat(size <= FAN, size)  # one node: its fingerprints against each other
        bucket = np.repeat(np.arange(len(size)), size)
        for d in range(1, min(FAN, len(key))):
            i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d]) & (label[d:] != label[:-d]))
            yield close(*(x[np.bitwise_count(fp[i] ^ fp[i + d]) <= radius] for x in (i, i + d)))
        for s, n in zip(start[size > FAN].tolist(), size[size > FAN].tolist(), strict=True):
            _, first, same = np.unique(label[s : s + n], return_index=True, return_inverse=True)
            held = own_links(fp[s : s + n], radius, lambda i, j, s=s: tuple(x - s for x in close(s + i, s + j)), first[same])
            yield s + np.arange(n), s + held

    part = local_labels(len(key), links())
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, part, rep)
    root = least[part]
    linked = root != rep
    return rep[linked], root[linked]


def _linked_buckets(radius: int, most: int, run_rows: int):
    """Batches of (key, fp, rep, label, more words of the fingerprint ...), sorted by key: the links of each bucket; of one of more than
    run_rows rows those in each run of so many, in the order that the rows come in."""

    def run(batches):
        held: list[list[np.ndarray]] = []
        size = 0

        def out(c):
            new = np.r_[True, c[0][1:] != c[0][:-1]]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            part = np.cumsum(new | ((np.arange(len(new)) - first) % run_rows == 0))
            a, b = bucket_links(part, c[1].view(np.uint64), c[2], c[3], np.stack(c[4:], 1).view(np.uint64), radius, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            held.append([x.to_numpy(zero_copy_only=False) for x in batch.columns])
            size += batch.num_rows
            if size < 1 << 16:
                continue
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            first = int(np.flatnonzero(cols[0] == cols[0][-1])[0])
            cut = first + (len(cols[0]) - first) // run_rows * run_rows  # the last bucket may go on: its whole runs go now
            held, size = [[x[cut:] for x in cols]], len(cols[0]) - cut
            if cut:
                yield out([x[:cut] for x in cols])
        if size:
            yield out([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


def _far_labels(classes: DataFrame, similarity: float, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Labels (rep, label) of candidate components, from buckets of shared small shingle hashes: those that the fingerprints tell, and those
    that groups which are candidates as a whole join further.

    classes: rep, label, w0.., keys. Texts of that similarity share some of their KEYS smallest hashes but for a few in a million
    (0.2^8). A bucket whose rows have one label holds no news. A bucket above its size is searched in runs, each bucket's in the order
    of another word of the fingerprints, which brings near-copies together: what has one label then is done. Where all but a
    bucket's worth of rows have one label, the others become candidates with it. Hashes whose buckets are larger still belong to passages
    that many texts share. Texts with such a hash meet again in the buckets of all others of their ALL_KEYS smallest hashes; texts
    that have too few others, as the passage is most of them, are one candidate group, which the exact comparison takes apart.
    So no pair is lost to a bucket's size.
    """
    names = [f"w{i}" for i in range(WORDS)]
    share = expected_bits(similarity, 1)
    most, radius = (int(n * share + SPREAD * (n * share * (1 - share)) ** 0.5) for n in (64 * WORDS, 64))
    linked = lambda rows: written(rows.mapInArrow(_linked_buckets(radius, most, bucket), "a long, b long").distinct(), "links")

    def searched(keyed: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """labels after a search of all buckets of keyed (key, rep); members (key, rep) of those that are too large and mixed still; and for
        each such key the label b that most of its rows have, and how many others there are."""
        told = keyed.join(labels, "rep")
        sizes = told.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi"))
        sizes = written(sizes.where("lo != hi").select("key", "n"), "buckets")
        # Numbers of few bytes go to the buckets first; fingerprints only join what is left.
        fat = lambda rows: rows.join(classes.drop("label"), "rep").select("key", "w0", "rep", "label", *names[1:])
        small = fat(told.join(sizes.where(F.col("n") <= bucket).select("key"), "key", "left_semi"))
        found = linked(small.repartition("key").sortWithinPartitions("key"))
        members = written(keyed.join(sizes.where(F.col("n") > bucket).select("key"), "key", "left_semi"), "members")
        if not members.isEmpty():
            order = F.get(F.array(*names), F.pmod("key", F.lit(WORDS)).cast("int"))
            rows = fat(members.join(labels, "rep")).withColumn("_o", order).repartitionByRange("key", "_o").sortWithinPartitions("key", "_o").drop("_o")
            found = found.unionByName(linked(rows))
        labels = merged_labels(labels, found)
        counts = members.join(labels, "rep").groupBy("key", "label").agg(F.count(F.lit(1)).alias("c"))
        counts = counts.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "label")).alias("top"))
        counts = counts.where("top.c < n").select("key", F.col("top.label").alias("b"), (F.col("n") - F.col("top.c")).alias("others"))
        return labels, members, written(counts, "counts")

    def hubs(members: DataFrame, of: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of the members of some keys (key, b) to their b: they are candidates as a whole."""
        rows = members.join(of.select("key", "b"), "key").join(labels, "rep").where("label != b")
        return written(rows.select(F.col("rep").alias("a"), "b").distinct(), "hubs")

    hashed = lambda k: F.explode(F.transform(k, lambda x: F.xxhash64(x))).alias("key")
    labels, members, counts = searched(classes.select("rep", hashed(F.slice("keys", 1, KEYS))), classes.select("rep", "label"))
    whole = hubs(members, counts.where(F.col("others") <= bucket), labels)
    wide = counts.where(F.col("others") > bucket).select("key", "b")
    if not wide.isEmpty():
        members = members.join(wide.select("key"), "key", "left_semi")
        # What a text shares is told by rows of shared keys only, and taken from its list: no row of an own key goes through a join to be told.
        shared = lambda keyed, of, name: keyed.join(of.select("key"), "key", "left_semi").groupBy("rep").agg(F.collect_list("key").alias(name))
        listed = lambda c: F.coalesce(c, F.array().cast("array<long>"))
        apiece = lambda rows, keys: rows.select("rep", F.explode(keys).alias("key"))
        further = classes.join(members.select("rep").distinct(), "rep", "left_semi").select("rep", F.transform("keys", lambda x: F.xxhash64(x)).alias("all"))
        further = further.join(shared(apiece(further, F.col("all")), wide, "wide"), "rep", "left")
        further = written(further.select("rep", F.size("all").alias("all"), F.array_except("all", listed(F.col("wide"))).alias("own")), "further")
        labels, more, counts = searched(apiece(further, F.col("own")), labels)
        whole = whole.unionByName(hubs(more, counts.where(F.col("others") <= bucket), labels))
        wider = counts.where(F.col("others") > bucket).select("key", "b")
        told = further.join(shared(more, wider, "wider"), "rep", "left")
        few = told.select("rep", "all", (F.size("own") - F.size(listed(F.col("wider")))).alias("own"))
        few = few.where((F.col("own") < ENOUGH) & (F.col("own") * 2 < F.col("all"))).select("rep")
        last = members.unionByName(more).join(few, "rep", "left_semi")
        whole = whole.unionByName(hubs(last, wide.unionByName(wider), labels))
    return labels, merged_labels(labels, whole)


def _compared(texts: DataFrame, members: DataFrame, k: int, similarity: float) -> DataFrame:
    """Star links (a, b) of the exact components of each group. texts: id, text; members: id, d, group, pivot."""
    # Both sides grow with the corpus: the same plan at every size, never a broadcast.
    rows = texts.join(members.hint("merge"), "id").select("group", "d", "text", "pivot")
    return written(rows.repartition("group").sortWithinPartitions("group").mapInArrow(_exact_groups(k, similarity), "a long, b long"), "links")


def exact_links(texts: DataFrame, candidates: DataFrame, k: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between digests whose shingle sets have that Jaccard similarity or more, inside each candidate component.

    texts: id, text. candidates: d, rep (an id whose text has that digest), label (the component), core (its part that fingerprints
    alone join). The links join what any pairs inside a component join. A component of more than `block` members is dealt to blocks. A
    member of its largest core, the pivot, goes to every block: what links to it there is settled with all others of the kind, which is
    nearly all of a group of copies. The rest of the component then meets every block of it, in parts of `block` members.
    """
    cores = candidates.groupBy("label", "core").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("d", "rep")).alias("first"))
    sizes = cores.groupBy("label").agg(F.sum("c").alias("n"), F.max_by("first", F.struct("c", "core")).alias("pivot")).where("n > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / F.lit(block)).cast("int"))
    at = F.pmod(F.xxhash64("d", F.lit("block")), F.col("blocks")).cast("int")
    member = candidates.join(sizes, "label").select("label", "d", F.col("rep").alias("id"), at.alias("block"), "blocks", "pivot")
    member = written(member, "members")
    group = lambda *c: F.xxhash64("label", *c).alias("group")
    pivots = member.where("blocks > 1").select("label", "block", "pivot").distinct()
    pivots = pivots.select(F.col("pivot.rep").alias("id"), F.col("pivot.d").alias("d"), group("block"), F.col("pivot.d").alias("pivot"))
    links = _compared(texts, member.select("id", "d", group("block"), F.col("pivot.d").alias("pivot")).unionByName(pivots).distinct(), k, similarity)
    large = member.where("blocks > 1")
    if large.isEmpty():
        return links
    settled = links.select(F.col("b").alias("d"), F.col("a").alias("p"))
    rest = large.join(settled, "d", "left").where("p is null or p != pivot.d").where("d != pivot.d").select("label", "id", "d", "blocks").distinct()
    rest = written(rest, "rest")
    if rest.isEmpty():
        return links
    parts = rest.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("d", F.lit("part")), F.col("parts")).cast("int")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    rest = rest.join(parts, "label").select("label", "id", "d", part.alias("part"), upto("blocks").alias("block"))
    held = large.join(parts, "label").select("label", "id", "d", "block", upto("parts").alias("part"))
    meet = held.unionByName(rest, allowMissingColumns=True).select("id", "d", group("block", "part"), F.lit(None).cast("long").alias("pivot")).distinct()
    return links.unionByName(_compared(texts, meet, k, similarity))


def similar_components(docs: DataFrame, k: int = 5, similarity: float = 0.8, key: str = "doc_id", bucket: int = BUCKET) -> DataFrame:
    """key and component_id (the smallest key reachable) of every row of docs with a key, texts linked from a similarity on.

    A link is a Jaccard similarity of the sets of shingle hashes, computed exactly. Candidates come from SimHash fingerprints of the
    sets: the Gray-order index joins those within CLOSE bits, and whole groups of near-copies at once. At a similarity of 0.8
    fingerprints differ in about ten bits of 64, too many for any order to prune; there, texts meet in buckets of their smallest
    shingle hashes (similar texts share most of them), in which fingerprints of WORDS x 64 bits may differ in as many bits as sets of
    that similarity do on average, and SPREAD standard deviations. Inside candidate components exact links decide.
    Null and blank texts have equal sets. Rows with null key take no part. An empty table gives no rows.
    """
    names = [f"w{i}" for i in range(WORDS)]
    with temporary(docs.sparkSession) as keep:
        texts = docs.select(docs[key].cast("long").alias("id"), "text").where("id is not null")
        fps = keep(written(_wide(texts, k), "wide"))
        classes = written(fps.groupBy("d", *names).agg(F.min("id").alias("id"), F.min("keys").alias("keys")).withColumnRenamed("d", "rep"), "classes")
        first = written(classes.groupBy(F.col("w0").alias("fp")).agg(F.min("rep").alias("rep")), "first")
        equal = classes.select("rep", F.col("w0").alias("fp")).join(first.withColumnRenamed("rep", "b"), "fp").select(F.col("rep").alias("a"), "b").where("a != b")
        near = written(fingerprint_links(first, CLOSE).unionByName(equal), "near")
        labels = connected_components(near).withColumnRenamed("node", "rep")
        classes = written(classes.join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")), "labelled")
        # Candidate components, then the components of exact links inside them.
        cores, labels = _far_labels(classes, similarity, bucket)
        ids = classes.select("rep", "id")
        candidates = labels.join(cores.withColumnRenamed("label", "core"), "rep").join(ids, "rep").select(F.col("rep").alias("d"), F.col("id").alias("rep"), "label", "core")
        labels = connected_components(exact_links(texts, written(candidates, "candidates"), k, similarity)).withColumnRenamed("node", "rep")
        told = written(ids.join(labels, "rep", "left").select("rep", "id", F.coalesce("label", "rep").alias("label")), "told")
        least = told.groupBy("label").agg(F.min("id").alias("component_id"))
        told = keep(written(told.join(least, "label").select(F.col("rep").alias("d"), "component_id"), "told"))
    return fps.select("id", "d").join(told, "d").select(F.col("id").alias(key), "component_id")


def one_of_each(docs: DataFrame, **kw) -> DataFrame:
    """docs with one row, that of the smallest doc_id, of each group of near-duplicates; rows without doc_id all stay.

    Of rows that share the doc_id that stays, the one with the smallest hash of its text does.
    """
    told = similar_components(docs, **kw).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("doc_id") == F.col("component_id")).alias("stays"))
    kept = written(told.where("stays").select("doc_id", "n"), "kept")
    # Both sides grow with the corpus: the same plan at every size, never a broadcast.
    out = docs.join(kept.select("doc_id").hint("merge"), "doc_id", "left_semi").select(*docs.columns)
    many = kept.where("n > 1").select("doc_id")
    if not many.isEmpty():
        mark = F.xxhash64("text", F.isnull("text"))
        first = docs.join(many, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(mark).alias("_mark"))
        twice = docs.join(first, "doc_id").where(mark == F.col("_mark")).dropDuplicates(["doc_id"]).select(*docs.columns)
        out = out.join(many, "doc_id", "left_anti").select(*docs.columns).unionByName(twice)
    return out.unionByName(docs.where("doc_id is null"))
