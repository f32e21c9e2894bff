"""Removal of repeated byte strings with suffix arrays.

A byte goes if it lies in a SPAN-byte window that also starts anywhere else. Windows are dealt to groups by content: a
window's own smallest hash of GRAM bytes names its group, so equal windows always meet. Neighbouring windows of a text with the same
minimal gram form a fragment; equal fragments are one before any is moved, and weigh as many as they are. Shards hold the fragments of
groups, GROUP of them at most of one group. Each shard joins its fragments, sorts their suffixes by Larsson-Sadakane refinement (ranks of
depth h double to 2 h, only where they still tie), takes Kasai's common prefixes, and marks the windows in runs of prefixes of
SPAN bytes or more that weigh two or more. Of a group that is split over shards, each shard passes on the sorted digests of its different
windows, one a run, and these lists are merged by binary search. No text is compared with all others, and no group has to
fit in one task.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, mix64, plus, release, small_batches, temporary, written

SPAN, GRAM = 200, 16
#: Different fragments of a group in one shard, and on average in a range of digests that is merged at once; bytes handled at once
#: (places must fit PLACE bits).
GROUP, RANGE, PLACE = 256, 4096, 20
CHUNK = 1 << PLACE
KASAI_LANE = 256
T_SCHEMA = "h long, fd long, id long, th long, s0 int, n int"


# Fragments ---------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the GRAM (16) bytes at each place that has so many."""
    n = len(data) - 7
    eight = np.empty(n, np.uint64)
    raw = data.tobytes()
    for j in range(min(8, n)):
        eight[j::8] = np.frombuffer(raw, "<u8", count=(n - j + 7) // 8, offset=j)
    with np.errstate(over="ignore"):
        return mix64(eight[:-8] * np.uint64(0x9E3779B97F4A7C15) ^ (eight[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93))


def window_minima(key: np.ndarray, w: int) -> np.ndarray:
    """Smallest of each w neighbours, by prefix and suffix minima of blocks."""
    n = len(key) - w + 1
    blocks = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    blocks[: len(key)] = key
    blocks = blocks.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def fragments(texts: list[bytes], span: int = SPAN):
    """(text number, first window, number of windows, group hash, content digest) arrays of all fragments, in parts."""
    part: list[tuple[int, int, bytes]] = []
    size = 0

    def out():
        raw = b"".join(p[2] for p in part)
        data = np.frombuffer(raw, np.uint8)
        length = np.fromiter((len(p[2]) for p in part), np.int64, len(part))
        begin = np.cumsum(length) - length
        h = gram_hashes(data)
        place = np.uint64(CHUNK - 1)
        low = window_minima((h & ~place) | np.arange(len(h), dtype=np.uint64), span - GRAM + 1)
        own = np.repeat(np.arange(len(part)), length)[: len(low)]
        good = np.arange(len(low)) + span <= (begin + length)[own]
        new = np.r_[True, (low[1:] != low[:-1]) | (own[1:] != own[:-1])]
        s0 = np.flatnonzero(new & good)  # the windows of a part that fit in it come first
        stop = np.append(np.flatnonzero(new | ~good), len(low))
        n = stop[np.searchsorted(stop, s0, "right")] - s0
        h = h[(low[s0] & place).astype(np.int64)]
        digest = xxhash.xxh3_64_intdigest
        view = memoryview(raw)
        fd = np.fromiter((digest(view[a:b]) for a, b in zip(s0.tolist(), (s0 + n + span - 1).tolist(), strict=True)), np.uint64, len(s0))
        number = np.fromiter((p[0] for p in part), np.int64, len(part))[own[s0]]
        offset = np.fromiter((p[1] for p in part), np.int64, len(part))[own[s0]]
        return number, s0 - begin[own[s0]] + offset, n, h, fd

    for i, t in enumerate(texts):
        for lo in range(0, max(0, len(t) - span + 1), CHUNK // 2):  # a text longer than that goes in overlapping parts
            piece = t[lo : lo + CHUNK // 2 + span - 1] if len(t) > CHUNK // 2 else t
            if size + len(piece) > CHUNK and part:
                yield out()
                part, size = [], 0
            part.append((i, lo, piece))
            size += len(piece)
            if piece is t:
                break
    if part:
        yield out()


# Suffix arrays -----------------------------------------------------------------------------------


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All suffixes in order, by Larsson-Sadakane refinement.

    The first ranks come from eight bytes; a rank is the place of the last suffix of its group. Each round sorts the
    suffixes of groups that still tie by the ranks that lie h further on, and doubles h, until none ties: the walk over common
    prefixes needs the whole order.
    """
    n = len(data)
    padded = np.r_[data, np.zeros(8, np.uint8)].astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = key << np.uint64(8) | padded[j : j + n]
    order = np.argsort(key)  # the default sort is several times as fast as the stable one; what ties is sorted further below
    k = key[order]
    last = np.flatnonzero(np.r_[k[1:] != k[:-1], True])
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    size = np.diff(np.r_[-1, last])
    rank[order] = np.repeat(last, size)
    ties = np.flatnonzero(np.repeat(size > 1, size))
    h = 8
    while len(ties):
        at = order[ties]
        group, further = rank[at], rank[np.minimum(at + h, n)]
        o = np.argsort(group * (n + 2) + further + 1)
        at, group, further = at[o], group[o], further[o]
        order[ties] = at
        end = np.r_[(group[1:] != group[:-1]) | (further[1:] != further[:-1]), True]
        stop = np.flatnonzero(end)
        size = np.diff(np.r_[-1, stop])
        rank[at] = np.repeat(ties[stop], size)
        ties = ties[np.repeat(size > 1, size)]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix (most at most) of each suffix with the one before it in order.

    Kasai's walk in text order, many stretches of the text at once: from one suffix to the next the common prefix
    shrinks by one at most.
    """
    n = len(data)
    before = np.empty(n, np.int64)
    before[order[1:]] = order[:-1]
    before[order[0]] = n
    padded = np.r_[data.astype(np.int16), np.full(most + 1, -1, np.int16)]
    other = np.r_[data.astype(np.int16), np.full(most + 1, -2, np.int16)]
    found = np.zeros(n, np.int64)
    i = np.arange(0, n, KASAI_LANE)
    end = np.minimum(i + KASAI_LANE, n)
    l = np.zeros(len(i), np.int64)  # noqa: E741
    while len(i):
        b = before[i]
        same = (l < most) & (padded[i + l] == other[np.minimum(b + l, n + most)])
        stop = ~same
        found[i[stop]] = l[stop]
        l = np.where(same, l + 1, np.maximum(l - 1, 0))  # noqa: E741
        i = i + stop
        live = i < end
        if not live.all():
            i, end, l = i[live], end[live], l[live]  # noqa: E741
    return found[order]


def window_runs(data: np.ndarray, valid: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The valid window starts of data in the order of their suffixes, and the number of the run of equal windows that each is in."""
    order = suffix_array(data)
    prefix = common_prefixes(data, order, span)
    run = np.cumsum(prefix < span) - 1
    ok = valid[order]
    return order[ok], run[ok]


def repeated_windows(data: np.ndarray, valid: np.ndarray, span: int, weight: np.ndarray | None = None) -> np.ndarray:
    """Which of the valid window starts of data have an equal window at another valid start, or weigh more than one."""
    starts, run = window_runs(data, valid, span)
    out = np.zeros(len(data), bool)
    if len(starts):
        out[starts] = np.bincount(run, None if weight is None else weight[starts])[run] > 1
    return out


SHARDS = "h long, fd long, lo int, hi int, r long, dig binary, fds binary, los binary, known binary"


def _shard(span: int):
    """Whole shards in, sorted by (h, salt): ranges of windows that repeat inside the shard (dig null), and for split groups the lists
    of digests of different windows, a row for each range r of digests."""
    names = [x.split()[0] for x in SHARDS.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4)

    def batch(**cols):
        n = len(next(iter(cols.values())))
        return pa.RecordBatch.from_arrays([pa.array(cols[c], k) if c in cols else pa.nulls(n, k) for c, k in zip(names, kinds, strict=True)], names)

    def out(rows):
        h, salt, fd, split, many, ranges, frag = (x for x in zip(*rows, strict=True))
        length = np.fromiter(map(len, frag), np.int64, len(frag))
        begin = np.cumsum(length) - length
        raw = b"".join(frag)
        data = np.frombuffer(raw, np.uint8)
        own = np.repeat(np.arange(len(frag)), length)
        valid = np.arange(len(data)) + span <= (begin + length)[own]
        starts, run = window_runs(data, valid, span)
        heavy = np.bincount(run, 1.0 + np.array(many, bool)[own[starts]]) > 1
        hit = np.zeros(len(data), bool)
        hit[starts] = heavy[run]
        edge = np.diff(np.r_[False, hit, False].astype(np.int8))
        lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # never across fragments: their last places are no windows
        o = own[lo]
        hs, fds = np.array(h, np.int64), np.array(fd, np.int64)
        yield batch(h=hs[o], fd=fds[o], lo=(lo - begin[o]).astype(np.int32), hi=(hi - begin[o]).astype(np.int32))
        # One window of each run; if a run is light, that is its only one.
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        cut = starts[first]
        known = heavy[run[first]]
        of = own[cut]
        there = np.array(split, bool)[of]
        cut, known, of = cut[there], known[there], of[there]
        if not len(cut):
            return
        dig = np.frombuffer(b"".join(xxhash.xxh3_128_digest(raw[i : i + span]) for i in cut.tolist()), np.uint64).reshape(-1, 2)
        r = ((dig[:, 0] >> np.uint64(32)) * np.array(ranges, np.uint64)[of] >> np.uint64(32)).astype(np.int64)
        salts = np.array(salt, np.int64)[of]
        by = np.lexsort((dig[:, 0], r, salts, hs[of]))
        key = np.stack([hs[of], salts, r])[:, by]
        at = np.flatnonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])
        parts = [np.split(x, at[1:]) for x in (dig[by], fds[of][by], (cut - begin[of])[by].astype(np.int32), known[by])]
        for i in range(0, len(at), 64):
            yield batch(h=key[0, at[i : i + 64]], r=key[2, at[i : i + 64]], **{c: [x.tobytes() for x in p[i : i + 64]] for c, p in zip(("dig", "fds", "los", "known"), parts, strict=True)})

    def run(batches):
        held, size, last = [], 0, None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size > CHUNK and row[:2] != last:
                    yield from out(held)
                    held, size = [], 0
                last = row[:2]
                held.append(row)
                size += len(row[6])
        if held:
            yield from out(held)

    return run


class MergedLists:
    """Sorted lists of different digests that come one after another, merged by binary search.

    What was merged is kept in sorted parts whose sizes double, so each list is searched for in few of them. A digest that two lists hold
    is told once for each place (fd, lo) that did not know yet.
    """

    def __init__(self):
        self.parts: list[tuple[np.ndarray, ...]] = []  # (first half, second half, fd, lo, known)

    def add(self, a: np.ndarray, b: np.ndarray, fd: np.ndarray, lo: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(fd, lo) of the places that are now known to repeat."""
        told_fd, told_lo = [], []
        for pa_, pb, pfd, plo, pknown in self.parts:
            at = np.searchsorted(pa_, a)
            found = np.zeros(len(a), bool)
            left = np.flatnonzero(at < len(pa_))
            while len(left):  # again where the first halves are equal and the second are not
                left = left[pa_[at[left]] == a[left]]
                same = pb[at[left]] == b[left]
                here = at[left[same]]
                found[left[same]] = True
                new = here[~pknown[here]]
                told_fd.append(pfd[new]), told_lo.append(plo[new])
                pknown[here] = True
                left = left[~same]
                at[left] += 1
                left = left[at[left] < len(pa_)]
            new = found & ~known
            told_fd.append(fd[new]), told_lo.append(lo[new])
            a, b, fd, lo, known = (x[~found] for x in (a, b, fd, lo, known))
        if len(a):
            part = (a, b, fd, lo, known.copy())
            while self.parts and len(self.parts[-1][0]) <= 2 * len(part[0]):
                part = tuple(np.concatenate(x) for x in zip(self.parts.pop(), part, strict=True))
                o = np.lexsort((part[1], part[0]))
                part = tuple(x[o] for x in part)
            self.parts.append(part)
        return np.concatenate([np.zeros(0, np.int64), *told_fd]), np.concatenate([np.zeros(0, np.int32), *told_lo])


def _merge_lists(batches):
    """Rows (h, r, dig, fds, los, known), sorted by (h, r): the windows (h, fd, lo) whose digest lists of two shards hold."""
    key, merged = None, MergedLists()
    for b in batches:
        h_, fd_, lo_ = [], [], []
        for h, r, dig, fds, los, known in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (h, r) != key:
                key, merged = (h, r), MergedLists()
            d = np.frombuffer(dig, np.uint64).reshape(-1, 2)
            fd, lo = merged.add(d[:, 0].copy(), d[:, 1].copy(), np.frombuffer(fds, np.int64), np.frombuffer(los, np.int32), np.frombuffer(known, bool))
            h_.append(np.full(len(fd), h)), fd_.append(fd), lo_.append(lo)
        if h_:
            h, fd, lo = (np.concatenate(x) for x in (h_, fd_, lo_))
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(fd, pa.int64()), pa.array(lo.astype(np.int32))], ["h", "fd", "lo"])


# The operator ------------------------------------------------------------------------------------


def fragment_table(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """A row for each fragment of each text: h, fd (digest of its content), id, th, s0, n. docs: id, th, text."""
    small_batches(docs.sparkSession)

    def cut(batches):
        for b in batches:
            ids, th = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for number, s0, n, h, fd in fragments([(t or "").encode("utf-8", "replace") for t in b.column(2).to_pylist()], span):
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(fd.view(np.int64)), pa.array(ids[number]), pa.array(th[number]), pa.array(s0.astype(np.int32)), pa.array(n.astype(np.int32))], ["h", "fd", "id", "th", "s0", "n"])

    return written(docs.select("id", "th", "text").mapInArrow(cut, T_SCHEMA), "fragments")


def wanted_fragments(pieces: DataFrame, group: int = GROUP) -> DataFrame:
    """(id, th, want): which fragments of which texts stand for their kinds in the shards. pieces: fragment_table."""
    with temporary(pieces.sparkSession) as keep:
        kinds = pieces.groupBy("h", "fd").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("id", "th", "s0", "n")).alias("rep"))
        kinds = written(kinds, "kinds")
        release(pieces.sparkSession)
        several = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("d"), F.max("c").alias("most")).where("d > 1 or most > 1").drop("most")
        # One text of each different fragment, in shards where a group has many.
        parts = F.ceil(F.col("d") / group).cast("long")
        reps = kinds.join(several, "h").select("rep.*", "h", "fd", F.pmod("fd", parts).alias("salt"), (parts > 1).alias("split"), (F.col("c") > 1).alias("many"), F.ceil(F.col("d") / RANGE).cast("long").alias("ranges"))
        return keep(written(reps.groupBy("id", "th").agg(F.collect_list(F.struct("h", "salt", "fd", "split", "many", "ranges", "s0", "n")).alias("want")), "wanted"))


def judged_shards(docs: DataFrame, pieces: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """What the shards of all groups of two fragments or more (equal ones counted) say, as in SHARDS. pieces: fragment_table of docs."""

    def pick(batches):
        for b in batches:
            rows = []
            for text, want in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode("utf-8", "replace")
                rows += [(w["h"], w["salt"], w["fd"], w["split"], w["many"], w["ranges"], raw[w["s0"] : w["s0"] + w["n"] + span - 1]) for w in want]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
            kinds_ = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds_, strict=True)], ["h", "salt", "fd", "split", "many", "ranges", "frag"])

    lists = wanted_fragments(pieces, group)
    picked = docs.join(lists, ["id", "th"]).select("text", "want").mapInArrow(pick, "h long, salt long, fd long, split boolean, many boolean, ranges long, frag binary")
    judged = picked.repartition("h", "salt").sortWithinPartitions("h", "salt").mapInArrow(_shard(span), SHARDS)
    return written(judged, "shards")


def repeated_spans(docs: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """(id, th, spans): for each text that has some, the ranges [lo, hi) of starts of repeated windows. docs: id, th, text."""
    with temporary(docs.sparkSession) as keep:
        t = fragment_table(docs, span)
        judged = judged_shards(docs, t, span, group)
        release(docs.sparkSession)
        lists = judged.where("dig is not null").select("h", "r", "dig", "fds", "los", "known")
        apart = lists.repartition("h", "r").sortWithinPartitions("h", "r").mapInArrow(_merge_lists, "h long, fd long, lo int")
        inside = judged.where("dig is null").select("h", "fd", "lo", "hi").unionByName(apart.select("h", "fd", "lo", (F.col("lo") + 1).alias("hi")))
        # What holds for a kind of fragment holds wherever it occurs. The join reads tables on both sides, so that a kind that
        # occurs very often is a skewed partition which can be split.
        ranges = written(inside.groupBy("h", "fd").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges")), "ranges")
        found = t.join(ranges, ["h", "fd"]).select("id", "th", F.explode("ranges").alias("r"), "s0")
        spans = found.groupBy("id", "th").agg(F.collect_set(F.struct((F.col("s0") + F.col("r.lo")).alias("lo"), (F.col("s0") + F.col("r.hi")).alias("hi"))).alias("spans"))
        return keep(written(spans, "spans"))


def removed_runs(spans: list[dict] | None, span: int) -> list[tuple[int, int]]:
    """Maximal byte runs [a, b) that windows with starts in spans cover."""
    runs: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"] - 1 + span) for s in spans or ()):
        if runs and lo <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], hi)
        else:
            runs.append([lo, hi])
    return [(a, b) for a, b in runs]


def without_repeats(docs: DataFrame, span: int = SPAN, group: int = GROUP) -> DataFrame:
    """docs with kept (the remaining bytes of text), n_bytes, n_removed and n_spans added.

    Null texts count as empty. Texts shorter than span lose nothing. Rows repeated in full repeat each other. Null doc_ids
    are told apart by their texts. Other columns stay.
    """
    keyed = docs.withColumns({"_id": F.coalesce(docs.doc_id.cast("long"), F.lit(-1)), "_th": F.xxhash64("text")})
    spans = repeated_spans(keyed.select(F.col("_id").alias("id"), F.col("_th").alias("th"), "text"), span, group)
    spans = spans.select(F.col("id").alias("_id"), F.col("th").alias("_th"), F.col("spans").alias("_spans"))
    names = [c for c in docs.columns if c not in ("kept", "n_bytes", "n_removed", "n_spans")]
    own = keyed.join(spans, ["_id", "_th"], "left").select(*names, "_spans")

    def strip(batches):
        for b in batches:
            kept, size, gone, many = [], [], [], []
            for text, s in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "replace")
                runs = removed_runs(s, span)
                at, rest = 0, []
                for lo, hi in runs:
                    rest.append(raw[at:lo])
                    at = hi
                kept.append(b"".join([*rest, raw[at:]]))
                size.append(len(raw)), gone.append(len(raw) - len(kept[-1])), many.append(len(runs))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(kept, pa.binary()), *(pa.array(x, pa.int64()) for x in (size, gone, many))], [*b.schema.names[:-1], "kept", "n_bytes", "n_removed", "n_spans"])

    return own.mapInArrow(strip, plus(own.drop("_spans").schema, kept="binary", n_bytes="long", n_removed="long", n_spans="long"))


def repeat_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row of docs."""
    out = without_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def deduplicated_documents(docs: DataFrame) -> DataFrame:
    """docs with the repeated bytes taken out of text; a character that lost some of its bytes goes as a whole. Null texts stay."""
    docs, names = guarded(docs, "doc_id", "text")
    out = without_repeats(docs)

    def decode(batches):
        for b in batches:
            texts = [None if t is None else k.decode("utf-8", "ignore") for t, k in zip(b.column("text").to_pylist(), b.column("kept").to_pylist(), strict=True)]
            at = b.schema.names.index("text")
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns) if b.schema.names[i] != "kept"], [n for n in b.schema.names if n != "kept"])

    out = out.drop("n_bytes", "n_removed", "n_spans")
    return out.mapInArrow(decode, out.drop("kept").schema).select(*docs.columns).toDF(*names)




def repeat_sql(span: int = SPAN) -> str:
    """repeat_report over a table `documents`, as DuckDB SQL: every window of every text is hashed and counted."""
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, i, md5_number(substr(x, CAST(2 * i + 1 AS bigint), {2 * span})) AS h FROM (SELECT r, x, unnest(generate_series(0, length(x) // 2 - {span})) AS i FROM d)),
s AS (SELECT r, i FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
g AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= {span} + lag(i) OVER (PARTITION BY r ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM s)),
c AS (SELECT r, min(i) AS lo, max(i) + {span} AS hi FROM g GROUP BY r, run),
e AS (SELECT r, lo, hi FROM c UNION ALL SELECT r, length(x) // 2, length(x) // 2 FROM d),
k AS (SELECT e.r, string_agg(substr(d.x, 2 * a + 1, 2 * (lo - a)), '' ORDER BY lo, hi) AS kept FROM (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo, hi), 0) AS a FROM e) e JOIN d USING (r) GROUP BY e.r)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(removed, 0)::bigint AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256
FROM d JOIN k USING (r) LEFT JOIN (SELECT r, sum(hi - lo) AS removed, count(*) AS spans FROM c GROUP BY r) USING (r)"""
