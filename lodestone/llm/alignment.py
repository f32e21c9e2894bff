"""Alignment of two tokenizers by an event sweep.

Both tokenizers' tokens end at byte offsets of the same text. The end events of both are united, dealt by document and sorted by
offset inside a partition, and a state machine passes over them: where a token of A and one of B end together a group of both is
closed. It holds the tokens behind the last common end, the open document's sums, and its linked id pairs. Events are packed: a row is a
run of consecutive tokens of one side with the offset that it starts at; lengths of tokens, and so all ends, follow from their ids.

Corpus-wide counts of linked id pairs go back to the documents by blocks: a block of documents asks once for each pair it holds.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, temporary, written

#: Tokens of a run; tokens that the sweep gathers before it matches ends; distinct pairs of a block of documents, about.
RUN, GATHER, BLOCK_PAIRS = 8192, 1 << 18, 1 << 21
#: Words that a worker remembers, and their length at most: memory stays bounded, results do not depend on it.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: Words that are encoded as one text. Fixed value: how byte-level BPE cuts texts.
TOGETHER = 400
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Groups with more links are linked by their distinct ids. Documents lie this many bits apart on the sweep's line.
LARGE_GROUP, SPAN = 4096, 40
#: No token of either kind reaches over a space between two characters that are not blank, so texts are encoded word by word.
CUT = re.compile(r"(?<=\S) (?=\S)")
EVENTS = "k1 long, k2 long, doc_id long, start long, side byte, void boolean, ids binary"
KEY = ["k1", "k2", "doc_id", "start", "side", "void", "ids"]


class Tokens:
    """A tokenizer: ids of ` word` for words, and the bytes of each id."""

    def __init__(self, of: list[bytes]):
        if len(of) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.of = of
        self.lengths = np.array([len(x) for x in of], np.int64)
        self.cache: dict[str, bytes] = {}
        self.passing: dict[str, bytes] = {}
        self.bad: set[str] = set()

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Ids of ` text` for each text."""
        raise NotImplementedError

    def learn(self, texts: list[list[str]]) -> None:
        """Encode what is not remembered, each word once, many in one text: words are encoded alike wherever they stand. Only words with a
        blank at an end (the first or last of a text) would grow together with their neighbour's space; those are encoded alone."""
        self.passing.clear()
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            self.bad.clear()
        new = sorted(dict.fromkeys(w for ws in texts for w in ws if w not in self.cache), key=lambda w: (not w.isascii() and max(w) >= "\u0250"))
        alone = [w for w in new if w != w.strip()]
        new = [w for w in new if w == w.strip()]
        groups = [new[i : i + TOGETHER] for i in range(0, len(new), TOGETHER)] + [[w] for w in alone]
        joined = [" ".join(ws) for ws in groups]
        for ws, text, ids in zip(groups, joined, self.encoded(joined) if joined else [], strict=True):
            if b"".join([self.of[i] for i in ids]) == f" {text}".encode():
                found = np.array(ids, np.uint16)
                ends = np.cumsum(np.fromiter((len(w.encode()) + 1 for w in ws), np.int64, len(ws)))
                cuts = (2 * (np.searchsorted(np.cumsum(self.lengths[found]), ends) + 1)).tolist()
                raw = found.tobytes()
                parts = [raw[i:j] for i, j in zip([0, *cuts], cuts, strict=False)]
            else:  # some word is not given back by its tokens: one by one
                each = self.encoded(ws)
                parts = [np.array(x, np.uint16).tobytes() for x in each]
                self.bad.update(w for w, x in zip(ws, each, strict=True) if b"".join([self.of[i] for i in x]) != f" {w}".encode())
            for w, part in zip(ws, parts, strict=True):
                (self.cache if len(w) <= CACHE_CHARS else self.passing)[w] = part

    def ids(self, text: str, words: list[str]) -> np.ndarray | None:
        """All ids of ` text`; None if their bytes differ from it."""
        try:
            raw = b"".join(map(self.cache.__getitem__, words))
        except KeyError:
            raw = b"".join([self.cache[w] if w in self.cache else self.passing[w] for w in words])
        found = np.frombuffer(raw, np.uint16)
        whole = not self.bad or self.bad.isdisjoint(words) or b"".join([self.of[i] for i in found.tolist()]) == f" {text}".encode()
        return found if whole else None


class ByteLevel(Tokens):
    """Byte-level BPE of a tokenizers file; strings of special tokens are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        # The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        entries = sorted((i, t) for t, i in self.model.get_vocab().items())
        super().__init__([bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for _, t in entries])
        with open(path, encoding="utf-8") as f:
            held = json.load(f)["model"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in held["merges"]]
        made = [held["vocab"]["".join(m)] for m in merges]
        self.quick = None
        if made == list(range(256, 256 + len(made))):  # the order of ids is that of merges
            import tiktoken

            self.quick = tiktoken.Encoding("merges", pat_str=PATTERN, mergeable_ranks={t: i for i, t in enumerate(self.of[: 256 + len(made)])}, special_tokens={})

    def encoded(self, texts: list[str]) -> list[list[int]]:
        """Latin texts by the faster of two libraries, which cuts and merges these alike; others, whose letters depend on a library's version of
        Unicode, by the tokenizer itself."""
        if self.quick is None:
            return [e.ids for e in self.model.encode_batch_fast([f" {t}" for t in texts], add_special_tokens=False)]
        out: list = [self.quick.encode_ordinary(f" {t}") if t.isascii() or max(t) < "\u0250" else None for t in texts]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.model.encode_batch_fast([f" {texts[i]}" for i in rest], add_special_tokens=False) if rest else [], strict=True):
            out[i] = e.ids
        return out


class Pieces(Tokens):
    """A sentencepiece model that puts a space before the text and has no piece with a space behind another character."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(len(m))]
        if any(a != "▁" and b == "▁" for p in pieces for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece has a space mark behind another character; words cannot be cut there")
        super().__init__([bytes([int(p[3:5], 16)]) if m.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)])

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(maxsize=4)
def loaded(kind: str, path: str) -> Tokens:
    return {"bytes": ByteLevel, "pieces": Pieces}[kind](path)


Side = tuple[str, str]


def end_events(docs: DataFrame, tokenizer: Side, side: int) -> DataFrame:
    """Runs of tokens of docs (k1, k2, doc_id, text). Side 0 begins each document with a row at -1; void: it has no tokens."""

    def run(batches):
        tokens = loaded(*tokenizer)
        for b in batches:
            texts = b.column("text").to_pylist()
            words = [CUT.split(t) if t else [] for t in texts]
            tokens.learn(words)
            at, start, void, ids = [], [], [], []
            for i, (t, ws) in enumerate(zip(texts, words, strict=True)):
                found = tokens.ids(t, ws) if t else None
                if side == 0 or (t and found is None):
                    at.append(i), start.append(-1), void.append(found is None), ids.append(b"")
                if found is None:
                    continue
                offset = 0
                for j in range(0, len(found), RUN):
                    part = found[j : j + RUN]
                    at.append(i), start.append(offset), void.append(False), ids.append(part.tobytes())
                    offset += int(tokens.lengths[part].sum())
            held = b.select(["k1", "k2", "doc_id"]).take(pa.array(at, pa.int64()))
            cols = [pa.array(start, pa.int64()), pa.array(np.full(len(at), side, np.int8)), pa.array(void, pa.bool_()), pa.array(ids, pa.binary())]
            yield pa.RecordBatch.from_arrays([*held.columns, *cols], KEY)

    return docs.mapInArrow(run, EVENTS)


class Sweep:
    """The state machine. feed() takes runs in order; what is matched goes to close(documents, ends, a, b), ended documents to done()."""

    def __init__(self, a: Tokens, b: Tokens):
        self.lengths = a.lengths, b.lengths
        self.key, self.last = None, None
        self.doc = -1
        self.open: list[list] = [[], []]  # runs (position, ids) of either side
        self.rest = [(np.zeros(0, np.uint16), np.zeros(0, np.int64))] * 2  # tokens behind the last common end: ids, ends
        self.size = 0
        self.told: dict[int, list] = {}  # documents not handed on yet: doc_id, copies, void

    def feed(self, key: tuple, doc_id: int | None, start: int, side: int, void: bool, ids: bytes) -> None:
        if key != self.key:
            self.doc += 1
            self.key, self.last = key, (-1, 0)
            self.told[self.doc] = [doc_id, 1, void]
            return  # every document begins with side 0's row at -1
        if (start, side) == self.last:  # a repeated row
            self.told[self.doc][1] += start == -1 and side == 0
            return
        self.last = start, side
        held = self.told[self.doc]
        held[2] |= void
        if not held[2]:
            part = np.frombuffer(ids, np.uint16)
            self.open[side].append(((self.doc << SPAN) + start, part))
            self.size += len(part)

    def match(self) -> Iterator[tuple]:
        """The groups that the runs fed so far close: (document of each, common end of each, tokens of A and of B of each, ids of A, ids of B)."""
        sides = []
        for (ids, ends), runs, lengths in zip(self.rest, self.open, self.lengths, strict=True):
            if runs:
                new = np.concatenate([x for _, x in runs])
                n = np.fromiter((len(x) for _, x in runs), np.int64, len(runs))
                total = np.cumsum(lengths[new])
                first = np.cumsum(n) - n
                base = np.fromiter((p for p, _ in runs), np.int64, len(runs)) - np.where(first > 0, total[first - 1], 0)
                ids, ends = np.r_[ids, new], np.r_[ends, total + np.repeat(base, n)]
            sides.append((ids, ends))
        (a, ea), (b, eb) = sides
        self.open, self.size = [[], []], 0
        at = np.searchsorted(eb, ea)
        both = np.flatnonzero(at < len(eb))
        both = both[eb[at[both]] == ea[both]]
        ma, mb = both, at[both]
        if not len(both):
            self.rest = sides
            return
        na, nb = np.diff(ma, prepend=-1), np.diff(mb, prepend=-1)
        self.rest = [(a[ma[-1] + 1 :], ea[ma[-1] + 1 :]), (b[mb[-1] + 1 :], eb[mb[-1] + 1 :])]
        # The last byte of a group tells its document.
        yield (ea[ma] - 1) >> SPAN, ea[ma], na, nb, a[: ma[-1] + 1], b[: mb[-1] + 1]


def linked(doc: np.ndarray, na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """document, pair (id of A, 16 bits, and of B) and number of links of all distinct ones, sorted. doc: of each group, ascending."""
    sa, sb = np.cumsum(na) - na, np.cumsum(nb) - nb
    small = na * nb <= LARGE_GROUP
    each = np.where(small, nb, 0)  # every token of A meets those of B
    ga = np.repeat(np.arange(len(na)), na)
    n = each[ga]
    i = np.repeat(np.arange(len(a)), n)
    j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(sb[ga], n)
    first = int(doc[0]) if len(doc) else 0
    key = (np.repeat(doc - first, na)[i] << 32) | (a[i].astype(np.int64) << 16) | b[j]
    key, count = np.unique(key, return_counts=True)
    if not small.all():
        more = [(key, count)]
        for g in np.flatnonzero(~small).tolist():
            (x, cx), (y, cy) = (np.unique(v, return_counts=True) for v in (a[sa[g] : sa[g] + na[g]], b[sb[g] : sb[g] + nb[g]]))
            more.append((((int(doc[g]) - first) << 32 | x.astype(np.int64)[:, None] << 16 | y).ravel(), np.outer(cx, cy).ravel()))
        key, count = summed(*(np.concatenate(x) for x in zip(*more, strict=True)))
    return (key >> 32) + first, key & 0xFFFFFFFF, count


def summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    o = np.argsort(key, kind="stable")
    key, count = key[o], count[o]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(count, at) if len(key) else count


@lru_cache(maxsize=1)
def _digits() -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of 16-bit ids, right-aligned with room for a separator, and their number."""
    n = np.arange(1 << 16)
    return np.stack([*(48 + n // 10**p % 10 for p in (4, 3, 2, 1, 0)), np.zeros_like(n)], 1).astype(np.uint8), np.maximum(1, sum((n >= 10**p).astype(int) for p in range(5)))


def group_text(na: np.ndarray, nb: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of `a1,a2|b1;` for all groups, and where each group ends in them."""
    ga, gb = np.repeat(np.arange(len(na)), na), np.repeat(np.arange(len(nb)), nb)
    ca, cb = np.cumsum(na), np.cumsum(nb)
    at_a, at_b = np.arange(len(a)) + (cb - nb)[ga], np.arange(len(b)) + ca[gb]
    ids, sep = np.empty(len(a) + len(b), np.int64), np.full(len(a) + len(b), ord(","), np.uint8)
    ids[at_a], ids[at_b] = a, b
    ends = ca + cb - 1  # the last token of each group, and the last of A in it
    sep[ends], sep[ends - nb] = ord(";"), ord("|")
    digits, many = _digits()
    table, n = digits[ids], many[ids]
    table[:, 5] = sep
    shown = np.arange(6) >= 5 - n[:, None]
    return table[shown], np.cumsum(n + 1)[ends]


def packed(key: np.ndarray, count: np.ndarray) -> bytes:
    raw = np.r_[np.diff(key, prepend=0), count].astype(np.uint32)
    return pa.compress(raw.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True) if len(key) else b""


def unpacked(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    held = np.frombuffer(pa.decompress(raw, 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().astype(np.int64)
    return np.cumsum(held[:n]), held[n:]


TOLD = ["doc_id", "copies", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "block", "n_pairs", "pairs"]
DOCUMENTS = "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, block long, n_pairs long, pairs binary"


class Sums:
    """What an open document has so far."""

    def __init__(self):
        self.n = [0, 0, 0, 0]
        self.text, self.tail = hashlib.sha256(), b""
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, n: list[int], text: bytes, key: np.ndarray, count: np.ndarray) -> None:
        self.n = [x + y for x, y in zip(self.n, n, strict=True)]
        self.text.update(self.tail + text[:-1])
        self.tail = text[-1:]  # the last separator goes if nothing follows
        self.parts.append((key, count))
        if sum(len(k) for k, _ in self.parts[1:]) > BLOCK_PAIRS:
            self.parts = [self.pairs()]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        return self.parts[0] if len(self.parts) == 1 else summed(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))


def _swept(a: Side, b: Side, emit):
    """Batches of sorted events through the machine; emit(sweep, groups or None, last) yields batches, and takes documents out of sweep.told."""

    def run(batches):
        sweep = Sweep(loaded(*a), loaded(*b))
        out = emit(sweep)
        next(out)
        for batch in batches:
            for k1, k2, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sweep.feed((k1, k2), *row)
                if sweep.size >= GATHER:
                    for groups in sweep.match():
                        yield from out.send((groups, sweep.doc))
            for groups in sweep.match():
                yield from out.send((groups, sweep.doc))
            yield from out.send((None, sweep.doc))
        yield from out.send((None, sweep.doc + 1))

    return run


def _documents(sweep: Sweep):
    """A row for each document that has ended: its sums, the digest of its groups, its linked pairs."""
    sums: dict[int, Sums] = {}
    block = [TaskContext.get().partitionId() << 32, 0]
    found: list = []
    while True:
        groups, before = yield found
        found = []
        if groups is not None:
            doc, _, na, nb, a, b = groups
            of, key, count = linked(doc, na, nb, a, b)
            text, ends = group_text(na, nb, a, b)
            raw = text.tobytes()
            last = np.flatnonzero(np.r_[doc[1:] != doc[:-1], True])
            first = np.r_[0, last[:-1] + 1]
            cuts = np.searchsorted(of, doc[last], "right")
            sa, sb, sl = (np.add.reduceat(x, first) for x in (na, nb, na * nb))
            starts = np.r_[0, ends[last[:-1]]]
            for i, d in enumerate(doc[last].tolist()):
                lo = int(cuts[i - 1]) if i else 0
                sums.setdefault(d, Sums()).add([int(sa[i]), int(sb[i]), int(last[i] - first[i] + 1), int(sl[i])], raw[starts[i] : ends[last[i]]], key[lo : cuts[i]], count[lo : cuts[i]])
        rows = []
        for d in [d for d in sweep.told if d < before]:
            doc_id, copies, void = sweep.told.pop(d)
            s = sums.pop(d, None)
            if void or s is None:
                rows.append((doc_id, copies, 0, 0, 0, 0, "", block[0], 0, b""))
                continue
            key, count = s.pairs()
            block[1] += len(key)
            if block[1] > BLOCK_PAIRS:
                block = [block[0] + 1, len(key)]
            rows.append((doc_id, copies, *s.n, s.text.hexdigest(), block[0], len(key), packed(key, count)))
        if rows:
            kinds = [pa.int64()] * 6 + [pa.string(), pa.int64(), pa.int64(), pa.binary()]
            found = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], TOLD)]


def _group_rows(sweep: Sweep):
    """A row for each group: where it ends, its ids on both sides. A document that turns out void has none."""
    found: list = []
    number: dict[int, int] = {}
    while True:
        groups, before = yield found
        found = []
        if groups is not None:
            doc, ends, na, nb, a, b = groups
            first = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
            nth = np.arange(len(doc)) - np.repeat(first, np.diff(np.append(first, len(doc))))
            nth[: np.diff(np.append(first, len(doc)))[0]] += number.get(int(doc[0]), 0)
            number = {int(doc[-1]): int(nth[-1]) + 1}
            told = [sweep.told[d] for d in doc.tolist()]
            lists = [pa.ListArray.from_arrays(np.r_[0, np.cumsum(n)].astype(np.int32), pa.array(x.astype(np.int32))) for n, x in ((na, a), (nb, b))]
            cols = [pa.array([t[0] for t in told], pa.int64()), pa.array([t[1] for t in told], pa.int64()), pa.array(nth), pa.array(ends & ((1 << SPAN) - 1)), *lists]
            found = [pa.RecordBatch.from_arrays(cols, ["doc_id", "copies", "number", "end", "a", "b"])]
        for d in [d for d in sweep.told if d < before]:
            sweep.told.pop(d)


def sorted_events(docs: DataFrame, a: Side, b: Side, key: str = "doc_id", text: str = "text") -> DataFrame:
    """End events of both tokenizers, a document's in one partition, in order of offset."""
    small_batches(docs.sparkSession)
    number, t = docs[key].cast("long"), docs[text]
    keyed = docs.select(F.xxhash64(number, t, F.isnull(t)).alias("k1"), F.xxhash64(F.lit(1), t, number).alias("k2"), number.alias("doc_id"), t.alias("text"))
    events = end_events(keyed, a, 0).unionByName(end_events(keyed, b, 1))
    return events.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "start", "side")


def aligned_groups(docs: DataFrame, a: Side, b: Side, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, copies (of the row), number, end (byte offset in space+text), a and b (ids) of every group of every text.

    Texts that are null, empty, or not given back by the bytes of either side's tokens have no groups. Other columns are ignored.
    """
    return sorted_events(docs, a, b, key, text).mapInArrow(_swept(a, b, _group_rows), "doc_id long, copies long, number long, end long, a array<int>, b array<int>")


def _pair_counts(batches):
    """(pair, documents) of each task, added up as far as memory allows."""
    held, rows = [], 0

    def out():
        key, count = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(count)], ["pair", "c"])

    for b in batches:
        for copies, n, raw in zip(*(b.column(c).to_pylist() for c in ("copies", "n_pairs", "pairs")), strict=True):
            key, _ = unpacked(raw, n)
            held.append((key, np.full(n, copies)))
            rows += n
            if rows > 2 * BLOCK_PAIRS:
                yield out()
                held, rows = [], 0
    if held:
        yield out()


def _asked(batches):
    """(block, pair): the distinct pairs of each block of documents, as far as a task sees it at once."""
    block, held, rows = None, [], 0

    def out():
        key = np.unique(np.concatenate(held))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), block)), pa.array(key)], ["block", "pair"])

    for b in batches:
        for at, n, raw in zip(*(b.column(c).to_pylist() for c in ("block", "n_pairs", "pairs")), strict=True):
            if held and (at != block or rows > 2 * BLOCK_PAIRS):
                yield out()
                held, rows = [], 0
            block = at
            held.append(unpacked(raw, n)[0])
            rows += n
    if held:
        yield out()


def _with_counts(docs: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
    """A block's documents with n_best and count_sum, from the counts of all its pairs."""
    pairs = pairs.sort_values("pair")
    known, c, best = pairs["pair"].to_numpy(), pairs["c"].to_numpy(), pairs["best"].to_numpy()
    sums = []
    for n, raw in zip(docs["n_pairs"], docs["pairs"], strict=True):
        key, count = unpacked(raw, n)
        at = np.searchsorted(known, key)
        sums.append((int(count[best[at]].sum()), int((count * c[at]).sum())) if n else (0, 0))
    out = docs.drop(columns=["pairs", "block", "n_pairs"])
    return out.assign(n_best=[x for x, _ in sums], count_sum=[y for _, y in sums])


def align(docs: DataFrame, a: Side, b: Side, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a row of docs: key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    a and b: ("bytes" or "pieces", path of the tokenizer). Links are all pairs of tokens of A and B in one group; a pair of ids counts
    in how many documents it is linked. n_best: links whose count is the highest of their id of A; count_sum: the counts of all links.

    Texts that are null, empty, or not given back by the bytes of either side's tokens have no tokens: zeros, and '' as digest. Texts
    of any length are read whole. Repeated rows count as documents each. Null keys are keys like others. Other columns are ignored.
    An empty table gives no rows.
    """
    with temporary(docs.sparkSession) as keep:
        swept = written(sorted_events(docs, a, b, key, text).mapInArrow(_swept(a, b, _documents), DOCUMENTS), "swept")
        told = swept.where("n_pairs > 0")
        counts = written(told.select("copies", "n_pairs", "pairs").mapInArrow(_pair_counts, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c")), "counts")
        most = counts.groupBy(F.shiftright("pair", 16).alias("a")).agg(F.max("c").alias("most"))
        counts = counts.withColumn("a", F.shiftright("pair", 16)).join(most, "a").select("pair", "c", (F.col("c") == F.col("most")).alias("best"))
        asked = told.select("block", "n_pairs", "pairs").mapInArrow(_asked, "block long, pair long").distinct()
        pairs = asked.join(counts, "pair").select("block", "pair", "c", "best")
        out = told.groupBy("block").cogroup(pairs.groupBy("block")).applyInPandas(_with_counts, "doc_id long, copies long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")
        rest = swept.where("n_pairs = 0").withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")}).drop("block", "n_pairs", "pairs")
        out = keep(written(out.unionByName(rest), "aligned"))
    out = out.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return out.select(F.col("doc_id").alias(key), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
