"""SentencePiece (BPE with byte fallback) encoding and decoding by vectorised merge rounds.

A text is cut into words at points that no piece of the vocabulary spans (before a space, and between signs and other characters), so words can be encoded one by one and remembered.
Unseen words are encoded together: one flat numpy array holds their symbols; every round looks up the rank of each
neighbouring pair, takes each word's smallest rank (segmented minimum), merges the leftmost pair with that rank in all words
at once - and further copies of it to the right where no later merge could have come first - compacts the array, and goes
on with the words that still have a pair, until no pair remains.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import plus, small_batches

SPACE = "▁"
#: Words remembered by a worker, and their length at most: memory stays bounded, results do not depend on it.
CACHE_WORDS, CACHE_CHARS = 250_000, 64
#: Symbols encoded together at most (one longer word is taken alone).
ROUND_SYMBOLS = 400_000


class PieceModel:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, train = proto.normalizer_spec, proto.trainer_spec
        if train.model_type != 2 or not train.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only BPE models with byte fallback, a space prefix and no text normalisation are supported")
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 6}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == 1}
        score = {p: proto.pieces[i].score for p, i in normal.items()}
        # Symbols: ids of pieces; then single characters that are no piece but may be part of one.
        self.symbol = dict(normal)
        n = len(self.pieces)
        for ch in sorted({c for p in normal for c in p} - set(normal)):
            self.symbol[ch] = n
            n += 1
        self.first_unknown = n  # other characters: n + code point, never part of a pair
        self.loose = {i: c for c, i in self.symbol.items() if i >= len(self.pieces)}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        rank = {p: order[score[p]] for p in normal}
        left, right, made, ranks = [], [], [], []
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = self.symbol.get(p[:k]), self.symbol.get(p[k:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), made.append(i), ranks.append(rank[p])
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        o = np.argsort(key)
        self.key, self.made, self.rank = key[o], np.array(made)[o], np.array(ranks)[o]
        # A piece is safe to merge at all its places in one round if no piece that begins or ends with it ranks before it.
        self.safe = np.ones(len(self.pieces), bool)
        for p in normal:
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if part in rank and len(part) > 1 and rank[p] <= rank[part]:
                        self.safe[normal[part]] = False
        inner = {c for p in normal if len(p) > 1 for c in p}
        if any(a != SPACE and b == SPACE for p in normal for a, b in zip(p, p[1:], strict=False)):
            raise ValueError("a piece has a space mark behind another character; words cannot be cut there")
        # ASCII characters of no longer piece stand alone; ASCII signs never share a piece with other characters, but for `odd` ones.
        alone = "".join(chr(i) for i in range(128) if chr(i) not in inner and chr(i) != " ")
        signs = {c for c in inner if c.isascii() and not c.isalnum()}
        near = {(a, b) for p in normal for a, b in zip(p, p[1:], strict=False) if a != SPACE}
        odd = {c for pair in near for c in pair if (pair[0] in signs) != (pair[1] in signs)} - signs
        a, s = re.escape(alone), re.escape("".join(sorted(signs)))
        self.words = re.compile(f" *[^ {s}{a}]+| *[{s}]+|[{a}]| +" if alone else f" *[^ {s}]+| *[{s}]+| +", re.S)
        self.wider = re.compile(f" +[^ {a}]*|[{a}]|[^ {a}]+" if alone else " +[^ ]*|[^ ]+", re.S)
        self.odd = re.compile(f"[{re.escape(''.join(sorted(odd)))}]") if odd else None
        self.text = [p.replace(SPACE, " ") if k == 1 else None for p, k in zip(self.pieces, self.kinds, strict=True)]
        self.number = [str(i) for i in range(len(self.pieces))]
        self.cache: dict[str, tuple[str, int, str]] = {}
        self.passing: list[str] = []

    def symbols(self, cps: np.ndarray) -> np.ndarray:
        uniq, back = np.unique(cps, return_inverse=True)
        of = [self.symbol.get(SPACE if c == 32 else chr(c), self.first_unknown + int(c)) for c in uniq.tolist()]
        return np.array(of, np.int64)[back] if len(of) else np.zeros(0, np.int64)

    def merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols after all merges, with their words (both sorted by word)."""
        done_s, done_w = [], []
        none = np.int64(1 << 40)
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            ok = (self.key[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(ok, self.rank[at], none), none)
            made = np.append(self.made[at], 0)
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, start)
            length = np.diff(np.append(start, len(sym)))
            live = np.repeat(least < none, length)
            if not live.all():
                done_s.append(sym[~live]), done_w.append(word[~live])
                sym, word, rank, made = sym[live], word[live], rank[live], made[live]
                if not len(sym):
                    break
                keep = least < none
                least, length = least[keep], length[keep]
                start = np.cumsum(length) - length
            hit = rank == np.repeat(least, length)
            place = np.flatnonzero(hit)
            w = word[place]
            new = np.r_[True, w[1:] != w[:-1]]
            # Copies of a safe pair: every other one of a run of overlapping places, from the left.
            run = np.r_[True, (place[1:] != place[:-1] + 1) | new[1:]]
            begin = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
            first_made = np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))
            same = (made[place] == made[place[first_made]]) & self.safe[made[place]] & (sym[place] == sym[place[first_made]])
            take = place[new | (same & same[first_made] & ((np.arange(len(place)) - begin) % 2 == 0) & (same[begin]))]
            sym = sym.copy()
            sym[take] = made[take]
            left = np.ones(len(sym), bool)
            left[take + 1] = False
            sym, word = sym[left], word[left]
        s, w = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_s, done_w))
        o = np.argsort(w, kind="stable")
        return s[o], w[o]

    def encode_words(self, words: list[str]) -> list[list[int]]:
        out: list[list[int]] = []
        at = 0
        while at < len(words):
            n, size = 0, 0
            while at + n < len(words) and (n == 0 or size + len(words[at + n]) <= ROUND_SYMBOLS):
                size += len(words[at + n])
                n += 1
            part = words[at : at + n]
            cps = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32)
            word = np.repeat(np.arange(n), np.fromiter(map(len, part), np.int64, n))
            s, w = self.merge(self.symbols(cps), word)
            ends = np.searchsorted(w, np.arange(1, n))
            if len(s) and s.max() >= len(self.pieces):
                out += [self._fall_back(x.tolist()) for x in np.split(s, ends)]
            else:
                out += [x.tolist() for x in np.split(s, ends)]
            at += n
        return out

    def _fall_back(self, syms: list[int]) -> list[int]:
        ids: list[int] = []
        for s in syms:
            if s < len(self.pieces):
                ids.append(s)
            else:
                ch = self.loose.get(s) or chr(s - self.first_unknown)
                ids += [self.bytes[b] for b in ch.encode("utf-8", "replace")]
        return ids

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = " " + text.replace(SPACE, " ")
        return (self.wider if self.odd and self.odd.search(text) else self.words).findall(text)

    def encode(self, texts: list[str]) -> list[list[int]]:
        cut = [self.cut(t) for t in texts]
        flat = list(dict.fromkeys(w for ws in cut for w in ws))
        ids = dict(zip(flat, self.encode_words(flat), strict=True))
        return [[i for w in ws for i in ids[w]] for ws in cut]

    def surface(self, ids: list[int]) -> str:
        """The text of a run of ids, space marks as spaces. Each run of byte pieces is read as UTF-8 by itself."""
        with suppress(TypeError):  # a piece without a text of its own
            return "".join([self.text[i] for i in ids])
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if self.kinds[i] == 2:
                out.append(" ⁇ ")
            elif self.kinds[i] != 3:
                out.append(self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids: control pieces vanish, bytes that form no character become U+FFFD each, one leading space goes."""
        out = self.surface(ids)
        first = next((i for i in ids if self.kinds[i] != 3), None)
        return out[1:] if first is not None and self.kinds[first] == 1 and self.pieces[first].startswith(SPACE) else out

    def learn(self, words: list[str]) -> dict[str, tuple[str, int, str]]:
        """(ids as text, number of ids, decoded text) of each word; short words are remembered."""
        for w, ids in zip(words, self.encode_words(words), strict=True):
            self.cache[w] = (",".join([self.number[i] for i in ids]), len(ids), self.surface(ids))
        self.passing += [w for w in words if len(w) > CACHE_CHARS]
        return self.cache

    def forget(self) -> None:
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        else:
            for w in self.passing:
                self.cache.pop(w, None)
        self.passing.clear()


def _utf8(b: bytes) -> str:
    try:
        return b.decode()
    except UnicodeDecodeError:
        out, rest = [], b
        while rest:
            try:
                out.append(rest.decode())
                break
            except UnicodeDecodeError as e:
                out.append(rest[: e.start].decode())
                out.append("�")
                rest = rest[e.start + 1 :]
        return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> PieceModel:
    return PieceModel(path)


def _digests(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        m = model(path)
        for b in batches:
            counts, ids_sha, text_sha = [], [], []
            texts = b.column(1).to_pylist()
            for lo in range(0, len(texts), 64):
                cut = [m.cut(t or "") for t in texts[lo : lo + 64]]
                m.forget()
                cache = m.cache
                unseen = [w for w in dict.fromkeys(w for ws in cut for w in ws) if w not in cache]
                if unseen:
                    m.learn(unseen)
                for ws in cut:
                    got = [cache[w] for w in ws]
                    ids_sha.append(hashlib.sha256(",".join([g[0] for g in got]).encode()).hexdigest())
                    counts.append(sum([g[1] for g in got]))
                    text_sha.append(hashlib.sha256("".join([g[2] for g in got])[1:].encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 for every row of docs.

    Null texts count as empty, which has no ids. Repeated rows stay; columns besides doc_id and text are ignored. Words of any
    length are encoded exactly; memory grows with the longest text only. path: a model file that every executor can read.
    """
    small_batches(docs.sparkSession)
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """docs with `ids` (array of int) and `decoded` (text of these ids) added, whatever docs has of these names kept as `<name>_before`.

    Null texts count as empty. Texts of any length are encoded whole; repeated rows stay. An empty table gives no rows. path: a
    model file that every executor can read.
    """

    def run(batches):
        m = model(path)
        for b in batches:
            ids = m.encode([t or "" for t in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32())), pa.array([m.decode(i) for i in ids], pa.string())], schema.names)

    small_batches(docs.sparkSession)
    own = docs.withColumnsRenamed({c: f"{c}_before" for c in ("ids", "decoded")})
    at = own.columns.index("text")
    schema = plus(own.schema, ids="array<int>", decoded="string")
    return own.mapInArrow(run, schema)
