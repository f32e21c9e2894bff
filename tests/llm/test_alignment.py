"""Alignment against a plain version that encodes whole texts by the libraries and lists all links."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import alignment
from lodestone.llm.queries import tokenizer_file

A, B = ("bytes", tokenizer_file("byte_bpe_50k.json")), ("pieces", tokenizer_file())
SCHEMA = "doc_id long, text string, k1 string, pairs string, block string, ids string, copies string, _copy string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))


TEXTS = [
    (1, words(1, 300)), (2, None), (3, ""), (3, "dup id, other text"), (4, words(1, 300)), (4, words(1, 300)), (None, "no id " + words(2, 30)), (None, "no id " + words(2, 30)), (5, " "), (6, " \t\n "),
    (7, "a" * 3000), (8, "日本語のテキスト 日本語" * 30), (9, "x▁y a mark of spaces"), (10, "▁"), (11, "<|endoftext|> and </s> <unk> <s> <0x41> [INST]"), (12, "  two  spaces \n\n\n new lines\r\n \ttab "),
    (13, "it's they're I'll  nbsp   em  \x85 \x1c \x00 zero"), (14, "\U0001f600\U0001f600 emoji\U0001f468‍\U0001f469‍\U0001f467 end"), (15, words(3, 20_000)), (16, "12345 678 9.0 ,,,, --- ???!!"), (17, "é" * 700 + " fin"),
    (18, "=" * 5000 + "\n" + "-" * 777), (19, "ÀÉÎõü ﬁ ﬂ Ⅷ ｆｕｌｌ"), (20, "a\n b\t c \n"), (21, "trail   "),
]


def tokens(text):
    """(ids and ends) of both sides, or None."""
    out = []
    for side in (A, B):
        held = alignment.loaded(*side)
        ids = held.model.encode(f" {text}", add_special_tokens=False).ids if side is A else held.model.encode(text)
        if b"".join(held.of[i] for i in ids) != f" {text}".encode():
            return None
        out.append((ids, np.cumsum([len(held.of[i]) for i in ids]).tolist()))
    return out


def groups(text):
    sides = tokens(text) if text else None
    if sides is None:
        return []
    (a, ea), (b, eb) = sides
    out, x, y = [], 0, 0
    for end in sorted(set(ea) & set(eb)):
        i, j = ea.index(end, x) + 1, eb.index(end, y) + 1
        out.append((end, a[x:i], b[y:j]))
        x, y = i, j
    return out


def plain(docs):
    held = [groups(t) for _, t in docs]
    links = [Counter((x, y) for _, a, b in gs for x in a for y in b) for gs in held]
    count = Counter(p for c in links for p in c)
    most = defaultdict(int)
    for (x, _), c in count.items():
        most[x] = max(most[x], c)
    out = []
    for (key, _), gs, c in zip(docs, held, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for _, a, b in gs)
        best = sum(n for p, n in c.items() if count[p] == most[p[0]])
        out.append((key, sum(len(a) for _, a, _ in gs), sum(len(b) for *_, b in gs), len(gs), sum(c.values()), best, sum(n * count[p] for p, n in c.items()), hashlib.sha256(text.encode()).hexdigest() if gs else ""))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, *("x",) * 6) for i, t in docs], SCHEMA)


@pytest.mark.parametrize("run, gather, large", [(8192, 1 << 18, 4096), (5, 40, 3), (64, 1, 4096)])
def test_alignment_equals_a_plain_one(spark, monkeypatch, run, gather, large):
    """Also with runs, gathered tokens and groups of other sizes, which must not show. The workers read the same constants by closures."""
    monkeypatch.setattr(alignment, "RUN", run)
    docs = TEXTS if run != 5 else [(i, t) for i, t in TEXTS if i != 15]
    df = frame(spark, docs).repartition(3)
    assert rows(alignment.align(df, A, B)) == plain(docs)
    # In one process, where the other constants can be set.
    monkeypatch.setattr(alignment, "GATHER", gather)
    monkeypatch.setattr(alignment, "LARGE_GROUP", large)
    events = [tuple(r) for r in alignment.sorted_events(df, A, B).toArrow().sort_by([(c, "ascending") for c in ("k1", "k2", "start", "side")]).to_pylist() for r in [r.values()]]
    sweep = alignment.Sweep(alignment.loaded(*A), alignment.loaded(*B))
    found = defaultdict(list)

    def take():
        for doc, ends, na, nb, a, b in sweep.match():
            ca, cb = np.cumsum(na), np.cumsum(nb)
            for i, d in enumerate(doc.tolist()):
                found[d].append((int(ends[i]) & ((1 << alignment.SPAN) - 1), a[ca[i] - na[i] : ca[i]].tolist(), b[cb[i] - nb[i] : cb[i]].tolist()))
            key = Counter()
            for d, p, c in zip(*(x.tolist() for x in alignment.linked(doc, na, nb, a, b)), strict=True):
                key[d, p] += c
            want = Counter((d, int(x) << 16 | int(y)) for i, d in enumerate(doc.tolist()) if na[i] * nb[i] < 10_000 for x in a[ca[i] - na[i] : ca[i]] for y in b[cb[i] - nb[i] : cb[i]])
            assert all(key[p] >= c for p, c in want.items()) and sum(key.values()) == int((na * nb).sum())

    for k1, k2, *e in events:
        sweep.feed((k1, k2), *e)
        if sweep.size >= gather:
            take()
    take()
    got = sorted(((sweep.told[d][0], found[d]) for d in sweep.told for _ in range(sweep.told[d][1])), key=repr)
    assert got == sorted(((i, groups(t)) for i, t in docs), key=repr)


def test_group_rows(spark):
    docs = [(i, t) for i, t in TEXTS if t != words(1, 300) and i is not None]
    out = alignment.aligned_groups(frame(spark, docs), A, B).collect()
    got = sorted((r["doc_id"], r["number"], r["end"], r["a"], r["b"]) for r in out)
    assert got == sorted((i, n, *g) for i, t in docs for n, g in enumerate(groups(t)))


def test_empty_table(spark):
    assert rows(alignment.align(frame(spark, TEXTS).limit(0), A, B)) == []
    assert rows(alignment.align(frame(spark, [(1, None), (2, "")]), A, B)) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(max_codepoint=0x24F), max_size=60))
def test_latin_texts_by_the_faster_library(text):
    held = alignment.loaded(*A)
    assert held.quick is not None
    assert held.encoded([text]) == [held.model.encode(f" {text}", add_special_tokens=False).ids]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("ab ' \n\t▁ é日\x85　\x1c12."), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_words_are_encoded_like_whole_texts(text):
    for side, whole in ((A, lambda m: m.encode(f" {text}", add_special_tokens=False).ids), (B, lambda m: m.encode(text))):
        held = alignment.loaded(*side)
        ws = alignment.CUT.split(text)
        held.learn([ws])
        ids = whole(held.model)
        same = b"".join(held.of[i] for i in ids) == f" {text}".encode()
        got = held.ids(text, ws)
        assert (got.tolist() if got is not None else None) == (ids if same else None)


def test_words_with_blanks_at_their_ends_are_encoded_alone(spark):
    """Texts of one batch are encoded together; blanks at the end of one must not merge with the space before the next one's first word."""
    docs = [(1, "ends in a blank "), (2, "next text"), (3, "the  "), (4, "  the"), (5, " "), (6, "and so on\t "), (7, "on"), (8, " \n a b ")]
    assert rows(alignment.align(frame(spark, docs).coalesce(1), A, B)) == plain(docs)


def test_packed_pairs():
    r = np.random.default_rng(1)
    for n in (0, 1, 1000):
        key, count = np.unique(r.integers(0, 1 << 32, n)), None
        count = r.integers(1, 1 << 20, len(key))
        k, c = alignment.unpacked(alignment.packed(key, count), len(key))
        assert k.tolist() == key.tolist() and c.tolist() == count.tolist()
