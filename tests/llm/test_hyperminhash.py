"""HyperMinHash near-duplicates against all pairs of full sets."""

import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import hyperminhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, rep string, label string, w0 string, id string, n string, d string, kept string"


def words(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 9))) for _ in range(n)]


def changed(ws, places, mark):
    out = list(ws)
    for p in places:
        out[p] = f"{mark}{p}"
    return out


def sets(text, k=3):
    ws = WORD.findall((text or "").translate(LOWER))
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())


def plain(docs, percent=85, k=3):
    """Sizes and smallest reachable ids by all pairs that share a shingle."""
    held = [sets(t, k) for _, t in docs]
    up = list(range(len(docs)))

    def top(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            both = len(held[i] & held[j])
            if both and 100 * both >= percent * (len(held[i]) + len(held[j]) - both):
                up[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((key, len(held[i]), None if key is None else least[top(i)]) for i, (key, _) in enumerate(docs)), key=repr)


def check(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, *("x",) * 7) for i, t in docs], SCHEMA).repartition(3)
    got = hyperminhash.near_components(df, **kw).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) if r["doc_id"] is not None else r["kept"] is None for r in got)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == plain(docs)


def test_odd_documents(spark):
    base = " ".join(words(1, 200))
    docs = [(5, base), (6, base.upper()), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "ONE"), (12, "one two"), (13, "two one"), (14, "One  two"), (15, "one two three"),
            (None, base + " tail"), (None, None), (3, base + " tail end"), (16, "é" * 500), (16, "other text of one id"), (17, " ".join(words(2, 30_000))), (18, " ".join(words(2, 30_000)[:29_000])), (5, base)]
    check(spark, docs)
    df = spark.createDataFrame([(1, "x", *("x",) * 7)], SCHEMA)
    assert hyperminhash.near_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [4, 64, 1024])
def test_near_copies_on_both_sides_of_the_bound(spark, bucket):
    """Groups of near copies, chains of them, pairs about the bound, and a passage that many texts share to different shares."""
    r = random.Random(4)
    texts = []
    for g in range(3):
        ws = words(10 + g, 150)
        texts += [changed(ws, r.sample(range(150), r.randint(0, 3)), f"g{i}x") for i in range(60)]
    for n in (9, 20, 41, 100, 301):  # one changed word takes up to three of n - 2 shingles out
        ws = words(100 + n, n)
        for many in range(1, max(2, n // 18)):
            texts += [changed(ws, [10 * j % n for j in range(many)], f"p{many}x"), changed(ws, [(10 * j + 5) % n for j in range(many)], f"q{many}x")]
        texts.append(ws)
    chain = words(500, 400)
    for i in range(12):
        texts.append(chain[10 * i : 10 * i + 250])
    passage = words(600, 120)
    for i in range(60):
        texts.append(words(700 + i, r.choice([5, 12, 20, 60, 300])) + passage + words(800 + i, r.choice([0, 2, 10])))
    docs = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(docs)
    check(spark, docs, bucket=bucket)


def test_exact_copies_and_near_copies_in_large_groups(spark):
    ws = words(20, 120)
    docs = [(i, " ".join(changed(ws, [i % 119, 119], f"n{i}x"))) for i in range(700)] + [(1000 + i, " ".join(ws)) for i in range(700)]
    df = spark.createDataFrame([(i, t, *("x",) * 7) for i, t in docs], SCHEMA).repartition(5)
    got = {r["doc_id"]: r["component_id"] for r in hyperminhash.near_components(df, bucket=64).collect()}
    assert got == {i: 0 for i, _ in docs}


def test_estimates_follow_similarity():
    r = np.random.default_rng(2)
    for size, share in ((40, 0.9), (400, 0.7), (5000, 0.85), (50_000, 0.3)):
        common = int(2 * share / (1 + share) * size)
        errors = []
        for _ in range(40):
            h = r.integers(0, 1 << 63, 2 * size - common, dtype=np.uint64) * np.uint64(2)
            a, b = hyperminhash.registers([h[:size], h[size - common :]])
            est, told = hyperminhash.estimate(a[None], b[None], np.array([size]), np.array([size]))
            errors.append(float(est[0]) - common / (2 * size - common))
        assert abs(np.mean(errors)) < 0.03
        assert max(map(abs, errors)) < hyperminhash.SPREAD * 0.5 / min(128, size) ** 0.5


def test_chance_agreement_is_corrected():
    """Registers of large disjoint sets agree by chance as often as the table says."""
    r = np.random.default_rng(3)
    equal = told = 0
    for _ in range(300):
        a, b = hyperminhash.registers([r.integers(0, 1 << 63, 20_000, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2)])
        equal, told = equal + int((a == b).sum()), told + 128
    want = hyperminhash._chances()[29, 29]
    assert 0.0001 < want < 0.0003
    assert abs(equal / told - want) < 5 * (want / told) ** 0.5


def test_registers_against_plain_python():
    hashes = [xxhash.xxh64_intdigest(str(i), 42) for i in range(3000)]
    want = [0] * 128
    for h in hashes:
        bits = f"{h:064b}"
        place, rest = int(bits[:7], 2), bits[7:]
        zeros = rest.index("1")
        behind = int((rest[zeros + 1 :] + "0" * 10)[:10], 2)
        want[place] = max(want[place], (zeros + 1 << 10) + 1023 - behind)
    assert hyperminhash.registers([np.unique(np.array(hashes, np.uint64)), np.zeros(0, np.uint64)]).tolist() == [want, [0] * 128]
