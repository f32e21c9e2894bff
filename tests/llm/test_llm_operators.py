"""Each operator against a brute-force version, on rows with nulls, empty and long texts, ties, repeated rows and clashing names."""

import base64
import hashlib
import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import ann, gray, langid, mixing, piece_codec, quality, queries, simhash, suffix_dedup, syncmer, url_filter, warc
from lodestone.llm.common import temporary
from lodestone.llm.components import connected_components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id int, key string, copies string, score string, ids string, kept string, leaf string, th string, w0 string, sketch string"
CLASH = ("x",) * 11


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(1, 9))) for _ in range(n))


BASE = prose(1, 120)
TEXTS = [
    (1, BASE, "en", "a"),
    (2, None, None, None),
    (3, "", "en", ""),
    (3, "dup id, other text", "de", "b"),
    (4, BASE, "en", "a"),
    (4, BASE, "en", "a"),
    (None, "text without an id " + BASE[:250], "de", None),
    (5, "é" * 300 + " fin", "fr", "c"),
    (6, "a" * 450, "en", "a"),
    (7, prose(2, 9000) + BASE[100:420] + prose(3, 2000), "en", "a"),
    (8, " \t\n ", "en", "b"),
    (9, "日本語のテキスト" * 40 + "\u2581 x", "ja", "c"),
    (10, BASE.replace(BASE.split()[60], "CHANGED", 1).upper(), "en", "a"),
    (11, "123 456 !!", "en", "d"),
    (12, "One", None, "d"),
    (13, prose(4, 30) + "\n" + BASE[:199], "en", None),
    (50, prose(5, 80) + " \U0001f600 " + prose(6, 20), "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", 1, *("x",) * 9) for i, t, l, s in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def rows(df, *cols):
    return sorted(((tuple(r[c] for c in cols)) for r in df.select(*cols).collect()), key=repr)


# 1 -----------------------------------------------------------------------------------------------


def water_level(sizes, weights, cap=3.0):
    total, target, open_ = sum(sizes), [None] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        level = left / sum(weights[i] for i in open_)
        over = [i for i in open_ if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in open_:
                target[i] = level * weights[i]
            break
        for i in over:
            target[i] = cap * sizes[i]
            left -= target[i]
            open_.discard(i)
    return target


def test_source_targets(spark):
    r = random.Random(3)
    for n in (1, 3, 7):
        sizes = [r.choice([0, 1, 10, 1000, 5000]) for _ in range(n)]
        names = [*[f"s{i}" for i in range(n - 1)], None]
        df = spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, size long")
        got = {x["source"]: x["target"] for x in mixing.source_targets(df).collect()}
        want = water_level(sizes, [(5, 2, 1)[i % 3] for i in range(n)])
        assert all(abs(got[k] - w) < 1e-6 for k, w in zip(names, want, strict=True))


def test_mix(docs, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_UNITS", 3)
    out = mixing.mix_sources(docs)
    got = rows(out, "doc_id", "size", "source_size", "target", "taken")
    assert [(i, s) for i, s, *_ in got] == sorted(((i, len(WORD.findall(t or ""))) for i, t, _, _ in TEXTS), key=repr)
    assert all(t <= 3 * s for _, s, _, _, t in got)
    assert all(t % s == 0 for _, s, _, _, t in got if s)
    assert got == rows(mixing.mix_sources(docs.repartition(7)), "doc_id", "size", "source_size", "target", "taken")
    assert mixing.mix_sources(empty).count() == 0
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    copies = Counter()
    for r in out.select("doc_id", "size", "copies").collect():
        copies[r["doc_id"], r["size"]] += r["copies"]
    assert Counter((r["doc_id"], len(WORD.findall(r["text"] or ""))) for r in mixed.collect()) == +copies


def test_mix_of_repeated_and_null_ids(spark):
    """A third of all rows equal, another third without id: targets are met, copies follow each row's own decision."""
    texts = [(-1, "a b c", "x", i % 5) for i in range(700)] + [(None, prose(i, 1 + i % 40), "x", 0) for i in range(700)] + [(i, prose(i, 1 + i % 40), "y", 0) for i in range(700)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string, extra int").repartition(5)
    out = mixing.mix_sources(df)
    assert out.count() == 2100
    for r in out.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["k"]) <= r["m"]
    spread = {r["copies"] for r in out.where("doc_id = -1").collect()}
    assert max(spread) - min(spread) <= 1
    mixed = mixing.mixed_documents(df)
    words = {r["source"]: r["w"] for r in mixed.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    want = Counter()
    for r in out.collect():
        want["x" if r["doc_id"] in (None, -1) else "y"] += r["taken"]
    assert words == want


def test_mix_of_many_sources(spark, monkeypatch):
    """As many sources as a few documents each: ranks, weights and targets as computed one by one, no bucket over two sources."""
    r = random.Random(41)
    names = sorted({prose(i, 1) + str(i) for i in range(500)})
    items = [(i, names[i % 500], r.randint(1, 60)) for i in range(1500)]
    df = spark.createDataFrame(items, "doc_id long, source string, own long").repartition(6)
    sizes = Counter()
    for _, s, n in items:
        sizes[s] += n
    got = {x["source"]: x["target"] for x in mixing.source_targets(df.select("source", F.col("own").alias("size"))).collect()}
    want = water_level([sizes[s] for s in names], [(5, 2, 1)[i % 3] for i in range(500)])
    assert all(abs(got[k] - w) < 1e-6 for k, w in zip(names, want, strict=True))
    out = {x["doc_id"]: x["taken"] for x in mixing.mix_sources(df, size=F.col("own")).collect()}
    taken = Counter()
    for i, s, _ in items:
        taken[s] += out[i]
    assert all(abs(taken[s] - got[s]) <= 60 for s in names)


def test_mix_is_near(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_UNITS", 50)
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"), (F.col("id") % 3).cast("string").alias("source"))
    out = mixing.mix_sources(df, size=F.pmod(F.xxhash64("doc_id"), F.lit(100)) + 1)
    for r in out.groupBy("source_size").agg(F.first("target").alias("t"), F.sum("taken").alias("k"), F.max("size").alias("m")).collect():
        assert abs(r["t"] - r["k"]) <= r["m"]


def test_sources_come_near_their_targets(spark):
    """Sources of few and of many documents, heavy tails included: within 1 % of the target, or their smallest document."""
    r = random.Random(9)
    rows = []
    for s, (n, top) in enumerate([(1, 50), (3, 400), (10, 3000), (50, 20_000), (50, 400), (300, 20_000), (3000, 5000), (50, 20_000), (70, 9000)]):
        rows += [(10_000 * s + i, f"s{s}", int(top ** r.random()) + 1) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    out = mixing.mix_sources(df, size=F.col("size")).join(df.select("doc_id", "source"), "doc_id")
    got = out.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.min("size").alias("least")).collect()
    for x in got:
        if x["source"] not in ("s0", "s1"):  # of one and three documents: none can bear the others
            assert abs(x["t"] - x["g"]) <= max(0.01 * x["g"], x["least"]), x


def plain_rounding(sizes, shares, keys, salt):
    """One source's open units, settled from large to small against the pool of the smaller ones."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], keys[i]))
    q = dict(enumerate(shares))
    for n, i in enumerate(order):
        if not 1e-9 <= q[i] <= 1 - 1e-9:
            continue
        pool = order[n + 1 :]
        up, down = (1 - q[i]) * sizes[i], q[i] * sizes[i]
        has, lacks = sum(q[j] * sizes[j] for j in pool), sum((1 - q[j]) * sizes[j] for j in pool)
        can_up, can_down = up <= has * (1 + 1e-9), down <= lacks * (1 + 1e-9)
        if can_up != can_down:
            taken = can_up
        elif not can_up and pool:
            taken = up - has < down - lacks
        else:
            taken = mixing._coin(keys[i], salt) < q[i]
        for j in pool:
            if taken:
                q[j] *= max(0.0, 1 - up / has) if has > 0 else 0.0
            else:
                q[j] = 1 - (1 - q[j]) * (max(0.0, 1 - down / lacks) if lacks > 0 else 0.0)
        q[i] = float(taken)
    return [round(q[i]) for i in range(len(sizes))]


def test_rounding_against_plain_python():
    r = random.Random(2)
    for n in (1, 2, 7, 60, 300):
        sizes, keys = [int(5000 ** r.random()) + 1 for _ in range(n)], [r.getrandbits(62) for _ in range(n)]
        shares = [0.37] * n if n % 2 else [r.random() for _ in range(n)]
        got = mixing.settle(np.zeros(n, int), np.zeros(n, int), np.ones(n, bool), np.array(keys), np.array(sizes), np.array(shares), 0)
        assert got.tolist() == plain_rounding(sizes, shares, keys, 7919)
    # Units of one share keep it in the mean, but for the smallest, where no pool is left to bear a coin.
    size, mean = np.array([3000, 900, 400, 400, 250, 200, 120, 90, 60, 40] * 6), np.zeros(60)
    for i in range(1500):
        keys = np.random.default_rng(i).integers(0, 1 << 62, 60)
        mean += mixing.settle(np.zeros(60, int), np.zeros(60, int), np.ones(60, bool), keys, size, np.full(60, 0.3), 0) / 1500
    assert np.abs(mean - 0.3).max() < 0.1 and np.abs(mean[size > 100] - 0.3).max() < 0.05


def test_pivot_keeps_mass_and_expectation():
    n, runs = 64, 400
    size = np.random.default_rng(1).integers(1, 50, n)
    p = np.full(n, 0.3)
    mean = np.zeros(n)
    for salt in range(runs):
        q = mixing.pivot_rounds(np.zeros(n, int), size, p, np.arange(n), salt)
        assert abs((q * size).sum() - (p * size).sum()) < 1e-6
        assert ((q > 1e-9) & (q < 1 - 1e-9)).sum() <= 1
        mean += q / runs
    assert abs(mean.mean() - 0.3) < 0.03 and np.abs(mean - 0.3).max() < 0.15


# 2 -----------------------------------------------------------------------------------------------


def brute_nearest(vectors, k=5, every=50):
    usable = {(i, tuple(v)) for i, v in vectors if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = []
    for q, v in usable:
        if q % every:
            continue
        found = set()
        for i, w in usable:
            if i != q and len(w) == len(v):
                a, b = np.array(v), np.array(w)
                found.add((-float(ann.cosines(a, b[None])[0]), i))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL", 40)
    monkeypatch.setattr(ann, "PIECE", 180)
    monkeypatch.setattr(ann, "PAST", 2)
    r = np.random.default_rng(2)
    vs = [(int(i), [float(x) for x in r.normal(size=6)]) for i in range(160)]
    vs += [(i, [1.0, 2.0, 0.0, 0.0, 0.0, 1.0]) for i in range(200, 290)]  # copies: ties
    vs += [(300, None), (350, [0.0] * 6), (400, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (450, [float("nan")] * 6), (None, [1.0] * 6), (500, [float("inf")] + [0.0] * 5), (550, [1.0, 2.0]), (600, [2.0, 1.0]), (100, vs[100][1])]
    df = spark.createDataFrame([(i, v, 1, 1.0) for i, v in vs], "vec_id long, embedding array<double>, cell int, seen double")
    got = rows(ann.nearest(df, confidence=0.9999), "query_id", "rank", "vec_id", "score")
    want = brute_nearest(vs)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-12 for g, w in zip(got, want, strict=True))
    assert ann.nearest(df.limit(0)).count() == 0


def test_nearest_of_extreme_sizes_and_many_widths(spark):
    """Components whose squares vanish or overflow, and more widths than a list should hold."""
    vs = [(50, [1e-200, 2e-200]), (1, [2e200, 4e200]), (2, [1e-308, -1e-308]), (3, [3.0, 1.0]), (4, [1e308, 1e308])]
    got = rows(ann.nearest(spark.createDataFrame(vs, "vec_id long, embedding array<double>")), "query_id", "rank", "vec_id", "score")
    want = [(1, 1.0), (4, 3 / math.sqrt(10)), (3, 1 / math.sqrt(2)), (2, -1 / math.sqrt(10))]
    assert [g[2] for g in got] == [i for i, _ in want] and all(abs(g[3] - s) < 1e-12 for g, (_, s) in zip(got, want, strict=True))
    vs = [(50 * w + i, [float((w * 7 + j * 3 + i) % 11 - 5) for j in range(w)]) for w in range(1, 1002) for i in range(2)]
    df = spark.range(1, 1002).select(F.explode(F.array(F.lit(0), F.lit(1))).alias("i"), F.col("id").cast("int").alias("w"))
    df = df.select((50 * F.col("w") + F.col("i")).cast("long").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda j: (F.col("w") * 7 + j * 3 + F.col("i")) % 11 - 5.0).alias("embedding"))
    got = {(r["query_id"], r["vec_id"]) for r in ann.nearest(df).collect()}
    usable = {i for i, v in vs if any(v)}
    assert got == {(50 * w, 50 * w + 1) for w in range(1, 1002) if {50 * w, 50 * w + 1} <= usable}


def test_all_candidates_if_there_are_few(spark):
    """Also those that lie opposite, whatever their projections: nothing stops before k are found."""
    r = np.random.default_rng(3)
    vs = [(50 * w + i, [float(x) * (-1) ** i for x in r.normal(size=w)] if not i else None) for w in range(1, 121) for i in range(3)]
    of = {i // 50: v for i, v in vs if v}
    df = spark.createDataFrame([(i, v or [-x for x in of[i // 50]]) for i, v in vs], "vec_id long, embedding array<double>")
    got = {(x["query_id"], x["vec_id"]) for x in ann.nearest(df).collect()}
    assert got == {(50 * w, 50 * w + i) for w in range(1, 121) for i in (1, 2)}


def test_nearest_equals_sql(spark):
    import duckdb

    vs = [(int(i), [float(x) for x in row]) for i, row in enumerate(np.random.default_rng(6).normal(size=(400, 12)))] + [(500, [0.0] * 12), (550, None), (100, [1.0] * 11)]
    df = spark.createDataFrame(vs, "vec_id long, embedding array<float>")
    con = duckdb.connect()
    con.register("embeddings", df.toArrow())
    assert rows(ann.nearest(df, confidence=0.9999), "query_id", "rank", "vec_id", "score") == sorted(con.sql(ann.nearest_sql()).fetchall(), key=repr)


def recall_and_share(spark, m):
    """Of the five nearest the share found, and the share of all rows that a query verifies."""
    table = pa.table({"vec_id": np.arange(len(m)), "embedding": pa.array(m.tolist(), pa.list_(pa.float64()))})
    df = spark.createDataFrame(table).repartition(4)
    with temporary(spark):
        best, waves = ann.searched(df, 5, 50, "vec_id", "embedding", ann.CONFIDENCE)
        got = {(r["query_id"], r["vec_id"]) for r in best.collect()}
        verified = sum(w.agg(F.sum("verified")).first()[0] or 0 for w in waves)
    u = m / np.sqrt((m * m).sum(1))[:, None]
    queries = np.arange(0, len(m), 50)
    want = set()
    for lo in range(0, len(queries), 200):
        q = queries[lo : lo + 200]
        s = u[q] @ u.T
        s[np.arange(len(q)), q] = -2
        want |= {(int(i), int(j)) for i, row in zip(q, np.argpartition(-s, 5, axis=1)[:, :5], strict=True) for j in row}
    return len(got & want) / len(want), verified / len(queries) / len(m), len(waves)


def test_nearest_without_structure(spark, monkeypatch):
    """On normal components, in one cell and in many: the same share of rows is verified, in the order of projections."""
    m = np.random.default_rng(5).normal(size=(6000, 64))
    for cell in (1 << 20, 500):
        monkeypatch.setattr(ann, "CELL", cell)
        recall, share, waves = recall_and_share(spark, m)
        assert recall >= 0.9 and share < 0.4 and (waves == 1) == (cell > 6000)


def test_nearest_of_clusters(spark):
    r = np.random.default_rng(7)
    centres = r.normal(size=(2000, 64))
    m = centres[r.integers(0, 2000, 200_000)] + r.normal(size=(200_000, 64)) * 0.25
    recall, share, waves = recall_and_share(spark, m)
    assert recall >= 0.9 and share < 0.05 and waves > 1


# 3 -----------------------------------------------------------------------------------------------


def brute_grams(text):
    counts = Counter()
    for w in re.findall(r"[^\W\d_]+", text.lower()):
        counts.update(w)
        p = f" {w} "
        counts.update(p[i : i + 2] for i in range(len(p) - 1))
        counts.update(p[i : i + 3] for i in range(len(p) - 2))
    return counts


def test_ngrams_match_counting():
    texts = ["The cat, the HAT; a", "", "ß und Öl 12 x", "z"]
    codes, owner = langid.ngrams(texts)

    def gram(c):
        return "".join(chr(x) if x else " " for x in (c >> 42, c >> 21 & 0x1FFFFF, c & 0x1FFFFF) if x != langid.NONE)

    for i, t in enumerate(texts):
        assert Counter(gram(int(c)) for c in codes[owner == i]) == brute_grams(t)


def test_languages(docs, empty):
    out = langid.identify_languages(docs)
    got = rows(out, "doc_id", "held_out", "lang_pred", "score")
    assert len(got) == len(TEXTS)
    for (i, t, _, _), _ in zip(TEXTS, TEXTS, strict=True):
        mine = [g for g in got if g[0] == i]
        assert mine and all(0 <= g[3] <= 1 for g in mine)
        import zlib

        assert all(g[1] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2) for g in mine)
        if t is None or not any(c.isalpha() for c in t):
            assert ("und", 0.0) in {(g[2], g[3]) for g in mine}
    assert langid.identify_languages(empty).count() == 0
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    told = langid.with_language(docs, langid.learn_profiles(docs)).collect()
    assert rows(kept, "doc_id", "text") == sorted(((r["doc_id"], r["text"]) for r in told if any(c.isalpha() for c in r["text"] or "") and r["score"] >= langid.LEAST_SCORE), key=repr)
    unlearned = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {g[0] for g in rows(langid.identify_languages(unlearned), "lang_pred")} == {"und"}
    assert langid.keep_identified(unlearned).count() == sum(any(c.isalpha() for c in t or "") for _, t, _, _ in TEXTS)


def brute_language(text, profiles):
    """(language, score) by the distance of ranks, in plain Python."""
    own = brute_grams(text or "")
    if not own or not profiles:
        return "und", 0.0
    top = sorted(own, key=lambda g: (-own[g], gram_code(g)))[:300]
    apart = {lang: sum(abs(k - p[g]) if g in p else 300 for k, g in enumerate(top)) for lang, p in profiles.items()}
    best = min(sorted(apart), key=apart.get)
    return best, 1 - apart[best] / (300 * len(top))


def gram_code(g):
    c = [0 if x == " " else ord(x) for x in g]
    return sum(x << 21 * (2 - k) for k, x in enumerate([langid.NONE] * (3 - len(c)) + c))


@pytest.mark.parametrize("block", [5000, 1])
def test_languages_against_plain_python(spark, monkeypatch, block):
    """Profiles with ties at their end, distances and scores of all texts; the same when languages are compared one at a time."""
    import zlib

    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(23)
    letters = {"aa": "abcdefghij", "bb": "efghijklmnop", "cc": "klmnopqrstuvwxyz"}
    docs = [(i, " ".join("".join(r.choice(letters[x]) for _ in range(r.randint(1, 7))) for _ in range(r.randint(0, 60))), x) for i, x in enumerate([*letters] * 30)]
    docs += [(200, None, "aa"), (201, "", "bb"), (202, "12 !", None), (203, "abc xyz", None)]
    counts = {x: Counter() for x in letters}
    for i, t, x in docs:
        if t is not None and x and zlib.crc32(str(i).encode()) % 4 != 2:
            counts[x] += brute_grams(t)
    assert any(sorted(c.values())[-300] == sorted(c.values())[-301] for c in counts.values())
    profiles = {x: {g: k for k, g in enumerate(sorted(c, key=lambda g: (-c[g], gram_code(g)))[:300])} for x, c in counts.items()}
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in langid.identify_languages(df).collect()}
    for i, t, _ in docs:
        lang, score = brute_language(t, profiles)
        assert got[i][0] == lang and abs(got[i][1] - score) < 1e-12
    noise = spark.createDataFrame([(900, "日本語の文字" * 40, "aa")], df.schema).where("doc_id > 0")
    kept = {x["doc_id"] for x in langid.keep_identified(df.unionByName(noise.withColumn("lang", F.lit(None).cast("string")))).collect()}
    assert 900 not in kept and len(kept) > 80


@pytest.mark.parametrize("query", ["op3_language_id", "op4_suffix_dedup", "op5_syncmers", "op8_simhash"])
def test_queries_equal_sql_on_odd_documents(spark, docs, query, tmp_path):
    """Nulls, empty and very long texts, repeated rows and ids, long runs without blanks: Spark and DuckDB give the same rows."""
    import duckdb

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    out = con.sql(queries.oracle_sql()[query])
    assert rows(queries.queries()[query](spark, str(tmp_path)), *out.columns) == sorted(out.fetchall(), key=repr)


# 4 -----------------------------------------------------------------------------------------------


def brute_repeats(texts, span):
    raw = [(t or "").encode() for t in texts]
    counts = Counter(b[k : k + span] for b in raw for k in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - span + 1):
            if counts[b[k : k + span]] > 1:
                gone[k : k + span] = True
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if len(b) else b""
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [4096, 2])
def test_repeats(docs, empty, group):
    out = suffix_dedup.without_repeats(docs, group=group).withColumn("sha", F.sha2(F.col("kept"), 256))
    got = rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha")
    want = sorted(((i, *w) for (i, *_), w in zip(TEXTS, brute_repeats([t for _, t, _, _ in TEXTS], 200), strict=True)), key=repr)
    assert got == want
    assert suffix_dedup.repeat_report(empty).count() == 0


def test_split_groups_merge(spark):
    """Many texts share one passage in different surroundings; groups of two force merging between shards."""
    r = random.Random(8)
    shared = prose(99, 60)
    texts = ["".join(r.choice("uvwxyz ") for _ in range(r.randint(0, 150))) + shared[r.randint(0, 60) :] + prose(1000 + i, 12) for i in range(40)]
    texts += ["ab" * 300, "b" + "ab" * 150, "z" * 199, "z" * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in (2, 4096):
        out = suffix_dedup.without_repeats(df, group=group).withColumn("sha", F.sha2("kept", 256))
        assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(((i, *w) for i, w in enumerate(brute_repeats(texts, 200))), key=repr)


def test_groups_split_without_being_forced(spark):
    """A phrase in thousands of texts: its group is split at the production size, and shards in different tasks find equal windows by merging."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the shards of so few texts would meet in one task
    try:
        _split_without_being_forced(spark)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def _split_without_being_forced(spark):
    r = random.Random(18)
    phrase = prose(98, 9)
    texts = [prose(20_000 + i, 24)[:110] + phrase + prose(30_000 + i, 30)[:120] for i in range(3000)]
    texts += [texts[r.randrange(3000)][5:225] + f" tail {i}" for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    keyed = df.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("th"), "text")
    judged = suffix_dedup.judged_shards(keyed, suffix_dedup.fragment_table(keyed))
    assert judged.where("dig is not null").select("h").distinct().count() > 0
    merged = judged.where("dig is not null").select("h", "r", "dig", "fds", "los", "known").repartition("h", "r").sortWithinPartitions("h", "r")
    assert merged.mapInArrow(suffix_dedup._merge_lists, "h long, fd long, lo int").count() > 0
    out = suffix_dedup.without_repeats(df).withColumn("sha", F.sha2("kept", 256))
    assert rows(out, "doc_id", "n_bytes", "n_removed", "n_spans", "sha") == sorted(((i, *w) for i, w in enumerate(brute_repeats(texts, 200))), key=repr)


def test_merged_lists():
    """Each place that repeats is told once, whatever the order of lists; equal first halves alone are no match."""
    r = np.random.default_rng(21)
    lists = [np.unique(r.integers(0, 400, (int(r.integers(1, 90)), 2)) // np.array([1, 100]), axis=0).astype(np.uint64) for _ in range(40)]
    count = Counter(map(tuple, np.concatenate(lists).tolist()))
    merged, got, at = suffix_dedup.MergedLists(), [], 0
    places = []
    for x in lists:
        lo = np.arange(at, at + len(x), dtype=np.int32)
        at += len(x)
        places += map(tuple, x.tolist())
        got += merged.add(x[:, 0].copy(), x[:, 1].copy(), lo.astype(np.int64), lo, np.zeros(len(x), bool))[1].tolist()
    assert len(got) == len(set(got))
    assert sorted(got) == [i for i, p in enumerate(places) if count[p] > 1]


def test_suffix_array_and_prefixes():
    r = np.random.default_rng(0)
    for n, letters in ((500, 1), (800, 2), (900, 4), (1, 1), (9, 1)):
        d = r.integers(97, 97 + letters, n).astype(np.uint8)
        b = bytes(d)
        order = suffix_dedup.suffix_array(d)
        assert order.tolist() == sorted(range(n), key=lambda i: b[i:])
        got = suffix_dedup.common_prefixes(d, order, 60)
        for k in range(1, n):
            x, y = b[order[k - 1] :][:60], b[order[k] :][:60]
            want = next((i for i, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
            assert got[k] == want


def test_long_text_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 1 << 10)
    t = prose(7, 900).encode()
    starts = sorted((int(s), int(n)) for _, s0, ns, _, _ in suffix_dedup.fragments([t, b"short"]) for s, n in zip(s0, ns, strict=True))
    assert [s for s, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    assert sum(n for _, n in starts) == len(t) - 199


def test_deduplicated_documents(docs):
    out = suffix_dedup.deduplicated_documents(docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.where("doc_id in (1, 2, 12)").collect()} == {1: "", 2: None, 12: "One"}


# 5 -----------------------------------------------------------------------------------------------


def test_syncmers(docs, empty):
    out = syncmer.fingerprint_edits(docs)
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()
    order = sorted(TEXTS, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t, _, _) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + nxt[:half]).encode()).hexdigest()))
    got = out.collect()
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(set)
    for r in got:
        by[(r["doc_id"], r["n_chars"])].add(r["fingerprint"])
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert by[(1, len(BASE))] == by[(4, len(BASE))] and len(by[(1, len(BASE))]) == 1
    assert syncmer.fingerprint_edits(empty).count() == 0
    assert syncmer.fingerprint_edits(docs.where("doc_id is null")).count() == 1


def test_syncmers_are_context_free(spark):
    """The anchors of a passage do not depend on what surrounds it; other ranges than one bucket give the same rows."""
    df = spark.createDataFrame([(i, prose(i, 20) + " " + BASE + " " + prose(100 + i, 20)) for i in range(2)], "doc_id long, text string")
    a, b = (set(r["s"]) for r in syncmer.with_sketch(df, "text", "s").orderBy("doc_id").select("s").collect())
    assert len(a & b) >= 0.4 * min(len(a), len(b))


def test_syncmers_keep_all_anchors(spark):
    """Long texts keep all anchors with places, runs without blanks survive an insertion, and every text with a token has an anchor."""
    shared = prose(5, 100)
    run = "".join(random.Random(4).choice("abcdefghijklmnop") for _ in range(3000))
    texts = [prose(1, 5000) + " " + shared, shared + " " + prose(2, 5000), run, "x" + run, *(prose(3000 + i, 4) for i in range(30))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["s"], r["s_at"]) for r in syncmer.with_sketch(df, "text", "s").collect()}
    assert len(got[0][0]) > 2500 and got[0][1] == sorted(set(got[0][1]))
    both = set(got[0][0]) & set(got[1][0])
    assert len(both) > 40
    moved = {dict(zip(*got[0], strict=True))[h] - dict(zip(*got[1], strict=True))[h] for h in both}
    assert any(m > 5000 for m in moved) and len(moved) < 5  # tokens that stand before it
    assert len(set(got[2][0]) & set(got[3][0])) > 0.95 * len(set(got[2][0]))
    assert all(len(a) == len(b) >= 1 for a, b in got.values())


def brute_syncmers(text):
    """(hash, token number) of the closed syncmers of a text, in plain Python."""

    def xx(*items):
        seed = 42
        for x in items:
            seed = xxhash.xxh64_intdigest(x.encode() if isinstance(x, str) else x.to_bytes(8, "little", signed=True), seed)
        return seed - (1 << 64) if seed >> 63 else seed

    def kind(ch):
        c = unicodedata.category(ch)
        return "N" if c[0] == "N" else "o" if c == "Lo" else "U" if c in ("Lu", "Lt") else "l" if c in ("Ll", "Lm") or c[0] == "M" else "s"

    tokens = []
    for run in WORD.findall(text or ""):
        kinds = "".join(map(kind, run))
        at = 0
        while at < len(run):
            many = lambda k, at: len(kinds) - at - len(kinds[at:].lstrip(k))  # noqa: E731  of one kind from there
            end = at + 1
            if kinds[at] in "Ul":
                caps = many("U", at)
                small = min(16, many("l", at + caps))
                if caps > 16 or not small:
                    end = at + min(16, caps)
                else:
                    cut = [i for i in range(small) if run[at + caps + i] in "qxjz"]
                    end = at + caps + (cut[0] + 1 if cut else small)
            elif kinds[at] == "N":
                digits = min(16, many("N", at))
                end = at + (run[at : at + digits].index("0") + 1 if "0" in run[at : at + digits] else digits)
            elif kinds[at] == "s":
                end = at + min(16, many("s", at))
            tokens.append(run[at:end])
            at = end
    inner = [xx(*tokens[i : i + 2]) for i in range(len(tokens) - 1)]
    out = []
    for i in range(len(tokens) - 3):
        three = inner[i : i + 3]
        if min(three) in (three[0], three[2]):
            out.append((xx(three[0], three[2]), i))
    return out or ([(xx(" ".join(tokens)), 0)] if tokens else [])


def test_syncmers_match_plain_python(spark, docs):
    r = random.Random(14)
    texts = [t for _, t, _, _ in TEXTS] + ["".join(r.choice("ab\u3042\u3044\U0001f600 ") for _ in range(r.randint(0, 90))) for _ in range(60)]
    texts += ["".join(r.choice("\u65e5\u672c\u8a9e\u6587") for _ in range(n)) for n in (31, 32, 33, 200)]
    texts += ["".join(r.choice("aBqz0190=-/\u0301\u0660\u01c5\u02b0 ") for _ in range(r.randint(0, 90))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: list(zip(x["s"], x["s_at"], strict=True)) for x in syncmer.with_sketch(df, "text", "s").collect()}
    assert got == {i: brute_syncmers(t) for i, t in enumerate(texts)}
    out = syncmer.fingerprint_edits(docs).collect()
    shown = {f"{h & (1 << 64) - 1:016x}" for t in texts for h, _ in brute_syncmers(t)}
    assert all(x["fingerprint"][i : i + 16] in shown for x in out for i in range(0, len(x["fingerprint"]), 24))


def test_runs_of_any_length_are_cut_alike(spark):
    """One character more behind a run changes no anchor but the last ones, at every length."""
    r = random.Random(6)
    runs = ["".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEF0123456789+/") for _ in range(n)) for n in (*range(28, 40), 200)]
    runs += [("ABC" * n)[:n] for n in (60, 90)] + ["a" * n for n in (80, 81, 200)]
    df = spark.createDataFrame([(2 * i + j, x + "Q1"[: 2 * j]) for i, x in enumerate(runs) for j in range(2)], "doc_id long, text string")
    got = {x["doc_id"]: x["s"] for x in syncmer.with_sketch(df, "text", "s").collect()}
    for i in range(len(runs)):
        a, b = got[2 * i], got[2 * i + 1]
        assert a[:-3] == b[: max(0, len(a) - 3)]


@pytest.mark.parametrize("ids", [range(60), [0, 1, 2, *range(2**62, 2**62 + 60)], [5], [3, 3, 3, 9], [-(2**63), 2**63 - 1, 0]])
def test_next_rows_over_ranges(spark, ids):
    """Ranges of four rows, ids beyond the precision of doubles, one far from all others, repeated ids, ids of either end."""
    rows_ = [(int(i), f"t{i}-{k}") for k, i in enumerate(ids)] + [(None, "n1"), (None, "n2")]
    df = spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)
    got = {r["text"]: r["next_text"] for r in syncmer.with_next(df, ["text"], bucket=4).collect()}
    order = [t for _, t in sorted(rows_, key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))]
    assert got == {t: order[(k + 1) % len(order)] for k, t in enumerate(order)}


# 6 -----------------------------------------------------------------------------------------------

URLS = [
    "http://A.Example.NET/en/x?q#f", "https://example.net/english", "http://example.net/en", "http://net/x", "http://x.org/fr/1", "http://org/fr/", "http://xorg/fr/",
    "http://example.com/de/1", "http://b.example.com/de", "http://example.com/fr/", None, "", "no scheme", "://", "http://?x", "http://net", "x://y://net/a", "http://é.net/ü", "http://net/a#b?c",
]


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate(LOWER)
    fits = [(len(r), r, v) for r, v in url_filter.RULES for h, p in [url_filter.split_rule(r)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "allow"


def test_urls(spark):
    r = random.Random(4)
    more = ["http://" + ".".join(r.choice(["a", "net", "org", "example", "com"]) for _ in range(r.randint(1, 4))) + r.choice(["", "/", "/en/", "/fr/", "/de/x"]) for _ in range(400)]
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate([*URLS, *more])], "page_id long, url string, host string, keys string").repartition(3)
    want = sorted(((i, *brute_rule(u)) for i, u in enumerate([*URLS, *more])), key=repr)
    assert rows(url_filter.filter_urls(df), "page_id", "host", "path", "rule", "verdict") == want
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_urls_under_a_long_list(spark):
    """A million rules as a table: plans hold none of them, and what a task holds follows the rules that occur."""
    rules = spark.range(1_000_000).select(F.concat(F.lit("h"), "id", F.lit(".net/"), F.when(F.col("id") % 2 == 0, F.substring(F.lit("abcdefgh"), F.lit(1), (F.col("id") % 8).cast("int"))).otherwise("")).alias("rule"), F.when(F.col("id") % 3 == 0, "allow").otherwise("block").alias("verdict"))
    rules = rules.unionByName(spark.createDataFrame([(None, "block"), ("h5.net/", "allow"), ("h5.net/", "block")], "rule string, verdict string"))
    urls = [(i, f"http://www.h{i * 37}.net/{'abcdefgh'[: i % 9]}x") for i in range(300)] + [(300, None), (300, "http://h5.net/")]
    out = url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), rules)
    assert len(out._jdf.queryExecution().toString()) < 100_000

    def want(i, url):
        n = 5 if i == 300 else i * 37
        path = url.split(".net", 1)[1] if url else ""
        prefix = "/" + "abcdefgh"[: n % 8] if n % 2 == 0 else "/"
        hit = bool(url) and path.startswith(prefix)
        return f"h{n}.net{prefix}" if hit else None, "block" if hit and (n % 3 or n == 5) else "allow"

    got = sorted(((r["page_id"], r["rule"], r["verdict"]) for r in out.collect()), key=repr)
    assert got == sorted(((i, *want(i, u)) for i, u in urls), key=repr)
    assert {r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(urls, "page_id long, url string"), ()).collect()} == {"allow"}


def test_cascade_needs_levels(spark):
    """Half of all keys pass each level wrongly; the cascade is still exact."""
    keys = spark.range(4000).select(F.xxhash64("id").alias("h"), (F.col("id") % 2 == 0).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    got = keys.collect()
    h = np.array([r["h"] for r in got], np.int64).view(np.uint64)
    assert len(cascade.levels) > 2
    assert cascade.has(h).tolist() == [r["listed"] for r in got]


def test_cascade_size_follows_the_list(spark):
    """Four listed keys among 300,000: few bits in all, as the first level is sized against the universe."""
    keys = spark.range(300_000).select(F.xxhash64("id").alias("h"), (F.col("id") < 4).alias("listed"))
    cascade = url_filter.build_cascade(keys)
    assert sum(x.bits for x in cascade.levels) < 5000
    h = np.array([r["h"] for r in keys.collect()], np.int64).view(np.uint64)
    assert cascade.has(h).sum() == 4


def test_long_urls(spark):
    """Hosts of thousands of labels and paths of 100,000 characters are read whole, and cost no square of their length."""
    urls = ["http://" + "a." * 20_000 + "example.net/en/" + "x" * 100_000, "http://" + "net." * 5000 + "net", "http://" + "net." * 5000 + "net/fr/", "x" * 200_000, "http://" + "y" * 100_000 + ".org/fr/?" + "z" * 100_000]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    want = sorted(((i, *brute_rule(u)) for i, u in enumerate(urls)), key=repr)
    assert rows(url_filter.filter_urls(df), "page_id", "host", "path", "rule", "verdict") == want


# 7 -----------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    path = queries.tokenizer_file()
    return piece_codec.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)


def test_encoding_equals_the_library(pieces):
    mine, lib = pieces
    r = random.Random(1)
    letters = "abcdefgh  ▁\n\t.,éñ日本語😀\u0301 aaaaa the ing <0x0A> <s>\x00\u200b"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += ["".join(r.choice(mine.pieces[3:]) for _ in range(r.randint(0, 30))).replace("▁", " ") for _ in range(800)]
    texts += ["a" * 5000, "ab" * 3000, " " * 999, "\n" * 500, "", "  x", "x  ", "=" * 101, "Q" * 70_000]
    assert mine.encode(texts) == lib.encode(texts, num_threads=1)
    for t in texts:
        ids = lib.encode(t)
        assert mine.decode(ids) == lib.decode(ids)
    for _ in range(2000):
        ids = [r.choice([r.randrange(32000), r.randrange(300)]) for _ in range(r.randint(0, 8))]
        assert mine.decode(ids) == lib.decode(ids)


def test_token_digests(docs, empty, pieces):
    _, lib = pieces
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for i, t, _, _ in TEXTS:
        ids = lib.encode(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids))))
    path = queries.tokenizer_file()
    assert rows(piece_codec.token_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert piece_codec.token_digests(empty, path).count() == 0
    full = piece_codec.encode_documents(docs, path)
    assert sorted(map(repr, (r["ids"] for r in full.collect()))) == sorted(repr(lib.encode(t or "")) for _, t, _, _ in TEXTS)


# 8 -----------------------------------------------------------------------------------------------


def brute_simhash(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    s = [" ".join(w[j : j + k]) for j in range(len(w) - k + 1)] if len(w) >= k else ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(items, linked):
    parent = list(range(len(items)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(items)):
        for b in range(a):
            if linked(items[a], items[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return [find(a) for a in range(len(items))]


def test_simhash(docs, empty):
    fps = [brute_simhash(t, 4) for _, t, _, _ in TEXTS]
    group = brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for g, (i, *_) in zip(group, TEXTS, strict=True):
        least[g] = min(least.get(g, 1 << 62), i if i is not None else 1 << 62)
    want = sorted(((i, f"{f:016x}", None if i is None else least[g]) for (i, *_), f, g in zip(TEXTS, fps, group, strict=True)), key=repr)
    out = simhash.simhash_components(docs).withColumn("fingerprint", F.lpad(F.lower(F.hex("fp")), 16, "0"))
    assert rows(out, "doc_id", "fingerprint", "component_id") == want
    assert simhash.simhash_components(empty).count() == 0


@pytest.mark.parametrize("run, most", [(gray.RUN, gray.TOP), (20, gray.TOP), (8, 10)])
def test_fingerprint_links(spark, run, most):
    """All links come from the index: over one run, over many, and over several levels of nodes."""
    r = random.Random(6)
    fps = set()
    for _ in range(12):
        base = r.getrandbits(64)
        for _ in range(25):
            x = base
            for _ in range(r.randint(0, 7)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    links = gray.fingerprint_links(df, 4, run, most)
    label = {r["node"]: r["label"] for r in connected_components(links).collect()}
    assert [label.get(i, i) for i in range(len(fps))] == brute_components(fps, lambda a, b: (a ^ b).bit_count() <= 4)


def test_links_of_a_dense_group(spark):
    """20,000 fingerprints of one group: few links are listed, and queries leave the nodes that are their own component's."""
    r = np.random.default_rng(4)
    x = np.uint64(0x0123456789ABCDEF) ^ np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 40, (30_000, 3)).astype(np.uint64), axis=1)
    x = np.unique(x)[:20_000]
    df = spark.createDataFrame([(int(v.view(np.int64)), i) for i, v in enumerate(x)], "fp long, rep long")
    links = gray.fingerprint_links(df, 4)
    assert links.count() < 10 * len(x)
    assert {r["label"] for r in connected_components(links).collect()} == {0}


def test_gray_index_finds_all():
    r = np.random.default_rng(3)
    x = np.unique(np.r_[r.integers(0, 2**63, 40, dtype=np.uint64), *(np.uint64(1 << 40) ^ (np.uint64(1) << r.integers(0, 64, 6).astype(np.uint64)) for _ in range(40))])
    x = x[np.argsort(gray.gray_rank(x))]
    got = {p for q, n, _, _ in gray.GrayIndex(x).near(x, 4) for p in zip(q.tolist(), n.tolist(), strict=True)}
    assert got == {tuple(p) for p in np.argwhere(np.bitwise_count(x[:, None] ^ x[None]) <= 4).tolist()}
    assert (gray.at_place(gray.place(x)) == x).all()


def test_components_of_paths(spark):
    """A long path and a star: the smallest node reaches all."""
    path = [(i, i + 1) for i in range(0, 60)]
    star = [(100, 200 + i) for i in range(50)] + [(500, 400), (400, 401)]
    r = random.Random(2)
    names = list(range(600))
    r.shuffle(names)
    df = spark.createDataFrame([(names[a], names[b]) for a, b in path + star], "a long, b long")
    label = {x["node"]: x["label"] for x in connected_components(df).collect()}
    assert {label[names[i]] for i in range(61)} == {min(names[i] for i in range(61))}
    assert {label[names[i]] for i in [100, *range(200, 250)]} == {min(names[i] for i in [100, *range(200, 250)])}
    assert label[names[500]] == min(names[400], names[401], names[500])


@pytest.mark.parametrize("bucket", [4096, 2])
def test_similar_texts(spark, bucket):
    r = random.Random(9)
    texts = []
    for g in range(6):
        w = prose(50 + g, 200).split()
        for _ in range(5):
            v = list(w)
            for _ in range(r.randint(0, 2)):
                v[r.randrange(len(v))] = "new" + str(r.random())
            texts.append(" ".join(v))
    texts += [prose(900 + i, 100) for i in range(20)] + [None, "", "one two", "one two"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df, bucket=bucket).collect()}
    for i in range(30):
        assert got[i] == i // 5 * 5
    assert all(got[i] == i for i in range(30, 50))
    assert (got[50], got[51], got[52], got[53]) == (50, 50, 52, 52)


def jaccard(a, b, k=5):
    a, b = (set(simhash.shingle_hashes(t, k)) for t in (a, b))
    return len(a & b) / len(a | b)


def test_exact_labels():
    r = np.random.default_rng(8)
    base = [r.choice(2**60, 60, replace=False).astype(np.uint64) for _ in range(6)]
    sets = []
    for i in range(120):
        x = base[i % 6].copy()
        n = int(r.integers(0, 14))
        x[r.choice(60, n, replace=False)] = r.choice(2**60, n, replace=False)
        sets.append(np.unique(x))
    sets += [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]
    close = lambda a, b: len(a) > 0 and len(np.intersect1d(a, b)) >= 0.8 * len(np.union1d(a, b)) - 1e-9
    assert simhash.exact_labels(sets, 0.8).tolist() == brute_components(sets, close)
    assert simhash.exact_labels([], 0.8).tolist() == []


@pytest.mark.parametrize("group", [simhash.BLOCK, 2])
def test_similar_texts_by_exact_similarity(spark, monkeypatch, group):
    """Pairs on both sides of the similarity, repeated ids and groups over several tasks: the components of exact Jaccard."""
    monkeypatch.setattr(simhash.exact_links, "__defaults__", (group,))
    r = random.Random(12)
    texts = []
    for g in range(40):
        w = prose(1500 + g, 120).split()
        for n in (0, 1, 2, 2, 3, 3):  # each change of a word takes up to five shingles
            v = list(w)
            for at in r.sample(range(len(v)), n):
                v[at] = "new" + str(r.random())
            texts.append(" ".join(v))
    sims = [jaccard(a, b) for g in range(0, 240, 6) for a, b in combinations(texts[g : g + 6], 2)]
    assert sum(0.7 <= s < 0.8 for s in sims) > 20 and sum(0.8 <= s < 0.85 for s in sims) > 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_components(df).collect()}
    want = []
    for g in range(0, 240, 6):
        want += [g + x for x in brute_components(texts[g : g + 6], lambda a, b: jaccard(a, b) >= 0.8)]
    assert [got[i] for i in range(240)] == want
    twice = df.unionByName(spark.createDataFrame([(0, prose(7000, 80)), (900, prose(7000, 80))], df.schema))
    got = {(r["doc_id"], r["component_id"]) for r in simhash.similar_components(twice).collect()}
    assert (900, 0) in got and {(i, x) for i, x in enumerate(want)} <= got


def test_many_near_copies(spark):
    """20,000 copies that differ in a word or two are one group, among texts that share a passage with them and stay apart."""
    r = random.Random(31)
    base = prose(8000, 150).split()
    texts = []
    for i in range(20_000):
        v = list(base)
        v[r.randrange(len(v))] = f"w{i}"
        texts.append(" ".join(v))
    texts += [" ".join([*prose(8100 + i, 40).split(), *base[:30], *prose(8500 + i, 40).split()]) for i in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_components(df).collect()}
    assert {got[i] for i in range(20_000)} == {0} and all(got[i] == i for i in range(20_000, 20_300))


def test_one_of_each(docs, empty):
    out = simhash.one_of_each(docs)
    got = rows(out, "doc_id")
    assert out.columns == docs.columns
    assert (1,) in got and (4,) not in got and (None,) in got
    assert len(got) == len(set(got))
    assert simhash.one_of_each(empty).count() == 0


# 9 -----------------------------------------------------------------------------------------------


def test_quality(docs, empty, spark):
    got = rows(quality.score_quality(docs.select("doc_id", "text", "id")), "doc_id", "weak", "score", "keep")
    assert len(got) == len(TEXTS) and all(0 <= g[1] <= 1 and 0 <= g[2] <= 1 for g in got)
    assert all(g[2] == 0 and not g[3] for g in got if g[0] in (2, 8))
    assert quality.score_quality(empty).count() == 0
    junk = [(1000 + i, " ".join(w.upper() + "!!" for w in prose(i, 60).split())) for i in range(40)] + [(2000 + i, " | ".join(prose(500 + i, 60).split())) for i in range(40)]
    clean = [(i, ". ".join(prose(i * 7 + j, 8) for j in range(8)) + ".") for i in range(300)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string")
    out = {r["doc_id"]: r["keep"] for r in quality.score_quality(df).collect()}
    assert sum(out[i] for i, _ in clean) >= 295
    assert sum(out[i] for i, _ in junk) <= 8


def test_quality_is_learned_from_different_rows(spark):
    """Many copies of an advert take no place in the sample that the scorer is fitted on."""
    good = [(i, " ".join(["The", *prose(i, 60).split(), "and it is of the", prose(i + 5000, 40)]) + ". It was the end of that.") for i in range(400)]
    junk = [(1000 + i, "BUY NOW!!! " * 3 + prose(i, 3).upper() + " $$$ !!! CLICK HERE") for i in range(100)]
    df = spark.createDataFrame(good + junk, "doc_id long, text string")
    advert = spark.range(300_000).select(F.lit(5000).cast("long").alias("doc_id"), F.lit("BUY NOW!!! CHEAP!!! CLICK HERE!!! $$$ $$$").alias("text"))
    few = {r["doc_id"]: r["score"] for r in quality.score_quality(df).collect()}
    many = {r["doc_id"]: (r["score"], r["keep"]) for r in quality.score_quality(df.unionByName(advert)).dropDuplicates(["doc_id"]).collect()}
    assert len({round(s, 6) for s, _ in many.values()}) > 400 and many[5000][1] is False
    assert np.corrcoef([few[i] for i in few], [many[i][0] for i in few])[0, 1] > 0.9


def test_quality_reads_whole_runs():
    """Texts without blanks count to their last character; a change in front moves few features."""
    r = random.Random(3)
    run = "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(2000))
    assert "".join(quality.pieces(run)) == run and max(map(len, quality.pieces("a" * 1000 + run))) <= quality.LONG
    of = lambda t: dict(zip(*(x.tolist() for x in quality.features(t)), strict=True))
    assert of(run) != of(run[:-1] + "x") != of(run[:64])
    assert of("w" * 50 + "a") != of("w" * 50 + "1")
    a, b = Counter(quality.pieces(run)), Counter(quality.pieces("x" + run))
    assert sum((a & b).values()) >= 0.95 * sum(a.values())
    # The scorer's weights on the later pieces reach the score.
    tail = "".join(chr(0xAC00 + r.randrange(3000)) for _ in range(400))
    w = quality.fit([(*quality.features(run[:64] + tail), 0.0), (*quality.features(run), 1.0)] * 5)
    score = lambda t: (lambda at, x: float(x @ w[at] + w[-1]))(*quality.features(t))
    assert score(run) > 0 > score(run[:64] + tail)


def plain_measures(text):
    """The labellers' measures of a text, written out."""
    nan = math.nan
    solid = [c for c in text if not c.isspace()]
    letters = [c for c in solid if c.isalpha()]
    signs = [c for c in solid if not c.isalnum() and c not in quality.PLAIN_SIGNS]
    out = [len(letters) / len(solid) if solid else nan, sum(c.isupper() for c in letters) / len(letters) if len(letters) >= 20 else nan, len(signs) / len(solid) if solid else nan]
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    repeated = 1 - len(set(lines)) / len(lines) if len(lines) >= 4 else nan
    if n < 20:
        return [*out, nan, repeated, *[nan] * 5]
    bare = [w for w in words if len(w) < 4 and not any(c.isalnum() for c in w)]
    return [
        *out, len(set(words)) / math.sqrt(n), repeated, (sum(len(w) <= 3 for w in words) - len(bare)) / n, sum(map(len, words)) / n,
        (text.count("!! ") + text.count("?? ")) / n, sum(a == b for a, b in zip(words, words[1:])) / n, len(bare) / n,
    ]


def test_votes_against_plain_python():
    r = random.Random(77)
    parts = ["word", "WORD", "a", "!!", "??", "|", "%%", "12", "é", "日本", "\n", "  ", "\t", ".", "same same", "xx!! "]
    texts = [" ".join(r.choice(parts) for _ in range(r.randint(0, 80))) for _ in range(300)] + ["", " ", "\n\n", "a" * 100]
    got = quality.measures(texts)
    want = np.array([plain_measures(t) for t in texts])
    assert np.allclose(got, want, equal_nan=True)
    for t, v in zip(texts, quality.votes(texts).tolist(), strict=True):
        for k, (x, (low, good, upto, high)) in enumerate(zip(plain_measures(t), quality.LABELLERS.values(), strict=True)):
            said = quality.BAD if x < low or x > high else quality.GOOD if good <= x <= upto else quality.NONE
            assert v // 3**k % 3 == said


def test_features_against_plain_python():
    """Square roots of counts of words and shapes, scaled to length one."""
    text = "The cat saw THE cat 12 times; the end the end"
    words = text.split()

    def shape(w):
        kinds = ["A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w]
        return "".join(k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k)

    counts = Counter()
    for w in words:
        counts[xxhash.xxh32_intdigest(w) % quality.BUCKETS] += 1
        counts[xxhash.xxh32_intdigest("\0" + shape(w)) % quality.BUCKETS] += 1
    counts[xxhash.xxh32_intdigest("\x02%d" % 0) % quality.BUCKETS] += len(words)
    counts[xxhash.xxh32_intdigest("\x01%d" % int((1 - len(set(words)) / len(words)) * 10)) % quality.BUCKETS] += len(words)
    norm = math.sqrt(sum(counts.values()))
    got = dict(zip(*(x.tolist() for x in quality.features(text)), strict=True))
    assert got.keys() == counts.keys() and all(abs(got[k] - math.sqrt(n) / norm) < 1e-12 for k, n in counts.items())


def test_label_model_against_plain_python():
    """One document at a time: the same posteriors as over counts of patterns."""
    r = np.random.default_rng(9)
    k = len(quality.LABELLERS)
    vote = np.where(r.random((200, k)) < 0.5, 2, (r.random((200, k)) < 0.7).astype(int))
    codes = (vote @ 3 ** np.arange(k)).tolist()
    got, _, _ = quality.label_model(dict(Counter(codes)), rounds=5)
    n = len(vote)
    post = []
    for v in vote.tolist():
        g, b = v.count(1), v.count(0)
        p = (g + 1) / (g + b + 2)
        post.append(min(p, 0.3) if b >= 2 else p)
    for _ in range(5):
        table = {}
        for j in range(k):
            for c in (0, 1):
                w = [(p if c else 1 - p) for p in post]
                own = {v: sum(x for x, row in zip(w, vote.tolist(), strict=True) if row[j] == v) for v in (0, 1)}
                own[c] += quality.RIGHT * n + 2
                own[1 - c] += 0.1 * quality.RIGHT * n + 0.2
                for v in (0, 1):
                    table[j, c, v] = own[v] / (own[0] + own[1])
        prior = min(0.99, max(0.01, sum(post) / n))
        post = []
        for row in vote.tolist():
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[j, 1, v]) - math.log(table[j, 0, v]) for j, v in enumerate(row) if v != 2)
            post.append(1 / (1 + math.exp(-odds)))
    assert np.allclose(got[codes], post)


def test_quality_sample_and_names(spark):
    """Repeated and null keys: the same scores however rows are dealt; columns named like the results stay."""
    texts = [(None, ". ".join(prose(i * 7 + j, 8) for j in range(8)) + ".", i) for i in range(60)] + [(7, " ".join(w.upper() + "!!" for w in prose(1, 60).split()), 0)] * 60
    df = spark.createDataFrame(texts, "doc_id long, text string, score int")
    out = quality.score_quality(df)
    assert out.columns == ["doc_id", "score_before", "weak", "score", "keep"]
    assert rows(out, *out.columns) == rows(quality.score_quality(df.repartition(5)), *out.columns)


def test_label_model_recovers_accuracies():
    r = np.random.default_rng(4)
    k, n = len(quality.LABELLERS), 20_000
    truth = r.random(n) < 0.8
    right = np.linspace(0.7, 0.95, k)
    vote = np.where(r.random((n, k)) < 0.4, 2, np.where(r.random((n, k)) < right, truth[:, None], ~truth[:, None]))
    patterns, counts = np.unique(vote @ 3 ** np.arange(k), return_counts=True)
    post, table, prior = quality.label_model(dict(zip(patterns.tolist(), counts.tolist(), strict=True)))
    assert abs(prior - 0.8) < 0.05
    assert ((post[vote @ 3 ** np.arange(k)] > 0.5) == truth).mean() > 0.93


# 10 ----------------------------------------------------------------------------------------------


def test_archive(spark, tmp_path):
    pages = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, None), (4, "http://b\r\nX: y", ""), (5, "u", "é" * 50_000), (6, "u", "y"), (7, "u", "<p>x</p>"), (None, "n", "z"), (None, "n", "y"), (8, "w", "once"), (8, "w", "once")]
    df = spark.createDataFrame([(*p, "x", "y") for p in pages], "page_id long, url string, html string, sha256 string, payload string").repartition(3)
    for least in (0, 3):
        top = defaultdict(lambda: -(1 << 63))
        for i, _, h in pages:
            top[h or ""] = max(top[h or ""], -(1 << 63) if i is None else i)
        want = []
        for i, _, h in pages:
            b = (h or "").encode()
            again = len(b) >= least and (-(1 << 63) if i is None else i) != top[h or ""]
            want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", top[h or ""] if again else None))
        assert rows(warc.archive_round_trip(df, least), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == sorted(want, key=repr)
    path = str(tmp_path / "archive")
    warc.write_archive(df, path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in pages})
    records = {r["key"]: bytes(r["record"]) for r in warc.record_bytes(warc.read_archive(spark, path)).collect()}
    assert records[7].startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and records[7].endswith(b"\r\n\r\n<p>x</p>\r\n\r\n")
    assert b"WARC-Refers-To: <urn:lodestone:page:7:" in records[1] and records[1].endswith(b"Content-Length: 0\r\n\r\n\r\n\r\n")
    assert warc.archive_round_trip(df.limit(0)).count() == 0
    read = warc.read_archive(spark, path)
    assert Counter((r["key"], r["url"], bytes(r["payload"])) for r in read.collect()) == Counter((i, u, (h or "").encode()) for i, u, h in pages)
    ids = [r["i"] for r in read.select(F.regexp_extract("header", "WARC-Record-ID: ([^\r\n]*)", 1).alias("i")).collect()]
    assert len(set(ids)) == len(set(pages))  # only equal rows share one
    refers = {r["i"] for r in read.where("record_type = 'revisit'").select(F.regexp_extract("header", "WARC-Refers-To: ([^\r\n]*)", 1).alias("i")).collect()}
    assert refers <= {r["i"] for r in read.where("record_type = 'response'").select(F.regexp_extract("header", "WARC-Record-ID: ([^\r\n]*)", 1).alias("i")).collect()}


def test_archive_of_shared_ids(spark, tmp_path):
    """Rows that share a key with other urls or payloads are records of their own; a record that was changed stops the reading."""
    df = spark.createDataFrame([(1, "http://a", "x"), (1, "http://b", "x"), (1, "http://b", "y"), (2, "http://b", None)], "page_id long, url string, html string")
    out = warc.archive_round_trip(df)
    assert rows(out, "page_id", "payload_bytes", "record_type", "refers_to") == [(1, 1, "response", None)] * 3 + [(2, 0, "response", None)]
    path = f"{tmp_path}/w"
    warc.write_archive(df, path)
    wrong = spark.read.parquet(f"{path}/payloads").withColumn("payload", F.concat("payload", F.lit(b"z").cast("binary")))
    wrong.write.parquet(f"{tmp_path}/v/payloads")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{tmp_path}/v/headers")
    records = warc.record_bytes(warc.read_archive(spark, f"{tmp_path}/v"))
    assert all(not bytes(r["record"]).endswith(b"\r\n\r\nx\r\n\r\n") for r in records.collect())


def test_archive_equals_sql(spark):
    import duckdb
    import pandas as pd

    pages = pd.DataFrame({"page_id": [1, 2, 3, 4], "url": ["u"] * 4, "html": ["é<p>", "x", "é<p>", None]})
    con = duckdb.connect()
    con.register("pages", pages)
    want = sorted(con.sql(warc.archive_sql()).fetchall(), key=repr)
    df = spark.createDataFrame([(i, "u", h) for i, h in zip(range(1, 5), ["é<p>", "x", "é<p>", None], strict=True)], "page_id long, url string, html string")
    assert rows(warc.archive_round_trip(df), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
