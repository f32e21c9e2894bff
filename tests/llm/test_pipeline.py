"""The pipeline's stages on a small corpus, each judged on its own input."""

import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import common, simhash

from test_hyperminhash import changed, plain, words
from test_llm_operators import BASE, prose


def test_stages(spark, tmp_path):
    passage = prose(77, 70)
    docs = [(i, prose(1000 + i, 80), "en", f"s{i % 3}") for i in range(60)]
    docs += [(100, BASE, "en", "s0"), (101, BASE, "en", "s1"), (102, BASE + " tail", "en", "s2"), (103, None, "en", "s0"), (104, "12 !!", "en", None)]
    docs += [(200 + i, prose(300 + i, 60) + " " + passage + " " + prose(400 + i, 60), "en", "s1") for i in range(4)]
    df = spark.createDataFrame([(*d, len(d[1] or "")) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    (tmp_path / "in").mkdir()
    df.write.parquet(f"{tmp_path}/in/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, kept, f"{tmp_path}/in")
        out.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = kept.collect()
        if name != "encode":
            assert kept.columns == df.columns
    ids = {n: sorted(r["doc_id"] for r in rows) for n, rows in seen.items()}
    assert ids["language"] == sorted(d[0] for d in docs if d[0] not in (103, 104))
    assert ids["near_duplicates"] == sorted(d[0] for d in docs if d[0] not in (101, 102, 103, 104))
    assert ids["repeated_passages"] == ids["near_duplicates"]
    texts = {r["doc_id"]: r["text"] for r in seen["repeated_passages"]}
    assert all(passage[5:-5] not in texts[200 + i] for i in range(4))
    assert all(texts[i] == t for i, t, *_ in docs if i < 60)
    assert set(ids["mix"]) <= set(ids["repeated_passages"])
    assert all(r["decoded"] == r["text"] for r in seen["encode"])
    assert len(seen["encode"]) == len(seen["mix"])


def test_run_and_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, prose(1, 50), "en", "a", 3)], "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    before = set(common._TABLES)
    out = corpus_pipeline.run(spark, f"{tmp_path}/a")
    assert out.count() == 1 and set(common._TABLES) - before == {out._table}  # nothing else is left in the shared folder
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, ids string, decoded string, fp string, label string, rep string, key string, id string, d string, n string, total string, _copies string, score string, lang_pred string, kept string, _text string, _id string"


def test_stages_on_odd_tables(spark):
    """Each stage on nulls in any column, empty and very long texts, repeated rows, ties and columns whose names clash."""
    long = prose(5, 30_000)
    rows = [(1, prose(1, 80), "en", "a"), (1, prose(1, 80), "en", "a"), (None, prose(2, 80), None, None), (None, prose(2, 80), None, None), (2, None, "en", "a"), (3, "", None, "b"), (4, long, "en", "b"), (5, prose(3, 90), None, None), (6, prose(4, 70), "de", None)]
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *["x"] * 16) for r in rows], CLASHING).repartition(3)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, "")
        got = out.collect()
        assert stage(spark, df.limit(0), "").count() == 0
        if name == "encode":
            assert out.columns == [*(f"{c}_before" if c in ("ids", "decoded") else c for c in df.columns), "ids", "decoded"] and len(got) == len(rows)
            continue
        assert out.columns == df.columns and all(r[c] == "x" for r in got for c in df.columns[5:])
        kept = sorted((r["doc_id"] or 0, len(r["text"] or "")) for r in got)
        if name == "language":
            assert (2, 0) not in kept and (3, 0) not in kept and (4, len(long)) in kept
        elif name == "near_duplicates":
            assert [i for i, _ in kept] == [0, 0, 1, 2, 4, 5, 6]
        elif name == "repeated_passages":
            assert len(got) == len(rows) and {r["text"] for r in got if r["doc_id"] == 1} == {""} and {r["text"] for r in got if r["doc_id"] == 4} == {long}
        elif name == "mix":
            assert {i for i, _ in kept} <= {0, 1, 4, 5, 6} and all(n for _, n in kept)


def test_expected_bits():
    assert abs(simhash.expected_bits(1.0, 64)) < 1e-6 and 9 < simhash.expected_bits(0.8, 64) < 10.5
    assert np.isclose(simhash.expected_bits(0.0, 64), 32)


@pytest.mark.parametrize("bucket", [16, 1024])
def test_near_duplicates_in_large_mixed_buckets(spark, bucket):
    """Groups of near copies, pairs on both sides of 0.8 and a passage that many texts share to different shares, with buckets that most
    of them are too many for: the components are those of all pairs."""
    r = random.Random(14)
    texts = []
    for g in range(2):
        ws = words(40 + g, 150)
        texts += [changed(ws, r.sample(range(150), r.randint(0, 4)), f"g{i}x") for i in range(50)]
    for n in (12, 30, 60, 200):  # a changed word takes up to five of n - 4 shingles out; from about n / 45 changes on pairs are apart
        ws = words(200 + n, n)
        for many in range(1, max(3, n // 20)):
            texts += [changed(ws, [11 * j % n for j in range(many)], f"p{many}x"), changed(ws, [(11 * j + 6) % n for j in range(many)], f"q{many}x")]
        texts.append(ws)
    passage = words(900, 120)
    for i in range(80):
        texts.append(words(1000 + i, r.choice([3, 8, 15, 20, 30, 60])) + passage + words(2000 + i, r.choice([0, 2, 8])))
    docs = [(i + 1, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = sorted((x["doc_id"], x["component_id"]) for x in simhash.similar_components(df, k=5, similarity=0.8, bucket=bucket).collect())
    want = sorted((i, c) for i, _, c in plain(docs, 80, 5))
    assert got == want and 20 < len({c for _, c in want}) < len(docs)


def test_own_keys_are_not_marked_by_joins(spark, monkeypatch):
    """Texts with a passage in common: what they share is told from rows of shared keys; a text's other keys stay a list, a row a text."""
    r = random.Random(3)
    passage = words(900, 40)
    df = spark.createDataFrame([(i, " ".join(words(1000 + i, r.choice([70, 80])) + passage)) for i in range(60)], "doc_id long, text string")
    held = {}

    def kept(rows, name, written=simhash.written):
        out = written(rows, name)
        if name == "further":
            held[name] = out.count(), out.select("rep").distinct().count()
        return out

    monkeypatch.setattr(simhash, "written", kept)
    got = {x["doc_id"]: x["component_id"] for x in simhash.similar_components(df, k=5, similarity=0.8, bucket=16).collect()}
    assert held["further"][0] == held["further"][1] > 16
    docs = [tuple(x) for x in df.collect()]
    assert got == {i: c for i, _, c in plain(docs, 80, 5)}
