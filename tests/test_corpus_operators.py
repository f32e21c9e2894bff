"""Operators against plain specifications and small fixtures."""

import json
import random
import re
import unicodedata
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import config, schemas
from lodestone.functions import text as T
from lodestone.functions import urls as U
from lodestone.operators import bias, chunking, crawl, html, neighbours, reports, sampling, segments, selection, validation
from lodestone.plans.corpus import chunk_report, prepared_chunks
from lodestone.session import temporary
from lodestone.sources import readers, writers
from lodestone.streaming import runs, sessions


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x")).alias("y")).first()["y"]


# Text --------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (None, ""),
        ("", ""),
        ("<p>A&nbsp;b</p> c &#39;d&#x27;", "A b c d&#x27;"),
        ("café ½ ﬁx “q”", "cafe 12 fix q"),
        ("Привет ß 日本", "Привет ß 日本"),
        ("a\tb   c , d !", "a b c, d!"),
        ("a\n \n\n b\n\nc", "a\n\n b\n\nc"),
        ("a|b^c~d`e\\f<g", "abcdefg"),
        ("x​y z", "xy z"),
        ("  \x1c trim \x1f ", "trim"),
    ],
)
def test_clean_text(spark, given, want):
    assert one(spark, T.clean_text, given) == want


def test_clean_text_switches(spark):
    assert one(spark, lambda c: T.clean_text(c, remove_html=False), "a  <b>") == "a b"
    assert one(spark, lambda c: T.clean_text(c, normalize_whitespace=False), "a  b") == "a  b"


def test_clean_text_against_a_specification(spark):
    def spec(t):
        t = re.sub("<[^>]+>", "", t)
        t = re.sub("&[a-zA-Z]+;|&#[0-9]+;", " ", t)
        t = "".join(c for c in unicodedata.normalize("NFKD", t) if c < "\x80" or c.isalpha())
        t = re.sub(" +([.,!?;:])", r"\1", re.sub(" +", " ", t.replace("\t", " ")))
        t = re.sub(r"\n\s*\n+", "\n\n", t)
        return "".join(c for c in t if c.isalnum() or c == "_" or c.isspace() or c in ".,!?;:-'\"()[]{}/@#$%&*+=").strip()

    r = random.Random(1)
    letters = "ab C9_é½ﬁ“—​ \t\n\r <b>&amp;&#12;.,!|~^Жß漢́\x1c\x85"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", T.clean_text(F.col("x")).alias("y")).collect()
    assert {g["i"]: g["y"] for g in got} == {i: spec(t) for i, t in enumerate(texts)}


def test_transcript_text(spark):
    assert one(spark, T.clean_transcript_text, "[00:12] Um, I like [Music] it (laughs) you know 2021\n\nhttp://x.io/a?b ok <i>") == ", I it 2O2l ok"
    assert one(spark, lambda c: T.clean_transcript_text(c, fix_ocr_digits=False), "call 101") == "call 101"
    assert one(spark, T.clean_transcript_text, "ﬁne\x07 umbrella") == "fine umbrella"


def test_meeting_text(spark):
    assert one(spark, T.clean_meeting_text, "Ann Lee: so we're going to ship [today] basically 10") == "ship [today] lO"
    assert one(spark, T.clean_meeting_text, "no mark\nBob: anyways hi") == "no mark Bob: hi"
    assert one(spark, T.clean_meeting_text, "(noise) let's see right?") == "?"


def test_fixing_and_sizes(spark):
    assert one(spark, T.fix_mojibake, "itâ€™s Ã©té\xa0x​") == "it\"™s été x" or one(spark, T.fix_mojibake, "itâ€™s") == "it's"
    assert one(spark, T.token_estimate, "x" * 11) == 2
    assert one(spark, T.word_count, " a\x1cb c ") == 3 and one(spark, T.word_count, None) == 0
    assert one(spark, T.is_valid_text, "one two three four five " + "x" * 30) is True
    assert one(spark, T.is_valid_text, "one two three four") is False and one(spark, T.is_valid_text, None) is False


# Urls --------------------------------------------------------------------------------------------


def test_file_names_of_long_titles(spark):
    """Signs that are dropped don't count: the name comes from the whole title, however far its letters lie."""
    assert one(spark, lambda c: U.numbered_file_name(F.lit(7), c), "#" * 5000 + "a b" + "!" * 5000 + "c" * 300) == "007_a b" + "c" * 97 + ".txt"


def test_urls(spark):
    assert one(spark, U.section, "https://h.io/a/b?c") == "a" and one(spark, U.section, "https://h.io/") == "" and one(spark, U.section, "https://h.io") == ""
    assert one(spark, U.file_id, "x") == "9dd4e461"
    assert one(spark, U.safe_file_name, " a/b: c_d-é!" + "x" * 200).startswith("ab c_d-é")
    assert spark.range(1).select(U.numbered_file_name(F.lit(1234), F.lit("t"))).first()[0] == "1234_t.txt"
    for url, want in [("https://www.youtube.com/watch?v=abc", "abc"), ("https://youtube.com/watch?v=&v=q", "q"), ("https://youtu.be/x/", "x/"), ("abcdefghij_", "abcdefghij_"), ("bad url", None), (None, None)]:
        assert one(spark, U.video_id, url) == want
    from urllib.parse import urljoin

    base = "https://h.io/a/b/c.html?q"
    for href in ["/x", "x", "../x", "//o.io/y", "https://z.io/p", "https://z.io/a/../b", "#f", "?q=1", "", "/a/../b", "mailto:x@y"]:
        assert one(spark, lambda c: U.absolute_url(F.lit(base), c), href) == urljoin(base, href), href
    assert one(spark, lambda c: U.is_followed(c, "h.io"), "https://h.io/a") is True
    assert one(spark, lambda c: U.is_followed(c, "h.io"), "https://h.io/a.PDF") is False


# Chunks ------------------------------------------------------------------------------------------


def spec_recursive(text, seps, limit=800, least=100):
    chunks, cur = [], ""
    for i, part in enumerate(parts := text.split(seps[0]) if seps else text.split()):
        if seps:
            part += seps[0] if i < len(parts) - 1 else ""
            grown = cur + part
        else:
            grown = f"{cur} {part}" if cur else part
        if len(grown) // 4 <= limit:
            cur = grown
            continue
        if cur:
            chunks.append(cur.strip())
        if seps and len(part) // 4 > limit:
            chunks += spec_recursive(part, seps[1:], limit, least)
            cur = ""
        else:
            cur = part
    if cur and (not seps or len(cur) // 4 >= least):
        chunks.append(cur.strip())
    return chunks


def test_recursive_chunks():
    r = random.Random(2)
    for _ in range(300):
        words = ["x" * r.choice([1, 3, 9, 40, 700]) for _ in range(r.randint(0, 60))]
        text = "".join(w + r.choice([" ", ". ", "\n", "\n\n", "  "]) for w in words)
        assert chunking.recursive_chunks(text, 50, 10) == spec_recursive(text, list(chunking.SEPARATORS), 50, 10)
    assert chunking.recursive_chunks("x" * 4000) == ["x" * 4000]
    assert chunking.recursive_chunks("short") == []


def test_fixed_chunks():
    assert chunking.fixed_chunks("aaaa bbbb cccc", 2) == ["aaaa bbbb", "cccc"]
    assert chunking.fixed_chunks("a b c", 0) == ["a b c"] and chunking.fixed_chunks("", 5) == []


def test_overlap():
    chunks = [" ".join(f"{c}{i}" for i in range(n)) for c, n in (("a", 20), ("b", 5), ("c", 20))]
    w = [c.split() for c in chunks]
    got = chunking.overlapped(chunks)
    assert got[0] == chunks[0] + " " + " ".join(w[1][:15])
    assert got[1] == " ".join(w[0][-8:]) + " " + chunks[1] + " " + " ".join(w[2][:7])
    assert got[2] == " ".join(w[1][-15:]) + " " + chunks[2]
    assert chunking.overlapped(["only"]) == ["only"] and chunking.overlapped(chunks, 0) == chunks


def test_chunk_plans(spark):
    """One pass over each text: cleaning once, chunking once, no window and no join back; repeated and null keys keep their own chunks."""
    df = spark.createDataFrame([(1, "word " * 2000, "en"), (1, "other " * 2000, "de"), (None, "third " * 2000, None)], "doc_id int, text string, lang string")
    out = prepared_chunks(df, keep=("lang",))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("MapInArrow") == 1 and "Window" not in plan and "Join" not in plan
    first = {r["content"].split()[0] for r in out.collect() if r["chunk_index"] == 0}
    assert first == {"word", "other", "third"}
    assert {r["lang"]: r["chunks"] > 1 for r in chunk_report(df).collect()} == {"en": True, "de": True, None: True}


def test_chunks_of_long_texts_are_passed_on_in_pieces():
    """A batch of 40 long texts, some without chunks: what was one batch of chunks comes in several, with the same rows."""
    texts = [None if i % 7 == 3 else "" if i % 7 == 5 else f"w{i} " * 20000 for i in range(40)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(40)), "text": texts})
    cut = lambda t: chunking.recursive_chunks(t) if t else []
    got = list(chunking.chunk_batches(batch, ["doc_id"], cut, 150))
    assert len(got) > 1 and max(g.nbytes for g in got) < 3 << 20
    rows = [r for g in got for r in zip(*g.to_pydict().values(), strict=True)]
    assert rows == [(i, p, len(c), x) for i, t in enumerate(texts) for c in [chunking.overlapped(cut(t), 150)] for p, x in enumerate(c)]
    assert list(chunking.chunk_batches(batch.slice(3, 1), ["doc_id"], cut)) == []


def test_chunk_records(spark):
    text = "word " * 2000
    df = spark.createDataFrame([(1, text, None), (2, "", "u"), (3, None, "v")], "doc_id int, text string, url string")
    rows = chunking.chunk_records(df, "doc_id", "text", "url")
    got = rows.orderBy("chunk_index").collect()
    assert [r["chunk_id"] for r in got] == [f"unknown_{i}" for i in range(len(got))] and {r["total_chunks"] for r in got} == {len(got)}
    assert all(r["estimated_tokens"] == len(r["content"]) // 4 for r in got)
    stats = {r["doc_id"]: r["n_chunks"] for r in chunking.chunk_statistics(df, rows, "doc_id").collect()}
    assert stats == {1: len(got), 2: 0, 3: 0}
    assert prepared_chunks(df).count() >= 1


# Segments ----------------------------------------------------------------------------------------

SEGMENTS = "video_id string, id int, start double, end double, text string, speaker string"


def spec_merge(rows, together):
    out = []
    for r in rows:
        if out and together(r, out[-1]):
            out[-1] = {**out[-1], "end": r["end"], "text": out[-1]["text"] + " " + r["text"]}
        else:
            out.append(dict(r))
    return out


def test_merging(spark):
    r = random.Random(3)
    rows = []
    for v in range(20):
        t = 0.0
        for i in range(r.randint(1, 12)):
            t += r.choice([0, 0, 1.5, 3.0, -1.0])
            rows.append({"video_id": str(v), "id": i, "start": t, "end": (t := t + r.choice([0.0, 2.0, 5.0])), "text": f"w{i}", "speaker": "s"})
    df = spark.createDataFrame([tuple(x.values()) for x in rows], SEGMENTS)
    for merged, rule in ((segments.merge_contiguous(df), lambda a, b: a["start"] == b["end"]), (segments.merge_near(df), lambda a, b: a["start"] - b["end"] <= 2.0)):
        want = [x for v in range(20) for x in spec_merge([x for x in rows if x["video_id"] == str(v)], rule)]
        got = sorted((x.asDict() for x in merged.collect()), key=lambda x: (int(x["video_id"]), x["id"]))
        assert got == want


def test_transcripts(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 5.0, "um hello there", "A"), ("v", 1, 5.0, 10.0, "you know friends", "B"), ("w", 0, 0.0, 1.0, " ", "A")], SEGMENTS)
    got = {r["video_id"]: r for r in segments.transcript_totals(df).collect()}
    assert (got["v"]["segment_count"], got["v"]["word_count"], got["v"]["full_text"]) == (1, 3, "hello there friends")
    stats = {r["video_id"]: r for r in segments.segment_statistics(df).collect()}
    assert tuple(stats["v"])[1:] == (2, 6, 5.0, 0) and stats["w"]["missing_values"] == 1
    records = spark.createDataFrame([("a", []), ("b", [(0, 0.0, 5.0, "hi um", "x")])], "video_id string, segments array<struct<id:int,start:double,end:double,text:string,speaker:string>>")
    done = {r["video_id"]: (r["segment_count"], r["word_count"], r["full_text"]) for r in segments.process_transcripts(records).collect()}
    assert done == {"a": (0, 0, ""), "b": (1, 1, "hi")}
    none = records.withColumn("segments", F.when(F.col("video_id") == "b", F.col("segments")))
    done = {r["video_id"]: (r["segment_count"], r["word_count"], r["full_text"]) for r in segments.process_transcripts(none).collect()}
    assert done == {"a": (None, None, None), "b": (1, 1, "hi")}  # a record without segments stops no other
    assert segments.meeting_totals(df).count() == 2


# Validation --------------------------------------------------------------------------------------


def test_validation(spark):
    good = {"title": "t", "video_id": "v", "segments": [{"id": 0, "start": 0, "end": 5, "text": "a"}]}
    bad = {"title": None, "segments": [{"id": 0, "start": 5.0, "end": 0.0, "text": "a"}, {"start": 1, "end": 1}]}
    df = spark.createDataFrame([(json.dumps(good),), (json.dumps(bad),), ("{}",)], "x string")
    got = [r["e"] for r in df.select(validation.validation_errors(F.col("x")).alias("e")).collect()]
    assert got[0] == []
    assert got[1] == ["Missing required field: video_id", "Segment 0 has invalid time range", "Segment 1 missing field: id", "Segment 1 missing field: text", "Segment 1 has invalid time range"]
    assert got[2] == [f"Missing required field: {k}" for k in schemas.REQUIRED]
    odd = spark.createDataFrame([("[1]",), ("not json",), (None,), ('{"title": 1, "video_id": null, "segments": {"a": 1}}',), ('{"title": 1, "video_id": 2, "segments": [7, {"id": 1, "start": "2", "end": 1.5, "text": null}]}',)], "x string")
    got = [r["e"] for r in odd.select(validation.validation_errors(F.col("x")).alias("e")).collect()]
    assert got[:3] == [[f"Missing required field: {k}" for k in schemas.REQUIRED]] * 3 and got[3] == []
    assert got[4] == [f"Segment 0 missing field: {k}" for k in schemas.REQUIRED_IN_SEGMENT] + ["Segment 1 has invalid time range"]


def test_schema_of_records(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": "x"}'), (2, '{"a": 2.5, "c": {"d": [1]}}'), (3, '{"a": null}'), (4, "broken"), (5, None), (6, '{"a": 3, "b": "y"}')], "i int, r string")
    told = validation.inferred_schema(rows, "r").first()
    assert (told["records"], told["broken"]) == (5, 1) and told["schema"].startswith("OBJECT<a: DECIMAL") and "c: OBJECT<d: ARRAY<BIGINT>>" in told["schema"]
    got = {(r["field"], r["found"]): (r["stored"], r["records"], r["status"]) for r in validation.schema_drift(rows, "r", "a bigint, b string, z int").collect()}
    assert got == {
        ("a", "BIGINT"): ("BIGINT", 2, "partial"), ("a", "DECIMAL(2,1)"): ("BIGINT", 1, "retyped"), ("a", "VOID"): ("BIGINT", 1, "retyped"),
        ("b", "STRING"): ("STRING", 2, "partial"), ("c", "OBJECT<d: ARRAY<BIGINT>>"): (None, 1, "new"), ("z", None): ("INT", 0, "missing"),
    }
    assert {r["status"] for r in validation.schema_drift(rows.where("i = 1"), "r", "a bigint, b string").collect()} == {"same"}
    assert [r["status"] for r in validation.schema_drift(rows.limit(0), "r", "a bigint").collect()] == ["missing"]


def test_anomalies(spark):
    df = spark.createDataFrame([(1, 10, 100, 5.0, 0), (2, 14, 50, 6.5, 9), (3, 5, 50, 6.5, 20)], "run int, total_segments int, total_words int, avg_segment_duration double, missing_values int")
    got = {(r["run"], r["metric"]): round(r["change"], 3) for r in validation.run_anomalies(df, "run").collect()}
    assert got == {(2, "total_words"): 0.5, (3, "total_segments"): 0.643}
    text = validation.run_anomalies(df, "run").select(validation.anomaly_message(F.col("metric"), F.col("change")).alias("message"))
    assert validation.alert_message(text).first()["message"].startswith("Data Pipeline Anomalies Detected:\n\n- Anomaly detected in total_segments: Changed by 64.3%")
    assert validation.alert_message(text.limit(0)).count() == 0
    with pytest.raises(Exception, match="more invalid"):
        validation.validity_gate(spark.createDataFrame([(False,)], "is_valid boolean")).collect()
    assert validation.empty_chunks(spark.createDataFrame([("f", 1, " \n"), ("f", 2, "x"), ("f", 3, None)], "n string, i int, c string"), "n", "i", "c").count() == 2


# Bias, sampling ----------------------------------------------------------------------------------


def test_terms_and_speakers(spark):
    df = spark.createDataFrame([(1, "He said she saw a Man and the woman, guys; girls he_x"), (2, None)], "k int, t string")
    got = {(r["k"], r["term"]): r["n"] for r in bias.term_frequency(df, F.col("t"), ["k"]).collect()}
    assert len(got) == 2 * len(bias.TERMS) and sum(got.values()) == 6 and got[1, "he"] == 1
    multi = {r["term"]: r["n"] for r in bias.term_frequency(df, F.lit("old man, an old man; older man"), ["k"], ("old man", "old")).where("k = 1").collect()}
    assert multi == {"old man": 2, "old": 2}
    seg = spark.createDataFrame([("v", "Alice"), ("v", "Bob"), ("v", "Alice")], "video_id string, speaker string")
    assert {r["speaker"]: r["n"] for r in bias.speaker_balance(seg, "video_id").collect()} == {"Alice": 2, "Bob": 1}


def test_fairness(spark):
    df = spark.createDataFrame([("m", 1, 1, 1), ("m", 0, 1, 2), ("f", 1, 1, 3), (None, 0, 0, 4)], "g string, t int, p int, a int")
    d = {(r["feature"], r["value"]): (r["n"], r["percent"]) for r in bias.distribution(df, ["g", "a"]).collect()}
    assert d["g", "m"] == (2, 50.0) and d["g", "f"] == (1, 25.0) and len(d) == 6
    i = {r["feature"]: (r["total"], r["distinct_values"], r["ratio"]) for r in bias.imbalance(df, ["g", "a"]).collect()}
    assert i == {"g": (4, 2, 2.0), "a": (4, 4, 1.0)}
    m = {(r["feature"], r["value"]): (r["n"], r["accuracy"], r["selection_rate"]) for r in bias.fairness_metrics(df, "t", "p", ["g"]).collect()}
    assert m["g", "m"] == (2, 0.5, 1.0) and m["overall", None] == (4, 0.75, 0.75)
    rep = {r["value"]: r for r in bias.fairness_report(df, df.where("a != 2"), ["g"]).collect()}
    assert rep["m"]["n_before"] == 2 and rep["m"]["n_after"] == 1 and rep["m"]["improvement"] == 1.0
    assert bias.imbalance(spark.createDataFrame([(None,)], "g string"), ["g"]).first()["ratio"] == float("inf")


def test_sampling(spark):
    df = spark.createDataFrame([(i, "a" if i < 70 else "b" if i < 90 else "c" if i < 99 else None) for i in range(100)], "id long, g string")
    count = lambda d: {r["g"]: r["count"] for r in d.groupBy("g").count().collect()}
    assert count(sampling.oversample(df, "g", "id")) == {"a": 70, "b": 70, "c": 70}
    assert count(sampling.oversample(df, "g", "id", "equal")) == {"a": 70, "b": 33, "c": 33}
    assert count(sampling.oversample(df, "g", "id", 25)) == {"a": 70, "b": 25, "c": 25}
    assert count(sampling.oversample(df, "g", "id", "unknown")) == {"a": 70, "b": 70, "c": 70}
    assert count(sampling.oversample_groups(df, ["g"], "id")) == {"a": 70, "b": 70, "c": 70, None: 70}
    assert sampling.oversample_groups(df, [], "id").count() == 100
    assert count(sampling.stratified_sample(df, 29, ["g"], "id")) == {"a": 20, "b": 5, "c": 2, None: 1}
    assert sampling.stratified_sample(df, 500, [], "id").count() == 100
    a = sorted(r["id"] for r in sampling.stratified_sample(df, 20, ["g"], "id").collect())
    assert a == sorted(r["id"] for r in sampling.stratified_sample(df.repartition(7), 20, ["g"], "id").collect())


def test_smote(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0], 0 if i < 30 else 1, "b" if i % 2 else "a", i % 3 == 0, 2.0 * i, None) for i in range(40)], "id long, x array<double>, y int, g string, f boolean, v double, n string")
    out = sampling.smote(df, "y", "x", "id", cell=4)
    assert {r["y"]: r["count"] for r in out.groupBy("y").count().collect()} == {0: 30, 1: 30}
    assert all(30 <= r["x"][0] <= 39 and r["x"][1] == 1.0 for r in out.where("id is null").collect())
    assert out.columns == df.columns and {(r["g"], r["f"], r["v"], r["n"]) for r in out.collect()} == {("a", False, 39.0, None)}
    odd = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "a"), (3, [3.0], "b"), (4, None, "b"), (5, [None], "b"), (6, [float("nan")], "b"), (7, [1.0], None), (None, [1.0], "b")], "id long, x array<double>, y string")
    assert sorted((r["y"], r["x"]) for r in sampling.smote(odd, "y", "x", "id").collect()) == [("a", [1.0]), ("a", [2.0]), ("b", [3.0]), ("b", [3.0])]
    assert sampling.smote(odd.limit(0), "y", "x", "id").collect() == []


@pytest.mark.parametrize("structure", [True, False])
def test_neighbours_in_classes(spark, monkeypatch, structure):
    """All pairs give the same neighbours, ties included; with structure, few rows are compared."""
    monkeypatch.setattr(neighbours, "PIECE", 150)
    monkeypatch.setattr(neighbours, "PAST", 100)
    r = np.random.default_rng(3)
    centres = r.normal(size=(30, 8)) * (20 if structure else 0)
    rows = [(i, [float(round(v, 2)) for v in centres[r.integers(0, 30)] + r.normal(size=8)], "abc"[i % 7 % 3]) for i in range(2400)]
    rows += [(3000 + i, rows[0][1], "a") for i in range(20)]  # copies: ties
    points = spark.createDataFrame(rows, "id long, x array<double>, c string").repartition(4)
    with temporary(spark):
        best, waves = neighbours.nearest_in_class(points, points.where("id % 4 = 0").select("id"), 5, cell=60)
        got = sorted((x["s"], x["d"], x["id"]) for x in best.collect())
        compared = sum(w.agg(F.sum("compared")).first()[0] for w in waves)
    want, pairs = [], 0
    for c in "abc":
        ids = np.array([i for i, _, y in rows if y == c])
        x = np.array([v for _, v, y in rows if y == c])
        for j in np.flatnonzero(ids % 4 == 0):
            d = neighbours.distances(x, x[j])
            o = [i for i in np.lexsort((ids, d)) if i != j][:5]
            want += [(int(ids[j]), float(d[i]), int(ids[i])) for i in o]
            pairs += len(ids)
    assert got == sorted(want)
    assert len(waves) > 1 and compared < pairs * (0.25 if structure else 1.01)


def test_no_class_is_sorted(spark):
    """The first rows of large classes by hash, cut inside a part of the hash, as ranking them all would give."""
    df = spark.range(40_000).select("id", F.when(F.col("id") % 3 == 0, "a").when(F.col("id") < 100, None).otherwise("b").alias("g"))
    got = {(r["g"], r["id"]) for r in sampling.stratified_sample(df, 9000, ["g"], "id").collect()}
    rows = df.withColumn("h", sampling.rank_hash(F.col("id"))).collect()
    want = set()
    for g in ("a", "b", None):
        own = sorted((r["h"], r["id"]) for r in rows if r["g"] == g)
        want |= {(g, i) for _, i in own[: max(1, int(9000 * (len(own) / 40_000)))]}
    assert got == want


def test_percentages(spark):
    """Exact halves go to the even digit, and what only looks like one to its nearer side."""
    shares = [0.8125, 0.0025, 0.8175, 0.00015, 0.0035, 1.0, 12.34567, 0.6425]
    df = spark.createDataFrame([(x,) for x in shares], "c double")
    assert [r["m"] for r in df.select(validation.percent(F.col("c")).alias("m")).collect()] == [f"{x * 100:.1f}%" for x in shares]


def test_anomalies_over_ranges(spark):
    """The same anomalies whether runs lie in one range or in many."""
    r = np.random.default_rng(1)
    runs = [(int(i), int(r.integers(0, 4)), 100, 1.0, 0) for i in r.permutation(400)]
    df = spark.createDataFrame(runs, "run int, total_segments int, total_words int, avg_segment_duration double, missing_values int").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {(x["run"], x["metric"], x["change"]) for x in validation.run_anomalies(df, "run").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    n = [x[1] for x in sorted(runs)]
    assert got == {(i, "total_segments", abs(n[i] - n[i - 1]) / n[i - 1]) for i in range(1, 400) if n[i - 1] and abs(n[i] - n[i - 1]) / n[i - 1] > 0.4}


# Selection, pages --------------------------------------------------------------------------------


def test_posts(spark):
    feed = spark.createDataFrame(
        [("Remote Work", "l1", None, None, None, None, [("X",)]), ("t", "l2", "s", None, None, None, [("DevOps",)]), ("u", "", "team", None, None, None, None), (None, "l4", "z" * 900, None, None, None, None)],
        schemas.FEED_ENTRY,
    )
    body = spark.createDataFrame([("l1", "c" * 100), ("l2", "c" * 99), ("l4", "w " * 80)], "link string, content string")
    got = {r["metadata"]["url"]: r for r in selection.posts(feed, body).collect()}
    assert set(got) == {"l1", "l4"} and got["l1"]["processing"]["is_relevant"] and not got["l4"]["processing"]["is_relevant"]
    assert got["l4"]["metadata"]["title"] == "Untitled" and len(got["l4"]["metadata"]["summary"]) == 500 and got["l4"]["processing"]["word_count"] == 80
    ranked = spark.createDataFrame([(0, False), (1, True), (2, False), (3, True)], "pos int, r boolean")
    assert sorted(r["pos"] for r in selection.select_posts(ranked, 3, "pos", "r").collect()) == [0, 1, 3]
    listing = spark.createDataFrame([("a", "x"), (None, "y"), ("c", "[Private video]"), ("d", None)], "video_id string, title string")
    done = spark.createDataFrame([("a",)], "video_id string")
    assert [(r["video_id"], r["title"]) for r in selection.pending_videos(listing, done).collect()] == [("d", "Unknown Title")]
    assert {r["status"]: r["n"] for r in selection.video_status(listing, done, done.limit(0)).collect()} == {"skipped": 2, "successful": 1, "pending": 1}


def test_html(spark):
    page = "<html><head><title> T &amp; </title></head><body><nav><a href='/n'>n</a></nav><div class='x content'>C</div><main><p>A<b>b</b> c</p><script>s()</script><br>d\n e</main></body></html>"
    assert html.parsed_content(page) == "A\nb\nc\nd\ne"
    assert html.parsed_content(page, html.POST_SELECTORS) == "C"
    assert html.parsed_content("<p>loose</p>") is None and html.parsed_content("<body>x<footer>f</footer></body>") == "x"
    assert html.parsed_content('<body><div role="main">r</div>o</body>', html.POST_SELECTORS) == "r"
    assert one(spark, html.content, None) == "" and one(spark, html.post_content, "<p>x") is None
    assert one(spark, html.title, "<h1>H <i>1</i></h1>") == "H 1" and one(spark, html.title, "<title></title><h1>h</h1>") == "" and one(spark, html.title, "x") == "Untitled"
    df = spark.createDataFrame([(1, "https://h.io/a/", '<nav><a href="/n">n</a></nav><a class="k" href="b">b</a><a href="/n">n</a><a href="#x">x</a><a href="https://o.io/">o</a>')], "page_id int, url string, html string")
    assert {r["link"] for r in html.links(df, "h.io").collect()} == {"https://h.io/n", "https://h.io/a/b"}


def test_references_without_a_semicolon_are_text(spark):
    page = "<article><h1>a&amp;&amp</h1>b &lt;&ltx; &copy c &#39;&#39 &x; &AMP;&#x41; d&</article>"
    assert html.parsed_content(page) == "a&&amp\nb <&ltx; &copy c '&#39 &x; &A d&"
    assert html.parsed_content(page, bare=True) == "a&&\nb <<x; © c '' &x; &A d&"
    shown = "<article><h1>a&amp;&amp</h1>b &lt;&#39;</article>"
    got = spark.createDataFrame([(shown,)], "html string").select(html.content(F.col("html")), html.post_content(F.col("html")), html.article_content(F.col("html"))).first()
    assert set(got) == {"a&&amp\nb <'"}


def test_post_content_of_cut_references(spark, tmp_path):
    """Titles cut inside `&amp;` and `&quot;`: each page as it is and behind a <main>, as the SQL has them."""
    import duckdb

    from lodestone.plans.registry import QUERIES, SQL

    rows = [(i, f"<html><body><article><h1>a &amp;&amp;{cut}</h1><p>b &quot;c&quot;{cut}</p></article></body></html>") for i, cut in enumerate(("", "&", "&a", "&amp", "&quo", "&quot", "&lt", "&#39"))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert {tuple(r) for r in QUERIES["post_content"](spark, str(tmp_path)).collect()} == set(con.execute(SQL["post_content"]).fetchall())


def test_post_content_of_odd_articles(spark, tmp_path):
    """Signs that the parser gives in parts, and blanks beyond ASCII: as the SQL has them, in the query and in the JVM's form."""
    import duckdb

    from lodestone.plans.registry import QUERIES, SQL

    odd = ("a < b", "<p>x</p>&<3", "<p>&nbsp;</p><p>b&nbsp;</p>", "\xa0a\u3000<br>\u2028", "x<!-- c -->y</i> z\x85", "\t a\r\n\x1cb \v\f", "<nav>n</nav><b>c</b>d &lt; e")
    rows = [(i, f"<!DOCTYPE html><html><body><article>{x}</article><p>y</p></body></html>") for i, x in enumerate(odd)]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    for name in ("post_content", "page_content", "article_content"):
        assert {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).collect()} == set(con.execute(SQL[name]).fetchall()), name
    assert html.parsed_content("<body>a < b\xa0<br>c &amp", bare=True) == "a < b\nc &"


def test_crawl(spark):
    e = spark.createDataFrame([(1, "a", 2, "a"), (2, "a", 3, "a"), (3, "a", 1, "a"), (1, "a", 9, "b"), (3, "a", 4, "a")], "src long, src_section string, dst long, dst_section string")
    assert {(r["page"], r["depth"]) for r in crawl.crawl(e, 1).collect()} == {(1, 0), (2, 1), (3, 2), (4, 3)}
    assert {r["page"] for r in crawl.crawl(e, 1, 1, same_section=False).collect()} == {1, 2, 9}
    assert [r["page"] for r in crawl.crawl(e, 1, pages=2).collect()] == [1, 2]


def test_crawl_without_depth(spark):
    """Until nothing new is found, also on a long path that ends in a loop."""
    e = spark.createDataFrame([(i, i + 1, "a", "a") for i in range(1, 10)] + [(10, 1, "a", "a")], "src long, dst long, src_section string, dst_section string")
    assert {(r["page"], r["depth"]) for r in crawl.crawl(e, 1, depth=None).collect()} == {(i, i - 1) for i in range(1, 11)}


# Reports, sources, streams -----------------------------------------------------------------------


def test_reports(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "short"), (3, None)], "doc_id int, text string")
    cleaned = reports.cleaned_documents(docs, "doc_id", "text")
    assert tuple(reports.cleaning_summary(cleaned).first()) == (3, 1, 2, 11.0)
    assert tuple(reports.cleaning_summary(cleaned.limit(0)).first()) == (0, 0, 0, 0.0)
    counts = reports.stage_counts({"a": docs, "b": docs.limit(0)})
    assert tuple(reports.stage_validity(counts).first()) == (False, 3)
    assert tuple(reports.fetch_summary(docs, F.col("text").isNotNull(), F.col("doc_id") == 1).first()) == (3, 2, 1, 1)
    assert reports.anomaly_report(docs.select(F.lit("m").alias("message"))).first()["anomaly_count"] == 3


def test_all_anomalies_are_listed(spark):
    """No cap on the list; the message of an alert is bounded, and says how many it leaves out."""
    rows = spark.range(2500).select(F.format_string("m%06d", F.col("id") % 2400).alias("message")).repartition(6)
    want = sorted(f"m{i % 2400:06d}" for i in range(2500))
    got = sorted((r["number"], r["message"], r["total"]) for r in reports.anomaly_list(rows).collect())
    assert got == [(i + 1, m, 2500) for i, m in enumerate(want)]
    assert reports.anomaly_report(rows, most=None).first()["anomalies"] == want
    assert validation.alert_message(rows).first()["message"].endswith("\n... and 1500 more")
    assert validation.alert_message(rows, most=None).first()["message"].count("\n- ") == 2500
    assert reports.anomaly_list(rows.limit(0)).collect() == []


def test_sources(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "handbook_1.json").write_text(json.dumps({"content": "c", "metadata": {"url": "u", "section": "s", "content_length": 1}, "html": "<p>"}))
    (d / "handbook_2.json").write_text("{broken")
    (d / "chunks_1.json").write_text(json.dumps([{"chunk_id": "a_0", "content": "x"}, {"chunk_id": "a_1", "content": " "}]))
    (d / "cleaned_t.json").write_text(json.dumps({"full_text": "spoken"}))
    (d / "t.txt").write_text("Video: T: x\nVideo ID: i\nURL: http://u\n" + "=" * 80 + "\n\nBody\nline\n")
    (d / "feed.xml").write_text("<feed><entry><title>A</title><link>l</link></entry><entry><title>B</title></entry></feed>")
    pages = readers.read_pages(spark, str(d)).cache()
    assert pages.count() == 2 and pages.where("_corrupt_record is not null").count() == 1
    assert readers.read_chunks(spark, str(d)).count() == 2
    assert readers.read_cleaned(spark, str(d)).first()["content"] == "spoken"
    t = readers.read_transcript_texts(spark, str(d))
    assert tuple(t.first()) == ("T: x", "i", "http://u", "Body\nline\n")
    assert t.select(writers.transcript_text().alias("x")).first()["x"] == (d / "t.txt").read_text()
    assert [r["title"] for r in readers.read_feed(spark, f"{d}/feed.xml").collect()] == ["A", "B"]
    out = str(tmp_path / "out")
    writers.write_records(pages.select("content", "metadata.section"), out, partition_by=("section",))
    assert spark.read.json(out).count() == 2
    for run in ("r1", "r2"):
        writers.write_history(spark.range(1), f"{tmp_path}/h", run)
        writers.snapshot(spark.range(2), f"{tmp_path}/v", run)
    assert spark.read.json(f"{tmp_path}/h").count() == 2 and spark.read.parquet(f"{tmp_path}/v").select("run_id").distinct().count() == 2
    s = schemas.parsed(schemas.TRANSCRIPT)
    assert schemas.loaded(schemas.saved(s)) == s


def test_settings(monkeypatch):
    monkeypatch.setenv("ROOT_DIR", "/r")
    tree = config.substituted({"a": {"b": "${ROOT_DIR}/x", "l": ["${ROOT_DIR}"]}, "n": 3})
    assert tree == {"a": {"b": "/r/x", "l": ["${ROOT_DIR}"]}, "n": 3}
    assert config.lookup(tree, "a.b") == "/r/x" and config.lookup(tree, "a.z.q", 7) == 7


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"2024-01-01 0{i % 6}:{i % 50:02d}:00", i % 3, "click", 1.0) for i in range(60)]
    df = spark.createDataFrame(rows, "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(f"{tmp_path}/e")
    late = spark.createDataFrame([(99, "2025-01-01 00:00:00", 9, "click", 1.0)], "event_id int, ts string, user_id int, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    late.write.mode("append").parquet(f"{tmp_path}/e")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/e")
    q = sessions.sessions(stream).writeStream.format("memory").queryName("sess").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    key = lambda d: sorted((r["user_id"], r["session_start"], r["n"]) for r in d.collect())
    assert key(spark.table("sess")) == key(sessions.sessions(df))
    assert sessions.windowed_counts(df).agg(F.sum("n")).first()[0] == 60


def test_run_checks_of_a_stream_equal_batch(spark, tmp_path):
    """Runs that come out of order within the watermark are compared in order, across micro-batches and a restart; later ones are left out."""
    metrics = ("total_segments", "total_words", "avg_segment_duration", "missing_values")
    schema = "series string, run int, ts timestamp, total_segments int, total_words int, avg_segment_duration double, missing_values int"
    r = random.Random(8)
    rows = [(s, i, datetime(2024, 1, 1) + timedelta(hours=2 * i), r.choice([0, 10, 12, 30]), r.choice([50, 60, 100]), r.choice([5.0, 6.0, 9.0]), r.choice([0, 1, 9, None])) for s in ("a", "b") for i in range(30)]
    late = [("a", 99, datetime(2024, 1, 1, 1), 1, 1, 1.0, 1)]
    end = [("z", 0, datetime(2025, 1, 1), 1, 1, 1.0, 1)]
    parts = [[x for x in rows if x[1] < 12], [x for x in rows if 12 <= x[1] < 22], late, [x for x in rows if x[1] >= 22], end, [("z", 1, datetime(2025, 1, 2), 1, 1, 1.0, 1)]]
    parts[0][3], parts[0][7] = parts[0][7], parts[0][3]
    parts[1].append(parts[0].pop(11))  # one run of the first part comes with the second
    for n, part in enumerate(parts):
        r.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        q = runs.run_checks(stream, "series", "ts", late="3 hours").writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
    got = sorted((x["series"], x["ts"], x["metric"], x["change"]) for x in spark.read.parquet(f"{tmp_path}/out").collect())
    want = []
    for s in ("a", "b"):
        one = spark.createDataFrame([x for x in rows if x[0] == s], schema)
        want += [(s, x["ts"], x["metric"], x["change"]) for x in validation.run_anomalies(one, "ts").collect()]
    assert got == sorted(want) and len(got) > 20 and {x[2] for x in got} == set(metrics)
