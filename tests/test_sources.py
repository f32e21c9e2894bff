"""Files as records, manifests and copies, histories, and the fetching data source over a local server."""

import hashlib
import json
import threading
import time
import tracemalloc
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from lodestone.sources import fetching, files, readers, writers


def names(folder):
    return {p.name for p in folder.iterdir() if p.name[0] not in "._"}


def test_record_files(spark, tmp_path):
    rows = [(f"{i:03d}.txt", f"text {i}\n" * i) for i in range(200)] + [("none", None)]
    files.write_files(spark.createDataFrame(rows, "name string, value string").repartition(7), f"{tmp_path}/out")
    assert {n: (tmp_path / "out" / n).read_text() for n in names(tmp_path / "out")} == {n: v or "" for n, v in rows}
    assert (tmp_path / "out" / "_SUCCESS").read_text() == "201"
    files.write_files(spark.createDataFrame([("000.txt", bytearray(b"\xff\x00"))], "name string, value binary"), f"{tmp_path}/out")
    assert (tmp_path / "out" / "000.txt").read_bytes() == b"\xff\x00" and len(names(tmp_path / "out")) == 201
    files.write_files(spark.createDataFrame([("new", "x")], "name string, value string"), f"{tmp_path}/out", "overwrite")
    assert names(tmp_path / "out") == {"new"}
    files.write_files(spark.createDataFrame([], "name string, value string"), f"{tmp_path}/empty")
    assert names(tmp_path / "empty") == set()


def test_no_half_written_file_after_a_failure(spark, tmp_path):
    """The task that fails leaves nothing of its own, neither in place nor beside it."""
    good = spark.createDataFrame([(f"a{i}", "x" * 100_000) for i in range(20)], "name string, value string").coalesce(1)
    bad = good.unionByName(spark.createDataFrame([("../b", "y")], "name string, value string")).coalesce(1)
    with pytest.raises(Exception, match="not the name of a file"):
        files.write_files(bad, f"{tmp_path}/out")
    assert [p for p in (tmp_path / "out").rglob("*") if p.is_file()] == []
    files.write_files(good, f"{tmp_path}/out")
    assert len(names(tmp_path / "out")) == 20


def test_manifests(spark, tmp_path):
    for name, text in (("a/1.txt", "one"), ("a/b/2.txt", "two"), ("3.bin", ""), ("a/_hidden", "no"), (".x", "no")):
        (tmp_path / "v" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "v" / name).write_text(text)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = files.manifest(spark, f"{tmp_path}/v")
    assert {(r["file"], r["size"], r["digest"]) for r in got.collect()} == {("a/1.txt", 3, sha("one")), ("a/b/2.txt", 3, sha("two")), ("3.bin", 0, sha(""))}
    told = files.copy_folder(spark, f"{tmp_path}/v", f"{tmp_path}/w").collect()
    assert all(r["copied"] and r["verified"] for r in told)
    assert files.folder_pointer(got).first() == files.folder_pointer(files.manifest(spark, f"{tmp_path}/w").repartition(5)).first()
    (tmp_path / "w" / "a" / "1.txt").write_text("uno")
    (tmp_path / "w" / "3.bin").unlink()
    (tmp_path / "w" / "4.bin").write_text("four")
    changes = files.manifest_diff(got, files.manifest(spark, f"{tmp_path}/w")).collect()
    assert {(r["file"], r["change"], r["old_digest"], r["new_digest"]) for r in changes} == {("a/1.txt", "changed", sha("one"), sha("uno")), ("3.bin", "removed", sha(""), None), ("4.bin", "added", None, sha("four"))}
    again = {r["file"]: r["copied"] for r in files.copy_folder(spark, f"{tmp_path}/v", f"{tmp_path}/w").collect()}
    assert again == {"a/1.txt": True, "a/b/2.txt": False, "3.bin": True}  # goes on where it stopped
    empty = files.folder_pointer(got.limit(0)).first()
    assert (empty["size"], empty["files"], empty["digest"]) == (0, 0, sha(""))


def test_a_large_folder_is_listed_entry_by_entry(spark, tmp_path):
    """What a task holds does not grow with a folder; links to nothing are no files, others are what they lead to."""
    for i in range(5000):
        (tmp_path / f"{i}.txt").touch()
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x").write_text("abc")
    (tmp_path / "l").symlink_to(tmp_path / "d" / "x")
    (tmp_path / "gone").symlink_to(tmp_path / "nothing")
    next(files.entries(str(tmp_path)))  # what is imported counts for nothing
    tracemalloc.start()
    n = sum(1 for _ in files.entries(str(tmp_path)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 5002 and peak < 100_000  # a list of them takes ten times as much
    got = {r["file"]: r["length"] for r in files.listed(spark, f"{tmp_path}/").collect()}
    assert got == {f"{i}.txt": 0 for i in range(5000)} | {"d/x": 3, "l": 3}
    assert list(files.entries(f"{tmp_path}/nothing")) == []


def test_pointer_is_a_tree_of_sorted_hashes(spark):
    rows = [(f"f{i}", i, hashlib.sha256(str(i).encode()).hexdigest()) for i in range(3000)]
    level = {}
    for name, _, digest in rows:
        h = hashlib.sha256(f"{name}:{digest}".encode()).hexdigest()
        level.setdefault(h[:8], []).append(h)
    for digits in (8, 6, 4, 2, 0):
        level = {k: hashlib.sha256("".join(sorted(v)).encode()).hexdigest() for k, v in level.items()}
        if digits:
            up = {}
            for k, h in level.items():
                up.setdefault(k[: digits - 2], []).append(h)
            level = up
    got = files.folder_pointer(spark.createDataFrame(rows, "file string, size long, digest string").repartition(6)).first()
    assert (got["digest"], got["size"], got["files"]) == (level[""], sum(range(3000)), 3000)


def test_histories(spark, tmp_path):
    path, frame = f"{tmp_path}/h", lambda *n: spark.createDataFrame([(f"m{i}", x) for i, x in enumerate(n)], "name string, n long")
    held = lambda: sorted((r["run"], r["name"], r["n"]) for r in writers.read_history(spark, path).select("run", "name", "n").collect())
    writers.write_history(frame(1, 2), path, "007")
    writers.write_history(frame(3), path, "a/b=c d")
    writers.write_history(frame(4), path, "007")
    assert held() == [("007", "m0", 4), ("a/b=c d", "m0", 3)]
    with pytest.raises(Exception):  # noqa: B017  what fails while it is written leaves the attempt before
        writers.write_history(frame(5).withColumn("n", F.raise_error(F.lit("down")).cast("long")), path, "007")
    assert held() == [("007", "m0", 4), ("a/b=c d", "m0", 3)]
    writers.write_history(frame(), path, "007")
    assert held() == [("a/b=c d", "m0", 3)]


@pytest.fixture
def server():
    hits, times = [], []

    class Site(BaseHTTPRequestHandler):
        def do_GET(self):
            hits.append(self.path)
            times.append(time.monotonic())
            if self.path.startswith("/down"):
                self.send_error(500)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(f"<p>{self.path}</p>".encode())

        def log_message(self, *_):
            pass

    held = ThreadingHTTPServer(("127.0.0.1", 0), Site)
    threading.Thread(target=held.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{held.server_port}", hits, times
    held.shutdown()


def test_fetching_from_a_server(spark, tmp_path, server):
    base, hits, _ = server
    urls = spark.createDataFrame([(f"{base}/{i}",) for i in range(30)] * 2 + [(f"{base}/down",), (None,)], "url string")
    seen = spark.createDataFrame([(f"{base}/{i}",) for i in range(10)], "url string")
    got = fetching.fetch(urls, seen, attempts=1, rate=0, lane=7).collect()
    assert {(r["url"], r["html"]) for r in got} == {(f"{base}/{i}", f"<p>/{i}</p>") for i in range(10, 30)} | {(f"{base}/down", None)}
    assert [r["error"] is None for r in got if r["url"].endswith("down")] == [False]
    assert sorted(hits) == sorted([f"/{i}" for i in range(10, 30)] + ["/down"])  # each once
    # A large host is dealt to several lanes, small ones share one.
    fetching.stage_urls(urls.unionByName(spark.createDataFrame([("http://a/1",), ("http://b/1",)], "url string")), f"{tmp_path}/u", lane=7)
    lanes = spark.read.parquet(f"{tmp_path}/u").groupBy("lane").agg(F.collect_set("host").alias("hosts"), F.max("share").alias("share")).collect()
    assert sorted((len(r["hosts"]), r["share"]) for r in lanes)[-1] == (2, 1) and max(r["share"] for r in lanes) == 5


def test_conditions_are_pushed_to_the_fetch(spark, tmp_path, server):
    base, hits, _ = server
    fetching.stage_urls(spark.createDataFrame([(f"{base}/{i}",) for i in range(6)], "url string"), f"{tmp_path}/u")
    pages = fetching.pages(spark, f"{tmp_path}/u", rate=0)
    some = pages.where(~F.col("url").isin(f"{base}/1", f"{base}/2") & (F.col("url") != f"{base}/3"))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert {r["url"][-1] for r in some.collect()} == {"0", "4", "5"} and sorted(hits) == ["/0", "/4", "/5"]
    assert "+- *(1) Filter" not in plan and "Filter (" not in plan
    assert pages.where(F.col("host") == "elsewhere").count() == 0 and len(hits) == 3
    empty = fetching.pages(spark, f"{tmp_path}/nothing", rate=0)
    assert empty.count() == 0


def test_rate_of_a_host(spark, tmp_path, server):
    base, _, times = server
    fetching.stage_urls(spark.createDataFrame([(f"{base}/{i}",) for i in range(5)], "url string"), f"{tmp_path}/u", lane=100)
    assert fetching.pages(spark, f"{tmp_path}/u", rate=10).count() == 5
    assert times[-1] - times[0] > 0.3  # five at ten a second


def test_stream_of_staged_urls(spark, tmp_path, server):
    base, hits, _ = server
    stage = lambda *n: fetching.stage_urls(spark.createDataFrame([(f"{base}/{i}",) for i in n], "url string"), f"{tmp_path}/u")

    def run():
        q = fetching.pages(spark, f"{tmp_path}/u", rate=0, stream=True).writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()

    stage(1, 2)
    run()
    stage(3)
    run()
    run()
    assert sorted(hits) == ["/1", "/2", "/3"]  # what was committed is not fetched again
    assert {r["html"] for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {"<p>/1</p>", "<p>/2</p>", "<p>/3</p>"}


def test_recordings(spark, tmp_path):
    vtt = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\nhello\nthere\n\n01:00:00,250 --> 01:00:03,000\nfriends\n"
    files.write_files(spark.createDataFrame([("v1", vtt), ("v2", ""), ("v3", "no cues")], "name string, value string"), f"{tmp_path}/a")
    got = {r["file"]: (r["transcript"], [tuple(s) for s in r["segments"]]) for r in fetching.transcribe(fetching.recordings(spark, f"{tmp_path}/a"), fetching.captions).collect()}
    assert got == {"v1": ("hello there friends", [(0, 1.0, 2.5, "hello there"), (1, 3600.25, 3603.0, "friends")]), "v3": ("", [])}
    sizes = []

    def model():
        def hear(recordings):
            return [(f"{len(recordings)}", []) for _ in recordings]

        return hear

    many = spark.createDataFrame([(str(i), bytearray(b"x")) for i in range(40)], "file string, content binary").coalesce(1)
    sizes = [int(r["transcript"]) for r in fetching.transcribe(many, model, batch=16).collect()]
    assert max(sizes) == 16 and len(sizes) == 40


def test_transcript_files(spark, tmp_path):
    rows = [("Ein Titel", "v1", "http://u", "a text\nof lines"), ("", "v2", "", "")]
    writers.write_transcripts(spark.createDataFrame(rows, "title string, video_id string, url string, transcript string"), f"{tmp_path}/t", F.concat("video_id", F.lit(".txt")))
    assert names(tmp_path / "t") == {"v1.txt", "v2.txt"}
    got = readers.read_transcript_texts(spark, f"{tmp_path}/t").collect()
    assert sorted(map(tuple, got)) == sorted((t, v, u, x) for t, v, u, x in rows)
    assert json.dumps(rows[0][3]) in json.dumps([r["transcript"] for r in got])


def test_many_small_files_and_lanes_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    """A table of few bytes can mean many files: neither a mirror nor lanes are left to one task, and a task reads several lanes without a rate."""
    from lodestone.plans import landed

    urls = spark.range(0, 3000, 1, 1).select(F.concat(F.lit("http://p/"), "id").alias("url"), F.lit("x").alias("html"))
    mirrored, write = [], files.write_files
    monkeypatch.setattr(files, "write_files", lambda df, *a: (mirrored.append(df.rdd.getNumPartitions()), write(df, *a)))
    folder = landed.mirrored(urls)
    assert mirrored[0] > 1
    fetching.stage_urls(urls, f"{tmp_path}/lanes", lane=20)
    lanes = list((tmp_path / "lanes").rglob("*.parquet"))
    assert len(lanes) > 128 and len({p.name.split("-")[1] for p in lanes}) > 1
    parts = lambda rate: fetching.LaneReader({"path": f"{tmp_path}/lanes", "rate": rate}).partitions()
    assert len(parts("1")) == len(lanes) and not any(p.more for p in parts("1"))  # a host's lanes side by side
    assert 64 <= len(parts("0")) < len(lanes) and sorted(x for p in parts("0") for x in (p.path, *p.more)) == sorted(map(str, lanes))
    got = fetching.pages(spark, f"{tmp_path}/lanes", fetching.mirror(folder), 1, 0).collect()
    assert len(got) == 3000 and {(r["html"], r["error"]) for r in got} == {("x", None)} and len({r["url"] for r in got}) == 3000
