"""Drivers end to end on landed files, with openers and models that need no network."""

import json

import pytest

from lodestone.plans import drivers
from lodestone.sources import fetching


def test_pages_to_chunks(spark, tmp_path):
    src = tmp_path / "raw"
    src.mkdir()
    for i in range(4):
        text = "A sentence of some words. " * (300 if i else 1)
        (src / f"handbook_{i}.json").write_text(json.dumps({"content": text, "metadata": {"url": f"u{i}", "title": "t", "section": "s"}, "html": ""}))
    out = drivers.clean_pages(spark, str(src), f"{tmp_path}/clean")
    assert (out["total"], out["successful"], out["failed"]) == (4, 3, 1)
    assert [r["url"] for r in out["failed_urls"].collect()] == ["u0"]
    summary = drivers.chunk_pages(spark, f"{tmp_path}/clean", f"{tmp_path}/chunks")
    assert summary["documents"] == 3 and summary["chunks"] == spark.read.parquet(f"{tmp_path}/chunks").count() > 3
    first = drivers.publish(spark, f"{tmp_path}/raw", f"{tmp_path}/copy")
    assert (first["files"], first["copied"], first["failed"]) == (4, 4, 0) and first["size"] == sum(f.stat().st_size for f in src.iterdir())
    (tmp_path / "copy" / "handbook_1.json").write_text("half a fi")
    again = drivers.publish(spark, f"{tmp_path}/raw", f"{tmp_path}/copy")
    assert (again["files"], again["copied"], again["failed"], again["digest"]) == (4, 1, 0, first["digest"])
    assert drivers.check_environment(spark, [f"{tmp_path}/copy", f"{tmp_path}/new"]) == {f"{tmp_path}/copy": True, f"{tmp_path}/new": False}
    assert (tmp_path / "new").is_dir()


def test_fetching(spark):
    waits, calls = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise OSError("down")
        return "page"

    assert fetching.with_retry(flaky, "u", 3, waits.append) == ("page", None) and waits == [1.0, 2.0]
    assert fetching.with_retry(lambda u: 1 / 0, "u", 2, waits.append) == (None, "division by zero")
    urls = spark.createDataFrame([("http://a/1",), ("http://a/1",), ("http://b/2",), (None,)], "url string")
    got = fetching.fetch(urls, urls.where("url like '%b%'"), opener=lambda u: "<p>" + u, rate=0).collect()
    assert [(r["url"], r["html"], r["error"]) for r in got] == [("http://a/1", "<p>http://a/1", None)]


def test_alerts(spark):
    sent = []

    def broken(_):
        raise OSError

    alert = spark.createDataFrame([("m",)], "message string")
    assert drivers.deliver(alert, [broken, sent.append]) and sent == ["m"]
    assert not drivers.deliver(alert.limit(0), [sent.append])
    drivers.report_failure("clean", ValueError("x"), [broken, sent.append])
    assert sent[-1] == "Pipeline Error in step 'clean':\nx"


@pytest.mark.parametrize("step", ["a"])
def test_observed(spark, step):
    df, seen = drivers.observed(spark.range(7), step)
    df.collect()
    assert seen.get["rows"] == 7


FEED = """<feed>{}</feed>"""
ENTRY = "<entry><title>{}</title><link>{}</link><summary>s</summary><tags><term>{}</term></tags></entry>"


def test_fetching_posts(spark, tmp_path):
    entries = [("Remote work", "http://b/1", "x"), ("Plain", "http://b/2", "x"), ("Short", "http://b/3", "DevOps"), ("Down", "http://b/4", "culture")]
    (tmp_path / "feed.xml").write_text(FEED.format("".join(ENTRY.format(*e) for e in entries)))

    def opener(url):
        if url.endswith("4"):
            raise OSError("down")
        return "<article>" + ("few words" if url.endswith("3") else "A post of some words. " * 20) + "</article>"

    out = drivers.fetch_posts(spark, f"{tmp_path}/feed.xml", f"{tmp_path}/posts", opener, most=4, rate=0)
    assert (out["total"], out["successful"], out["failed"], out["relevant"]) == (4, 2, 2, 1)
    assert {r["url"] for r in out["failed_posts"].collect()} == {"http://b/3", "http://b/4"}
    out = drivers.fetch_posts(spark, f"{tmp_path}/feed.xml", f"{tmp_path}/posts2", opener, most=1, rate=0)
    assert out["total"] == 1 and out["relevant"] == 1


def crawl_by_rounds(base, sections, site, most):
    """All sections at once: of each queue as many as it lacks; a page that several take is the first section's."""
    seen, queues, done, tried = {}, [{base + p: (0, 0, 0)} for p in sections], [0] * len(sections), []
    r = 0
    while True:
        r += 1
        taken = {}
        for i, q in enumerate(queues):
            for rank, url in enumerate(sorted(q, key=lambda u: (q[u], u))[: most - done[i]]):
                taken.setdefault(url, (i, rank))
        if not taken:
            return seen, tried
        for url, (i, _) in taken.items():
            del queues[i][url]
            tried.append(url)
        for i in range(len(sections)):
            for url in sorted((u for u, (j, _) in taken.items() if j == i and u in site), key=lambda u: taken[u][1]):
                done[i] += 1
                seen[url] = (i, done[i], r)
        for url, (i, position, found) in list(seen.items()):
            if found == r:
                for n, x in enumerate(site[url]):
                    if x.split("/")[3] == url.split("/")[3]:
                        queues[i][x] = min((r, position, n), queues[i].get(x, (r, position, n)))
        for q in queues:
            for url in [u for u in q if u in seen]:
                del q[url]


def test_crawling_sections(spark, tmp_path):
    base = "http://h/"
    site = {
        "http://h/a/0": ["http://h/a/1", "http://h/a/down", "http://h/b/0", "http://h/a/2"],
        "http://h/a/1": ["http://h/a/3", "http://h/a/down", "http://h/a/0"],
        "http://h/a/2": ["http://h/a/4", "http://h/a/1"],
        "http://h/a/3": ["http://h/a/5", "http://h/a/down"],
        "http://h/a/4": [], "http://h/a/5": [], "http://h/b/0": ["http://h/b/1"], "http://h/b/1": ["http://h/b/0"],
    }

    def opener(url):
        return "<body><main>text</main>" + "".join(f'<a href="{x}">l</a>' for x in site[url])

    for n, most in enumerate((2, 3, 50)):
        out = drivers.crawl_sections(spark, base, ["a/0", "b/0", "a/2", "nowhere/0"], f"{tmp_path}/{n}", opener, most, rate=0)
        want, tried = crawl_by_rounds(base, ["a/0", "b/0", "a/2", "nowhere/0"], site, most)
        pages = spark.read.parquet(f"{tmp_path}/{n}")
        assert {(r["url"], r["start"], r["round"]) for r in pages.where("html is not null").collect()} == {(u, i, r) for u, (i, _, r) in want.items()}
        assert out["pages"] == len(want) and all(x <= most for x in out["by_section"].values())
        assert sorted(r["url"] for r in out["failed_urls"].collect()) == sorted({u for u in tried if u not in site})
        assert {r["section"] for r in pages.where("content = 'text'").collect()} == {"a", "b"}


def test_transcripts_and_videos(spark, tmp_path):
    src = tmp_path / "t"
    src.mkdir()
    seg = [{"id": 0, "start": 0.0, "end": 5.0, "text": "hello there"}, {"id": 1, "start": 5.0, "end": 9.0, "text": "friends"}]
    (src / "1.json").write_text(json.dumps({"title": "a", "video_id": "v1", "url": "u", "transcript": "x", "segments": seg}))
    (src / "2.json").write_text(json.dumps({"title": "b", "video_id": "v2", "url": "u", "transcript": "x", "segments": []}))
    (src / "3.json").write_text(json.dumps({"title": "c", "video_id": "v3"}))
    (src / "4.json").write_text("not json")
    assert drivers.clean_transcripts(spark, str(src), f"{tmp_path}/clean") == {"total": 4, "successful": 2, "failed": 2}
    got = {r["video_id"]: (r["segment_count"], r["full_text"]) for r in spark.read.parquet(f"{tmp_path}/clean").collect()}
    assert got == {"v1": (1, "hello there friends"), "v2": (0, "")}
    listing = spark.createDataFrame([(1, "v1", "First: one"), (2, "v2", "[Private video]"), (3, "v3", "Third"), (4, "v4", None), (5, None, "x")], "position int, video_id string, title string")
    hear = lambda: lambda recordings: [("heard " + r.decode(), [{"id": 0, "start": 0.0, "end": 1.0, "text": "heard"}]) for r in recordings]
    out = drivers.process_videos(spark, listing, f"{tmp_path}/v", lambda v: None if v == "v3" else b"/" + v.encode(), hear)
    assert {k: out[k] for k in ("successful", "failed", "skipped")} == {"successful": 2, "failed": 1, "skipped": 2}
    assert [r["title"] for r in out["failed_videos"].collect()] == ["Third"]
    files = lambda folder: {p.name for p in (tmp_path / "v" / folder).iterdir() if p.name[0] not in "._"}
    assert files("texts") == {"001_First one.txt", "004_Unknown Title.txt"} and files("audio") == {"v1", "v4"}
    asked = tmp_path / "asked"
    asked.mkdir()

    def download(v):
        (asked / v).touch()
        return b"/" + v.encode()

    again = drivers.process_videos(spark, listing, f"{tmp_path}/v", download, hear)
    assert {k: again[k] for k in ("successful", "failed", "skipped")} == {"successful": 3, "failed": 0, "skipped": 2}
    assert {p.name for p in asked.iterdir()} == {"v3"}  # the others were there
    assert spark.read.json(f"{tmp_path}/v/records").count() == 3
    assert (tmp_path / "v" / "texts" / "003_Third.txt").read_text().endswith("heard /v3")


def test_validating_runs(spark, tmp_path):
    def record(n, title="t"):
        seg = [{"id": i, "start": 5.0 * i, "end": 5.0 * i + 5, "text": "two words"} for i in range(n)]
        return json.dumps({"title": title, "video_id": "v", "segments": seg})

    frame = lambda *r: spark.createDataFrame([(str(i), x) for i, x in enumerate(r)], "video_id string, record string")
    bad = json.dumps({"title": "t", "segments": [{"id": 0, "start": 5.0, "end": 0.0, "text": "x"}]})
    first = drivers.validate_records(spark, frame(record(4), bad), f"{tmp_path}/h", "r1")
    assert {r["video_id"]: r["errors"] for r in first["errors"].collect()} == {"0": [], "1": ["Missing required field: video_id", "Segment 0 has invalid time range"]}
    assert first["statistics"].first()["total_segments"] == 5 and first["anomalies"].count() == 0
    second = drivers.validate_records(spark, frame(record(2)), f"{tmp_path}/h", "r2")
    assert {r["message"] for r in second["anomalies"].collect()} >= {"Anomaly detected in total_segments: Changed by 60.0%"}


def test_runs_written_again(spark, tmp_path):
    """A step that is tried again leaves one run, and the run after it is compared with one."""
    frame = lambda n: spark.createDataFrame([("0", json.dumps({"title": "t", "video_id": "v", "segments": [{"id": i, "start": 5.0 * i, "end": 5.0 * i + 5, "text": "two words"} for i in range(n)]}))], "video_id string, record string")
    for n in (9, 4):
        out = drivers.validate_records(spark, frame(n), f"{tmp_path}/h", "r1")
    assert [r["total_segments"] for r in out["statistics"].collect()] == [4]
    out = drivers.validate_records(spark, frame(1), f"{tmp_path}/h", "r2")
    assert {r["message"] for r in out["anomalies"].collect()} >= {"Anomaly detected in total_segments: Changed by 75.0%"}
