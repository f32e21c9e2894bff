"""Fetching pages and running models over recordings, on the executors. What opens a url or hears a recording is given by the
caller, so nothing here needs a network.

Urls are first dealt to lanes, tables of a bounded number of urls each in the shared folder: small hosts side by side, large ones in ranges.
The data source `fetched_pages` reads lanes: a lane is a partition (in streams, what was staged since the last batch is a batch),
rows come as they are fetched, and a lost executor costs the lanes it was reading.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from functools import lru_cache
from itertools import batched

import numpy as np
from pyspark import cloudpickle
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, IsNotNull, Not
from pyspark.sql.types import StringType, StructType

from ..session import fresh_path
from .files import file_system

Opener = Callable[[str], str]
PAGES = "url string, host string, html string, error string, scraped_at string"
#: Urls of a lane, about; lanes that a task reads one after the other at most, where no host is waited for and there are many.
LANE, TOGETHER = 1000, 8


def open_url(url: str, timeout: float = 30.0) -> str:
    """The text behind a url, by the standard library."""
    from urllib.request import urlopen

    with urlopen(url, timeout=timeout) as r:
        return r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")


class Gone(OSError):
    """What an opener raises for a page that no further attempt will bring."""


def with_retry(opener: Opener, url: str, attempts: int = 3, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, str | None]:
    """(text, None), or (None, error) after all attempts; before attempt n + 1 it waits 2^n seconds. After Gone there is none."""
    for attempt in range(attempts):
        try:
            return opener(url), None
        except Gone as e:
            return None, str(e)
        except Exception as e:  # noqa: BLE001  any failure of a page is its own
            error = str(e) or type(e).__name__
            if attempt + 1 < attempts:
                sleep(2.0**attempt)
    return None, error


def packed(f: Callable) -> str:
    """A function as an option of the data source."""
    return base64.b64encode(cloudpickle.dumps(f)).decode()


def mirror(folder: str) -> Opener:
    """An opener that reads a mirror: a folder that all share, with a file a url, named by the url's MD5."""

    def opener(url: str) -> str:
        fs, root = file_system(f"{folder}/{hashlib.md5(url.encode()).hexdigest()}.html")
        if not fs.get_file_info(root).is_file:
            raise Gone(f"not in the mirror: {url}")
        with fs.open_input_stream(root) as f:
            return f.read().decode("utf-8", "replace")

    return opener


def stage_urls(urls: DataFrame, path: str, seen: DataFrame | None = None, lane: int = LANE) -> None:
    """Deal every distinct url that was not seen to lanes of about `lane` urls below path; may be called again with more.

    A lane's rows have `share`, the number of lanes that its host is dealt to: reading a host's lanes side by side, each as many times
    slower, keeps the host's rate. Null urls are left out.
    """
    spark = urls.sparkSession
    todo = urls.select("url").where("url is not null").distinct()
    if seen is not None:
        todo = todo.join(seen.select("url"), "url", "left_anti")
    todo = todo.withColumn("host", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    hosts = todo.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.ceil(F.col("n") / F.lit(lane)).cast("int"))
    small = hosts.where("share = 1").agg(F.ceil(F.coalesce(F.sum("n"), F.lit(0)) / F.lit(lane)).alias("k")).first()["k"]
    own = F.concat_ws("-", F.hex(F.xxhash64("host")), F.pmod(F.xxhash64("url"), F.col("share")).cast("string"))
    shared = F.concat(F.lit("s-"), F.pmod(F.xxhash64("host"), F.lit(max(1, int(small)))).cast("string"))
    dealt = todo.join(hosts.select("host", "share"), "host").select("url", "host", "share", F.when(F.col("share") == 1, shared).otherwise(own).alias("lane"))
    batch = f"{time.time_ns():020d}"
    # a lane is a file, however small: dealt over all cores, as a number that is not given would be lowered to what the bytes need
    dealt.repartition(spark.sparkContext.defaultParallelism, "lane").write.partitionBy("lane").parquet(f"{path}/batch={batch}")


@dataclass
class Lane(InputPartition):
    path: str
    more: tuple[str, ...] = ()  # lanes that are read after it


class FetchedPages(DataSource):
    """Format `fetched_pages`: url, host, html, error, scraped_at of the urls staged at `path`.

    Options: opener (packed), attempts, rate (urls a second and host; 0: no wait). Conditions on url and host of the kinds =, in
    and their negations are pushed down: what they exclude is never fetched.
    """

    @classmethod
    def name(cls) -> str:
        return "fetched_pages"

    def schema(self) -> str:
        return PAGES

    def reader(self, schema: StructType) -> DataSourceReader:
        return LaneReader(dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return LaneStream(dict(self.options))


def _lanes(path: str, after: str = "", upto: str | None = None) -> list[Lane]:
    """Lanes of batches after one and up to another."""
    fs, root = file_system(path)
    if fs.get_file_info(root).type.name != "Directory":
        return []
    from pyarrow.fs import FileSelector

    names = sorted(f.path for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(".parquet"))
    held = [(re.search(r"/batch=(\d+)/", n), n) for n in names]
    prefix = path[: len(path) - len(root)] if path.endswith(root) else ""
    return [Lane(prefix + n) for m, n in held if m and after < m[1] and (upto is None or m[1] <= upto)]


class LaneReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options
        self.tests: list[tuple[str, frozenset, bool]] = []  # column, values, whether the column must be among them

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            inner, wanted = (f.child, False) if isinstance(f, Not) else (f, True)
            if isinstance(inner, EqualTo) and inner.attribute in (("url",), ("host",)):
                self.tests.append((inner.attribute[0], frozenset([inner.value]), wanted))
            elif isinstance(inner, In) and inner.attribute in (("url",), ("host",)):
                self.tests.append((inner.attribute[0], frozenset(inner.value), wanted))
            elif not (wanted and isinstance(f, IsNotNull) and f.attribute in (("url",), ("host",))):  # they never are
                yield f

    def partitions(self) -> list[InputPartition]:
        """A lane each; without a rate, where a task's start would take longer than a lane, as many as leave 64 tasks, TOGETHER at most."""
        lanes = _lanes(self.options["path"])
        if float(self.options.get("rate", 1)):
            return lanes
        k = max(1, min(TOGETHER, len(lanes) // 64))
        return [Lane(own.path, tuple(x.path for x in more)) for own, *more in batched(lanes, k)]

    def read(self, partition: Lane | None) -> Iterator[tuple]:
        for path in (partition.path, *partition.more) if partition else ():  # none: nothing is staged
            yield from self._read(path)

    def _read(self, lane: str) -> Iterator[tuple]:
        import pyarrow.parquet as pq

        opener = cloudpickle.loads(base64.b64decode(self.options["opener"])) if "opener" in self.options else open_url
        attempts, rate = int(self.options.get("attempts", 3)), float(self.options.get("rate", 1))
        fs, path = file_system(lane)
        with fs.open_input_file(path) as f:
            rows = pq.ParquetFile(f).read(["url", "host", "share"]).to_pylist()  # a lane's
        last: dict[str, float] = {}
        for row in rows:
            if not all((row[c] in values) == wanted for c, values, wanted in self.tests):
                continue
            if rate and row["host"] in last:  # the first of a host goes at once, and nothing waits after the last
                time.sleep(max(0.0, last[row["host"]] + row["share"] / rate - time.monotonic()))
            last[row["host"]] = time.monotonic()
            html, error = with_retry(opener, row["url"], attempts)
            yield row["url"], row["host"], html, error, datetime.now(UTC).isoformat()


class LaneStream(DataSourceStreamReader):
    """An offset is the last batch of staged urls; a micro-batch reads the lanes of all batches since."""

    def __init__(self, options: dict[str, str]):
        self.options = options
        self.reader = LaneReader(options)

    def initialOffset(self) -> dict:
        return {"batch": ""}

    def latestOffset(self) -> dict:
        found = [re.search(r"/batch=(\d+)/", x.path)[1] for x in _lanes(self.options["path"])]
        return {"batch": max(found, default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return _lanes(self.options["path"], start["batch"], end["batch"])

    def read(self, partition: Lane) -> Iterator[tuple]:
        return self.reader.read(partition)

    def commit(self, end: dict) -> None:
        """Staged urls stay, for other readers."""


def pages(spark: SparkSession, path: str, opener: Opener = open_url, attempts: int = 3, rate: float = 1.0, stream: bool = False) -> DataFrame:
    """The pages of the urls staged at path; read a second time, they are fetched a second time."""
    spark.dataSource.register(FetchedPages)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    read = spark.readStream if stream else spark.read
    options = {"opener": packed(opener), "attempts": str(attempts), "rate": str(rate)}
    return read.format("fetched_pages").options(**options).load(path)


def fetch(urls: DataFrame, seen: DataFrame | None = None, opener: Opener = open_url, attempts: int = 3, rate: float = 1.0, lane: int = LANE) -> DataFrame:
    """url, html, error, scraped_at of every distinct url that was not seen, at most `rate` a second from a host."""
    path = fresh_path(urls.sparkSession, "urls")
    stage_urls(urls, path, seen, lane)
    return pages(urls.sparkSession, path, opener, attempts, rate).drop("host")


# Recordings --------------------------------------------------------------------------------------

SEGMENTS = "array<struct<id:int,start:double,end:double,text:string>>"
Heard = tuple[str, list[dict]]


def recordings(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """file and content of landed recordings, wherever the folder is; a recording is one row, of 2 GB at most. Empty files are none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")


def transcribe(rows: DataFrame, model: Callable[[], Callable[[list[bytes]], list[Heard]]], batch: int = 16) -> DataFrame:
    """rows without content but with transcript and segments. model() is called once a worker and gives what turns a batch of recordings
    into texts and segments."""

    def make():
        hear = model()

        def predict(content: np.ndarray) -> np.ndarray:
            return np.array([json.dumps({"transcript": text, "segments": segments}) for text, segments in hear([bytes(c) for c in content])], object)

        return predict

    heard = F.from_json(predict_batch_udf(make, return_type=StringType(), batch_size=batch)("content"), f"transcript string, segments {SEGMENTS}")
    return rows.withColumn("_heard", heard).select(*[c for c in rows.columns if c != "content"], "_heard.transcript", "_heard.segments")


CUE = re.compile(r"(?:(\d+):)?(\d\d):(\d\d)[.,](\d{3}) --> (?:(\d+):)?(\d\d):(\d\d)[.,](\d{3})[^\n]*\n(.*?)(?:\n\n|\Z)", re.S)

BLANK = re.compile(r"[ \t\n\r\f\v]+")


@lru_cache(maxsize=1)
def captions() -> Callable[[list[bytes]], list[Heard]]:
    """A model for recordings that are captions (WebVTT or SubRip): a segment a cue."""

    def seconds(h: str | None, m: str, s: str, ms: str) -> float:
        return int(h or 0) * 3600 + int(m) * 60 + int(s) + int(ms) / 1000

    def one(content: bytes) -> Heard:
        cues = CUE.findall(content.decode("utf-8", "replace").replace("\r\n", "\n"))
        segments = [{"id": i, "start": seconds(*c[:4]), "end": seconds(*c[4:8]), "text": BLANK.sub(" ", c[8]).strip(" ")} for i, c in enumerate(cues)]
        return " ".join(s["text"] for s in segments), segments

    return lambda contents: [one(c) for c in contents]
