"""Crawling as reachability over a link table, and crawls of several sections at once."""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import fresh_path, replaced, temporary, written


def crawl(edges: DataFrame, start: int, depth: int | None = None, pages: int | None = None, same_section: bool = True) -> DataFrame:
    """page, depth of all pages that can be reached from start (depth: within so many links), breadth first; at most `pages` of them in the order (depth, page).

    edges: src, dst and, to stay within a section, src_section and dst_section. Each round joins the frontier with the links and
    leaves out what was seen. What was seen is one table in the shared folder, a folder a round: the frontier is one of them, so neither
    the plan nor what a round writes grows with depth.
    """
    if same_section:
        edges = edges.where(F.col("src_section").eqNullSafe(F.col("dst_section")))
    spark = edges.sparkSession
    with temporary(spark) as keep:
        links = written(edges.select("src", "dst").distinct(), "links")
        path = fresh_path(spark, "seen")
        read = lambda: spark.read.schema("page long, depth int").parquet(path)
        spark.range(start, start + 1).select(F.col("id").alias("page")).write.parquet(f"{path}/depth=0")
        for d in count(1) if depth is None else range(1, depth + 1):
            frontier = read().where(F.col("depth") == d - 1)
            found = frontier.join(links, F.col("page") == F.col("src")).select(F.col("dst").alias("page")).distinct()
            found.join(read().select("page"), "page", "left_anti").write.parquet(f"{path}/depth={d}")
            if read().where(F.col("depth") == d).isEmpty():
                break
        seen = keep(written(read(), "crawled"))
    return seen if pages is None else seen.orderBy("depth", "page").limit(pages)


#: Reads pages (start, page) and gives those that could be read.
Visit = Callable[[DataFrame, int], DataFrame]
#: Gives links (start, position, number, link) of pages (start, page, position) that were read in a round; number: a link's place on its page.
Links = Callable[[DataFrame, int], DataFrame]


def crawl_together(starts: DataFrame, links: Links, quota: int, visit: Visit | None = None, rounds: int | None = None) -> DataFrame:
    """start, page, position, round: the pages that each start reads first in first out, until it has read `quota`; all starts at once.

    starts: start (a number), page. A start's queue is in the order in which its links were found: by round, then by the position of
    the page that they stand on, then by their place there. In a round every start takes as many of its queue as it still lacks; of
    those that take the same page the smallest start gets it, and nobody reads it again. Pages that can't be read don't count and
    leave the queue; a later link brings them back. Rows with null start or page are left out.

    Queue and pages read are tables in the shared folder; new links are compared with all pages read, what is left of the queue with those
    of the last round. The driver holds no page.
    """
    spark = starts.sparkSession
    kinds = dict(starts.dtypes)
    schema = f"start {kinds['start']}, page {kinds['page']}, position int, round int"
    mine = Window.partitionBy("start").orderBy("found", "parent", "number", "page")
    with temporary(spark) as keep:
        path = fresh_path(spark, "read")
        first = starts.where("start is not null and page is not null").groupBy("start", "page").agg(F.lit(0).alias("found"), F.lit(0).alias("parent"), F.lit(0).cast("long").alias("number"))
        queue = written(first, "queue")
        seen = spark.createDataFrame([], schema)
        for r in count(1) if rounds is None else range(1, rounds + 1):
            done = seen.groupBy("start").agg(F.count(F.lit(1)).cast("int").alias("done"))  # a row a start
            # A start takes no more than its quota, so the ranking may stop there in every task.
            ranked = queue.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= quota)
            ranked = ranked.join(done, "start", "left").withColumn("done", F.coalesce("done", F.lit(0))).where(F.col("rank") + F.col("done") <= quota)
            taken = ranked.groupBy("page").agg(F.min(F.struct("start", "rank", "done")).alias("t")).select("t.start", "page", "t.rank", "t.done")
            taken = written(taken, "taken")
            if taken.isEmpty():
                break
            good = taken if visit is None else taken.join(visit(taken.select("start", "page"), r).select("start", "page"), ["start", "page"], "left_semi")
            order = Window.partitionBy("start").orderBy("rank")
            good.select("start", "page", (F.row_number().over(order) + F.col("done")).cast("int").alias("position")).write.parquet(f"{path}/round={r}")
            seen = spark.read.schema(schema).parquet(path)
            fresh = seen.where(F.col("round") == r)
            # What was taken has gone, read or not, from the queues of those who took it; what was read from all queues.
            left = queue.join(taken.select("start", "page"), ["start", "page"], "left_anti").join(fresh.select("page"), "page", "left_anti")
            new = links(fresh.select("start", "page", "position"), r).where("link is not null")
            new = new.groupBy("start", F.col("link").alias("page")).agg(F.min(F.struct(F.lit(r).alias("found"), F.col("position").alias("parent"), F.col("number").cast("long").alias("number"))).alias("o"))
            new = new.join(seen.select("page"), "page", "left_anti").select("start", "page", "o.found", "o.parent", "o.number")
            both = left.select("start", "page", "found", "parent", "number").unionByName(new)
            both = both.groupBy("start", "page").agg(F.min(F.struct("found", "parent", "number")).alias("o")).select("start", "page", "o.found", "o.parent", "o.number")
            queue = replaced(queue, written(both, "queue"))
        return keep(written(seen, "crawled"))


def crawl_sections(edges: DataFrame, starts: DataFrame, quota: int, rounds: int | None = None) -> DataFrame:
    """crawl_together over a link table: edges (src, dst, src_section, dst_section), followed within a section; links in the order of dst."""
    inside = edges.where(F.col("src_section").eqNullSafe(F.col("dst_section"))).select("src", "dst").distinct()
    with temporary(edges.sparkSession) as keep:
        inside = written(inside, "links")

        def links(pages: DataFrame, _: int) -> DataFrame:
            return pages.join(inside, F.col("page") == F.col("src")).select("start", "position", F.col("dst").alias("number"), F.col("dst").alias("link"))

        return keep(crawl_together(starts, links, quota, rounds=rounds))


def unseen(candidates: DataFrame, seen: DataFrame, url: str = "url") -> DataFrame:
    """Distinct urls that were not fetched before."""
    return candidates.select(url).distinct().join(seen.select(url), url, "left_anti")
