"""Connected components of a link table by contraction, entirely in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import temporary, written


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable, for every node of links (a long, b long).

    Each round every node hooks onto its smallest neighbour (or itself), pointers jump once, links are renamed and made distinct, and
    loops go; the rounds end when no link is left. Nodes of high degree only meet in aggregates with partial sums and in
    joins against one row a node. Every round is written to the shared folder.
    """
    with temporary(links.sparkSession) as keep:
        links = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        links = written(links, "links")
        labels = written(links.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node")), "labels")
        while not links.isEmpty():
            # Links lead from small to large ones: the smallest neighbour of b, and of a if it is below a itself, which it never is.
            up = written(links.groupBy(F.col("b").alias("n")).agg(F.min("a").alias("p")), "hooks")
            far = up.select(F.col("n").alias("p"), F.col("p").alias("q"))
            up = written(up.join(far, "p", "left").select("n", F.coalesce("q", "p").alias("p")), "hooks")
            to = lambda c: up.select(F.col("n").alias(c), F.col("p").alias(f"{c}_to"))
            labels = written(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_to", "label").alias("label")), "labels")
            moved = links.join(to("a"), "a", "left").join(to("b"), "b", "left")
            moved = moved.select(F.coalesce("a_to", "a").alias("x"), F.coalesce("b_to", "b").alias("y")).where("x != y")
            links = written(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "links")
        return keep(labels)


def merged_labels(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) after more links (a, b) between reps: only links between different components are followed, once for each pair of them."""
    with temporary(labels.sparkSession) as keep:
        side = lambda c: labels.select(F.col("rep").alias(c), F.col("label").alias(f"{c}_label"))
        apart = links.join(side("a"), "a").join(side("b"), "b").where("a_label != b_label")
        apart = apart.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct()
        new = connected_components(apart).toDF("label", "new")
        return keep(written(labels.join(new, "label", "left").select("rep", F.coalesce("new", "label").alias("label")), "labels"))
