"""Connected components by alternating large-star and small-star over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.shared import delete, materialize, shared_dir


def _large_star(links: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it."""
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    least = least.select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return joined.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def star_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for the nodes that ``links`` (a, b) names; a component is named by its smallest node.

    Each round is two joins and is written to the shared folder; rounds end when the links are stars about the smallest
    nodes and a round changes nothing. No component is ever gathered: hubs are split by skew joins and partial sums.
    Links of a node with itself and links with nulls are left out; an empty table gives an empty result.
    """
    spark = links.sparkSession
    path = shared_dir(spark)
    now = materialize(links.select("a", "b").filter("a is not null and b is not null and a <> b").distinct(), path)
    digest = None
    while True:
        n, total = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if (n, total) == digest or n == 0:
            break
        digest, old, path = (n, total), path, shared_dir(spark)
        now = materialize(_small_star(_large_star(now)), path)
        delete(spark, old)
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
