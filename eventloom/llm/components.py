"""Connected components by alternating large and small stars, with a written table each round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from eventloom.llm.rows import join_one
from eventloom.runtime import written


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """One large-star and one small-star step over the ``n`` rows (a, b), a > b; same columns."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count_if(F.col("b") > F.col("a")).alias("n"))
    large = written(
        join_one(both.filter("b > a"), least.filter("n > 0"), "a", "n", n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a > b").distinct(), "links"
    )
    small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    return (
        join_one(large, small, "a", "n", n)
        .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        .select("e.*")
        .filter("a > b")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) of every node of ``edges`` (a, b: long); component: its smallest node.

    Links of a node to itself and repeated links don't matter; no link gives no row.  A node
    with very many links is never gathered: a step takes its smallest neighbour by a partial
    aggregate and brings it to the links where they are (see rows.join_one).
    """
    edges = written(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "links",
    )
    mark = None
    while True:  # it settles after O(log^2 n) rounds
        sums = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
        ).first()
        if sums[0] == 0 or sums == mark:
            break
        mark = sums
        edges = written(_stars(edges, sums[0]), "links")
    heads = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(heads)
