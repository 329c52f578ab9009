"""Connected components of an edge table by alternating stars; no node list leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from fillsight.session import materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _nearest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour-or-self of every node that has an edge from it."""
    return edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b of one orderable type).

    Large-star links every larger neighbour of a node to the smallest one, small-star every
    smaller neighbour; both keep components and end in one star per component. A round is
    two aggregations (combined before the shuffle) and two joins whose skewed side may be
    split, and its result is a table in the shared folder, so the plan stays short and a
    lost executor costs a re-read. Self loops and repeated edges are ignored.
    """
    edges = materialize(
        edges.where(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _fingerprint(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.join(_nearest(both), "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        )
        near = _nearest(large)
        small = (
            large.join(near, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(near.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        )
        edges = materialize(small)
        after = _fingerprint(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
