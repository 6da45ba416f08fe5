"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasontide.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) for each id in ``links`` (a, b); component is the smallest id reachable.

    Alternates large-star and small-star steps. Each step takes one minimum per
    vertex (combined before the shuffle) and joins it back, so that a vertex with
    very many links is never gathered. Self-links and nulls are ignored; no links
    give an empty table. It ends as soon as all links are stars.
    """
    edges = stored(_ordered(links.select("a", "b")), "edges")
    while not _stars(edges):
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # large star: every larger neighbour moves to the smallest one; equal links are left to the small star
        large = edges.join(least, "a").select(F.col("m").alias("a"), "b")
        # small star: the smaller neighbours and the vertex itself move to the smallest
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b").select(F.explode(F.array("a", "b")).alias("b"), F.col("m").alias("a"))
        edges = stored(_ordered(small.select("a", "b")), "edges")
    roots = edges.select(F.col("a").alias("id"), F.col("a").alias("component"))
    return edges.select(F.col("b").alias("id"), F.col("a").alias("component")).union(roots).groupBy("id").agg(
        F.min("component").alias("component")
    )


def _stars(edges: DataFrame) -> bool:
    """Whether each larger end of the distinct, ordered links has one link and is no smaller end."""
    ends = edges.select(F.col("b").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select("a", F.lit(0), F.lit(1)))
    ends = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.where("up > 1 or up = 1 and down = 1").agg(F.count(F.lit(1))).first()[0]


def _ordered(links: DataFrame) -> DataFrame:
    return (
        links.where("a != b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
