"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Most vertices of which a step broadcasts a row each (some 10 MB for numbers).
BROADCAST_VERTICES = 1 << 18


def _both_ways(e: DataFrame) -> DataFrame:
    return e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", rows: int | None = None) -> DataFrame:
    """(id, component) for each vertex of an undirected edge list; component is the least id reachable.

    Self loops and repeated edges are harmless, null ends are dropped, isolated vertices don't appear.
    Each step joins every edge with one row per vertex, so that a hub's edges never meet in one task;
    few such rows are broadcast. It writes the edges, so that lineage stays short. The steps end once every
    vertex has either only larger neighbours or only one; their number grows with the logarithm of the longest path. rows: about how many
    edges there are at most, where known.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col("a") != F.col("b")))
    e = materialize(e.distinct(), rows)
    rows = 2 * e.count()
    while True:
        both = _both_ways(e)
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("k")), rows)
        vertices, open_ = least.agg(F.count("*"), F.count_if(F.expr("m < a AND k > 1"))).first()
        if not open_:
            return least.select(F.col("a").alias("id"), F.col("m").alias("component"))

        def per_vertex(df: DataFrame, few: bool = vertices <= BROADCAST_VERTICES) -> DataFrame:
            return F.broadcast(df) if few else df

        large = both.join(per_vertex(least.drop("k")), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(per_vertex(least), "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # where b is the least, the edge (a, m) stays; other b hang on m as well, and a hangs on m by its least edge
        e = materialize(small.where("a != b").distinct(), rows)
