"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kawara.llm.common import discarded, written


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) for every end of an edge (a, b): comp is the smallest id that it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014): each is one aggregation and one join, and
    the number of steps grows with the logarithm of the longest path. Every pair of steps is written to the shared
    folder, and the loop ends when a pair of steps changes nothing.
    """
    stars = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges"
    )
    mark = _mark(stars)
    while mark[0]:
        both = stars.unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        small = joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        stars, last = written(small, "stars"), stars
        before, mark = mark, _mark(stars)
        discarded(last)
        if before == mark:
            break
    ends = stars.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return ends.unionByName(stars.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A number of rows and an order-free digest of them; equal for equal edge sets."""
    spread = F.xxhash64("a", "b")
    row = edges.agg(F.count("*"), F.sum(spread % 1_000_000_007), F.sum(F.col("b").cast("decimal(38,0)"))).first()
    return tuple(row)
