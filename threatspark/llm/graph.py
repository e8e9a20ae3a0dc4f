"""Connected components of a link table, by alternating star contraction.

Each round hangs every node's larger neighbours onto its smallest neighbour
(large star), then its smaller ones (small star), until nothing changes. Rounds
are grouped minima (combined before the shuffle) and joins, stored in between;
no component is ever gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MOST_ROUNDS = 100


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links -> (node, comp), comp the smallest node reachable; nodes without a link are absent."""
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .distinct(), "edges")
    last = _mark(e)
    for _ in range(MOST_ROUNDS):
        if not last[0]:
            break
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = (both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        large = stored(large, "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = (small.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())
        e = stored(small, "edges")
        now = _mark(e)
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(
                e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())
        last = now
    if last[0]:
        raise RuntimeError("the components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
