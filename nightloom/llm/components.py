"""Connected components of an edge table by alternating large-star and small-star steps, wholly on the executors.

Each step keeps the components and moves edges towards their least node, so the rounds end, in a number that follows the
logarithm of the longest path. Defined results: pairs with a null, and pairs of a node with itself, link nothing; repeated and
reversed pairs count once; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def _with_least(edges: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all v of u. Minima are aggregated before they are joined, so a hub is no hot task."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("_u")).select("u", "v", "m")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): root is the least node that edges reach from node. Nodes without an edge to another are left out."""
    e = common.cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = _with_least(large)
        small = star.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(star.select("u", F.col("m").alias("v")))
        e = common.cut(small.where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == last:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        last = now
