"""Connected components of an edge table by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave import scratch


#: Parts into which the arcs of each node are dealt, so that a hub's arcs do not meet in one task.
SALTS = 16


def _to_min(directed: DataFrame) -> DataFrame:
    """(u, v, m): each arc with the least of its tail and the tail's heads.

    Minima are taken in each task first and then copied to every part of the node's arcs.
    """
    least = directed.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("m"))
    least = least.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    arcs = directed.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return arcs.join(least, (F.col("u") == F.col("n")) & (F.col("salt") == F.col("part"))).select("u", "v", F.least("u", "m").alias("m"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of the edges (a, b): root is the least node of its component.

    Each round links every neighbour to the least node around it; the edges end as stars. Rounds
    are written to the shared folder. Takes a number of rounds logarithmic in practice.
    """
    now = scratch.materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _to_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _to_min(large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        now = scratch.materialize(small.filter("u <> v").distinct(), "edges")
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
