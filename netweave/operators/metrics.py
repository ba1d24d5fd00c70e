"""Ranking and quality metrics over predictions (pos, label, score, protocol).

Curves are built from counts per distinct score and protocol; running totals over scores go through
range partitions, so no task orders all predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave import scratch


def running(df: DataFrame, by: str, order: list, sums: list[str]) -> DataFrame:
    """Add before_<sum> for each of ``sums``: its total over the group's rows that come before.

    Rows are range-partitioned by group and order; each partition's total per group is added to the
    running totals within the partitions that follow.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(parts, by, *order).withColumn("__part", F.spark_partition_id())
    rows = scratch.materialize(rows, "ranged")
    inside = Window.partitionBy(by, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(by, "__part").agg(*[F.sum(s).alias(f"__sum_{s}") for s in sums])
    totals = totals.select(by, "__part", *[F.coalesce(F.sum(f"__sum_{s}").over(across), F.lit(0)).alias(f"__sum_{s}") for s in sums])
    rows = rows.join(totals, [by, "__part"])
    out = rows.select("*", *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"__sum_{s}")).alias(f"before_{s}") for s in sums])
    return out.drop("__part", *[f"__sum_{s}" for s in sums])


def curve(predictions: DataFrame) -> DataFrame:
    """(protocol, score, p, n) with the positives and negatives above each score."""
    counts = predictions.groupBy("protocol", "score").agg(F.sum("label").cast("long").alias("p"), F.sum(1 - F.col("label")).cast("long").alias("n"))
    counts = counts.withColumn("down", -F.col("score"))
    totals = counts.groupBy("protocol").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"))
    return running(counts, "protocol", ["down"], ["p", "n"]).join(totals, "protocol")


def auc(predictions: DataFrame) -> DataFrame:
    """(protocol, auc): share of positive-negative pairs in order, ties half; null with a single class."""
    c = curve(predictions)
    wins = F.sum(F.col("n") * (F.col("before_p") + F.col("p") / 2.0))
    return c.groupBy("protocol").agg((wins / F.nullif(F.first("all_p") * F.first("all_n"), F.lit(0))).alias("auc"))


def average_precision(predictions: DataFrame) -> DataFrame:
    """(protocol, ap): gain in recall times precision over distinct thresholds."""
    c = curve(predictions)
    tp, all_ = F.col("before_p") + F.col("p"), F.col("before_p") + F.col("p") + F.col("before_n") + F.col("n")
    return c.groupBy("protocol").agg(F.sum(F.col("p") / F.nullif(F.col("all_p"), F.lit(0)) * (tp / all_)).alias("ap"))


def _discounts(a, b):
    """Sum of 1 / log2(place + 1) over places a + 1 .. b."""
    return F.when(b > a, F.aggregate(F.sequence(a + 1, b), F.lit(0.0), lambda s, i: s + F.lit(1.0) / F.log2((i + 1).cast("double")))).otherwise(0.0)


def ndcg(predictions: DataFrame) -> DataFrame:
    """(protocol, ndcg): one list per protocol, gain by label, ties share their discounts."""
    c = curve(predictions)
    a = F.col("before_p") + F.col("before_n")
    size = F.col("p") + F.col("n")
    rows = c.select("protocol", "all_p", (F.col("p") / size * _discounts(a, a + size)).alias("g"), _discounts(F.col("before_p"), F.col("before_p") + F.col("p")).alias("i"))
    return rows.groupBy("protocol").agg((F.sum("g") / F.nullif(F.sum("i"), F.lit(0.0))).alias("ndcg"))


def mean_reciprocal_rank(predictions: DataFrame) -> DataFrame:
    """(protocol, mrr): mean of 1 / place over all positives in one order by score, ties by pos."""
    rows = predictions.withColumn("down", -F.col("score")).withColumn("one", F.lit(1))
    at = running(rows, "protocol", ["down", "pos"], ["one"])
    return at.filter("label = 1").groupBy("protocol").agg(F.avg(1.0 / (F.col("before_one") + 1)).alias("mrr"))


def precision_f1(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    hit = F.col("score") >= threshold
    tp, fp, fn = F.count_if(hit & (F.col("label") == 1)), F.count_if(hit & (F.col("label") == 0)), F.count_if(~hit & (F.col("label") == 1))
    zero = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    return predictions.groupBy("protocol").agg(zero(tp, tp + fp).alias("precision"), zero(2 * tp, 2 * tp + fp + fn).alias("f1"))


def youden(predictions: DataFrame) -> DataFrame:
    """(protocol, threshold, gain): the score with the largest difference of true and false positive rate, the highest of equals, in 0 .. 1."""
    c = curve(predictions)
    gain = F.round((F.col("before_p") + F.col("p")) / F.col("all_p") - (F.col("before_n") + F.col("n")) / F.col("all_n"), 9)
    best = c.groupBy("protocol").agg(F.max(F.struct(gain.alias("g"), F.col("score"))).alias("b"))
    return best.select("protocol", F.least(F.greatest("b.score", F.lit(0.0)), F.lit(1.0)).alias("threshold"), F.col("b.g").alias("gain"))


def objective(per_protocol: DataFrame, value: str, weights: dict[str, float] | None = None, least: bool = False) -> DataFrame:
    """Weighted mean of a metric over protocols, or its least value."""
    if least:
        return per_protocol.agg(F.min(value).alias("objective"))
    w = F.lit(1.0)
    for k, x in (weights or {}).items():
        w = F.when(F.col("protocol") == k, F.lit(x)).otherwise(w)
    return per_protocol.agg((F.sum(F.col(value) * w) / F.sum(w)).alias("objective"))


def future_hits(negatives: DataFrame, future: DataFrame) -> DataFrame:
    """One row: how many negatives are edges of the future splits, and their share."""
    hits = negatives.join(future.select("nodes").distinct().withColumn("hit", F.lit(1)), "nodes", "left")
    n = F.count(F.lit(1))
    return hits.agg(F.count("hit").alias("hits"), n.alias("samples"), F.when(n == 0, 0.0).otherwise(F.count("hit") / n).alias("hit_rate"))


def negative_quality(samples: DataFrame, low: float = 0.3, high: float = 0.7) -> DataFrame:
    """One row of means over negatives with hardness, similarity to their source, and risks."""
    risks = [c for c in ("nearest", "closure", "cowalk", "hitting", "residual") if c in samples.columns]
    return samples.agg(
        F.avg("hardness").alias("mean_hardness"), F.avg(F.col("hardness").between(low, high).cast("double")).alias("hard_ratio"), F.avg("source_jaccard").alias("mean_source_jaccard"),
        *[F.avg(c).alias(f"mean_{c}") for c in risks],
    )
