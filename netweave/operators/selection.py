"""Normalising, ranking and choosing candidates per source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions import uniform


def _over(c: Column, by: tuple[str, ...]) -> Column:
    return c.over(Window.partitionBy(*by))


def zscore(value: str, *by: str) -> Column:
    """Population z-score within a group; 0 where the spread is at most 1e-12."""
    std = _over(F.stddev_pop(value), by)
    return F.when(std <= 1e-12, 0.0).otherwise((F.col(value) - _over(F.avg(value), by)) / std)


def robust_z(df: DataFrame, value: str, *by: str, out: str = "z") -> DataFrame:
    """Add the distance from the group's median over 1.4826 times its median absolute deviation; 0 without spread."""
    med = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("__med"))
    rows = df.join(med, list(by))
    mad = rows.groupBy(*by).agg(F.percentile(F.abs(F.col(value) - F.col("__med")), F.lit(0.5)).alias("__mad"))
    rows = rows.join(mad, list(by))
    z = F.when(F.col("__mad") * 1.4826 <= 1e-12, 0.0).otherwise((F.col(value) - F.col("__med")) / (F.col("__mad") * 1.4826))
    return rows.withColumn(out, z).drop("__med", "__mad")


def rank_scale(value: str, tie: str, *by: str) -> Column:
    """Place in ascending order, scaled to -1 .. 1; 0 for a single row."""
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    return F.when(n == 1, 0.0).otherwise(2.0 * (F.row_number().over(w.orderBy(value, tie)) - 1) / F.greatest(n - 1, F.lit(1)) - 1.0)


def normalized(df: DataFrame, mode: str, value: str, tie: str, source: str = "source_id", label: str = "label", out: str = "z") -> DataFrame:
    """Add ``out``: none, local_zscore, robust_zscore, local_rank per source; pool_zscore, pool_rank per source and label."""
    if mode == "none":
        return df.withColumn(out, F.col(value))
    if mode == "robust_zscore":
        return robust_z(df, value, source, out=out)
    by = (source, label) if mode.startswith("pool_") else (source,)
    if mode in ("local_zscore", "pool_zscore"):
        return df.withColumn(out, zscore(value, *by))
    if mode in ("local_rank", "pool_rank"):
        return df.withColumn(out, rank_scale(value, tie, *by))
    raise ValueError(f"unknown mode {mode}")


def retrieval_weight(target: float, epoch: int, warmup: int, mode: str = "full") -> tuple[float, float]:
    """(similarity weight, hardness weight) of an epoch; the first grows linearly to its target."""
    bounded = min(1.0, max(0.0, target))
    warm = bounded * min(1.0, epoch / warmup) if warmup > 0 else bounded
    if mode == "no_diffusion_signal":
        return 0.0, 1.0 - warm
    if mode in ("no_diffusion", "hard_only", "no_diffusion_proposal"):
        return 0.0, 1.0
    if mode == "diffusion_only":
        return 1.0, 0.0
    return warm, 1.0 - warm


def top_by(df: DataFrame, k: int, order: list[Column], by: str = "source_id") -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("place") <= k)


def boundary_closest(df: DataFrame, k: int, score: str, low: float, high: float, target: float, tie: str, similarity: str | None = None, weight: float = 0.0) -> DataFrame:
    """Per source the ``k`` candidates in the band first, then nearest to the target score (a similarity lowers the distance), then of higher score."""
    inside = F.col(score).between(low, high)
    distance = F.abs(F.col(score) - target) - (F.lit(weight) * F.col(similarity) if similarity else F.lit(0.0))
    order = [(~inside).cast("int"), distance, *([F.desc(similarity)] if similarity else []), F.desc(score), F.col(tie)]
    return top_by(df, k, order).withColumn("in_band", inside)


def sample_top(df: DataFrame, k: int, pool: int, score: str, temperature: float, tie: str, seed: int = 1) -> DataFrame:
    """Draw ``k`` of the best ``pool`` without replacement by softmax weights: the largest of score / temperature plus Gumbel noise."""
    u = F.greatest(uniform(seed, "gumbel", F.col("source_id"), F.col(tie)), F.lit(1e-9))
    best = top_by(df, max(k, pool), [F.desc(score), F.col(tie)]).drop("place")
    noisy = best.withColumn("key", F.col(score) / F.lit(max(temperature, 1e-6)) - F.log(-F.log(u)))
    return top_by(noisy, k, [F.desc("key"), F.col(tie)])


def first_wins(df: DataFrame, priority: str, key: str = "edge_key") -> DataFrame:
    """A union of pools with each edge of a source once, from the pool of least priority."""
    return df.withColumn("r", F.row_number().over(Window.partitionBy("source_id", key).orderBy(priority))).filter("r = 1").drop("r")


def quotas(df: DataFrame, size: int, weights: DataFrame, by: str = "source_id") -> DataFrame:
    """(source, label, quota): shares of ``size`` by weight (label, weight; 1 where missing), largest remainders first, ties to the larger label.

    Labels of no weight are left out, unless a source has no other.
    """
    have = df.select(by, "label").distinct().join(weights, "label", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    w = Window.partitionBy(by)
    have = have.withColumn("some", F.max((F.col("weight") > 0).cast("int")).over(w)).filter("weight > 0 or some = 0")
    exact = F.lit(float(size)) * F.col("weight") / F.greatest(F.sum("weight").over(w), F.lit(1e-12))
    have = have.withColumn("exact", exact).withColumn("base", F.floor("exact"))
    left = F.lit(size) - F.sum("base").over(w)
    place = F.row_number().over(w.orderBy(F.desc(F.col("exact") - F.col("base")), F.desc("label")))
    return have.select(by, "label", (F.col("base") + F.when(place <= left, 1).otherwise(0)).cast("long").alias("quota"))


def take_by_quota(df: DataFrame, size: int, weights: DataFrame, hardness: str, tie: str, by: str = "source_id") -> DataFrame:
    """Fill each label's quota by hardness, then the rest of ``size`` with the hardest unused; adds ``filled`` (quota or rest)."""
    q = quotas(df, size, weights, by)
    rank = F.row_number().over(Window.partitionBy(by, "label").orderBy(F.desc(hardness), tie))
    rows = df.join(q, [by, "label"], "left").withColumn("in_quota", rank <= F.coalesce("quota", F.lit(0)))
    order = Window.partitionBy(by).orderBy(F.desc("in_quota"), F.desc(hardness), tie)
    rows = rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= size)
    return rows.withColumn("filled", F.when(F.col("in_quota"), "quota").otherwise("rest")).drop("in_quota", "quota")


def partitioned_quota(df: DataFrame, first: int, second: int, weights: DataFrame, hardness: str, tie: str) -> DataFrame:
    """Two disjoint choices by quota; adds ``part`` 0 or 1."""
    a = take_by_quota(df, first, weights, hardness, tie)
    rest = df.join(a.select("source_id", tie), ["source_id", tie], "left_anti")
    return a.withColumn("part", F.lit(0)).unionByName(take_by_quota(rest, second, weights, hardness, tie).withColumn("part", F.lit(1)))


def padded(df: DataFrame, size: int, tie: str, by: str = "source_id") -> DataFrame:
    """Repeat each source's candidates in turn until it has ``size``; adds ``slot``."""
    w = Window.partitionBy(by)
    rows = df.withColumn("__i", F.row_number().over(w.orderBy(tie)) - 1).withColumn("__n", F.count(F.lit(1)).over(w))
    slots = F.sequence(F.col("__i").cast("long"), F.lit(size - 1).cast("long"), F.col("__n").cast("long"))
    return rows.filter(F.col("__i") < size).withColumn("slot", F.explode(slots)).drop("__i", "__n")


def without_teacher(df: DataFrame, teacher: DataFrame, key: str = "edge_key") -> DataFrame:
    return df.join(teacher.select("source_id", key), ["source_id", key], "left_anti")


def replayed(df: DataFrame, bank: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """Replace a share of the slots by the bank's edge of the same source and slot."""
    bank = bank.select("source_id", "slot", F.col("nodes").alias("__nodes"))
    use = (uniform(seed, "replay", F.col("source_id"), F.col("slot")) < share) & F.col("__nodes").isNotNull()
    rows = df.join(bank, ["source_id", "slot"], "left").withColumn("replayed", F.coalesce(use, F.lit(False)))
    return rows.withColumn("nodes", F.when(F.col("replayed"), F.col("__nodes")).otherwise(F.col("nodes"))).drop("__nodes")


def warmed_weights(start: dict[str, float], end: dict[str, float], epoch: int, warmup: int) -> dict[str, float]:
    """Pool weights on the line from ``start`` to ``end``."""
    t = 1.0 if warmup <= 0 else min(1.0, max(0.0, epoch / warmup))
    return {k: start.get(k, 0.0) * (1 - t) + end.get(k, 0.0) * t for k in sorted({*start, *end})}


def batches_for(df: DataFrame, sources: int = 4096) -> int:
    """A number of batches of about so many sources each."""
    return max(1, -(-df.select("source_id").distinct().count() // sources))


def source_mix(df: DataFrame, per_source: int, weights: dict[str, float], score: str, tie: str, batches: int) -> DataFrame:
    """Choose per source while keeping each label's running share near its weight.

    The running counts make the choice sequential; they run within batches of sources, dealt by
    hash, so the sequence of a batch is one task's. Let the number of batches grow with the input, and
    take it from the data (``batches_for``), not from a setting of the session: the choice depends on it.
    """
    import pandas as pd

    total = sum(w for w in weights.values() if w > 0)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # plain lists: a source has few rows, for which a table of its own costs more than the choice
        pdf = pdf.sort_values(["source_id", score, tie], ascending=[True, False, True], kind="stable", ignore_index=True)
        sources, labels = pdf["source_id"].tolist(), pdf["label"].tolist()
        counts: dict[str, int] = {}
        taken, start, n = [], 0, 1
        while start < len(sources):
            end = start + 1
            while end < len(sources) and sources[end] == sources[start]:
                end += 1
            rest = list(range(start, end))
            for _ in range(min(per_source, end - start)):
                first: dict[str, int] = {}  # of each label with a weight its best row
                for i in rest:
                    if labels[i] not in first and weights.get(labels[i], 0) > 0:
                        first[labels[i]] = i
                if first:
                    label = max(sorted(first), key=lambda k: (weights[k] * n / total - counts.get(k, 0), weights[k]))
                    chosen = first[label]
                else:
                    chosen = rest[0]
                    label = labels[chosen]
                rest.remove(chosen)
                counts[label] = counts.get(label, 0) + 1
                n += 1
                taken.append(chosen)
            start = end
        return pdf.loc[taken].drop(columns="batch")

    rows = df.withColumn("batch", F.pmod(F.xxhash64("source_id"), F.lit(batches)))
    return rows.groupBy("batch").applyInPandas(run, df.schema)
