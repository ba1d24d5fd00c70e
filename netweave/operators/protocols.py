"""Validation batches by protocol, their evaluation, checks of stored negative banks, and how sources are dealt."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import draw
from netweave.operators import samplers
from netweave.operators.metrics import curve, future_hits, mean_reciprocal_rank, ndcg, precision_f1
from netweave.sources.hyperedges import place_of


def batches(positives: DataFrame, negatives: DataFrame, protocols: tuple[str, ...]) -> DataFrame:
    """One batch for each protocol: all positives with label 1, and the protocol's own negatives with label 0.

    Negatives of other protocols are left out. Without negatives a batch has positives only.
    """
    names = F.explode(F.array(*[F.lit(p) for p in protocols]))
    known = positives.drop("protocol", "label").withColumn("protocol", names).withColumn("label", F.lit(1))
    own = negatives.drop("label").filter(F.col("protocol").isin(*protocols)).withColumn("label", F.lit(0))
    return known.unionByName(own)


def evaluate(predictions: DataFrame) -> DataFrame:
    """(protocol, positives, negatives, auc, ap) from one curve; a batch of a single class has null AUC and AP."""
    c = curve(predictions)
    wins = F.sum(F.col("n") * (F.col("before_p") + F.col("p") / 2.0))
    tp = F.col("before_p") + F.col("p")
    gain = F.col("p") / F.nullif(F.col("all_p"), F.lit(0)) * (tp / (tp + F.col("before_n") + F.col("n")))
    p, n = F.first("all_p"), F.first("all_n")
    return c.groupBy("protocol").agg(p.alias("positives"), n.alias("negatives"), (wins / F.nullif(p * n, F.lit(0))).alias("auc"), F.when(n > 0, F.sum(gain)).alias("ap"))


def evaluate_all(predictions: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(protocol, positives, negatives, auc, ap, ndcg, mrr, precision, f1) of predictions (protocol, pos, label, score).

    A batch of a single class has null AUC, AP and NDCG, as these have no meaning there.
    """
    rows = scratch.materialize(predictions.select("protocol", "pos", "label", "score"), "predictions")
    two = F.col("auc").isNotNull()
    out = evaluate(rows).join(ndcg(rows), "protocol").join(mean_reciprocal_rank(rows), "protocol", "left").join(precision_f1(rows, threshold), "protocol")
    return out.withColumn("ndcg", F.when(two, F.col("ndcg"))).na.fill(0.0, ["mrr"])


def objectives(evaluated: DataFrame, weights: dict[str, float] | None = None, auc_weight: float = 0.5, ap_weight: float = 0.5) -> DataFrame:
    """One row with the six figures a checkpoint is chosen by: weighted means and least values of AUC, AP and their mix.

    Protocols of a single class have none of these and count in none of the means.
    """
    w = F.lit(1.0)
    for k, x in (weights or {}).items():
        w = F.when(F.col("protocol") == k, F.lit(max(0.0, x))).otherwise(w)
    a, b = max(0.0, auc_weight), max(0.0, ap_weight)
    mix = (F.lit(a) * F.col("auc") + F.lit(b) * F.col("ap")) / F.lit(max(1e-12, a + b))
    rows = evaluated.filter(F.col("auc").isNotNull() & F.col("ap").isNotNull()).select(w.alias("w"), "auc", "ap", mix.alias("auc_ap"))
    mean = lambda c: F.coalesce(F.sum(F.col(c) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0.0)), F.lit(0.0)).alias(f"mean_{c}")
    least = lambda c: F.coalesce(F.min(c), F.lit(0.0)).alias(f"min_{c}")
    return rows.agg(*[f(c) for c in ("auc", "ap", "auc_ap") for f in (mean, least)])


def bank_violations(bank: DataFrame, sources: DataFrame, positives: DataFrame, per_source: int, num_nodes: int) -> DataFrame:
    """One row of counts, all 0 for a bank that fits: a stored bank (source_id, nodes) against its sources (edge_id, size).

    sources_missing and sources_unknown: not aligned; wrong_count: sources with another number of rows than ``per_source``;
    wrong_size, out_of_range and known_edges: rows whose distinct nodes are not as many as the source's, that have a node outside
    0 .. num_nodes - 1, and that are among the positives. Null nodes are of the wrong size.
    """
    ids = sources.select(F.col("edge_id").alias("source_id"), F.col("size").alias("want"))
    held = bank.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).join(ids, "source_id", "full")
    aligned = held.agg(
        F.count_if(F.col("n").isNull()).alias("sources_missing"),
        F.count_if(F.col("want").isNull()).alias("sources_unknown"),
        F.count_if(F.col("n").isNotNull() & (F.col("n") != per_source)).alias("wrong_count"),
    )
    nodes = F.array_sort(F.array_distinct("nodes"))
    known = positives.select(F.array_sort(F.array_distinct("nodes")).alias("key")).distinct().withColumn("known", F.lit(1))
    rows = bank.select("source_id", nodes.alias("key")).join(ids, "source_id", "left").join(known, "key", "left")
    outside = F.exists("key", lambda v: (v < 0) | (v >= num_nodes))
    checked = rows.agg(
        F.count_if(F.col("want").isNotNull() & F.coalesce(F.size("key") != F.col("want"), F.lit(True))).alias("wrong_size"),
        F.count_if(F.coalesce(outside, F.lit(False))).alias("out_of_range"),
        F.count_if(F.col("known").isNotNull()).alias("known_edges"),
    )
    return aligned.join(F.broadcast(checked))  # one row each


def sample_sources(edges: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """``n`` edges without replacement, those of smallest draw; all of them if there are fewer."""
    return edges.withColumn("__d", draw(seed, "source", F.col("edge_id"))).orderBy("__d", "edge_id").limit(n).drop("__d")


def future_probe(train: DataFrame, future: DataFrame, nodes: int, count: int = 256, name: str = "sns", per_source: int = 1, seed: int = 1, **options) -> DataFrame:
    """(hits, samples, hit_rate): how many negatives that a sampler gives for ``count`` drawn training edges are edges of the future."""
    sources = scratch.materialize(sample_sources(train, count, seed), "probed")
    return future_hits(samplers.sampler(name)(sources, train, nodes, per_source=per_source, seed=seed, **options), future)


def minibatches(edges: DataFrame, size: int, seed: int = 1) -> DataFrame:
    """(edge_id, batch): edges in drawn order, ``size`` a batch; what belongs to an edge follows it by a join."""
    rows = edges.select("edge_id", draw(seed, "batch", F.col("edge_id")).alias("__d"))
    return place_of(rows, ["__d", "edge_id"]).select("edge_id", F.floor(F.col("place") / size).cast("long").alias("batch"))


def teacher_retrieval(items: DataFrame, teacher: int, retrieval: int, order: list) -> DataFrame:
    """Adds place and role: of each source's items in order the first ``teacher``, then ``retrieval`` more; the rest go."""
    place = F.row_number().over(Window.partitionBy("source_id").orderBy(*order))
    rows = items.withColumn("place", place).filter(F.col("place") <= teacher + retrieval)
    return rows.withColumn("role", F.when(F.col("place") <= teacher, "teacher").otherwise("retrieval"))
