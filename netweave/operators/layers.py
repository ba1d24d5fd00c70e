"""Layers with given weights over nodes (node_id, vec) and incidence (edge_id, node_id): attention pooling, deep-sets layers, set statistics and a predictor on them.

Messages are joins and aggregates, one aggregate per dimension; dense maps are matrix products over Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import dot
from netweave.operators import representations

ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "none": lambda x: x, "relu": lambda x: np.maximum(x, 0.0), "tanh": np.tanh, "sigmoid": lambda x: 1.0 / (1.0 + np.exp(-x)),
    "gelu": lambda x: 0.5 * x * (1.0 + np.tanh(np.sqrt(2.0 / np.pi) * (x + 0.044715 * x**3))),
}


@dataclass(frozen=True)
class Dense:
    """A dense map: ``weight`` has a row for each output."""

    weight: tuple[tuple[float, ...], ...]
    bias: tuple[float, ...]
    activation: str = "none"

    def __post_init__(self) -> None:
        if self.activation not in ACTIVATIONS:
            raise ValueError(f"unknown activation {self.activation}")
        if len(self.bias) != len(self.weight):
            raise ValueError("a bias for each output is needed")

    def __call__(self, column: Column) -> Column:
        """The mapped column of arrays; null stays null."""
        weight, bias, act = np.array(self.weight, float), np.array(self.bias, float), ACTIVATIONS[self.activation]

        @F.pandas_udf("array<double>")
        def mapped(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                known = s[s.notna()]
                rows = act(np.stack(known.to_numpy()).astype(float) @ weight.T + bias) if len(known) else []
                yield pd.Series(list(rows), index=known.index, dtype=object).reindex(s.index)

        return mapped(column)


def layer_norm(column: Column, gain: list[float] | None = None, shift: list[float] | None = None, eps: float = 1e-5) -> Column:
    """Components less their mean, over their spread, times ``gain`` plus ``shift``."""
    n = F.size(column).cast("double")
    mean = F.aggregate(column, F.lit(0.0), lambda s, x: s + x) / n
    var = F.aggregate(column, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n
    lit = lambda v, i, d: F.lit(d) if v is None else F.element_at(F.array(*[F.lit(float(x)) for x in v]), i + 1)
    return F.transform(column, lambda x, i: (x - mean) / F.sqrt(var + eps) * lit(gain, i, 1.0) + lit(shift, i, 0.0))


def _sums(rows: DataFrame, keys: list[str], vector: str, weight: Column, dim: int, out: str) -> DataFrame:
    """(keys, out, __w): the weighted sum of vectors of each group, and the sum of weights."""
    part = [F.sum(weight * F.get(vector, F.lit(k)).cast("double")).alias(f"__m{k}") for k in range(dim)]
    sums = rows.groupBy(*keys).agg(*part, F.sum(weight).alias("__w"))
    return sums.select(*keys, F.array(*[F.col(f"__m{k}") for k in range(dim)]).alias(out), "__w")


def attention_pool(incidence: DataFrame, nodes: DataFrame, query: list[float], scale: float | None = None) -> DataFrame:
    """(edge_id, rep): the mean of an edge's node vectors by a softmax of their products with ``query`` over ``scale`` (default: the root of the dimension).

    The softmax is taken against the edge's largest logit, so large logits do no harm: a first aggregate gives the largest, a second one the sums. Nodes
    without a vector take no part; edges of such nodes alone have no row.
    """
    dim = len(query)
    by = float(dim) ** 0.5 if scale is None else scale
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = incidence.join(nodes.select("node_id", "vec", (dot(F.col("vec"), q) / by).alias("logit")), "node_id").filter(F.col("vec").isNotNull())
    most = rows.groupBy("edge_id").agg(F.max("logit").alias("most"))
    rows = rows.join(most, "edge_id")
    sums = _sums(rows, ["edge_id"], "vec", F.exp(F.col("logit") - F.col("most")), dim, "sum")
    return sums.select("edge_id", F.transform("sum", lambda x: x / F.col("__w")).alias("rep"))


def deepsets_layer(nodes: DataFrame, incidence: DataFrame, node_phi: Dense, edge_rho: Dense, edge_phi: Dense, node_rho: Dense, norm: Callable[[Column], Column] = layer_norm) -> DataFrame:
    """(node_id, vec) after a layer of two deep sets: nodes to edges and back.

    An edge is ``edge_rho`` of the mean of its mapped nodes beside their sum over the root of its size; a node adds ``node_rho`` of itself beside the mean of its mapped
    edges, and is normed. Nodes of no edge meet zeros.
    """
    width, out = len(node_phi.weight), len(edge_phi.weight)
    mapped = scratch.materialize(nodes.select("node_id", node_phi(F.col("vec")).alias("t")), "mapped_nodes")
    sums = _sums(incidence.join(mapped, "node_id"), ["edge_id"], "t", F.lit(1.0), width, "sum")
    both = F.concat(F.transform("sum", lambda x: x / F.col("__w")), F.transform("sum", lambda x: x / F.sqrt("__w")))
    edges = sums.select("edge_id", both.alias("both"))
    edges = scratch.materialize(edges.select("edge_id", edge_rho(F.col("both")).alias("c")), "edge_context")
    edges = scratch.materialize(edges.select("edge_id", edge_phi(F.col("c")).alias("u")), "mapped_edges")
    back = _sums(incidence.join(edges, "edge_id"), ["node_id"], "u", F.lit(1.0), out, "sum").select("node_id", F.transform("sum", lambda x: x / F.col("__w")).alias("ctx"))
    zeros = F.array(*[F.lit(0.0)] * out)
    beside = nodes.join(back, "node_id", "left").select("node_id", "vec", F.concat(F.transform("vec", lambda x: x.cast("double")), F.coalesce("ctx", zeros)).alias("beside"))
    updated = scratch.materialize(beside.select("node_id", "vec", node_rho(F.col("beside")).alias("update")), "updated")
    return updated.select("node_id", norm(F.zip_with("vec", "update", lambda a, b: a + b)).alias("vec"))


def smoothed_vectors(incidence: DataFrame, dim: int = 16, rounds: int = 2, keep: float = 0.1, seed: int | str = 1) -> DataFrame:
    """(node_id, vec): random unit vectors of the nodes, averaged over the edges and back, ``rounds`` times; a share ``keep`` of the start stays in each.

    Nodes that share edges come near each other. What all nodes have in common (the mean) is taken out each time, and vectors have length 1 again.
    """
    ids = incidence.select("node_id").distinct()
    start = scratch.materialize(representations.random_vectors(ids.withColumnRenamed("node_id", "source_id"), dim, seed).withColumnRenamed("source_id", "node_id"), "start")
    now = start
    for _ in range(rounds):
        # dealt by edge before they are summed: rows of one node stand together and pack well, sums of few rows do not
        edges = representations.means(incidence.join(now, "node_id").select("edge_id", "vec").repartition("edge_id"), ["edge_id"], "vec", dim)
        back = scratch.materialize(representations.means(incidence.join(edges, "edge_id"), ["node_id"], "rep", dim), "smoothed")
        middle = representations.prototype(back, dim)
        moved = back.join(F.broadcast(middle)).join(start.withColumnRenamed("vec", "first"), "node_id")  # one row
        moved = moved.select("node_id", F.zip_with(F.zip_with("rep", "proto", lambda a, b: a - b), "first", lambda a, b: a + F.lit(keep) * b).alias("v"))
        norm = F.greatest(F.sqrt(dot(F.col("v"), F.col("v"))), F.lit(1e-12))
        now = scratch.materialize(moved.select("node_id", F.transform("v", lambda x: x / norm).alias("vec")), "vectors")
    return now


def set_statistics(sets: DataFrame, vectors: DataFrame, dim: int, kinds: tuple[str, ...] = ("mean", "max", "min", "std")) -> DataFrame:
    """(nodes, features): of each distinct set the named statistics of its nodes' vectors, dimension by dimension, then the logarithm of one more than its size.

    Nodes without a vector count as zeros.
    """
    sets = sets.select("nodes").distinct().withColumn("__set", F.xxhash64("nodes"))
    return sets.join(_statistics(sets, vectors, dim, kinds), "__set").select("nodes", "features")


def _statistics(sets: DataFrame, vectors: DataFrame, dim: int, kinds: tuple[str, ...]) -> DataFrame:
    """(__set, features) of distinct sets (nodes, __set). A vector moves to each set it is in, beside the set's number; the many sums of a set do not move, nor do its nodes."""
    rows = sets.select("__set", F.explode("nodes").alias("node_id")).join(vectors.select("node_id", "vec"), "node_id", "left").select("__set", "vec").repartition("__set")
    at = lambda k: F.coalesce(F.get("vec", F.lit(k)).cast("double"), F.lit(0.0))
    make = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_pop}
    if unknown := set(kinds) - set(make):
        raise ValueError(f"unknown statistics {sorted(unknown)}")
    stats = rows.groupBy("__set").agg(*[make[s](at(k)).alias(f"{s}_{k}") for s in kinds for k in range(dim)], F.count(F.lit(1)).alias("__n"))
    named = [F.col(f"{s}_{k}") for s in kinds for k in range(dim)]
    return stats.select("__set", F.array(*named, F.log1p(F.col("__n").cast("double"))).alias("features"))


class SetPredictor:
    """A multilayer perceptron on set statistics that tells known sets from others; trained on Spark, whose tasks add up their gradients."""

    def __init__(self, hidden: tuple[int, ...] = (32,), kinds: tuple[str, ...] = ("mean", "max", "min", "std"), iterations: int = 60, seed: int = 1):
        self.hidden, self.kinds, self.iterations, self.seed = hidden, kinds, iterations, seed

    def _features(self, sets: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
        sets = sets.withColumn("__set", F.xxhash64("nodes"))
        stats = _statistics(sets.select("__set", "nodes").dropDuplicates(["__set"]), vectors, dim, self.kinds)
        return sets.join(stats, "__set").withColumn("raw", array_to_vector("features")).drop("features", "__set")

    def fit(self, labelled: DataFrame, vectors: DataFrame, dim: int) -> SetPredictor:
        """Fit on (nodes, label 0 or 1). Raises ValueError without both labels."""
        rows = scratch.as_files(labelled.select("nodes", F.col("label").cast("double").alias("label")), "labelled")
        if rows.select("label").distinct().count() < 2:
            raise ValueError("both labels are needed")
        self.dim = dim
        # written once, for the scaler and the model
        rows = scratch.materialize(self._features(rows, vectors, dim).select("raw", "label"), "statistics")
        self.scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(rows)
        width = len(self.kinds) * dim + 1
        model = MultilayerPerceptronClassifier(layers=[width, *self.hidden, 2], maxIter=self.iterations, seed=self.seed, blockSize=128)
        # the order of rows within tasks decides the order of sums, so it is fixed
        self.model = model.fit(scratch.materialize(self.scaler.transform(rows).select("features", "label"), "training"))
        return self

    def score(self, sets: DataFrame, vectors: DataFrame) -> DataFrame:
        """``sets`` with score, the chance of a known set."""
        rows = self.scaler.transform(self._features(sets, vectors, self.dim))
        self.model.setPredictionCol("")
        self.model.setRawPredictionCol("")
        return self.model.transform(rows).withColumn("score", vector_to_array("probability")[1]).drop("raw", "features", "probability")
