"""Pooling and parameter-free propagation of node features (node_id, dim, value) over the incidence, and vector search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave import scratch


def pool(incidence: DataFrame, features: DataFrame) -> DataFrame:
    """(edge_id, dim, mean, max, min, std, log_size): population spread with 1e-8 under the root."""
    v = F.col("value")
    rows = incidence.join(features, "node_id").groupBy("edge_id", "dim")
    return rows.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.sqrt(F.greatest(F.avg(v * v) - F.avg(v) * F.avg(v), F.lit(0.0)) + 1e-8).alias("std"), F.log1p(F.count(F.lit(1)).cast("double")).alias("log_size"))


def spread(incidence: DataFrame, features: DataFrame) -> DataFrame:
    """(edge_id, dim, spread): largest minus smallest value."""
    return pool(incidence, features).select("edge_id", "dim", (F.col("max") - F.col("min")).alias("spread"))


def spreads(incidence: DataFrame, values: DataFrame, names: list[str]) -> DataFrame:
    """(edge_id, names): largest minus smallest of each of the named columns of ``values`` (node_id, names), all of a node in one row."""
    rows = incidence.join(values, "node_id").groupBy("edge_id")
    return rows.agg(*[(F.max(v) - F.min(v)).alias(v) for v in names])


def propagate(incidence: DataFrame, features: DataFrame) -> DataFrame:
    """(node_id, dim, value): mean over a node's edges of their mean values."""
    edges = incidence.join(features, "node_id").groupBy("edge_id", "dim").agg(F.avg("value").alias("value"))
    return incidence.join(edges, "edge_id").groupBy("node_id", "dim").agg(F.avg("value").alias("value"))


def clique_product(expansion: DataFrame, features: DataFrame) -> DataFrame:
    """(node_id, dim, value): an expansion (x, y, weight) times the features."""
    rows = expansion.join(features.withColumnRenamed("node_id", "y"), "y")
    return rows.groupBy(F.col("x").alias("node_id"), "dim").agg(F.sum(F.col("weight") * F.col("value")).alias("value"))


def two_norms(incidence: DataFrame, features: DataFrame) -> DataFrame:
    """(edge_id, dim, mean, scaled): sums over the size and over its root."""
    n = incidence.count()
    met = scratch.dealt(incidence, n, "node_id").join(features, "node_id")
    rows = scratch.dealt(met, 2 * n, "edge_id").groupBy("edge_id", "dim")
    return rows.agg(F.avg("value").alias("mean"), (F.sum("value") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("scaled"))


def weighted_norms(incidence: DataFrame, features: DataFrame, alpha_node: float = -0.5, alpha_edge: float = -0.5) -> DataFrame:
    """(node_id, dim, value): to edges with weights degree ** alpha_node, and back with size ** alpha_edge, each over its sum."""
    degree = incidence.groupBy("node_id").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha_node)).alias("wv"))
    size = incidence.groupBy("edge_id").agg(F.pow(F.count(F.lit(1)).cast("double"), F.lit(alpha_edge)).alias("we"))
    edges = incidence.join(degree, "node_id").join(features, "node_id").groupBy("edge_id", "dim")
    edges = edges.agg((F.sum(F.col("wv") * F.col("value")) / F.sum("wv")).alias("value")).join(size, "edge_id")
    return incidence.join(edges, "edge_id").groupBy("node_id", "dim").agg((F.sum(F.col("we") * F.col("value")) / F.sum("we")).alias("value"))


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "embedding", block: int = 1024) -> DataFrame:
    """(query_id, vec_id, similarity, place): the ``k`` rows of largest cosine for each query, itself left out.

    Queries are dealt into blocks; every batch of rows meets every block as one matrix product, and
    gives its own best ``k`` for each query, of which the best are kept.
    """
    q = queries.select(F.col(id_col).alias("query_id"), F.col(vec_col).alias("query"))
    n = q.count()
    blocks = max(1, -(-n // block))
    q = q.withColumn("b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    q = q.groupBy("b").agg(F.collect_list(F.struct("query_id", "query")).alias("qs"))
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vec_col).alias("vec"), F.pmod(F.xxhash64(id_col), F.lit(64)).alias("part"))
    rows = rows.groupBy("part", F.floor(F.pmod(F.xxhash64(id_col, F.lit(1)), F.lit(max(1, vectors.count() // (64 * 4096) + 1)))).alias("sub")).agg(F.collect_list(F.struct("vec_id", "vec")).alias("vs"))
    met = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(q, "b").select("vs", "qs")

    def unit(x: np.ndarray) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for vs, qs in zip(pdf["vs"], pdf["qs"]):
                vi, qi = np.array([v["vec_id"] for v in vs]), np.array([v["query_id"] for v in qs])
                s = unit(np.array([v["query"] for v in qs], np.float64)) @ unit(np.array([v["vec"] for v in vs], np.float64)).T
                s = np.round(s, 9)
                s[qi[:, None] == vi[None, :]] = -2
                order = np.lexsort((np.broadcast_to(vi, s.shape), -s), axis=1)[:, :k]
                take = np.take_along_axis(s, order, 1)
                out = pd.DataFrame({"query_id": np.repeat(qi, order.shape[1]), "vec_id": vi[order].ravel(), "similarity": take.ravel()})
                yield out[out["similarity"] > -2]

    found = met.mapInPandas(best, "query_id long, vec_id long, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
