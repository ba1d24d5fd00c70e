"""All queries over the hypergraph tables, with their SQL twins.

Orders are edges over parts (H1) unless a query says otherwise. Doubles are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import cosine, dot, edge_key, set_jaccard, uniform
from netweave.operators import calibration, indexes, losses, metrics, propagation, proposals, protocols, risks, samplers, selection
from netweave.plans import oracles, training
from netweave.session import table
from netweave.sources import hyperedges as H
from netweave.streaming import support

#: Neighbours kept for each node.
TOP = 128
BOUNDS = {"nearest": 0.25, "closure": 0.35, "residual": 0.5}


def r6(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def edges(spark: SparkSession, d: str) -> DataFrame:
    return H.basket_edges(spark, d)


def kept_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges, written once for queries that read them many times."""
    return scratch.materialize(edges(spark, d), "edges")


def cands(spark: SparkSession, d: str) -> DataFrame:
    return risks.as_candidates(edges(spark, d))


def splits(spark: SparkSession, d: str) -> DataFrame:
    return H.random_split(H.distinct_edges(edges(spark, d)).select("edge_id", "nodes", "size"))


def listed(df: DataFrame) -> DataFrame:
    """Samples with their nodes as text."""
    return df.withColumn("edge", edge_key(F.col("nodes"))).drop("nodes")


def pool_items(spark: SparkSession, d: str) -> DataFrame:
    """Candidates per order: its lines, with a label, a score and an item key."""
    key = F.concat_ws(":", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), key.alias("item"), F.col("l_returnflag").alias("label"), F.col("l_extendedprice").alias("value"), (F.col("l_extendedprice") / 105000.0).alias("score")
    )


def predictions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "F").cast("int").alias("label"), F.round(F.col("o_totalprice") / 500000.0, 3).alias("score"), F.col("o_orderpriority").alias("protocol")
    )


def logits(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("source_id"), (F.col("l_returnflag") == "R").cast("int").alias("label"), (F.col("l_quantity") / 10.0 - 2.5).alias("logit"), (1.0 - F.col("l_discount")).alias("weight")
    )


def node_values(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), (F.col("p_size") / 49.0).alias("v0"), F.log("p_retailprice").alias("v1"))


def node_features(spark: SparkSession, d: str) -> DataFrame:
    dims = F.array(*[F.struct(F.lit(k).alias("dim"), F.col(f"v{k}").alias("value")) for k in (0, 1)])
    return node_values(spark, d).select("node_id", F.explode(dims).alias("f")).select("node_id", "f.dim", "f.value")


def parts_count(spark: SparkSession, d: str) -> int:
    return H.num_nodes(table(spark, d, "lineitem").select(F.col("l_partkey").alias("node_id")))


def _sampled(name: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, d: str) -> DataFrame:
        e = kept_edges(spark, d)
        out = samplers.sampler(name)(e, e, parts_count(spark, d), **options)
        return listed(out.select("source_id", "slot", "nodes", "attempt"))

    return query


def load_canonical(spark, d):
    return listed(H.distinct_edges(edges(spark, d)))


def size_histogram(spark, d):
    return edges(spark, d).groupBy("size").agg(F.count(F.lit(1)).alias("edges"))


def rule_violations(spark, d):
    return H.violations(edges(spark, d), parts_count(spark, d))


def random_split(spark, d):
    return splits(spark, d).select("edge_id", "split")


def cover_aware_split(spark, d):
    return H.cover_aware_split(H.distinct_edges(edges(spark, d)).select("edge_id", "nodes", "size")).select("edge_id", "split")


def synthetic(spark, d):
    return listed(H.synthetic(spark, 400, 800, 4, 3, 6, 0.8))


def pair_sketch(spark, d):
    return indexes.edge_pairs(H.edges_of(H.baskets(spark, d, "l_partkey", "l_suppkey")), 64)


def nodes_of(spark, d):
    return H.baskets(spark, d).select("node_id").distinct()


def _risk(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: r6(f(edges(spark, d), cands(spark, d)), "risk")


def cowalk_risk(spark, d):
    e = kept_edges(spark, d)
    return risks.co_walk(e, risks.as_candidates(e), TOP)


def hitting_risk(spark, d):
    """Over all neighbours of each node."""
    e = kept_edges(spark, d)
    return risks.hitting(e, risks.as_candidates(e), 0)


def combined_risk(spark, d):
    e, c = edges(spark, d), cands(spark, d)
    rows = risks.nearest(e, c, F.col("nodes")).withColumnRenamed("risk", "nearest").join(risks.closure(e, c).withColumnRenamed("risk", "closure"), "cand_id").join(risks.residual(e, c).withColumnRenamed("risk", "residual"), "cand_id")
    rows = r6(rows, "nearest", "closure", "residual")
    caps = {k: 2 * v for k, v in BOUNDS.items()}
    out = rows.select("cand_id", risks.combined(BOUNDS).alias("score"), risks.within(caps).alias("safe"), risks.rejection_reason(BOUNDS, 3.0, caps).alias("reason"))
    return r6(out, "score")


def all_risks(spark, d):
    e = kept_edges(spark, d)
    return r6(risks.all_risks(e, risks.as_candidates(e), TOP), *risks.NAMES)


def risk_controlled(spark, d):
    e = kept_edges(spark, d)
    out = samplers.risk_controlled(e, e, parts_count(spark, d), {"nearest": 0.3, "closure": 0.35}, tries=4, every=True)
    return r6(listed(out.drop("strategy", "size")), "score", "nearest", "closure")


def risk_controlled_near(spark, d):
    e = kept_edges(spark, d)
    pool = indexes.replacement_pool(e, TOP, 16)
    out = samplers.risk_controlled(e, e, parts_count(spark, d), {"nearest": 0.3, "closure": 0.35}, budget=1.5, caps={"nearest": 0.6}, tries=4, pool=pool, pool_share=0.5)
    return samplers.diagnostics(out, ("nearest", "closure"))


def mixed(spark, d):
    e = kept_edges(spark, d)
    return listed(samplers.mixed(e, e, parts_count(spark, d)))


def motif(spark, d):
    e = kept_edges(spark, d)
    return listed(samplers.motif(e, e, parts_count(spark, d)).select("source_id", "slot", "nodes", "fallback"))


def star_negatives(spark, d):
    e = kept_edges(spark, d)
    return listed(proposals.star_negatives(e, e, parts_count(spark, d)).select("source_id", "slot", "nodes", "fallback"))


def node_risks(spark, d):
    e = kept_edges(spark, d)
    support = scratch.materialize(indexes.pair_support(e), "support")  # read for the neighbours and for the risks
    return proposals.node_risks(proposals.anchor_pool(e, e, support=support).drop("source"), e, support=support)


def anchor_node_risks(spark, d):
    return r6(node_risks(spark, d).select("source_id", "node_id", "support", "place", "closure", "residual"), "closure", "residual")


def risk_aware_pool(spark, d):
    return r6(proposals.risk_aware_pool(node_risks(spark, d)).select("source_id", "node_id", "risk", "rank"), "risk")


def residual_safe_pool(spark, d):
    return r6(proposals.residual_safe_pool(node_risks(spark, d)).select("source_id", "node_id", "distance", "rank"), "distance")


def diffusion_mixed(spark, d):
    return listed(proposals.diffusion_mixed(node_risks(spark, d), edges(spark, d)))


def boundary_guided(spark, d):
    """Guided by the structure of the known edges: a set's closure over one more than it."""
    e = kept_edges(spark, d)
    scorer = lambda rows: rows.withColumn("score", F.round(F.col("closure") / (1 + F.col("closure")), 6))
    out = proposals.boundary_guided(e, e, parts_count(spark, d), scorer, {"nearest": 0.3, "closure": 0.35}, target=0.2, band=(0.1, 0.3), multipliers={"nearest": 0.1, "closure": 0.1})
    return r6(listed(out.drop("size")), "risk", "nearest", "closure")


def proposal_diagnostics(spark, d):
    """Each vector as a proposal for the one before it: mean cosine and norms."""
    v = table(spark, d, "embeddings")
    pairs = v.select("vec_id", F.col("embedding").alias("a")).join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    norm = lambda c: F.sqrt(dot(F.col(c), F.col(c)))
    out = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.avg(cosine(F.col("a"), F.col("b"))).alias("cosine"), F.avg(norm("a")).alias("norm"), F.avg(norm("b")).alias("proposal_norm"))
    return r6(out, "cosine", "norm", "proposal_norm")


def future_hits(spark, d):
    s = scratch.materialize(splits(spark, d), "split")
    negatives = samplers.uniform_edges(s.filter("split = 'train'"), s.filter("split = 'train'"), parts_count(spark, d))
    return r6(metrics.future_hits(negatives, s.filter("split <> 'train'")), "hit_rate")


def negative_quality(spark, d):
    """Half-corrupted orders: how hard they are by their closure over one more than it, how near their source and other orders, and their closure."""
    e = kept_edges(spark, d)
    s = samplers.half_corruption(e, e, parts_count(spark, d))
    own = e.select(F.col("edge_id").alias("cand_id"), F.col("nodes").alias("source"))
    c = scratch.materialize(s.select(F.col("source_id").alias("cand_id"), "nodes", "size").join(own, "cand_id"), "sampled")
    rows = c.join(risks.closure(e, c).withColumnRenamed("risk", "closure"), "cand_id").join(risks.nearest(e, c, F.col("source")).withColumnRenamed("risk", "nearest"), "cand_id")
    rows = rows.select("closure", "nearest", set_jaccard(F.col("nodes"), F.col("source")).alias("source_jaccard"), (F.col("closure") / (1 + F.col("closure"))).alias("hardness"))
    out = metrics.negative_quality(rows, 0.1, 0.3)
    return r6(out, *out.columns)


def _items(f) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(pool_items(spark, d))


def _z(mode: str):
    return _items(lambda p: r6(selection.normalized(p, mode, "value", "item").select("source_id", "item", "z"), "z"))


def retrieval_score(spark, d):
    a, b = selection.retrieval_weight(0.6, 3, 5)
    rows = selection.normalized(pool_items(spark, d), "local_zscore", "value", "item")
    return r6(rows.select("source_id", "item", (F.lit(a) * F.col("z") + F.lit(b) * F.col("score")).alias("combined")), "combined")


def boundary(spark, d):
    return selection.boundary_closest(pool_items(spark, d), 2, "score", 0.3, 0.7, 0.5, "item").select("source_id", "item", "place", "in_band")


def embedding_boundary(spark, d):
    rows = pool_items(spark, d).withColumn("similarity", F.round(uniform("similarity", F.col("source_id"), F.col("item")), 6))
    return selection.boundary_closest(rows, 2, "score", 0.3, 0.7, 0.5, "item", "similarity", 0.5).select("source_id", "item", "place", "in_band")


def softmax_sample(spark, d):
    return selection.sample_top(pool_items(spark, d), 2, 5, "score", 0.8, "item").select("source_id", "item", "place")


def _weights(spark):
    return spark.createDataFrame([("A", 4.0), ("N", 2.0), ("R", 0.0)], "label string, weight double")


def quota_select(spark, d):
    return selection.take_by_quota(pool_items(spark, d), 3, _weights(spark), "value", "item").select("source_id", "item", "place", "filled")


def quota_parts(spark, d):
    return selection.partitioned_quota(pool_items(spark, d), 2, 2, _weights(spark), "value", "item").select("source_id", "item", "part", "place")


def padded_slots(spark, d):
    return selection.padded(pool_items(spark, d), 6, "item").select("source_id", "item", "slot")


def union_dedup(spark, d):
    li = table(spark, d, "lineitem")
    pools = li.select(F.col("l_orderkey").alias("source_id"), F.col("l_suppkey").alias("edge_key"), F.struct("l_returnflag", "l_linestatus", "l_partkey", "l_extendedprice").alias("priority"))
    return selection.first_wins(pools, "priority").select("source_id", "edge_key", F.col("priority.l_returnflag").alias("pool"))


def teacher_exclusion(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.col("l_partkey").alias("edge_key"), "l_returnflag")
    return selection.without_teacher(li, li.filter("l_returnflag = 'A'")).select("source_id", "edge_key", F.col("l_returnflag").alias("label"))


def teacher_pick(spark, d):
    return selection.top_by(pool_items(spark, d), 1, [F.desc("score"), F.col("item")]).select("source_id", "item")


def replay(spark, d):
    rows = pool_items(spark, d).withColumn("slot", F.row_number().over(_slots())).select("source_id", "slot", F.col("item").alias("nodes"))
    bank = rows.filter("slot % 2 = 1").withColumn("nodes", F.concat(F.lit("bank:"), "nodes"))
    return selection.replayed(rows, bank, 0.4).select("source_id", "slot", "nodes", "replayed")


def _slots():
    from pyspark.sql import Window

    return Window.partitionBy("source_id").orderBy("item")


def source_mix(spark, d):
    items = pool_items(spark, d)
    return selection.source_mix(items, 2, {"A": 90.0, "N": 6.0, "R": 4.0}, "score", "item", selection.batches_for(items)).select("source_id", "item", "label")


def _metric(f, *names: str):
    return lambda spark, d: r6(f(predictions(spark, d)), *names)


def checkpoint_objective(spark, d):
    per = metrics.auc(predictions(spark, d))
    a = metrics.objective(per, "auc", {"1-URGENT": 3.0}).withColumnRenamed("objective", "weighted")
    b = metrics.objective(per, "auc", least=True).withColumnRenamed("objective", "least")
    return r6(a.join(F.broadcast(b)), "weighted", "least")  # one row each


PROTOCOLS = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def evaluated(spark, d):
    p = predictions(spark, d)
    return protocols.evaluate(protocols.batches(p.filter("label = 1"), p.filter("label = 0"), PROTOCOLS))


def validation_batches(spark, d):
    p = predictions(spark, d)
    return protocols.batches(p.filter("label = 1"), p.filter("label = 0"), PROTOCOLS).select("protocol", "pos", "label", "score")


def checkpoint_objectives(spark, d):
    out = protocols.objectives(evaluated(spark, d), {"1-URGENT": 3.0}, 0.25, 0.75)
    return r6(out, *out.columns)


def bank_violations(spark, d):
    """Each line's part and supplier as a stored negative of its order, held against the orders of at least two parts."""
    bank = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.array("l_partkey", "l_suppkey").alias("nodes"))
    e = edges(spark, d)
    return protocols.bank_violations(bank, e.filter("size >= 2"), e, 4, 1500)


def nearest_mean(spark, d):
    return risks.nearest(edges(spark, d), cands(spark, d), F.col("nodes")).agg(F.round(F.avg("risk"), 6).alias("mean_nearest"))


def observed(spark, d):
    e = kept_edges(spark, d)
    s = samplers.anchored(e, e, parts_count(spark, d), per_source=1)
    c = scratch.materialize(s.select(F.col("source_id").alias("cand_id"), "nodes", "size"), "sampled")
    rows = risks.closure(e, c).withColumnRenamed("risk", "closure").join(risks.residual(e, c).withColumnRenamed("risk", "residual"), "cand_id")
    return scratch.materialize(r6(rows, "closure", "residual"), "observed")


def calibrated_bounds(spark, d):
    out = calibration.bounds(observed(spark, d), ("closure", "residual"), q=0.9)
    return r6(out, *out.columns)


def calibrated_budget(spark, d):
    o = observed(spark, d)
    return r6(calibration.budget(o, calibration.bounds(o, ("closure", "residual"), q=0.9), ("closure", "residual"), 0.8), "budget")


def normalized_rows(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("vec"))
    rows = H.normalized_features(v).select("node_id", F.posexplode("vec").alias("dim", "value"))
    return r6(rows, "value")


def edge_pool(spark, d):
    out = propagation.pool(H.baskets(spark, d), node_features(spark, d))
    return r6(out, "mean", "max", "min", "std", "log_size")


def propagated(f):
    return lambda spark, d: r6(f(H.baskets(spark, d), node_features(spark, d)), "value")


def edge_norms(spark, d):
    return r6(propagation.two_norms(H.baskets(spark, d), node_features(spark, d)), "mean", "scaled")


def clique_product(spark, d):
    e = indexes.clique_expansion(edges(spark, d), nodes_of(spark, d)).withColumnRenamed("value", "weight")
    return r6(propagation.clique_product(e, node_features(spark, d)), "value")


def cosine_topk(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return r6(propagation.nearest_vectors(v, v.filter("vec_id % 100 = 0"), 10), "similarity")


def loss_bce_gce(spark, d):
    rows = logits(spark, d)
    return r6(losses.bce(rows).join(F.broadcast(losses.gce(rows))), "bce", "gce")  # one row each


def loss_nnpu(spark, d):
    return r6(losses.nnpu(logits(spark, d)), "prior", "nnpu")


def loss_pairwise(spark, d):
    return r6(losses.pairwise(logits(spark, d)), "pairwise")


def loss_weights(spark, d):
    rows = combined_risk(spark, d)
    return r6(rows.select("cand_id", losses.risk_weight(F.col("score"), 3.0).alias("weight")), "weight")


def predictor(spark, d):
    """AUC of a logistic regression that tells known edges from sampled ones by closure, spread and size, on held-out edges."""
    known = scratch.materialize(H.distinct_edges(edges(spark, d)).select("edge_id", "nodes", "size"), "edges")
    split, n = H.splitter(known), parts_count(spark, d)
    c = samplers.uniform_edges(known, known, n).select((-1 - F.col("source_id")).alias("cand_id"), "nodes", "size", F.lit(0).alias("label"), F.col("source_id").alias("of"))
    c = c.unionByName(known.select(F.col("edge_id").alias("cand_id"), "nodes", "size", F.lit(1).alias("label"), F.col("edge_id").alias("of")))
    values = node_values(spark, d).select("node_id", F.col("v0").alias("s0"), F.col("v1").alias("s1"))
    pooled = propagation.spreads(c.select(F.col("cand_id").alias("edge_id"), F.explode("nodes").alias("node_id")), values, ["s0", "s1"]).withColumnRenamed("edge_id", "cand_id")
    rows = split(c, "of").join(risks.closure(split(known).filter("split = 'train'"), c), "cand_id").join(pooled, "cand_id")
    rows = rows.select(F.col("cand_id").alias("pos"), "label", "split", F.lit("sns").alias("protocol"), F.col("size").cast("double").alias("n"), "risk", "s0", "s1")
    rows = scratch.materialize(rows, "features")  # the fit reads its rows some times
    return losses.predictor_auc(rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["n", "risk", "s0", "s1"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    e = edges
    return {
        "hyperedge_load_canonical": load_canonical,
        "incidence_degrees": lambda s, d: H.degrees(H.baskets(s, d)),
        "edge_size_histogram": size_histogram,
        "edge_rule_violations": rule_violations,
        "random_split": random_split,
        "cover_aware_split": cover_aware_split,
        "synthetic_edges": synthetic,
        "sequence_digest": lambda s, d: H.sequence_digest(e(s, d)),
        "pair_support": lambda s, d: indexes.pair_support(e(s, d)),
        "pair_sketch_bounded": pair_sketch,
        "triple_support": lambda s, d: indexes.triple_support(e(s, d)),
        "two_section_neighbors": lambda s, d: indexes.two_section(e(s, d)),
        "clique_expansion_full": lambda s, d: r6(indexes.clique_expansion(e(s, d), nodes_of(s, d)), "value"),
        "clique_expansion_mediator": lambda s, d: r6(indexes.clique_expansion(e(s, d), nodes_of(s, d), full=False), "value"),
        "closure_risk": _risk(risks.closure),
        "cowalk_risk": lambda s, d: r6(cowalk_risk(s, d), "risk"),
        "hitting_risk": lambda s, d: r6(hitting_risk(s, d), "risk"),
        "residual_risk": _risk(risks.residual),
        "nearest_positive": _risk(lambda e, c: risks.nearest(e, c, F.col("nodes"))),
        "combined_risk_budget": combined_risk,
        "all_risks": all_risks,
        "expansion_means": lambda s, d: r6(indexes.expansion_means(e(s, d)), "gm2", "hm2", "am2", "gm3", "hm3", "am3"),
        "expansion_neighbor_features": lambda s, d: r6(indexes.expansion_neighbors(e(s, d)), "cn", "jc", "aa"),
        "expansion_third_neighbors": lambda s, d: r6(indexes.third_neighbors(e(s, d)), "cn", "jc", "aa"),
        "star_test": lambda s, d: indexes.star_share(e(s, d)),
        "replacement_pool_topk": lambda s, d: indexes.replacement_pool(e(s, d), TOP, 8),
        "sampler_random": _sampled("random", low=2, high=6),
        "sampler_size_matched": _sampled("size_matched"),
        "sampler_half_corruption": _sampled("half_corruption"),
        "sampler_anchored": _sampled("anchored_random"),
        "sampler_anchored_safe": _sampled("anchored_safe", tries=4),
        "sampler_fast_safe": _sampled("fast_safe"),
        "sampler_clique": _sampled("cns"),
        "sampler_motif": motif,
        "sampler_mixed": mixed,
        "sampler_risk_controlled": risk_controlled,
        "sampler_diagnostics": risk_controlled_near,
        "sampler_star": star_negatives,
        "anchor_node_risks": anchor_node_risks,
        "risk_aware_pool": risk_aware_pool,
        "residual_safe_pool": residual_safe_pool,
        "sampler_diffusion_mixed": diffusion_mixed,
        "sampler_boundary_guided": boundary_guided,
        "proposal_diagnostics": proposal_diagnostics,
        "future_positive_hits": future_hits,
        "negative_quality": negative_quality,
        "zscore_local": _z("local_zscore"),
        "zscore_robust": _z("robust_zscore"),
        "rank_local": _z("local_rank"),
        "pool_zscore": _z("pool_zscore"),
        "pool_rank": _z("pool_rank"),
        "retrieval_score": retrieval_score,
        "rerank_boundary_closest": boundary,
        "rerank_embedding_boundary": embedding_boundary,
        "topk_softmax_select": softmax_sample,
        "source_quota_select": quota_select,
        "partitioned_quota_select": quota_parts,
        "padded_slots": padded_slots,
        "candidate_union_dedup": union_dedup,
        "teacher_exclusion": teacher_exclusion,
        "teacher_pick": teacher_pick,
        "replay_mix": replay,
        "source_mix_select": source_mix,
        "metric_auc": _metric(metrics.auc, "auc"),
        "metric_average_precision": _metric(metrics.average_precision, "ap"),
        "metric_ndcg": _metric(metrics.ndcg, "ndcg"),
        "metric_mrr": _metric(metrics.mean_reciprocal_rank, "mrr"),
        "metric_precision_f1": _metric(metrics.precision_f1, "precision", "f1"),
        "youden_threshold": _metric(metrics.youden, "threshold", "gain"),
        "checkpoint_objective": checkpoint_objective,
        "checkpoint_objectives": checkpoint_objectives,
        "protocol_evaluation": lambda s, d: r6(evaluated(s, d), "auc", "ap"),
        "validation_batches": validation_batches,
        "bank_violations": bank_violations,
        "nearest_mean": nearest_mean,
        "source_sample": lambda s, d: protocols.sample_sources(e(s, d), 100).select("edge_id", "size"),
        "source_minibatches": lambda s, d: protocols.minibatches(e(s, d), 128),
        "teacher_retrieval_split": lambda s, d: protocols.teacher_retrieval(pool_items(s, d), 1, 2, [F.desc("score"), F.col("item")]).select("source_id", "item", "place", "role"),
        "calibrated_bounds": calibrated_bounds,
        "calibrated_budget": calibrated_budget,
        "feature_row_normalize": normalized_rows,
        "edge_pool_stats": edge_pool,
        "edge_norms": edge_norms,
        "incidence_propagation": propagated(propagation.propagate),
        "weighted_propagation": propagated(propagation.weighted_norms),
        "clique_product": clique_product,
        "cosine_topk": cosine_topk,
        "loss_bce_gce": loss_bce_gce,
        "loss_nnpu": loss_nnpu,
        "loss_pairwise": loss_pairwise,
        "loss_weights": loss_weights,
        "predictor_auc": predictor,
        "streaming_pair_support": support.query,
    } | training.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.SQL | training.oracle_sql()
