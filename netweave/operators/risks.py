"""Structural risks of candidate edges against known ones.

Candidates are (cand_id, nodes, size); each risk gives (cand_id, risk), 0 for edges of one node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import jaccard, safe_ratio
from netweave.operators import products
from netweave.operators.indexes import adjacency, edge_pairs, pair_support
from netweave.sources.hyperedges import degrees, incidence_of


def as_candidates(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("edge_id").alias("cand_id"), "nodes", "size")


def _mean_over_pairs(candidates: DataFrame, pairs: DataFrame, value: Column) -> DataFrame:
    means = pairs.groupBy("cand_id").agg(F.avg(value).alias("risk"))
    return candidates.select("cand_id").join(means, "cand_id", "left").select("cand_id", F.coalesce("risk", F.lit(0.0)).alias("risk"))


def _mean_of_met(candidates: DataFrame, met: DataFrame, value: Column) -> DataFrame:
    """As ``_mean_over_pairs``, of all pairs of a candidate, where a value above 0 is had by ``met`` alone: the other pairs are counted and do not move."""
    sums = met.groupBy("cand_id").agg(F.sum(value).alias("s"))
    pairs = F.col("size").cast("double") * (F.col("size") - 1) / 2
    return candidates.select("cand_id", "size").join(sums, "cand_id", "left").select("cand_id", F.when(F.col("s").isNotNull(), F.col("s") / pairs).otherwise(0.0).alias("risk"))


#: Nodes up to which a set meets others on its pairs.
LARGE = 64


def _small_pairs(candidates: DataFrame) -> DataFrame:
    """The pairs of sets of up to ``LARGE`` nodes, said in the same way wherever they are read: so several risks of the same candidates move them once."""
    return edge_pairs(candidates.select("cand_id", "nodes", "size").filter(F.col("size") <= LARGE), 0, "cand_id")


def _met_pairs(candidates: DataFrame, support: DataFrame) -> DataFrame:
    """The pairs of the candidates that are in ``support``."""
    rest = edge_pairs(candidates.select("cand_id", "nodes", "size").filter(F.col("size") > LARGE), 0, "cand_id")
    return _small_pairs(candidates).join(support, ["x", "y"]).unionByName(rest.join(support, ["x", "y"]))


def closure(edges: DataFrame, candidates: DataFrame, max_pairs: int = 0, support: DataFrame | None = None) -> DataFrame:
    """Mean of ln(1 + number of edges with the pair) over the candidate's pairs. ``support``: that of the edges' pairs, if it is at hand."""
    support = pair_support(edges, max_pairs) if support is None else support
    if max_pairs <= 0:
        return _mean_of_met(candidates, _met_pairs(candidates, support), F.log1p(F.col("support").cast("double")))
    pairs = edge_pairs(candidates, max_pairs, "cand_id").join(support, ["x", "y"], "left")
    return _mean_over_pairs(candidates, pairs, F.log1p(F.coalesce("support", F.lit(0)).cast("double")))


def _needed(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    pairs = edge_pairs(candidates, 0, "cand_id")
    return pairs, pairs.select("x", "y").distinct()


def co_walk(edges: DataFrame, candidates: DataFrame, top: int = 128, max_pairs: int = 0, near: DataFrame | None = None) -> DataFrame:
    """Mean cosine of the pair's truncated adjacency rows. Each distinct pair is computed once. ``near``: the truncated adjacency of the edges, if it is at hand."""
    near = adjacency(edges, top, max_pairs) if near is None else near
    rows = products.packed(near, "x", "y", "w").withColumn("norm", F.sqrt(F.aggregate("w", F.lit(0.0), lambda s, w: s + w * w)))
    rows = scratch.materialize(rows.select("x", "ms", F.col("w").alias("ws"), "norm"), "adjacency_rows")
    pairs, needed = _needed(candidates)
    dots = products.sums(needed, rows.withColumnRenamed("norm", "a"), rows.withColumnsRenamed({"x": "y", "norm": "b"}))
    return _mean_of_met(candidates, pairs.join(dots, ["x", "y"]), F.col("s") / (F.col("a") * F.col("b")))


def _both_steps(column: Column, key: str, two_step: float) -> list[Column]:
    """(ms, ws): ``two_step`` times the chances of a column, and 1 at its own node, so that a row of chances times these is that of one step or two."""
    two = F.transform(column, lambda c: F.struct(c["m"].alias("m"), (c["p"] * F.lit(float(two_step))).alias("p")))
    whole = F.array_append(two if two_step > 0 else F.filter(two, lambda c: F.lit(False)), F.struct(F.col(key).alias("m"), F.lit(1.0).alias("p")))
    return [F.transform(whole, lambda c: c["m"]).alias("ms"), F.transform(whole, lambda c: c["p"]).alias("ws")]


def hitting(edges: DataFrame, candidates: DataFrame, top: int = 128, two_step: float = 0.5, max_pairs: int = 0, near: DataFrame | None = None) -> DataFrame:
    """Mean over the pairs, both ways, of the chance to reach one node from the other in one step plus ``two_step`` times that in two.

    ``top`` of 0 takes all neighbours of each node. ``near``: the truncated adjacency of the edges, if it is at hand.
    """
    whole = near is None and top <= 0
    near = adjacency(edges, top, max_pairs) if near is None else near
    rows = products.packed(near, "x", "y", "w").withColumn("t", F.aggregate("w", F.lit(0.0), lambda s, w: s + w))
    rows = scratch.materialize(rows.select("x", "ms", F.col("w").alias("ws"), "t"), "adjacency_rows")
    steps = rows.select(F.col("x").alias("m"), "t", F.explode(F.arrays_zip("ms", "ws")).alias("c")).select("m", F.col("c.ms").alias("y"), (F.col("c.ws") / F.col("t")).alias("p"))
    columns = steps.groupBy("y").agg(F.sort_array(F.collect_list(F.struct("m", "p"))).alias("column"))
    pairs, needed = _needed(candidates)
    if whole:
        # weights are the same both ways, so the sums of a pair are, but for the total that each divides by
        right = columns.join(rows.select(F.col("x").alias("y"), (1 / F.col("t")).alias("b")), "y").select("y", *_both_steps(F.col("column"), "y", two_step), "b")
        met = products.sums(needed, rows.select("x", "ms", "ws", (1 / F.col("t")).alias("a")), scratch.materialize(right, "step_columns"))
        return _mean_of_met(candidates, pairs.join(met, ["x", "y"]), F.col("s") * (F.col("a") + F.col("b")) / 2)
    turned = F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    ways = needed.select(turned.alias("w")).select("w.x", "w.y")
    right = columns.select("y", *_both_steps(F.col("column"), "y", two_step), F.lit(1.0).alias("b"))
    left = rows.select("x", "ms", F.transform("ws", lambda w: w / F.col("t")).alias("ws"), F.lit(1.0).alias("a"))
    met = products.sums(ways, left, scratch.materialize(right, "step_columns"))
    met = met.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg((F.sum("s") / 2).alias("h"))
    return _mean_of_met(candidates, pairs.join(met, ["x", "y"]), F.col("h"))


def residual(edges: DataFrame, candidates: DataFrame, max_pairs: int = 0, support: DataFrame | None = None) -> DataFrame:
    """Mean over the pairs of ln(1 + z), z the count above what degrees alone would give over its root; 0 if not above."""
    size = F.col("size").cast("double")
    totals = edges.agg(F.sum(size).alias("all_sizes"), F.sum(size * (size - 1)).alias("all_pairs"))
    d = degrees(incidence_of(edges))
    support = pair_support(edges, max_pairs) if support is None else support
    # a pair that no edge has is not above what degrees give, so it adds 0
    pairs = _met_pairs(candidates, support)
    pairs = pairs.join(d.select(F.col("node_id").alias("x"), F.col("degree").alias("da")), "x", "left").join(d.select(F.col("node_id").alias("y"), F.col("degree").alias("db")), "y", "left")
    pairs = pairs.join(F.broadcast(totals)).na.fill(0, ["support", "da", "db"])  # totals: one row
    base = F.col("all_sizes") * (F.col("all_sizes") - 1)
    expected = F.when(base > 0, F.col("all_pairs") * F.col("da") * F.col("db") / base).otherwise(0.0)
    z = F.when(F.col("support") <= expected, 0.0).otherwise(F.log1p((F.col("support") - expected) / F.sqrt(expected + 1e-9)))
    return _mean_of_met(candidates, pairs, z)


def nearest(edges: DataFrame, candidates: DataFrame, excluded: Column | None = None, large: int = LARGE) -> DataFrame:
    """Largest Jaccard similarity to a known edge that shares a node; 0 if none.

    ``excluded``: the node set of an edge that does not count for the candidate; null for none.

    Known sets are taken once each. Of two sets with more than ``large`` nodes in either, the common nodes are counted node by node, so an edge costs as many rows as
    its nodes have known sets of that kind. Other sets that share two nodes or more meet on pairs of nodes, and c common
    nodes give c * (c - 1) / 2 common pairs, so the number of meetings tells c. Of those that share one node the smallest
    is the nearest, and each node has its two smallest sets (one may be the excluded one), so a hub
    costs a row for each of its candidates and not for each of its known sets as well.
    """
    known = edges.select("nodes", "size").distinct().withColumns({"known_id": F.xxhash64("nodes"), "known_size": F.col("size")})
    not_id = F.lit(None).cast("long") if excluded is None else F.when(excluded.isNotNull(), F.xxhash64(excluded))
    wanted = candidates.select("cand_id", "nodes", "size", not_id.alias("not_id"))
    counts = F.col("not_id").isNull() | (F.col("not_id") != F.col("known_id"))

    # of a node's two smallest sets the smaller one that counts is the nearest, so a candidate has one row a node
    order = Window.partitionBy("node_id").orderBy("known_size", "known_id")
    smallest = known.select("known_id", "known_size", F.explode("nodes").alias("node_id")).withColumn("r", F.row_number().over(order)).filter("r <= 2")
    smallest = smallest.groupBy("node_id").agg(F.max(F.when(F.col("r") == 1, F.col("known_id"))).alias("id1"), F.max(F.when(F.col("r") == 1, F.col("known_size"))).alias("size1"), F.max(F.when(F.col("r") == 2, F.col("known_size"))).alias("size2"))
    asked = wanted.select("cand_id", "size", "not_id", F.explode("nodes").alias("node_id"))
    one = asked.join(smallest, "node_id")
    one = one.select("cand_id", "size", F.when(F.col("not_id").isNull() | (F.col("not_id") != F.col("id1")), F.col("size1")).otherwise(F.col("size2")).alias("known_size")).filter("known_size is not null")
    one = one.select("cand_id", jaccard(F.lit(1), F.col("size"), F.col("known_size")).alias("j"))

    small = F.col("size") <= large
    # few pairs of a candidate are pairs of known sets, so its size is looked up for those that are
    own = _small_pairs(candidates) if large == LARGE else edge_pairs(wanted.filter(small), 0, "cand_id")
    met = own.join(edge_pairs(known.filter(small), 0, "known_id", "known_size"), ["x", "y"]).groupBy("cand_id", "known_id")
    met = met.agg(F.count(F.lit(1)).alias("n"), F.first("known_size").alias("known_size")).join(wanted.select("cand_id", "size", "not_id"), "cand_id").filter(counts)
    common = F.round((1 + F.sqrt(8 * F.col("n") + 1)) / 2).cast("long")
    more = met.select("cand_id", jaccard(common, F.col("size"), F.col("known_size")).alias("j"))

    held = known.select("known_id", "known_size", F.explode("nodes").alias("node_id"))
    # nodes of all candidates are read as for the smallest sets, so they move once
    big = asked.join(held.filter(F.col("known_size") > large), "node_id").unionByName(asked.filter(~small).join(held.filter(F.col("known_size") <= large), "node_id")).filter(counts)
    big = big.groupBy("cand_id", "known_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("known_size").alias("known_size"))
    big = big.select("cand_id", jaccard(F.col("n"), F.col("size"), F.col("known_size")).alias("j"))

    best = one.unionByName(more).unionByName(big).groupBy("cand_id").agg(F.max("j").alias("risk"))
    return candidates.select("cand_id").join(best, "cand_id", "left").select("cand_id", F.coalesce("risk", F.lit(0.0)).alias("risk"))


NAMES = ("nearest", "closure", "cowalk", "hitting", "residual")


def all_risks(edges: DataFrame, candidates: DataFrame, top: int = 128, exclude_self: bool = True) -> DataFrame:
    """(cand_id, nearest, closure, cowalk, hitting, residual); pair support and adjacency are written once and read by all."""
    support = scratch.materialize(pair_support(edges), "support")
    near = scratch.materialize(adjacency(edges, top), "adjacency")
    parts = {
        "nearest": nearest(edges, candidates, F.col("nodes") if exclude_self else None),
        "closure": closure(edges, candidates, support=support),
        "cowalk": co_walk(edges, candidates, top, near=near),
        "hitting": hitting(edges, candidates, top, near=near),
        "residual": residual(edges, candidates, support=support),
    }
    out = candidates.select("cand_id")
    for name, risk in parts.items():
        out = out.join(risk.withColumnRenamed("risk", name), "cand_id")
    return out


def combined(bounds: dict[str, float], weights: dict[str, float] | None = None) -> Column:
    """Weighted sum of the risks over their bounds."""
    total = F.lit(0.0)
    for name, bound in bounds.items():
        total = total + F.lit((weights or {}).get(name, 1.0)) * safe_ratio(F.col(name), F.lit(bound))
    return total


def within(caps: dict[str, float]) -> Column:
    passed = F.lit(True)
    for name, cap in caps.items():
        passed = passed & (F.col(name) <= cap)
    return passed


def rejection_reason(bounds: dict[str, float], budget: float, caps: dict[str, float]) -> Column:
    """Null if accepted; else the bound exceeded most, in proportion (ties in the order of NAMES); else budget; else safety."""
    ratios = {n: safe_ratio(F.col(n), F.lit(b)) for n, b in bounds.items()}
    worst = F.greatest(*ratios.values(), F.lit(0.0))
    reason = F.when(combined(bounds) > budget, F.lit("budget")).when(~within(caps), F.lit("safety"))
    out = None
    for n in NAMES:
        if n in ratios:
            hit = (ratios[n] > 1) & (ratios[n] == worst)
            out = F.when(hit, F.lit(n)) if out is None else out.when(hit, F.lit(n))
    return out.otherwise(reason)
