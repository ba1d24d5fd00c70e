"""Candidate lists, discrete diffusion, repair and the primal-dual loop against plain versions."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave import scratch
from netweave.operators import dual, membership, representations
from netweave.plans import training

SCHEMA = "edge_id long, nodes array<long>, size int"


def table(spark, sets):
    return scratch.materialize(spark.createDataFrame([(k, sorted(s), len(s)) for k, s in enumerate(sets)], SCHEMA), "sets")


@pytest.fixture(scope="module")
def sets():
    r = random.Random(31)
    return [{7}, {0, 1, 2}, set(r.sample(range(5000), 2000)), set(range(2, 40)), set(r.sample(range(5000), 30))]


def test_candidate_lists(spark, sets):
    edges = table(spark, sets)
    found = spark.createDataFrame([(0, [9, 7, 3, 9]), (4, [4999, 1])], "edge_id long, found array<long>")
    anchors = spark.createDataFrame([(1, [2])], "edge_id long, anchor array<long>")
    got = {x.edge_id: x for x in membership.candidate_lists(edges, 5000, 12, found, anchors).collect()}
    for k, s in enumerate(sets):
        want = list(dict.fromkeys([*sorted(s), *{0: [9, 7, 3, 9], 4: [4999, 1]}.get(k, [])]))[: max(12, len(s))]
        for n in range(5000):
            if len(want) >= max(12, len(s)):
                break
            if n not in want:
                want.append(n)
        x = got[k]
        assert x.candidates == want and x.membership == [int(c in s) for c in want] and x.anchor == [int(k == 1 and c == 2) for c in want]
    few = membership.candidate_lists(table(spark, [{1}, {0, 2}]), 3, 10).collect()
    assert all(sorted(x.candidates) == [0, 1, 2] for x in few)


def test_forward_marginals(spark):
    """Shares of members after t steps are those of the closed form, and of single steps after one another."""
    rates = membership.keep_rates(5)
    lists = spark.range(6000).select(F.col("id").alias("edge_id"), F.expr("array(1L, 2L, 3L)").alias("candidates"), F.expr("array(1, 0, 1)").alias("membership"), F.expr("array(0, 0, 1)").alias("anchor"))
    for t in (1, 5):
        a, b, c = membership.corrupted(lists, rates, F.lit(t)).agg(*[F.avg(F.get("state", F.lit(k))) for k in range(3)]).first()
        assert a == pytest.approx((1 + rates[t]) / 2, abs=0.03) and b == pytest.approx((1 - rates[t]) / 2, abs=0.03) and c == 1
    beta = [0.02 + (0.35 - 0.02) * k / 4 for k in range(5)]
    m = np.eye(2)
    for x in beta:
        m = m @ np.array([[1 - x / 2, x / 2], [x / 2, 1 - x / 2]])
    assert m[1, 1] == pytest.approx((1 + rates[5]) / 2)
    steps = membership.corrupted(lists, rates, membership.drawn_step(5)).groupBy("step").count().collect()
    assert sorted(x.step for x in steps) == [1, 2, 3, 4, 5] and all(abs(x["count"] - 1200) < 200 for x in steps)


def test_posterior(spark):
    rates = membership.keep_rates(4)
    q = lambda r: np.array([[1 + r, 1 - r], [1 - r, 1 + r]]) / 2
    for t in range(1, 5):
        for state in (0, 1):
            for p in (0.0, 0.3, 1.0):
                step, before = q(rates[t] / rates[t - 1]), q(rates[t - 1])
                rows = [before[x0] * step[:, state] for x0 in (0, 1)]
                want = sum(w * (r / r.sum()) for w, r in zip((1 - p, p), rows))[1]
                got = spark.range(1).select(membership.posterior(F.lit(state), F.lit(p), rates, F.lit(t))).first()[0]
                assert got == pytest.approx(want)


def test_reverse_keeps_size(spark, sets):
    """A denoiser that knows the members gives them back; anchors stay."""
    edges = table(spark, sets[:2] + sets[3:])
    anchors = edges.select("edge_id", F.slice("nodes", 1, 1).alias("anchor"))
    lists = scratch.materialize(membership.candidate_lists(edges, 5000, 50, None, anchors), "lists")
    knows = lambda rows, t: rows.withColumn("logits", F.transform("membership", lambda m: m * 20.0 - 10.0))
    got = membership.denoised(lists, knows, membership.keep_rates(3)).collect()
    assert len(got) == 4 and all(x.drawn == x.nodes for x in got)
    blind = lambda rows, t: rows.withColumn("logits", F.transform("candidates", lambda c: F.pmod(F.xxhash64(c), F.lit(1000)) / 1000.0))
    for x in membership.denoised(lists, blind, membership.keep_rates(3)).collect():
        assert len(set(x.drawn)) == len(x.nodes) and x.nodes[0] in x.drawn


def test_corrupted_vectors(spark, sets):
    edges = table(spark, sets[:2] + sets[3:])
    vectors = spark.range(5000).select(F.col("id").alias("node_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    rows = membership.corrupted_vectors(edges, vectors, 2, 8, membership.keep_rates(6), 2).collect()
    assert len(rows) == 4 and all(1 <= x.step <= 6 and x.rep[1] in (0.0, 1.0) for x in rows)


def test_repair_fixes_the_size(spark, sets):
    edges = table(spark, sets)
    lists = membership.candidate_lists(edges, 5000, 60)
    rows = lists.select(F.col("edge_id").alias("source_id"), F.col("nodes").alias("source"), F.slice("nodes", 1, F.floor(F.size("nodes") / 2).cast("int")).alias("anchor"), "candidates")
    got = {x.source_id: x.nodes for x in membership.repaired(rows, edges, 5000).collect()}
    assert len(got) == len(sets)
    for k, s in enumerate(sets):
        half = set(sorted(s)[: len(s) // 2])
        assert len(got[k]) == len(set(got[k])) == len(s) and half <= set(got[k]) and not (set(got[k]) - half) & s
    with pytest.raises(RuntimeError):
        only = rows.filter("source_id = 0").withColumn("candidates", F.col("source"))
        membership.repaired(only, table(spark, [{7}, {0}]), 1, tries=3)  # the one node outside the source is a known edge


def plain_loop(rows, bounds, rate, most, target, width):
    lam, out = {n: 0.0 for n in bounds}, {}
    for key in sorted({r[:2] for r in rows}):
        best = None
        for r in sorted(x for x in rows if x[:2] == key):
            hard = -abs(r[3] - target) / width
            cost = sum(lam[n] * r[4 + k] / bounds[n] for k, n in enumerate(bounds))
            if best is None or hard - cost > best[1]:
                best = (r, hard - cost)
        for k, n in enumerate(bounds):
            lam[n] = min(most, max(0.0, lam[n] + rate * (best[0][4 + k] / bounds[n] - 1)))
        out[key] = (best[0][2], best[1], *lam.values())
    return out, lam


def test_primal_dual_is_the_loop(spark):
    r = random.Random(8)
    rows = [(s, k, p, round(r.random(), 3), round(r.random(), 3), round(2 * r.random(), 3)) for s in range(300) for k in range(2) for p in range(r.randrange(1, 6))]
    bounds = {"nearest": 0.4, "closure": 0.9}
    probes = scratch.materialize(spark.createDataFrame(rows, "source_id long, slot int, probe int, score double, nearest double, closure double").repartition(5), "probes")
    want, lam = plain_loop(rows, bounds, 0.1, 3.0, 0.5, 0.4)
    chosen, end = dual.primal_dual(probes, bounds, rate=0.1, most=3.0)
    got = {(x.source_id, x.slot): (x.probe, x.objective, x.multiplier_nearest, x.multiplier_closure) for x in chosen.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want) and end == pytest.approx(lam)
    many, after = dual.primal_dual(probes, bounds, rate=0.1, most=3.0, shards=4, blocks=3)
    assert many.count() == len(want) and all(0 <= v <= 3 for v in after.values()) and any(v > 0 for v in after.values())
    again, same = dual.primal_dual(probes.repartition(2), bounds, rate=0.1, most=3.0, shards=4, blocks=3)
    assert same == pytest.approx(after) and sorted(again.select("source_id", "slot", "probe").collect()) == sorted(many.select("source_id", "slot", "probe").collect())
    assert dual.dual_figures(chosen).first().samples == len(want)
    assert dual.primal_dual(probes.filter("source_id < 0"), bounds)[0].count() == 0


def test_primal_dual_query_is_one_sequence(spark):
    d = "/root/testdata/sf0.001"
    rows = sorted(spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey", "concat_ws(':', l_partkey, l_suppkey, l_linenumber) AS item", "round(l_extendedprice / 105000.0, 6) AS score", "l_discount", "l_tax").collect())
    place, probes = {}, []
    for x in rows:
        place[x.l_orderkey] = place.get(x.l_orderkey, 0) + 1
        probes.append((x.l_orderkey, 0, place[x.l_orderkey], float(x.score), float(x.l_discount), float(x.l_tax)))
    want, _ = plain_loop(probes, {"closure": 0.04, "residual": 0.03}, 0.05, 10.0, 0.5, 0.4)
    got = training.primal_dual(spark, d).first()
    assert got.samples == len(want)
    assert got.objective_mean == pytest.approx(np.mean([v[1] for v in want.values()]), abs=1e-6)
    assert [got.multiplier_closure_mean, got.multiplier_residual_mean] == pytest.approx([np.mean([v[k] for v in want.values()]) for k in (2, 3)], abs=1e-6)
    held = spark.createDataFrame(probes, "source_id long, slot int, probe int, score double, closure double, residual double")
    chosen, _ = dual.primal_dual(held, {"closure": 0.04, "residual": 0.03}, blocks=7)
    assert {(x.source_id, x.slot): x.probe for x in chosen.collect()} == {k: v[0] for k, v in want.items()}


def test_manifold_and_diversity(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(70, 5)), rng.normal(size=(90, 5))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(a)] + [(500, [0.0] * 5)], "source_id long, vec array<double>")
    bank = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(b)], "edge_id long, rep array<double>")
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    near = np.append((unit(a) @ unit(b).T).max(axis=1), 0.0)
    got = representations.nearest_in_bank(rows, bank, 5, size=16).orderBy("source_id").collect()
    assert [x.nearest for x in got] == pytest.approx(near.tolist())
    risk = representations.manifold_risk(rows, bank, 5, 0.6, size=16).first()
    over = np.maximum(near - 0.6, 0)
    assert risk.risk == pytest.approx((over**2).mean()) and risk.violation_rate == pytest.approx((over > 0).mean()) and risk.nearest_max == pytest.approx(near.max())
    g = unit(a) @ unit(a).T
    want = ((g**2).sum() - (np.diag(g) ** 2).sum()) / (71 * 70)
    out = representations.diversity(rows, 5).first()
    assert out.rows == 71 and out.diversity == pytest.approx(want)
    assert representations.diversity(rows.limit(1), 5).first().diversity == 0
