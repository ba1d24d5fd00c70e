"""What a task holds or does stays bounded as tables grow."""

from __future__ import annotations

import time
from collections import Counter

from pyspark.sql import functions as F

from netweave import scratch
from netweave.operators import mixture, propagation, retrieval, representations, risks, samplers, selection
from netweave.streaming import support
from test_scale import moved, near_of, no_broadcast, some_edges  # noqa: F401


def test_source_mix_of_many_sources_takes_seconds(spark):
    rows = spark.range(120_000).select((F.col("id") % 40_000).alias("source_id"), F.element_at(F.array(F.lit("A"), F.lit("N"), F.lit("R")), (F.col("id") % 3 + 1).cast("int")).alias("label"), F.col("id").cast("string").alias("item"), (F.col("id") / 120_000).alias("score"))
    began = time.time()
    assert selection.source_mix(rows, 2, {"A": 90.0, "N": 6.0, "R": 4.0}, "score", "item", 1).count() == 80_000
    assert time.time() - began < 12


def most_in_a_task(df) -> int:
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_roles_and_norms_take_their_partitions_from_the_rows(spark, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 50)
    pool = spark.range(2_000).select((F.col("id") % 500).alias("source_id"), F.col("id").alias("slot"), F.array("id").alias("nodes"), F.lit("a").alias("label"))
    assert most_in_a_task(retrieval.split_roles(pool, 1, 2)) < 150
    incidence = spark.range(2_000).select((F.col("id") % 500).alias("edge_id"), (F.col("id") % 97).alias("node_id"))
    features = spark.range(97).select(F.col("id").alias("node_id"), F.lit(0).alias("dim"), F.lit(1.0).alias("value"))
    out = propagation.two_norms(incidence, features)
    assert most_in_a_task(out) < 60 and out.count() == 500


def test_stream_has_more_files_for_more_edges(spark, monkeypatch):
    seen, follow = [], support.follow
    monkeypatch.setattr(support, "FILE_EDGES", 100)
    monkeypatch.setattr(support, "follow", lambda spark, path, state, mark, each: seen.append((spark.read.parquet(path).count(), each)) or follow(spark, path, state, mark, each))
    out = support.query(spark, "/root/testdata/sf0.001")
    assert seen[0][1] >= seen[0][0] / 400 > 1
    assert out.agg(F.sum("support")).first()[0] > 0


def test_pairs_that_no_edge_has_move_once(spark, no_broadcast):
    _, edges = some_edges(spark, 400, 120)
    _, far = some_edges(spark, 2_000, 5_000, seed=11)
    c = risks.as_candidates(far)
    for risk, most in ((risks.closure, 20_000), (risks.residual, 26_000)):
        rows, records = moved(spark, risk(edges, c))
        assert len(rows) == 2_000 and records < most, (risk, records)  # 12,000 pairs


def test_random_fills_make_no_pools(spark, monkeypatch):
    _, edges = some_edges(spark, 40, 60)
    monkeypatch.setattr(mixture, "slot_pools", lambda *a, **k: 1 / 0)
    samples, attempts = mixture.controlled(edges, edges, 60, {"closure": 0.2}, tries=2)
    assert samples.count() == 40 and attempts.filter("strategy <> 'random' OR neighbors > 0").count() == 0


def test_slot_pools_move_nodes_and_not_meetings(spark, no_broadcast, monkeypatch):
    sets, edges = some_edges(spark, 300, 40, 8)
    monkeypatch.setattr(scratch, "materialize", lambda df, name: df)
    anchors = mixture.slot_anchors(edges, 1)
    rows, records = moved(spark, mixture.slot_pools(anchors, edges, ("neighborhood",), 16, 6))
    near, want = near_of(sets, 16), {}
    for r in anchors.collect():
        met = Counter(y for x in r["anchor"] for y in near[x] if y not in r["source"])
        want[r["source_id"]["source_id"]] = [y for y, _ in sorted(met.items(), key=lambda m: (-m[1], m[0]))[:6]]
    assert {r["source_id"]["source_id"]: r["pool"] for r in rows} == want
    assert records < 12_000, records  # 600 anchors of 16 neighbours each meet 9,600 times


def test_risks_of_the_same_candidates_move_their_pairs_once(spark, no_broadcast):
    _, edges = some_edges(spark, 400, 120)
    c = scratch.materialize(risks.as_candidates(some_edges(spark, 2_000, 5_000, 6, seed=11)[1]), "candidates")
    rows, records = moved(spark, risks.nearest(edges, c, F.col("nodes")).join(risks.closure(edges, c).withColumnRenamed("risk", "closure"), "cand_id"))
    assert len(rows) == 2_000 and records < 70_000, records  # 30,000 pairs and 12,000 nodes


def test_clique_moves_three_lists_of_a_source(spark, no_broadcast):
    _, edges = some_edges(spark, 400, 300, 6)
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda q: [q.apply(k) for k in range(q.size())])(store.stageList(None, False, False, none, None)))
    before, rows = total(), samplers.clique(edges.filter("edge_id < 40"), edges, 300).collect()
    assert len(rows) == 40 and total() - before < 12_000, total() - before  # 12,000 pairs of neighbours, each met from both ends


def test_vectors_that_nodes_share_stay_where_the_sets_are(spark):
    _, edges = some_edges(spark, 400, 120)
    shared = spark.range(10).select(F.col("id").alias("node_id"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("vec"))
    each = spark.range(120).select(F.col("id").alias("node_id"), F.array((F.col("id") % 10).cast("double"), F.lit(1.0)).alias("vec"))
    rows, records = moved(spark, representations.set_vectors(edges, shared, 2, F.pmod("node_id", F.lit(10))))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, representations.set_vectors(edges, each, 2).collect()))
    assert records < 900, records  # 400 sets, and not their 1,600 nodes
