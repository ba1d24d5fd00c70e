"""Protocol batches, bank checks and how sources are dealt."""

from __future__ import annotations

from pyspark.sql import functions as F

from netweave.operators import protocols


def edges_of(spark, rows):
    return spark.createDataFrame(rows, "edge_id long, nodes array<long>").withColumn("size", F.size("nodes"))


def test_bank_violations(spark):
    edges = edges_of(spark, [(1, [0, 5, 9]), (2, [3, 4]), (3, [7, 8])])
    bank = lambda rows: spark.createDataFrame(rows, "source_id long, nodes array<long>")
    fits = bank([(1, [2, 5, 9]), (1, [0, 6, 9]), (2, [3, 6]), (2, [4, 6]), (3, [7, 1]), (3, [8, 2])])
    assert set(protocols.bank_violations(fits, edges, edges, 2, 10).first()) == {0}
    bad = bank([(1, [2, 5]), (1, [9, 5, 0]), (2, [3, 10]), (2, [4, 4]), (2, None), (6, [1, 2])])
    got = protocols.bank_violations(bad, edges, edges, 2, 10).first().asDict()
    assert got == {"sources_missing": 1, "sources_unknown": 1, "wrong_count": 2, "wrong_size": 3, "out_of_range": 1, "known_edges": 1}
    assert protocols.bank_violations(bank([]), edges, edges, 2, 10).first().asDict()["sources_missing"] == 3


def test_batches_and_objectives(spark):
    schema = "pos long, label int, score double, protocol string"
    rows = [(1, 1, 0.9, None), (2, 1, 0.4, None), (3, 0, 0.5, "x"), (4, 0, 0.1, "y"), (5, 0, 0.9, "unused")]
    p = spark.createDataFrame(rows, schema)
    out = protocols.batches(p.filter("label = 1"), p.filter("label = 0"), ("x", "y", "none"))
    assert sorted((r.protocol, r.pos, r.label) for r in out.collect()) == [("none", 1, 1), ("none", 2, 1), ("x", 1, 1), ("x", 2, 1), ("x", 3, 0), ("y", 1, 1), ("y", 2, 1), ("y", 4, 0)]
    got = {r.protocol: r for r in protocols.evaluate(out).collect()}
    assert got["x"].auc == 0.5 and abs(got["x"].ap - (0.5 + 0.5 * 2 / 3)) < 1e-9
    assert got["y"].auc == 1.0 and got["y"].ap == 1.0 and got["none"].auc is None
    best = protocols.objectives(protocols.evaluate(out.filter("protocol <> 'none'")), {"y": 3.0}, 1.0, 0.0).first()
    assert best.mean_auc == best.mean_auc_ap == 0.875 and best.min_auc == 0.5
    none = protocols.objectives(protocols.evaluate(out.filter("false"))).first()
    assert set(none) == {0.0}


def test_sources_are_dealt(spark):
    edges = edges_of(spark, [(i, [i, i + 1]) for i in range(25)])
    assert [r.edge_id for r in protocols.sample_sources(edges, 7).collect()] == [r.edge_id for r in protocols.sample_sources(edges.repartition(5), 7).collect()]
    assert protocols.sample_sources(edges, 99).count() == 25
    sizes = {r.batch: r["count"] for r in protocols.minibatches(edges, 10).groupBy("batch").count().collect()}
    assert sizes == {0: 10, 1: 10, 2: 5}
    items = spark.createDataFrame([(1, k) for k in range(6)] + [(2, 0)], "source_id long, item long")
    got = {(r.source_id, r.item): r.role for r in protocols.teacher_retrieval(items, 2, 3, ["item"]).collect()}
    assert got == {(1, 0): "teacher", (1, 1): "teacher", (1, 2): "retrieval", (1, 3): "retrieval", (1, 4): "retrieval", (2, 0): "teacher"}
