"""Loading of datasets, the catalog, run folders, and pairs and triples of large edges."""

from __future__ import annotations

import itertools
import random

import pytest
from pyspark.sql import functions as F

from netweave.operators import indexes, samplers
from netweave.sources import datasets, runs


@pytest.fixture
def root(tmp_path):
    r = random.Random(2)
    edges = sorted({tuple(sorted(r.sample(range(30), r.choice([2, 3, 5])))) for _ in range(50)} | {(28, 29)})
    (tmp_path / "own_edges.txt").write_text("# comment\n\n" + "\n".join(" ".join(map(str, e)) for e in edges) + "\n" + "29 28\n")
    return tmp_path, edges


def test_load(spark, root):
    path, edges = root
    at = f"file://{path}"
    spark.createDataFrame([(k, [float(k), 1.0]) for k in range(30)], "node_id long, vec array<double>").write.parquet(f"{at}/own_features.parquet")
    entry = datasets.Entry("own", 30, len(edges))
    for split in ("random", "cover"):
        got = datasets.load(spark, entry, at, split=split, features=True)
        assert got.num_nodes == 30 and sorted(tuple(x.nodes) for x in got.edges.collect()) == edges
        assert {x.split for x in got.edges.select("split").distinct().collect()} == {"train", "val", "test"}
        assert got.part("train").count() + got.future().count() == len(edges)
        assert {x.node_id: x.vec for x in got.features.collect()}[3] == [0.75, 0.25]
        if split == "cover":
            assert got.part("train").select(F.explode("nodes")).distinct().count() == len({n for e in edges for n in e})
    small = datasets.probe(got, {"train": 5, "val": 0})
    assert small.part("train").count() == 5 and small.part("val").count() == 0 and small.part("test").count() == got.part("test").count()
    for bad in (datasets.Entry("own", 31), datasets.Entry("own", 0, len(edges) + 1)):
        with pytest.raises(ValueError):
            datasets.load(spark, bad, at)
    with pytest.raises(ValueError):
        datasets.load(spark, entry, at, split="other")
    for k, rows in enumerate(([(k, [1.0]) for k in range(29)], [(k, [1.0] * (1 + k % 2)) for k in range(30)], [(k % 29, [1.0]) for k in range(30)])):
        spark.createDataFrame(rows, "node_id long, vec array<double>").write.parquet(f"{at}/bad{k}.parquet")
        with pytest.raises(ValueError):
            datasets.load(spark, datasets.Entry("own", feature_path=f"bad{k}.parquet"), at, features=True)


def test_catalog():
    c = datasets.Catalog()
    assert c["pubmed"].nodes == 3840 and c["pubmed"].edges_at("/x/") == "/x/pubmed_edges.txt" and len(c.keys()) == 19
    c.add(datasets.Entry("own", edge_path="a/b.txt"))
    assert c["own"].edges_at("/x") == "/x/a/b.txt"
    with pytest.raises(KeyError):
        c["none"]
    assert datasets.weight_mapping("a:1, b : 2.5,,") == {"a": 1.0, "b": 2.5}
    with pytest.raises(ValueError):
        datasets.weight_mapping("a:1,b")


def test_runs(spark, tmp_path):
    root = f"file://{tmp_path}"
    jobs = [("one", {"seed": k, "mode": "full"}) for k in range(3)]
    assert runs.open_jobs(spark, root, jobs) == jobs
    runs.write_metrics(spark, root, "one", {"mode": "full", "seed": 1}, {"auc": 0.5})
    runs.write_metrics(spark, root, "one", {"mode": "full", "seed": 1}, {"auc": 0.7})
    assert runs.open_jobs(spark, root, jobs) == [jobs[0], jobs[2]]
    assert [x.metrics for x in runs.finished(spark, root).collect()] == ['{"auc":0.7}']
    runs.append_event(spark, None, "nothing")
    for k in range(2):
        runs.append_event(spark, f"{root}/events", "epoch", number=k)
    assert [x.event for x in runs.read_events(spark, f"{root}/events").collect()] == ["epoch"] * 2


def test_pairs_and_triples_of_large_edges(spark):
    r = random.Random(4)
    sets = [tuple(sorted(r.sample(range(999), n))) for n in (1, 2, 3, 65, 66, 200)]
    e = spark.createDataFrame([(k, list(s), len(s)) for k, s in enumerate(sets)], "edge_id long, nodes array<long>, size int")
    got = {(x.edge_id, x.x, x.y) for x in indexes.edge_pairs(e).collect()}
    assert got == {(k, a, b) for k, s in enumerate(sets) for a, b in itertools.combinations(s, 2)}
    bounded = indexes.edge_pairs(e, 100).groupBy("edge_id").count().collect()
    assert {x.edge_id: x["count"] for x in bounded} == {1: 1, 2: 3, 3: 100, 4: 100, 5: 100}
    few = e.filter("size < 70")
    assert indexes.edge_triples(few).count() == sum(len(s) * (len(s) - 1) * (len(s) - 2) // 6 for s in sets if len(s) < 70)
    rows = indexes.edge_triples(e, 150).collect()
    assert len({tuple(x) for x in rows}) == len(rows) and all(x.x < x.y < x.z and {x.x, x.y, x.z} <= set(sets[x.edge_id]) for x in rows)
    counts = {k: sum(x.edge_id == k for x in rows) for k in range(6)}
    assert counts[2] == 1 and 60 <= counts[3] <= 150 and 60 <= counts[4] <= 150 and 150 <= counts[5] <= 150


def test_mixed_gives_each_slot_one_kind(spark):
    r = random.Random(6)
    sets = sorted({tuple(sorted(r.sample(range(40), r.choice([2, 3, 4])))) for _ in range(60)})
    e = spark.createDataFrame([(k, list(s), len(s)) for k, s in enumerate(sets)], "edge_id long, nodes array<long>, size int")
    rows = samplers.mixed(e, e, 40, per_source=2).collect()
    assert sorted((x.source_id, x.slot) for x in rows) == [(k, s) for k in range(len(sets)) for s in (0, 1)]
    assert {x.kind for x in rows} == {"sns", "mns", "cns"} and all(len(x.nodes) == len(sets[x.source_id]) for x in rows)
