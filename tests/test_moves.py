"""What splits, the set predictor and the expansion features move does not outgrow their input; results against plain loops."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from netweave.operators import indexes, layers, losses
from netweave.plans import registry
from netweave.sources import hyperedges as H
from test_scale import no_broadcast, some_edges  # noqa: F401


def moved_bytes(spark, make) -> tuple[object, float]:
    """What ``make`` gives, and the MB that its stages shuffled."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteBytes() for s in (lambda q: [q.apply(k) for k in range(q.size())])(store.stageList(None, False, False, none, None)))
    before, out = total(), make()
    return out, (total() - before) / 1e6


def mixed_edges(spark, count: int, nodes: int, most: int):
    r = random.Random(count)
    sets = sorted({tuple(sorted(r.sample(range(nodes), r.randint(2, most)))) for _ in range(count)})
    return sets, spark.createDataFrame([(k, list(s), len(s)) for k, s in enumerate(sets)], "edge_id long, nodes array<long>, size int")


def covering(sets) -> set[int]:
    """The edges of a node of their own, then one after another the edge of most uncovered nodes, smallest size and id."""
    degree = Counter(n for s in sets for n in s)
    taken = {k for k, s in enumerate(sets) if any(degree[n] == 1 for n in s)}
    covered = {n for k in taken for n in sets[k]}
    while len(covered) < len(degree):
        gain, _, k = min((-len(set(s) - covered), len(s), k) for k, s in enumerate(sets))
        taken.add(k)
        covered |= set(sets[k])
    return taken


@pytest.mark.parametrize("count,nodes,most", [(300, 200, 6), (400, 60, 12), (120, 90, 20)])
def test_cover_takes_the_greedy_edges(spark, count, nodes, most):
    sets, edges = mixed_edges(spark, count, nodes, most)
    got = {x.edge_id: x.split for x in H.cover_aware_split(edges).collect()}
    taken, n = covering(sets), len(sets)
    order = [r.edge_id for r in edges.withColumn("d", H.split_of(F.col("edge_id").cast("string"), 1)).orderBy("d", "edge_id").collect() if r.edge_id not in taken]
    train, val = int(n * 0.6), int(n * 0.2)
    want = dict.fromkeys(taken, "train") | {k: "train" if p + len(taken) < train else "val" if p + len(taken) < train + val else "test" for p, k in enumerate(order)}
    assert got == want


def test_cover_moves_edges_in_their_rounds_alone(spark, no_broadcast):
    _, edges = mixed_edges(spark, 3_000, 1_500, 7)
    store = lambda: sum(s.shuffleWriteRecords() for s in stages(spark))
    before, nodes = store(), edges.agg(F.sum("size")).first()[0]
    H.cover_aware_split(edges).collect()
    assert store() - before < 12 * nodes, (store() - before, nodes)


def stages(spark) -> list:
    q = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return [q.apply(k) for k in range(q.size())]


def test_split_moves_no_edges(spark):
    _, edges = mixed_edges(spark, 3_000, 1_500, 7)
    order = [r.edge_id for r in edges.withColumn("d", H.split_of(F.col("edge_id").cast("string"), 1)).orderBy("d", "edge_id").collect()]
    before, n = sum(s.shuffleWriteRecords() for s in stages(spark)), len(order)
    out = H.random_split(edges).collect()
    assert sum(s.shuffleWriteRecords() for s in stages(spark)) - before < 4 * n  # counts of draws from four tasks at most, twice
    assert {x.edge_id: x.split for x in out} == {k: "train" if p < int(n * 0.6) else "val" if p < int(n * 0.6) + int(n * 0.2) else "test" for p, k in enumerate(order)}


def test_statistics_move_vectors_and_no_sums(spark, no_broadcast):
    r = random.Random(5)
    vecs = {n: [r.random() for _ in range(8)] for n in range(400)}
    sets, edges = some_edges(spark, 300, 420, 60)
    vectors = spark.createDataFrame(list(vecs.items()), "node_id long, vec array<double>")
    rows, mb = moved_bytes(spark, lambda: layers.set_statistics(edges, vectors, 8).collect())
    got = {tuple(x.nodes): x.features for x in rows}
    for s in sets[:20]:
        held = [vecs.get(n, [0.0] * 8) for n in s]
        assert got[tuple(s)][:8] == pytest.approx([sum(v[k] for v in held) / 60 for k in range(8)])
        assert got[tuple(s)][8:16] == pytest.approx([max(v[k] for v in held) for k in range(8)])
    assert len(got) == 300 and mb < 0.69, mb  # 0.75 with the sums that moved


def test_expansion_moves_filters_and_not_meetings(spark, no_broadcast):
    sets, edges = some_edges(spark, 3_000, 1_000)
    near = {n: set() for n in range(1_000)}
    for s in sets:
        for n in s:
            near[n] |= set(s) - {n}
    before = sum(s.shuffleWriteRecords() for s in stages(spark))
    got = {x.edge_id: x for x in indexes.expansion_neighbors(edges).collect()}
    records = sum(s.shuffleWriteRecords() for s in stages(spark)) - before
    for k, s in enumerate(sets):
        a, b = near[s[0]], near[s[-1]]
        assert got[k].cn == len(a & b) and got[k].jc == pytest.approx(len(a & b) / len(a | b))
        assert got[k].aa == pytest.approx(sum(1 / math.log(len(near[m])) for m in a & b if len(near[m]) > 1))
    assert records < 200_000, records  # 270,000 with the meetings


def test_predictor_makes_its_features_once(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(losses, "predictor_auc", lambda train, test, names: seen.append(train._jdf.queryExecution().optimizedPlan().toString()) or train)
    registry.predictor(spark, "/root/testdata/sf0.001")
    assert "Join" not in seen[0] and "Aggregate" not in seen[0]
