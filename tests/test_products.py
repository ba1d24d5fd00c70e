"""Sums over common neighbours against plain sums; walks of nodes with more neighbours than any cap keeps."""

from __future__ import annotations

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave import scratch
from netweave.operators import indexes, products, representations, risks
from netweave.plans import registry


def plain_hitting(sets: dict[int, set], two_step: float = 0.5) -> dict[int, float]:
    w = defaultdict(lambda: defaultdict(float))
    for s in sets.values():
        for x in s:
            for y in s - {x}:
                w[x][y] += 1 / (len(s) - 1)
    p = {x: {y: v / sum(row.values()) for y, v in row.items()} for x, row in w.items()}
    h = lambda x, y: p[x].get(y, 0) + two_step * sum(v * p[m].get(y, 0) for m, v in p[x].items())
    out = {}
    for k, s in sets.items():
        pairs = [(x, y) for x in s for y in s if x < y]
        out[k] = sum((h(x, y) + h(y, x)) / 2 for x, y in pairs) / len(pairs) if pairs else 0.0
    return out


@pytest.mark.parametrize("entries", [40, 1 << 22])
def test_sums(spark, monkeypatch, entries):
    monkeypatch.setattr(products, "BLOCK_ENTRIES", entries)
    r = random.Random(3)
    rows = {s: {x: {m: round(r.random(), 3) for m in r.sample(range(60), r.randrange(1, 20))} for x in range(50)} for s in "lr"}
    ways = [(x, y) for x in range(55) for y in range(0, 55, 3)]
    frame = lambda s, key, by: spark.createDataFrame([(x, list(sorted(v)), [v[m] for m in sorted(v)], float(x)) for x, v in rows[s].items()], f"{key} long, ms array<long>, ws array<double>, {by} double")
    got = products.sums(spark.createDataFrame(ways, "x long, y long").repartition(3), frame("l", "x", "a"), frame("r", "y", "b")).collect()
    want = {}
    for x, y in ways:
        s = sum(v * rows["r"].get(y, {}).get(m, 0) for m, v in rows["l"].get(x, {}).items())
        if s:
            want[x, y] = s
    assert {(g.x, g.y): g.s for g in got} == pytest.approx(want) and all((g.a, g.b) == (g.x, g.y) for g in got)


def test_hitting_query_takes_all_neighbours(spark, tmp_path):
    r = random.Random(5)
    sets = {k: {0, *r.sample(range(1, 900), r.randrange(1, 4))} for k in range(300)} | {1000 + k: set(r.sample(range(1, 900), r.randrange(1, 5))) for k in range(200)}
    assert len(set().union(*(s for s in sets.values() if 0 in s))) > 2 * registry.TOP
    spark.createDataFrame([(k, x) for k, s in sets.items() for x in s], "l_orderkey long, l_partkey long").write.parquet(f"file://{tmp_path}/lineitem.parquet")
    got = {x.cand_id: x.risk for x in registry.queries()["hitting_risk"](spark, f"file://{tmp_path}").collect()}
    assert got == pytest.approx(plain_hitting(sets), abs=1e-6)
    e = scratch.materialize(registry.edges(spark, f"file://{tmp_path}"), "edges")
    capped = {x.cand_id: x.risk for x in risks.hitting(e, risks.as_candidates(e), 900).collect()}  # a cap that no node reaches
    assert got == pytest.approx(capped, abs=1e-6)


def test_third_neighbours_move_pairs(spark):
    r = random.Random(9)
    sets = [sorted(r.sample(range(14), r.randrange(1, 6))) for _ in range(60)] + [sorted(r.sample(range(14), 3)) for _ in range(30)]
    near = defaultdict(set)
    for s in sets:
        for t in combinations(s, 3):
            pairs = list(combinations(t, 2))
            for u in pairs:
                near[u] |= set(pairs) - {u}
    e = scratch.materialize(spark.createDataFrame([(k, s, len(s)) for k, s in enumerate(sets)], "edge_id long, nodes array<long>, size int"), "edges")
    found = indexes.third_neighbors(e)
    for x in found.collect():
        s = sets[x.edge_id]
        a, b = (near[tuple(s[:2])], near[tuple(s[-2:])]) if len(s) > 2 else (set(), set())
        want = (len(a & b), len(a & b) / len(a | b) if a | b else 0, sum(1 / math.log(len(near[m])) for m in a & b))
        assert (x.cn, x.jc, x.aa) == pytest.approx(want)
    assert indexes.third_neighbors(e.filter("size < 3")).agg({"cn": "max"}).first()[0] == 0


def test_third_neighbours_list_no_triples(spark, monkeypatch):
    monkeypatch.setattr(indexes, "edge_triples", None)  # triples and the links between their pairs were listed before
    e = scratch.materialize(spark.createDataFrame([(0, list(range(200)), 200), (1, [0, 1, 300], 3)], "edge_id long, nodes array<long>, size int"), "edges")
    assert {x.edge_id: x.cn for x in indexes.third_neighbors(e).collect()} == {0: 4.0, 1: 1.0}


def test_bank_blocks_move_few_times(spark, monkeypatch):
    monkeypatch.setattr(representations, "HELD", 4)
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(160, 4)), rng.normal(size=(300, 4))
    frame = lambda v, key, name: spark.createDataFrame([(k, x.tolist()) for k, x in enumerate(v)], f"{key} long, {name} array<double>")
    found = representations.nearest_in_bank(frame(a, "source_id", "vec"), frame(b, "edge_id", "rep"), 4, size=10)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    assert [x.nearest for x in found.orderBy("source_id").collect()] == pytest.approx((unit(a) @ unit(b).T).max(axis=1).tolist())
    sizes = []
    monkeypatch.setattr(type(spark.range(1)), "repartitionById", lambda df, n, c: (sizes.append((n, df.groupBy("turn").count().orderBy("turn").collect())), df.repartition(n, c))[1])
    assert representations.nearest_in_bank(frame(a, "source_id", "vec"), frame(b, "edge_id", "rep"), 4, size=10).count() == 160
    # 30 blocks of the bank in eight tasks' keeping, rows in two streams; before, each block met each, so 480 of both kinds moved
    assert [(n, [x["count"] for x in by]) for n, by in sizes] == [(16, [60, 128])]


def test_neighbours_move_packed(spark):
    r = random.Random(4)
    lists = {x: sorted({r.choice([r.randrange(-9, 9), r.randrange(1 << 20), r.randrange(1 << 62)]) for _ in range(r.randrange(1, 40))}) for x in range(60)}
    near = spark.createDataFrame([(x, y) for x, ys in lists.items() for y in ys], "x long, y long")
    packed = {p.x: bytes(p.list) for p in indexes.packed_neighbors(near).collect()}
    for x, ys in lists.items():
        got, of = indexes._unpack(np.frombuffer(packed[x], np.uint8), np.array([0]))
        assert got.tolist() == ys and not of.any()
    dense = spark.range(1000).selectExpr("0L AS x", "id * 90 AS y")
    assert len(indexes.packed_neighbors(dense).first().list) == 1000  # 8,000 as numbers
    held = spark.createDataFrame([(k, x) for k in range(40) for x in r.sample(range(60), 5)], "k long, x long").withColumn("own", F.array(F.lit(3).cast("long")))
    mine = defaultdict(list)
    for h in held.collect():
        mine[h.k] += lists[h.x]
    met = indexes.gathered(held, near, "k").withColumn("own", F.array(F.lit(3).cast("long")))
    got = defaultdict(list)
    for x in sorted(indexes.best_met(met, "own", 7, "n").collect(), key=lambda x: (x.k, x.place)):
        got[x.k].append((x.node_id, x.n))
    assert got == {k: sorted(((y, v.count(y)) for y in set(v) - {3}), key=lambda c: (-c[1], c[0]))[:7] for k, v in mine.items()}
