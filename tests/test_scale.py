"""What moves between tasks follows the input, not the meetings of neighbours; results against plain loops."""

from __future__ import annotations

import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from netweave import scratch
from netweave.operators import indexes, proposals, representations, risks, samplers


def moved(spark, df) -> tuple[list, int]:
    """The rows of ``df``, and the shuffle records that its stages wrote."""
    store, none = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)
    total = lambda: sum(s.shuffleWriteRecords() for s in (lambda q: [q.apply(k) for k in range(q.size())])(store.stageList(None, False, False, none, None)))
    before, rows = total(), df.collect()
    return rows, total() - before


@pytest.fixture
def no_broadcast(spark):
    """Tables of any size meet as large ones do."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


def some_edges(spark, count: int, nodes: int, size: int = 4, seed: int = 3):
    sets = [sorted(random.Random(seed * 1000 + k).sample(range(nodes), size)) for k in range(count)]
    rows = spark.createDataFrame(list(enumerate(sets)), "edge_id long, nodes array<long>").withColumn("size", F.size("nodes"))
    return sets, rows


def support_of(sets) -> Counter:
    return Counter(p for s in sets for p in combinations(s, 2))


def near_of(sets, top: int) -> dict[int, list[int]]:
    near = defaultdict(list)
    for (x, y), n in support_of(sets).items():
        near[x].append((-n, y))
        near[y].append((-n, x))
    return {x: [y for _, y in sorted(v)[:top]] for x, v in near.items()}


def test_replacement_pool_moves_nodes_and_not_meetings(spark, no_broadcast):
    sets, edges = some_edges(spark, 400, 120)
    rows, records = moved(spark, indexes.replacement_pool(edges, 32, 8))
    near, want = near_of(sets, 32), set()
    for k, s in enumerate(sets):
        met = Counter(y for x in s for y in near[x] if y not in s)
        want |= {(k, y, n, place + 1) for place, (y, n) in enumerate(sorted(met.items(), key=lambda m: (-m[1], m[0]))[:8])}
    assert {(r["edge_id"], r["node_id"], r["anchors"], r["place"]) for r in rows} == want
    assert records < 400 * 4 * 12  # 400 edges of 4 nodes with 32 neighbours each: 51,200 meetings


def _weights(sets) -> dict[int, dict[int, float]]:
    near = defaultdict(lambda: defaultdict(float))
    for s in sets:
        for x, y in combinations(s, 2):
            near[x][y] += 1 / (len(s) - 1)
            near[y][x] += 1 / (len(s) - 1)
    return near


def test_walks_move_those_neighbours_only_that_may_be_common(spark, no_broadcast):
    sets, edges = some_edges(spark, 1500, 600)
    near = _weights(sets)
    cosine = lambda x, y: sum(w * near[y].get(m, 0.0) for m, w in near[x].items()) / math.sqrt(sum(w * w for w in near[x].values()) * sum(w * w for w in near[y].values()))
    chance = {x: {y: w / sum(v.values()) for y, w in v.items()} for x, v in near.items()}
    reach = lambda x, y: chance[x].get(y, 0.0) + 0.5 * sum(p * chance[m].get(y, 0.0) for m, p in chance[x].items())
    for f, want, most in ((risks.co_walk, cosine, 200000), (risks.hitting, lambda x, y: (reach(x, y) + reach(y, x)) / 2, 350000)):
        rows, records = moved(spark, f(edges, risks.as_candidates(edges)))
        found = {r["cand_id"]: r["risk"] for r in rows}
        assert all(abs(found[k] - sum(want(x, y) for x, y in combinations(s, 2)) / 6) < 1e-9 for k, s in enumerate(sets))
        assert records < most, (f.__name__, records)  # 9,000 pairs whose nodes have 30 neighbours each: 270,000 meetings one way


def test_node_risks_score_a_common_set_once(spark, no_broadcast):
    sets = [[0, k + 1, k + 2, k + 3] for k in range(0, 900, 3)]  # node 0 is the anchor of many sources
    edges = spark.createDataFrame(list(enumerate(sets)), "edge_id long, nodes array<long>").withColumn("size", F.size("nodes"))
    rows, records = moved(spark, proposals.node_risks(proposals.anchor_pool(edges, edges), edges, ("closure",)).select("source_id", "node_id", "support", "place", "anchor", "closure"))
    near, support = near_of(sets, 32), support_of(sets)
    by = defaultdict(list)
    for r in rows:
        by[r["source_id"]].append(r)
    assert len(by) > 50  # those that keep node 0; the others have no neighbours outside
    for k, found in by.items():
        anchor = found[0]["anchor"][0]
        want = sorted(y for y in near[anchor] if y not in sets[k])[:16]
        assert [r["node_id"] for r in sorted(found, key=lambda r: r["place"])] == want
        assert all(r["support"] == 1 and abs(r["closure"] - math.log1p(support[tuple(sorted((anchor, r["node_id"])))])) < 1e-12 for r in found)
    assert records < 4500, records


def _draw(*parts) -> int:
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


@pytest.mark.parametrize("hub,first", [(4096, 4), (14, 1)])
def test_clique_moves_nodes_and_not_meetings(spark, no_broadcast, monkeypatch, hub, first):
    monkeypatch.setattr(samplers, "HUB", hub)
    monkeypatch.setattr(samplers, "FIRST", first)
    sets, edges = [], None
    for size in (2, 3, 4):
        sets += some_edges(spark, 120, 70, size, size)[0]
    edges = spark.createDataFrame(list(enumerate(sets)), "edge_id long, nodes array<long>").withColumn("size", F.size("nodes"))
    known, near = {tuple(s) for s in sets}, {x: set(v) for x, v in near_of(sets, 1000).items()}
    rows, records = moved(spark, samplers.clique(edges, edges, 70))
    found = {r["source_id"]: r["nodes"] for r in rows if not r["fallback"]}
    want = {}
    for k, s in enumerate(sets):
        made = []
        for new in set().union(*(near[x] for x in s)) - set(s):
            beside = [x for x in s if new in near[x]]
            if len(beside) >= len(s) - 1:
                for gone in s if len(beside) == len(s) else set(s) - set(beside):
                    nodes = sorted(set(s) - {gone} | {new})
                    made += [(_draw(1, "gone", k, 0, gone), _draw(1, "new", k, 0, new), nodes)] if tuple(nodes) not in known else []
        if made:
            want[k] = min(made)[2]
    assert found == want and len(rows) == 360
    assert hub < 4096 or records < 13500, records  # 1,080 nodes of sources with 30 neighbours each


def test_motif_keeps_the_least_draw_by_hash(spark, monkeypatch):
    _, edges = some_edges(spark, 60, 40, 3)
    plans, write = [], scratch.materialize

    def noted(df, name):
        plans.extend([df._jdf.queryExecution().executedPlan().toString()] if name == "growing" else [])
        return write(df, name)

    monkeypatch.setattr(scratch, "materialize", noted)
    rows = samplers.motif(edges, edges, 40).collect()
    assert len(rows) == 60 and all(len(set(r["nodes"])) == 3 for r in rows)
    assert len(plans) == 3 and not any("SortAggregate" in p for p in plans)


def test_tables_that_grow_are_not_broadcast(spark):
    """Even where they look small, as they do here."""
    plan = lambda df: (df.collect(), df._jdf.queryExecution().executedPlan().toString())[1]
    _, edges = some_edges(spark, 40, 30)
    vectors = spark.range(30).select(F.col("id").alias("node_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("vec"))
    bank = edges.join(representations.set_vectors(edges, vectors, 2), "nodes").select("edge_id", "rep")
    rows = vectors.withColumnRenamed("node_id", "source_id")
    assert "Broadcast" not in plan(indexes.third_neighbors(edges))
    assert "Broadcast" not in plan(representations.set_vectors(edges, vectors, 2))
    assert "Broadcast" not in plan(representations.nearest_in_bank(rows, scratch.materialize(bank, "bank"), 2))


def test_risk_controlled_makes_every_attempt(spark):
    """Also those after an accepted one."""
    _, edges = some_edges(spark, 12, 400, 4)
    rows = samplers.risk_controlled(edges, edges, 400, {"closure": 99.0}, tries=4, every=True).collect()
    assert len(rows) == 12 and all(r["accepted"] and r["attempt"] == 0 and r["valid"] == 4 for r in rows)
