"""Candidate pools, run modes, retrieval against a plain version, stored banks and metrics from samplers."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave import scratch
from netweave.operators import banks, layers, protocols, representations, retrieval, samplers
from netweave.operators.retrieval import Mode
from netweave.sources import hyperedges as H

NODES, DIM = 50, 4


@pytest.fixture(scope="module")
def graph(spark):
    r = random.Random(5)
    sets = sorted({tuple(sorted(r.sample(range(NODES), r.choice([2, 3, 4])))) for _ in range(60)})
    return scratch.materialize(spark.createDataFrame([(k, list(s), len(s)) for k, s in enumerate(sets)], "edge_id long, nodes array<long>, size int"), "graph")


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    return scratch.materialize(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(rng.normal(size=(NODES - 1, DIM)))], "node_id long, vec array<double>"), "vectors")


@pytest.fixture(scope="module")
def pool(graph):
    rows = retrieval.candidate_pool(graph, graph, NODES, "named", 8, names=("sns", "half_corruption", "cns"), per_sampler=3, pad=False)
    return scratch.materialize(rows, "pool")


@pytest.fixture(scope="module")
def proposals(graph, spark):
    rng = np.random.default_rng(9)
    return spark.createDataFrame([(x.edge_id, rng.normal(size=DIM).tolist()) for x in graph.collect()], "source_id long, vec array<double>")


def test_modes():
    w = lambda m, epoch=2: tuple(round(x, 9) for x in m.weights(m.similarity_share(0.6, epoch, 5, 0.1)))
    assert w(Mode.FULL) == (0.3, 0.7) and w(Mode.FULL, 50) == (0.6, 0.4) and w(Mode.NO_DIFFUSION_SIGNAL) == (0.0, 0.7)
    assert w(Mode.HARD_ONLY) == w(Mode.NO_DIFFUSION) == w(Mode.NO_DIFFUSION_PROPOSAL) == (0.0, 1.0) and w(Mode.DIFFUSION_ONLY) == (1.0, 0.0)
    assert {m for m in Mode if not m.discrete} == {Mode.PLAIN_DIFFUSION, Mode.NO_DISCRETE_RETRIEVAL}
    assert {m for m in Mode if not m.generator_risk} == {Mode.PLAIN_DIFFUSION, Mode.NO_RISK, Mode.NO_RISK_CONTROL}
    assert Counter(m.teacher_target for m in Mode) == {"safe_teacher": len(Mode) - 3, "none": 1, "undistilled_noise": 1, "positive": 1}
    assert [m for m in Mode if m.pool("union") != "union"] == [Mode.NO_RISK_CONTROL] and [m for m in Mode if not m.boundary] == [Mode.NO_BOUNDARY]
    assert Mode.TOP_SCORE_ONLY.choice("topk_sample", 5) == ("top_score", 1) and Mode.FULL.choice("topk_sample", 5) == ("topk_sample", 5)
    assert Mode.FULL.partitioned() and not Mode.NO_DIFFUSION_PROPOSAL.partitioned() and Mode.NO_DIFFUSION_PROPOSAL.partitioned(True) and not Mode.PLAIN_DIFFUSION.partitioned(True)


def plain_scores(pool, vectors, proposals, proto):
    v = {x.node_id: np.array(x.vec) for x in vectors.collect()}
    p = {x.source_id: np.array(x.vec) for x in proposals.collect()}
    cos = lambda a, b: 0.0 if not np.linalg.norm(a) * np.linalg.norm(b) else float(a @ b / (np.linalg.norm(a) * np.linalg.norm(b)))
    out = defaultdict(list)
    for x in pool.collect():
        known = [v[n] for n in x.nodes if n in v]
        rep = np.mean(known, axis=0) if known else np.zeros(DIM)
        out[x.source_id].append((tuple(x.nodes), x.label, cos(rep, p[x.source_id]), 1 / (1 + math.exp(-4 * cos(rep, proto)))))
    return out


def plain_choice(rows, a, b, normalization, k):
    def norm(values, labels):
        groups = labels if normalization.startswith("pool") else [""] * len(values)
        out = list(values)
        for g in set(groups):
            at = [i for i, x in enumerate(groups) if x == g]
            sub = [values[i] for i in at]
            if normalization in ("local_zscore", "pool_zscore"):
                std = float(np.std(sub))
                new = [0.0 if std <= 1e-12 else (x - float(np.mean(sub))) / std for x in sub]
            elif normalization == "robust_zscore":
                mad = 1.4826 * float(np.median([abs(x - np.median(sub)) for x in sub]))
                new = [0.0 if mad <= 1e-12 else (x - float(np.median(sub))) / mad for x in sub]
            else:
                new = sub
            for i, x in zip(at, new):
                out[i] = x
        return out

    labels = [r[1] for r in rows]
    s, h = norm([r[2] for r in rows], labels), norm([r[3] for r in rows], labels)
    scored = sorted((-round(a * x + b * y, 9), ",".join(map(str, r[0]))) for x, y, r in zip(s, h, rows))
    return [n for _, n in scored[:k]]


@pytest.mark.parametrize("mode,normalization", [(Mode.FULL, "local_zscore"), (Mode.FULL, "robust_zscore"), (Mode.FULL, "pool_zscore"), (Mode.DIFFUSION_ONLY, "none"), (Mode.HARD_ONLY, "local_zscore"), (Mode.NO_DIFFUSION_SIGNAL, "none")])
def test_retrieval_equals_a_plain_version(graph, vectors, pool, proposals, mode, normalization):
    proto = scratch.materialize(representations.prototype(representations.set_vectors(graph, vectors, DIM), DIM), "proto")
    want = plain_scores(pool, vectors, proposals, np.array(proto.first().proto))
    a, b = mode.weights(mode.similarity_share(0.6, 3, 5))
    got = retrieval.retrieve(pool, vectors, proposals, DIM, mode, per_source=2, epoch=3, hardness=retrieval.unit_hardness(proto), strategy="topk_multi", normalization=normalization)
    chosen = defaultdict(list)
    for x in got.orderBy("source_id", "place").collect():
        chosen[x.source_id].append(",".join(map(str, x.nodes)))
    assert dict(chosen) == {k: plain_choice(rows, a, b, normalization, 2) for k, rows in want.items()}


def test_every_mode_runs(graph, vectors, pool, proposals):
    proto = representations.prototype(representations.set_vectors(graph, vectors, DIM), DIM)
    hard = retrieval.unit_hardness(scratch.materialize(proto, "proto"))
    sources = graph.count()
    for mode in Mode:
        out = retrieval.retrieve(pool, vectors, proposals, DIM, mode, hardness=hard)
        assert out.count() == sources and ("vec" in out.columns) == (not mode.discrete)
    with pytest.raises(ValueError):
        retrieval.retrieve(pool, vectors, None, DIM, Mode.FULL, hardness=hard)
    assert retrieval.retrieve(pool, vectors, None, DIM, Mode.NO_DIFFUSION_PROPOSAL, hardness=hard).count() == sources
    with pytest.raises(ValueError, match="teacher"):
        retrieval.retrieve(pool, vectors, proposals, DIM, hardness=hard, teacher=pool.limit(3))
    mixed = retrieval.retrieve(pool, vectors, proposals, DIM, hardness=hard, per_source=2, mix={"sns": 1.0, "half_corruption": 1.0, "cns": 1.0})
    figures = {x.label: x for x in retrieval.retrieval_figures(mixed, pool).collect()}
    assert sum(x.chosen_rate for x in figures.values()) == pytest.approx(1) and sum(x.candidate_rate for x in figures.values()) == pytest.approx(1)
    a = sorted(map(str, retrieval.retrieve(pool, vectors, proposals, DIM, Mode.RANDOM_PROPOSAL, hardness=hard, seed=3).collect()))
    assert a == sorted(map(str, retrieval.retrieve(pool.repartition(3), vectors, proposals, DIM, Mode.RANDOM_PROPOSAL, hardness=hard, seed=3).collect()))
    norms = representations.random_vectors(pool.select("source_id").distinct(), DIM).selectExpr("aggregate(vec, 0D, (s, x) -> s + x * x) AS n").collect()
    assert all(x.n == pytest.approx(1) for x in norms)


@pytest.mark.parametrize("name", ["risk_sns", "uncontrolled_union", "union_hard"])
def test_pool_modes(graph, name):
    options = {"risk_controlled": {"bounds": {"nearest": 0.4}, "tries": 4}}
    hardness = lambda rows: rows.withColumn("hardness", F.size("nodes") + F.pmod(F.xxhash64("nodes"), F.lit(100)) / 100.0)
    rows = retrieval.candidate_pool(graph, graph, NODES, name, 4, hardness=hardness if name == "union_hard" else None, options=options).collect()
    per = defaultdict(list)
    for x in rows:
        per[x.source_id].append(x)
    known = {tuple(x.nodes) for x in graph.collect()}
    assert len(per) == graph.count() and all(sorted(x.slot for x in v) == [0, 1, 2, 3] for v in per.values())
    assert {x.label for x in rows} <= set(retrieval.POOLS[name]) and not {tuple(x.nodes) for x in rows} & known
    if name == "union_hard":
        for v in per.values():
            ordered = [x.hardness for x in sorted(v, key=lambda x: x.slot)][: len({tuple(x.nodes) for x in v})]
            assert ordered == sorted(ordered, reverse=True)
    with pytest.raises(ValueError):
        retrieval.candidate_pool(graph, graph, NODES, "other", 4)


@pytest.fixture(scope="module")
def bank(spark, graph, tmp_path_factory):
    s = scratch.materialize(H.random_split(graph), "split")
    sources = s.filter("split = 'test'")
    rows = scratch.materialize(banks.protocol_negatives(sources, s, NODES, ("sns", "mns", "cns", "mix"), per_source=2), "negatives")
    path = f"file://{tmp_path_factory.mktemp('bank')}/b"
    banks.write_bank(path, rows, sources, s, NODES, per_source=2, seed=4, split="test", metadata=banks.sampled_metadata(rows))
    return path, sources, s, rows


def test_bank_round_trip(spark, bank):
    path, sources, s, rows = bank
    got, metadata = banks.read_bank(spark, path, sources, s, NODES, ("sns", "mix"), per_source=2, seed=4, split="test")
    key = lambda x: (x.protocol, x.source_id, x.slot, tuple(x.nodes))
    assert sorted(map(key, got.collect())) == sorted(map(key, rows.filter("protocol in ('sns', 'mix')").collect()))
    assert metadata["sns"]["rows"] == 2 * sources.count() and 0 <= banks.read_manifest(spark, path)["protocols"][0]["metadata"]["fallback_rate"] <= 1
    batches = banks.as_batches(sources, got, ("sns", "mix"))
    assert {(x.protocol, x.label): x["count"] for x in batches.groupBy("protocol", "label").count().collect()} == {(p, y): n for p in ("sns", "mix") for y, n in ((1, sources.count()), (0, 2 * sources.count()))}


def test_bank_that_does_not_fit(spark, bank):
    path, sources, s, rows = bank
    good = {"sources": sources, "positives": s, "num_nodes": NODES, "protocols": ("sns",), "per_source": 2, "seed": 4, "split": "test"}
    for change in ({"seed": 5}, {"split": "validation"}, {"num_nodes": NODES + 1}, {"positives": s.limit(5)}, {"per_source": 1}, {"sources": s.filter("split = 'val'")}, {"protocols": ("other",)}, {"kind": "replay"}):
        with pytest.raises(ValueError):
            banks.read_bank(spark, path, **{**good, **change})
    known = s.filter("split = 'train'").first().nodes
    swapped = F.when(F.col("slot") == 0, 1).otherwise(0)
    tampered = {
        "order": rows.withColumn("slot", swapped), "missing": rows.filter("not (protocol = 'sns' and slot = 1)"), "twice": rows.unionByName(rows.limit(1)),
        "node": rows.withColumn("nodes", F.array_sort(F.concat(F.slice("nodes", 2, 99), F.array(F.lit(NODES - 1).cast("long"))))),
        "range": rows.withColumn("nodes", F.transform("nodes", lambda x: x + NODES)), "known": rows.withColumn("nodes", F.when(F.size("nodes") == len(known), F.array(*[F.lit(x) for x in known])).otherwise(F.col("nodes"))),
        "size": rows.withColumn("nodes", F.slice("nodes", 1, 1)),
    }
    for k, (name, changed) in enumerate(tampered.items()):
        broken = f"{path}-{k}"
        changed.select("protocol", "source_id", "slot", "nodes").write.partitionBy("protocol").parquet(f"{broken}/rows")
        spark.read.text(f"{path}/manifest").coalesce(1).write.text(f"{broken}/manifest")
        with pytest.raises(ValueError):
            banks.read_bank(spark, broken, **good)
        if name in ("range", "known", "size", "missing", "twice"):
            with pytest.raises(ValueError):
                banks.write_bank(f"{broken}-new", changed, sources, s, NODES, per_source=2, seed=4, split="test")


def test_bank_with_a_row_more_in_a_protocol_not_asked_for(spark, bank):
    path, sources, s, rows = bank
    broken = f"{path}-more"
    rows.unionByName(rows.filter("protocol = 'mns'").limit(1)).select("protocol", "source_id", "slot", "nodes").write.partitionBy("protocol").parquet(f"{broken}/rows")
    spark.read.text(f"{path}/manifest").coalesce(1).write.text(f"{broken}/manifest")
    with pytest.raises(ValueError):
        banks.read_bank(spark, broken, sources, s, NODES, ("sns",), per_source=2, seed=4, split="test")


def test_replay_bank(spark, graph, tmp_path):
    train = graph.filter("edge_id % 2 = 0")
    rows = None
    for k in range(2):
        part = samplers.half_corruption(train, train, NODES, seed=k).select(F.lit(k).alias("bank"), "source_id", "nodes")
        rows = part if rows is None else rows.unionByName(part)
    path = f"file://{tmp_path}/replay"
    banks.write_replay_bank(path, rows, train, NODES, seed=7)
    got = banks.read_replay_bank(spark, path, train, NODES, seed=7)
    assert sorted((x.bank, x.source_id, tuple(x.nodes)) for x in got.collect()) == sorted((x.bank, x.source_id, tuple(x.nodes)) for x in rows.collect())
    with pytest.raises(ValueError):
        banks.read_replay_bank(spark, path, train.filter("edge_id > 0"), NODES, seed=7)


def test_digest_tree(spark):
    """Order counts, partitions do not, and blocks of any size of tree agree with themselves."""
    r = random.Random(1)
    rows = [(k, sorted(r.sample(range(99), 3)), 3) for k in range(60)]
    make = lambda rows, n: spark.createDataFrame(rows, "edge_id long, nodes array<long>, size int").repartition(n)
    one = lambda df, block: H.sequence_digest(df, block).first()[0]
    for block in (4096, 7, 2):
        assert one(make(rows, 1), block) == one(make(rows, 5), block)
    other = [(k, n, s) for (k, _, s), n in zip(rows, [rows[1][1], rows[0][1], *[x[1] for x in rows[2:]]])]
    assert one(make(rows, 2), 7) != one(make(other, 2), 7)
    assert H.sequence_digest(make(rows, 1).filter("edge_id < 0")).count() == 0


def test_metrics_of_single_class_protocols(spark):
    rows = [(k, int(k % 2), 0.1 * k, "two") for k in range(6)] + [(k, 1, 0.9, "one") for k in range(3)]
    p = spark.createDataFrame(rows, "pos long, label int, score double, protocol string")
    got = {x.protocol: x for x in protocols.evaluate_all(p).collect()}
    assert got["one"].auc is None and got["one"].ap is None and got["one"].ndcg is None and got["two"].auc == pytest.approx(6 / 9)
    out = protocols.objectives(protocols.evaluate(p), {"one": 5.0}).first()
    assert out.mean_auc == out.min_auc == pytest.approx(6 / 9) and out.mean_ap == pytest.approx(got["two"].ap)


def test_set_predictor_and_layers(spark):
    """Sets within communities against mixed ones; attention of equal logits is the mean, and large logits do no harm."""
    r = random.Random(3)
    draw = lambda c: tuple(sorted(r.sample(range(c * 30, c * 30 + 30), 4)))
    known = [draw(k % 4) for k in range(240)]
    mixed = [tuple(sorted(r.sample(range(120), 4))) for _ in range(240)]
    rows = spark.createDataFrame([(list(s), 1, k) for k, s in enumerate(known)] + [(list(s), 0, k) for k, s in enumerate(mixed)], "nodes array<long>, label int, k long").dropDuplicates(["nodes"])
    inc = spark.createDataFrame([(k, n) for k, s in enumerate(known) if k % 3 for n in s], "edge_id long, node_id long")
    vectors = layers.smoothed_vectors(inc, 8, 2)
    model = layers.SetPredictor((8,)).fit(rows.filter("k % 3 > 0"), vectors, 8)
    out = model.score(rows.filter("k % 3 = 0"), vectors).select(F.lit("p").alias("protocol"), F.col("k").alias("pos"), "label", "score")
    assert protocols.evaluate(out).first().auc > 0.9
    with pytest.raises(ValueError):
        layers.SetPredictor().fit(rows.filter("label = 1"), vectors, 8)
    nodes = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1e6, 0.0])], "node_id long, vec array<double>")
    edges = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 2), (2, 9)], "edge_id long, node_id long")
    got = {x.edge_id: x.rep for x in layers.attention_pool(edges, nodes, [0.0, 0.0]).collect()}
    assert got == {0: [2.0, 3.0], 1: pytest.approx([500001.5, 2.0])}
    assert {x.edge_id: x.rep for x in layers.attention_pool(edges, nodes, [1.0, 0.0]).collect()}[1] == pytest.approx([1e6, 0.0])
    with pytest.raises(ValueError):
        layers.Dense(((1.0,),), (0.0,), "other")
    normed = nodes.select(layers.layer_norm(F.col("vec")).alias("v")).first().v
    assert normed == pytest.approx([-1, 1], abs=1e-4)


def plain_roles(listed, teacher, retrieval):
    a, b = listed[:teacher], listed[teacher : teacher + retrieval]
    if set(a) & set(b):
        u = list(dict.fromkeys(listed))
        n = min(retrieval, max(1, len(u) - 1))
        t = max(1, min(teacher, len(u) - n))
        a, b = u[:t], u[t : t + n]
        a, b = [a[k % len(a)] for k in range(teacher)], [b[k % len(b)] for k in range(retrieval)]
    return {("teacher", k): x for k, x in enumerate(a)} | {("retrieval", k): x for k, x in enumerate(b)}


@pytest.mark.parametrize("teacher,retrieval_", [(1, 2), (3, 4), (2, 8)])
def test_roles(spark, teacher, retrieval_):
    r = random.Random(teacher)
    lists = {k: [(r.randrange(6),) for _ in range(r.randrange(2, 9))] for k in range(80)}
    lists = {k: v for k, v in lists.items() if len(set(v)) > 1}
    pool = spark.createDataFrame([(k, s, list(n), "x") for k, v in lists.items() for s, n in enumerate(v)], "source_id long, slot int, nodes array<long>, label string")
    got = defaultdict(dict)
    for x in retrieval.split_roles(pool, teacher, retrieval_).collect():
        assert (x.role, x.slot) not in got[x.source_id]
        got[x.source_id][x.role, x.slot] = tuple(x.nodes)
    assert dict(got) == {k: plain_roles(v, teacher, retrieval_) for k, v in lists.items()}
    one = pool.filter("source_id = 0").limit(1).withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    with pytest.raises(Exception, match="single candidate"):
        retrieval.split_roles(one, 1, 1).collect()
    assert retrieval.split_roles(one, 1, 1, strict=False).count() == 0


def test_exclude_teacher(spark):
    rows = [(1, k, [n], "x") for k, n in enumerate([5, 6, 7, 5])] + [(2, 0, [5], "x"), (2, 1, [9], "y")]
    c = scratch.materialize(spark.createDataFrame(rows, "source_id long, slot int, nodes array<long>, label string"), "c")
    t = spark.createDataFrame([(1, [6]), (2, [5]), (1, [6])], "source_id long, nodes array<long>")
    got = {(x.source_id, x.slot): x.nodes[0] for x in retrieval.exclude_teacher(c, t, 5).collect()}
    assert got == {(1, 0): 5, (1, 1): 7, (1, 2): 5, (1, 3): 5, (1, 4): 7} | {(2, k): 9 for k in range(5)}
    with pytest.raises(ValueError):
        retrieval.exclude_teacher(c, c, 5)


def test_future_probe(graph):
    """A size-2 future that holds all free pairs is always hit; count bounds the sources."""
    pairs = graph.sparkSession.range(NODES * NODES).select((F.col("id") / NODES).cast("long").alias("a"), (F.col("id") % NODES).alias("b")).filter("a < b").select(F.array("a", "b").alias("nodes"))
    out = protocols.future_probe(graph.filter("size = 2"), pairs, NODES, count=7, per_source=2).first()
    assert (out.hits, out.samples, out.hit_rate) == (14, 14, 1.0)
    assert protocols.future_probe(graph.filter("size = 3"), pairs, NODES, count=5, name="half_corruption").first().hits == 0
