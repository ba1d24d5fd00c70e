"""SimHash components, periodic runs and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm import negatives, periodic, simhash

SCHEMA = "doc_id long, text string, source string"


def docs_of(spark, rows):
    return scratch.materialize(spark.createDataFrame(rows, SCHEMA), "docs")


def ascii_words(text):
    return (text or "").encode().split()


def plain_fingerprint(text):
    words = [w.decode() for w in (text or "").encode().lower().split()]
    shingles = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(values, threshold):
    """The least place reachable from each place."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= threshold:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(values))]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(11)
    prose = lambda n: " ".join(f"{r.choice('AaBb')}{r.randrange(200)}É" for _ in range(n))
    rows = [(k, prose(r.randrange(1, 60))) for k in range(60)]
    base = prose(700)
    rows += [(100 + k, base.replace(" ", f" x{k} ", 1 + k % 3)) for k in range(30)] + [(7, base), (7, base), (None, base), (None, prose(30))]
    rows += [(200, None), (201, ""), (202, " \t\n"), (203, "one"), (204, "ONE"), (205, "a b"), (206, "x y z w q"), (207, prose(30_000)), (3, base.upper())]
    return rows


@pytest.mark.parametrize("bucket", [256, 4])
def test_simhash_components(spark, texts, bucket):
    docs = docs_of(spark, [(*row, "s") for row in texts])
    got = simhash.near_duplicates(docs, bucket=bucket)
    prints = [plain_fingerprint(t) for _, t in texts]
    roots = plain_components(prints, 2)
    least = {c: min((i for (i, _), x in zip(texts, roots) if x == c and i is not None), default=None) for c in set(roots)}
    want = Counter((i, f"{p:016x}", least[c]) for (i, _), p, c in zip(texts, prints, roots))
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got.collect()) == want
    assert len(set(roots)) < len(texts) - 20  # the copies hang together
    kept = simhash.keep_one(docs, bucket=bucket)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))


def planted_values(r, n):
    base, out = r.getrandbits(64), set()
    while len(out) < n:
        v = base if r.random() < 0.9 else r.getrandbits(64)
        for _ in range(r.randrange(7)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return sorted(out)


@pytest.mark.parametrize("threshold", [1, 2, 3])
def test_pigeonring_links(spark, threshold):
    """No pair is lost, whether a key is split or not, and links hold between near fingerprints only."""
    values = planted_values(random.Random(threshold), 400)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = scratch.materialize(spark.createDataFrame([(v,) for v in signed], "fp long"), "fps")
    want = plain_components(values, threshold)
    for bucket in (1000, 8):
        place = {v: k for k, v in enumerate(signed)}
        found = [(place[x.a], place[x.b]) for x in simhash.links(fps, threshold, bucket).collect()]
        root = simhash._roots(len(values), np.array([a for a, _ in found]), np.array([b for _, b in found]))
        assert root.tolist() == want
    with pytest.raises(ValueError):
        simhash.links(fps, 0)


def plain_runs(seq, least):
    out, n = set(), len(seq)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(least, 2 * q) and not any(all(seq[i + k] == seq[i + k + d] for k in range(size - d)) for d in range(1, q)):
                out.add((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_runs_of_small_alphabets():
    r = random.Random(5)
    for _ in range(120):
        seqs = []
        for _ in range(r.randrange(1, 6)):
            n, kinds = r.randrange(70), r.choice([1, 2, 3, 5])
            s = [r.randrange(kinds) for _ in range(n)]
            seqs.append((s[: r.randrange(1, n + 1)] * n)[:n] if n and r.random() < 0.5 else s)
        for least in (2, 12):
            for s, got in zip(seqs, periodic.runs_of([np.array(x, np.int64) for x in seqs], least)):
                assert [tuple(x) for x in got.tolist()] == plain_runs(s, least)
                assert least == 2 or not len(got) or periodic.may_repeat(np.array(s, np.int64))


def plain_op12(doc_id, text):
    words = [w.decode() for w in ascii_words(text)]
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words, 12)
    drop = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if best[1] else None, sha(listed), sha(" ".join(w for k, w in enumerate(words) if k not in drop)))


def test_periodic_query(spark, tmp_path):
    r = random.Random(6)
    prose = lambda n, k: " ".join(f"w{r.randrange(k)}" for _ in range(n))
    rows = [(k, prose(r.randrange(80), r.choice([2, 300])), "s") for k in range(150)]
    rows += [(300, None, "s"), (301, "", "s"), (302, "a b " * 40, None), (303, "x\n" * 11, "s"), (304, "x\n" * 12, "s"), (5, "y " * 13, "s"), (5, "y " * 13, "s")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = periodic.op12(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == Counter(plain_op12(i, t) for i, t, _ in rows)


def test_runs_of_long_texts_and_edges(spark):
    long = " ".join(f"w{k}" for k in range(200_000)) + " again" * 300 + " p q r" * 30_000
    docs = docs_of(spark, [(1, long, "s"), (None, "z " * 20, "s"), (2, "A  b\tc", "s"), (3, None, "s")]).withColumns({c: F.lit("x") for c in ("f", "i", "runs", "collapsed", "__ROW", "words")})
    found = {x.doc_id: x for x in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in found[1].runs] == [(200_000, 300, 1), (200_300, 90_000, 3)]
    assert [tuple(x) for x in found[None].runs] == [(0, 20, 1)] and not found[3].runs and found[3].collapsed == ""
    out = periodic.collapse(docs)
    assert out.columns == docs.columns
    texts = {x.doc_id: x.text for x in out.select("doc_id", "text").collect()}
    assert texts[2] == "A  b\tc" and texts[None] == "z" and texts[3] is None and texts[1].endswith(" w199999 again p q r")
    for f in (periodic.find_runs, periodic.collapse, simhash.near_duplicates, simhash.keep_one):
        assert f(docs.filter("doc_id = -1")).count() == 0


def plain_negatives(rows, positives=5, negatives_=10):
    rows = [(i, tuple(int(np.floor(256 * float(x))) for x in v), y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = Counter()
    for k, (i, v, y) in enumerate(rows):
        if i % 100:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, z) for m, (j, w, z) in enumerate(rows) if m != k)
        for s, j, _ in [x for x in scored if x[2] == y][:positives]:
            hits = [x for x in scored if x[2] != y and 30 * -s <= 100 * -x[0] <= 90 * -s][:negatives_]
            out.update((i, j, place + 1, x[1], -s, -x[0]) for place, x in enumerate(hits))
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def test_hard_negatives(spark):
    """Small blocks and chunks, ties, repeated ids and vectors, short vectors, negative scores, nulls and values that are not finite."""
    r = random.Random(13)
    near = lambda c: [x + r.gauss(0, 0.05) for x in c]
    centres = [[r.gauss(0, 0.3) for _ in range(6)] for _ in range(4)]
    rows = [(k, near(r.choice(centres)), r.randrange(3)) for k in range(900)]
    rows += [(1000 + k, [0.25] * 6, k % 2) for k in range(60)] + [(100, [0.25] * 6, 0), (100, [0.25] * 6, 0), (2000, [0.5, 0.5], 1), (2100, [], 1), (2200, [-1.0] * 6, 9)]
    rows += [(3000, None, 1), (3001, [0.1] * 6, None), (None, [0.2] * 6, 1), (3002, [float("nan")] * 6, 1), (3003, [float("inf")] * 6, 1), (3004, [None] + [0.1] * 5, 1)]
    vectors = spark.createDataFrame(rows, VECTORS).repartition(3).withColumns({c: F.lit("x") for c in ("row", "id", "rank", "block", "windows", "slice")})
    want = plain_negatives([(i, v, y) for i, v, y in rows])
    for block, chunk in ((64, 3), (4096, 256)):
        got = negatives.hard_negatives(vectors, F.col("id") % 100 == 0, block=block, chunk=chunk)
        assert Counter(map(tuple, got.collect())) == want
    assert negatives.hard_negatives(vectors.filter("vec_id < 0"), F.col("id") % 100 == 0).count() == 0
    assert negatives.hard_negatives(vectors, F.lit(False)).count() == 0


def test_ball_tree_prunes():
    """In few dimensions most rows are never scored, from above or from below the window."""
    rng = np.random.default_rng(3)
    rows = np.floor(rng.normal(0, 200, (4096, 2)))
    order, spans, centres, radii = negatives.ball_tree(rows)
    block = {"vectors": rows[order], "ids": order, "labels": np.zeros(4096, np.int64), "rows": order, "spans": spans, "centres": centres, "radii": radii}
    query = np.array([[100.0, 0.0]])
    scores = rows @ query[0]
    for lo, hi in ((negatives.LOW, negatives.HIGH), (20_000.0, 20_500.0), (-30_000.0, -29_000.0)):
        best = negatives.Best(1, 5)
        asked = {"vectors": query, "rows": np.array([-1]), "labels": np.zeros(1, np.int64), "of": np.zeros(1, np.int64), "lo": np.array([lo]), "hi": np.array([hi])}
        assert negatives.search(best, asked, block, True) < 2048
        fits = np.flatnonzero((scores >= lo) & (scores <= hi))
        assert best.id[0].tolist() == sorted(fits.tolist(), key=lambda k: (-scores[k], k))[:5]
