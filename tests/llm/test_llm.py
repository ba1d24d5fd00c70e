"""Each operator against a brute-force version or an exact round trip, and its edge cases."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from netweave import scratch
from netweave.llm import chat, exact_dedup, hilbert, maxent, mixing, near_dup, packing, quality, secrets, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, host string, h string"
WORD = re.compile(r"[^\x20\x09-\x0d]+")


def docs_of(spark, rows):
    """Documents with further columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, k, s, len(t or ""), "x", "y", "z") for i, t, k, s in rows], SCHEMA)


def prose(r, n, words=400):
    vocab = [f"w{r.randrange(words)}" for _ in range(words)]
    return " ".join(r.choice(vocab) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(4)
    out = []
    for i in range(60):
        out.append((i, "\n".join(prose(r, r.randint(3, 40)) for _ in range(r.randint(1, 6))), r.choice(["en", "de", None]), r.choice(["a", "b", None])))
    base = prose(r, 120).split()
    for i in range(60, 80):  # near copies, and copies of them
        w = list(base)
        w[r.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w), "en", "a"))
        out.append((i + 100, " ".join(w), "en", "b"))
    out += [(300, None, None, None), (301, "", "en", "a"), (302, " \n\t ", "en", "a"), (303, "one", "en", "b"), (304, "one", "en", "b"), (304, "one", "en", "b")]
    out += [(None, "no id at all here", "en", "b"), (305, "é\x0bÀ\x0c" * 30, None, "a"), (306, prose(r, 6000), "en", "a"), (307, "same eight words stand here again and again " * 9, "en", "a")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return scratch.materialize(docs_of(spark, rows), "docs")


def empty(docs):
    return docs.filter("doc_id = -1")


def test_packing_round_trip(spark, docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = packing.pack_documents(docs, group=64).collect()
    wanted = Counter()
    for i, text, _, _ in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            part = np.asarray(ids[k : k + 2048], "<u4")
            wanted[i, k // 2048, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == wanted
    by = defaultdict(list)
    for p in pieces:
        by[p.sequence_id].append((p.offset, p.length))
    for spans in by.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) <= math.ceil(sum(p.length for p in pieces) / 2048) + 3
    assert packing.pack_documents(empty(docs)).count() == 0


def test_packing_words():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["<|endoftext|> a <|startoftext|>B. C,d WON'T. it's. 're. x.y,z İ ẞ. ǅ. é. a b.", "<|ENDOFTEXT|>., a.. 12.3, 'S. K. Å. ΑΣ.", "", "\x0b\x0c ."]
    for entries in (1000, 1):
        got = packing.WordEncoder(path, entries).encode(texts)
        wanted = [np.asarray(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
        assert got == wanted


def test_local_search_empties_bins():
    lengths = np.array([6, 6, 4, 4, 5, 5, 3, 3, 2, 2])
    bins = [[0, 4], [1, 5], [2, 6, 8], [3, 7, 9]]
    out = packing.local_search(bins, lengths, 14)
    assert sorted(i for b in out for i in b) == list(range(10)) and len(out) == 3 and max(sum(lengths[b]) for b in out) <= 14


def test_quality_base_counts(docs, rows):
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(docs).collect())
    wanted = Counter()
    for i, text, _, _ in rows:
        words = WORD.findall(text or "")
        windows = Counter(tuple(words[k : k + 8]) for k in range(len(words) - 7))
        again = {k + j for k in range(len(words) - 7) if windows[tuple(words[k : k + 8])] > 1 for j in range(8)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        failed = len(words) < 20 or 100 * len(again) > 30 * len(words)
        wanted[i, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again), failed] += 1
    assert got == wanted


def test_quality_line_limits(spark):
    r = random.Random(1)
    shared = "subscribe to our newsletter and follow all of us on every channel today my friend"
    rows = [(i, shared + "\n" + prose(r, 60), "en", "a") for i in range(30)]
    rows += [(100 + i, shared + "\n" + prose(r, 8), "en", "a") for i in range(5)]
    copies = "\n".join(prose(r, 30) for _ in range(4))
    rows += [(200 + i, copies, "en", "a") for i in range(40)]  # copies are one document
    kept = {x.doc_id for x in quality.judge(docs_of(spark, rows)).filter("kept").collect()}
    assert kept == {i for i, *_ in rows if not 100 <= i < 200}


def test_quality_shared_line_is_longest(spark):
    r = random.Random(2)
    shared = "we use cookies to give you the best experience and by going on you accept all of them on this site or leave it through the door at the left"
    rows = [(i, shared + "\n" + prose(r, 12), "en", "a") for i in range(30)]
    rows += [(100 + i, "\n".join(prose(r, 30) for _ in range(4)), "en", "a") for i in range(20)]
    rows += [(200 + i, prose(r, 9) + "\n" + rows[30][1], "en", "b") for i in range(4)]  # too few documents
    rows += [(300 + i, shared + "\n" + rows[30][1][:20], "en", "c") for i in range(40)]  # copies are one document
    got = {x.doc_id: x for x in quality.judge(docs_of(spark, rows)).collect()}
    assert {i for i, x in got.items() if x.kept} == {i for i, *_ in rows if i >= 100}
    assert all((got[i].removed_chars > 0) == (i < 100) for i in got)


def test_quality_absolute_limit(spark):
    r = random.Random(3)
    rows = [(i, ("all rights reserved by the owner of this page\n" if i < 6 else "") + prose(r, 30), "en", "a") for i in range(400)]
    got = {x.doc_id: x.removed_chars > 0 for x in quality.judge(docs_of(spark, rows), many_docs=6).collect()}
    assert got == {i: i < 6 for i in range(400)}
    assert not any(x.removed_chars for x in quality.judge(docs_of(spark, rows), many_docs=7).collect())


def test_quality_removes_lines(spark):
    r = random.Random(5)
    body = lambda: [prose(r, 30) for _ in range(3)]
    shared = ["Sign up for offer 12 today", "sign up  for OFFER 98 today", "all of our pages in one list"]
    texts, wanted = {}, {}
    for i in range(20):
        lines = body()
        texts[i] = "\n".join([shared[i % 2], lines[0], "", lines[1], shared[2], " \t", lines[2], shared[i % 2], ""])
        wanted[i] = "\n".join([lines[0], "", lines[1], " \t", lines[2], ""])
    same = body()
    for i in (50, 51):  # another host's pages: the same body, and lines that only host a has often
        texts[i] = wanted[i] = "\n".join([*same, shared[2]])
    d = docs_of(spark, [(i, t, "en", "b" if i in (50, 51) else "a") for i, t in texts.items()])
    kept = quality.keep_good(d)
    assert kept.schema == d.schema
    assert {x.doc_id: (x.text, x.n_chars) for x in kept.collect()} == {i: (t, len(t)) for i, t in wanted.items()}


def test_warc_round_trip(spark, rows):
    pages = spark.createDataFrame([(i, f"http://x/{i}\r\n" if i else None, t) for i, t, *_ in rows], "page_id long, url string, html string")
    nested = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n").decode("latin-1")
    pages = pages.unionByName(spark.createDataFrame([(900, "u", nested), (901, "u", nested)], pages.schema))
    path = scratch.new_path(spark, "warc")
    warc.write_warc(pages, path)
    whole = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, path).collect()}
    first = {}
    for r in pages.collect():
        p = (r.html or "").encode()
        first[p] = min([x for x in (first.get(p), r.page_id) if x is not None], default=None)
    for r in pages.collect():
        p = (r.html or "").encode()
        again = r.page_id != first[p]
        assert (r.page_id, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None) in whole
    for size in (37, 512, 4096):  # ranges that cut records anywhere
        assert warc.read_warc(spark, path, range_bytes=size).count() == pages.count()
    for f in spark.read.format("binaryFile").load(path).collect():
        gzip.decompress(bytes(f.content))


def test_warc_nested_archive(spark, tmp_path):
    inner = warc.record(5, "u", random.Random(0).randbytes(40000), None, False)
    outer = warc.record(6, "u", inner, None, False)  # the payload does not compress: it stands there as it is
    (tmp_path / "a.warc.gz").write_bytes(outer + warc.record(7, None, b"", 3, True))
    for size in (1000, 10_000, 1 << 20):
        got = warc.read_warc(spark, f"file://{tmp_path}", range_bytes=size).collect()
        assert sorted(r.page_id for r in got) == [6, 7]
        assert [bytes(r.payload) for r in got if r.page_id == 6] == [inner]


def test_secrets(spark):
    r = random.Random(2)
    hexes = lambda n: "".join(r.choice("0123456789abcdef") for _ in range(n))
    rows, values = [], {}
    for i in range(60):
        kind = i % 4
        v = ["AKIA" + "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16)), hexes(40), hexes(40), str(r.randrange(10**15, 10**16))][kind]
        lead = ["use ", 'token = "', "commit: ", "call "][kind]
        values[i] = (v, kind < 2)
        rows.append((i, f"ä{prose(r, 10)} {lead}{v}{chr(34) if kind == 1 else ''} {prose(r, 5)}", "en", "a"))
    rows += [(500, None, None, None), (501, "", "en", "a")]
    table = docs_of(spark, rows)
    got = secrets.scan(table).collect()
    assert {x.doc_id: (x.value, x.is_secret) for x in got} == values
    text = {i: t for i, t, *_ in rows}
    assert all(text[x.doc_id][x.start : x.start + x.length] == x.value for x in got)
    table = scratch.as_files(table)
    clean = {x.doc_id: x.text for x in secrets.redact(table, secrets.scan(table)).collect()}
    assert len(clean) == len(rows) and all((v in clean[i]) != s for i, (v, s) in values.items()) and clean[500] is None
    assert secrets.scan(empty(table)).count() == 0


def test_secret_shapes(spark):
    """Short, letter-only, dotted and named-with-number secrets are candidates, at their places, with their names."""
    values = {
        1: ('password="Tr0ub4dor"', "Tr0ub4dor", "password"),
        2: ("password=Tr0ub4dor&3 x", "Tr0ub4dor&3", "password"),
        3: ("ä postgres://me:p4ss-w@host/db", "p4ss-w", ""),
        4: ('aws_secret_access_key_2 = "abcdEFGHijkl"', "abcdEFGHijkl", None),
        5: ("see eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4 end", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0.SflKxwRJSMeKKF2QT4", ""),
        6: ("a QWERTYasdfghZXCVBNqwertyuiop b", "QWERTYasdfghZXCVBNqwertyuiop", ""),
        7: ("-----BEGIN RSA PRIVATE KEY-----\nMIIabc123\nXYZ456abcdef\n-----END RSA PRIVATE KEY-----", None, ""),
    }
    table = docs_of(spark, [(k, v[0], "en", None) for k, v in values.items()])
    got = {x.doc_id: x for x in secrets.candidates(table).collect()}
    assert {k: x.value for k, x in got.items()} == {k: v[1] or v[0] for k, v in values.items()}
    assert all(values[k][0][x.start : x.start + len(x.value)] == x.value for k, x in got.items())
    assert got[4].before.endswith('key_2 = "') and got[1].before == 'password="' and got[5].after == " end"
    # nothing to learn from but one kind of label: all candidates stay findings
    words = scratch.materialize(secrets.dictionary(table, 1), "words")
    one = secrets.features(secrets.candidates(table), words).withColumn("label", F.lit(1.0))
    twice = secrets.scan(table.unionAll(table), labelled=one).collect()
    assert len(twice) == 2 * len(values) and all(x.is_secret for x in twice)


def test_secret_forest_held_out(spark):
    """Precision and recall on strings planted in other texts, and on kinds that the forest has not seen."""
    r = random.Random(4)
    table = docs_of(spark, [(i, prose(r, 60), "en", "ab"[i % 2]) for i in range(120)])
    words = scratch.materialize(secrets.dictionary(table, 5), "words")
    learned = secrets.planted_findings(table.filter("doc_id % 2 = 0"), words)
    tested = secrets.planted_findings(table.filter("doc_id % 2 = 1"), words, seed=11)
    new = ["prefixed", "quoted password", "digest", "bare uuid"]
    for train_on, test_on, floor in ((learned, tested, 0.97), (learned.filter(~F.col("kind").isin(new)), tested.filter(F.col("kind").isin(new)), 0.75)):
        got = secrets.judge(test_on, secrets.train(train_on)).select("label", (F.col("score") >= 0.5).alias("said")).collect()
        true = sum(x.said and x.label == 1 for x in got)
        assert true / max(1, sum(x.said for x in got)) >= floor and true / sum(x.label == 1 for x in got) >= floor


def test_mixing(docs, rows):
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = Counter()
    for _, text, _, s in rows:
        sizes[s] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = dict(zip(order, [3.0, 1.0, 2.0]))
    low, high = 0.0, 1e9
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * sizes[s], level * weight[s]) for s in order) < 1.5 * sum(sizes.values()) else (low, level)
    taken = Counter()
    for x in out:
        taken[x.source] += x.taken
        assert x.target == pytest.approx(min(2 * sizes[x.source], high * weight[x.source])) and x.taken <= 2 * x.size
    largest = max(x.size for x in out)
    assert all(abs(taken[s] - min(2 * sizes[s], high * weight[s])) <= largest for s in order)
    again = Counter((x.doc_id, x.taken) for x in mixing.mix(docs.repartition(7)).collect())
    assert again == Counter((x.doc_id, x.taken) for x in out)
    assert mixing.mix(empty(docs)).count() == 0
    assert mixing.apply_mix(docs).count() == sum(x.repeats for x in out)


def test_hilbert_curve_is_one_path():
    bits = 3
    cells = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    place = hilbert.hilbert_index(cells, bits)
    assert sorted(place.tolist()) == list(range(512))
    path = cells[np.argsort(place)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards(docs, rows):
    out = hilbert.curve_runs(docs, 7).collect()
    assert len(out) == len(rows)
    counts = Counter(x.shard for x in out)
    assert max(counts.values()) - min(counts.values()) <= 1 and sorted(counts) == list(range(7))
    for s in counts:
        assert sorted(x.slot for x in out if x.shard == s) == list(range(counts[s]))
    curve = [x.curve for x in sorted(out, key=lambda x: (x.shard, x.slot))]
    assert curve == sorted(curve)
    text = defaultdict(set)
    for i, t, *_ in rows:
        text[i].add((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())))
    assert all((x["size"], x.text_crc32) in text[x.doc_id] for x in out)
    homes = defaultdict(set)
    for x in out:
        homes[x["size"], x.text_crc32].add(x.shard)
    assert sum(len(h) - 1 for h in homes.values()) <= 6  # a cut falls into one group at most
    assert hilbert.curve_runs(empty(docs), 7).count() == 0
    few = hilbert.curve_runs(docs.filter("doc_id < 3"), 24).collect()
    assert all(x.slot == 0 for x in few) and len({x.shard for x in few}) == 3


def test_equal_texts_of_many_cells_stay_together(spark):
    rows = [(i, ("copy of all" if i % 3 == 0 else f"text {i % 40}"), f"l{i % 7}", f"s{i % 11}") for i in range(1200)]
    by_text = {i: t for i, t, *_ in rows}
    out = hilbert.curve_runs(docs_of(spark, rows), 8).collect()
    order = [by_text[x.doc_id] for x in sorted(out, key=lambda x: (x.shard, x.slot))]
    changes = 1 + sum(a != b for a, b in zip(order, order[1:]))
    assert changes == len(set(order))
    cells = np.array([(x.source_cell, x.lang_cell, x.size_cell) for x in out])
    least = {}
    for x, place in zip(out, hilbert.hilbert_index(cells, 7).tolist()):
        least[by_text[x.doc_id]] = min(place, least.get(by_text[x.doc_id], place))
    assert all(x.curve == least[by_text[x.doc_id]] for x in out)


def brute_links(rows):
    sets = {}
    for i, text, *_ in rows:
        w = WORD.findall((text or "").lower())
        if w:
            sets.setdefault(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))), []).append(i)
    links, root = Counter(), {s: s for s in sets}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    keys = list(sets)
    for a, s in enumerate(keys):
        for o in keys[a + 1 :]:
            if 5 * len(s & o) >= 4 * len(s | o):
                links[s] += 1
                links[o] += 1
                root[find(o)] = find(s)
    groups = defaultdict(list)
    for s in keys:
        groups[find(s)] += [i for i in sets[s] if i is not None]
    return Counter((i, min(groups[find(s)], default=None), links[s]) for s in keys for i in sets[s])


@pytest.mark.parametrize("options", [{}, {"bucket": 3, "block": 3}, {"block_bytes": 2000}])
def test_near_duplicates(docs, rows, options):
    out = near_dup.near_duplicates(docs, **options).collect()
    some = Counter((x.doc_id, x.class_id, x.n_links) for x in out if x.n_shingles)
    assert some == brute_links(rows)
    assert len(out) == len(rows)
    assert all(x.class_id == x.doc_id and x.n_links == 0 for x in out if not x.n_shingles)


def test_near_duplicates_empty(docs):
    assert near_dup.near_duplicates(empty(docs)).count() == 0


def test_prefix_length():
    assert near_dup.prefix_length(0.8, 0.9995) == 4 and near_dup.prefix_length(0.8, 0.99) == 6


def test_maxent_base_and_gain(spark):
    r = random.Random(3)
    words = {k: [f"{k}{i}" for i in range(80)] for k in ("en", "de")}
    rows = [(i, " ".join(r.choice(words[k]) for _ in range(r.randint(5, 80))), k, "a") for i in range(400) for k in [r.choice(["en", "de"])]]
    rows += [(900, None, None, None), (901, "", "en", "a"), (902, "NEVER Seen É", None, None), (902, "NEVER Seen É", None, None), (None, "no id", "en", "a")]
    out = maxent.score_documents(docs_of(spark, rows), top=100, bits=12).collect()
    tokens = {i: [*(t or "").encode().lower().split(), b""] for i, t, *_ in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in tokens}
    c = Counter(w for i, *_ in rows if not held[i] for w in tokens[i])
    n, v = sum(c.values()), len(c)
    for x in out:
        t = tokens[x.doc_id]
        assert x.held_out == held[x.doc_id] and x.n_tokens == len(t) and x.n_known == sum(c[w] > 0 for w in t) and x.train_tokens == n
        assert x.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t))
        assert x.score < 0
    assert len(out) == len(rows)
    assert sum(x.score for x in out if x.held_out) > sum(x.base_score for x in out if x.held_out)


def test_maxent_sums_to_one():
    v = maxent.Vocabulary({b"a": 0, b"b": 1}, np.array([0, 1]), np.array([3.0, 2.0]), np.array([3.0, 2.0, 1.0, 4.0]), 10, 4, 1, 1)
    e = maxent.Encoder(v, 8)
    weights = np.random.default_rng(0).normal(size=(256, 4)).astype(np.float32)
    p = np.exp(maxent.log_softmax(maxent._logits(weights, np.log(v.prior()).astype(np.float32), e.encode(["a b"])[2])))
    rare = v.rare_tokens + maxent.ADD * (v.rare_words + 1)
    inside = np.array([1.0, 1.0, (1 + maxent.ADD) / rare + maxent.ADD / rare, 1.0])  # each class over its words, the unseen one among the rare
    assert (p * inside).sum(axis=1) == pytest.approx(1.0)


def test_exact_dedup_and_index(spark, docs, rows):
    out = exact_dedup.ingest(docs, index := exact_dedup.new_index(spark, 4)).collect()
    groups = defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), i is None, i))
    assert len(out) == len(rows)
    for text, members in groups.items():
        d = hashlib.sha256(text.encode()).hexdigest()
        mine = [x for x in out if x.text_sha256 == d]
        assert all(x.group_size == len(members) and x.keep_id == min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2] for x in mine)
        assert [x.kept for x in mine].count(True) == 1
    more = docs_of(spark, [(800, rows[0][1] + " ", "en", "a"), (801, "a new text", "en", "a")])
    later = {x.doc_id: (x.kept, x.keep_id) for x in exact_dedup.ingest(more, index).collect()}
    assert later == {800: (False, rows[0][0]), 801: (True, 801)}
    reopened = exact_dedup.DigestIndex(spark, index.path, 4)
    assert reopened.entries().count() == len(groups) + 1 and reopened.compact(scratch.new_path(spark, "compact")).entries().count() == len(groups) + 1
    assert exact_dedup.dedup(docs).count() == len(groups)
    assert exact_dedup.ingest(empty(docs), exact_dedup.new_index(spark, 4)).count() == 0


TRICKY = ["\\", "\\l", "\\s<", "<turn user>\n", "</turn>\n", "a\n", "", None, "\\### Assistant: </turn> ok", ">\n<"]


def test_chat_round_trip(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "a>\n<b\\", None]), r.choice(TRICKY)) for c in range(40) for t in range(r.randint(1, 6))]
    rows += [(None, 0, "user", "x"), (77, None, "assistant", "later"), (77, 1, "assistant", "last"), (78, 0, "user", "tie"), (78, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1))
    out = chat.render(chat.canonical_turns(df)).withColumn("back", chat.read_back(F.col("formatted"))).withColumn("loss", chat.masked(F.col("formatted"), F.col("loss_spans"))).collect()
    by = defaultdict(list)
    for c, t, role, text in rows:
        by[c].append((t is not None, t or 0, role is not None, role or "", text is not None, text or ""))
    assert len(out) == len(by)
    for x in out:
        turns = sorted(by[x.conv_id])
        assert [(b.role, b.text) for b in x.back] == [(t[3], t[5]) for t in turns]
        assert x.loss == "".join(t[5] for t in turns if t[3] == "assistant")
    assert chat.digest(chat.render(chat.canonical_turns(df.filter("false")))).count() == 0


def test_chat_layouts(spark):
    want = [("user", "hi"), ("assistant", "yo")]
    tables = [
        spark.createDataFrame([(1, "hi", "yo", "extra")], "id long, prompt string, completion string, note string"),
        spark.createDataFrame([(1, "hi", "", "yo")], "id long, instruction string, input string, output string"),
        spark.createDataFrame([(1, [("user", "hi"), ("assistant", "yo")])], "id long, messages array<struct<role: string, content: string>>"),
        spark.createDataFrame([(1, [("human", "hi"), ("gpt", "yo")])], "id long, conversations array<struct<from: string, value: string>>"),
    ]
    for t in tables:
        assert [(x.role, x.text) for x in chat.canonical_turns(t).first().turns] == want
    with pytest.raises(ValueError, match="no mapping"):
        chat.canonical_turns(spark.range(1))


def test_pipeline_against_brute_force(spark, docs, rows):
    d = docs
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        d = scratch.materialize(stage(spark, d, ""), "stage")
        seen.append(d.collect())
        if name != "best-fit packing":
            assert d.columns == docs.columns
    kept = quality.judge(docs).filter("kept").collect()
    assert Counter(x.doc_id for x in seen[0]) == Counter(x.doc_id for x in kept)
    texts = {re.sub(r"[\x20\x09-\x0d]", "", x.text) for x in seen[0]}
    assert len(seen[1]) == len(texts)
    classes = {c for _, c, _ in brute_links([(x.doc_id, x.text) for x in seen[1]])}
    assert {x.doc_id for x in seen[2]} == classes
    assert {x.doc_id for x in seen[3]} <= classes
    assert Counter((p.doc_id, p.piece) for p in seen[4])[seen[3][0].doc_id, 0] == sum(x.doc_id == seen[3][0].doc_id for x in seen[3])


def test_secrets_in_texts_of_many_parts(spark):
    """Long dotted tokens, runs of one name and thousands of candidates cost as much as they are long."""
    dotted = "abcdefghij1k" + ".abcdefghij" * 900_000  # 10 MB
    many = " ".join(f"token=s3cr3t{k}" for k in range(20_000))
    texts = {1: dotted, 2: "key" * 2_000_000, 3: "pass" * 500_000 + "=", 4: "see " + "keyA1" * 10_000 + ' = "abcd1234" end', 5: many, 6: "://a:" * 200_000 + "x@", 7: "A" * 3_000_000 + "1", 8: 'pass="' * 100_000}
    table = docs_of(spark, [(k, t, "en", "a") for k, t in texts.items()])
    began = time.time()
    found = secrets.candidates(table).select("doc_id", "start", "value", "__row").cache()
    per = Counter(x.doc_id for x in found.select("doc_id").collect())
    assert time.time() - began < 60
    assert per[1] == 1 and per[5] == 20_000 and per[7] == 1
    assert found.filter("doc_id = 1").select(F.char_length("value")).first()[0] == len(dotted)
    starts = [(x.start, x.value) for x in found.filter("doc_id = 5").collect()]
    assert all(many[s : s + len(v)] == v for s, v in starts)
    table = scratch.as_files(table)
    begun = time.time()
    marked = secrets.redact(table, secrets.candidates(table).filter("doc_id in (1, 5)").withColumn("is_secret", F.lit(True)))
    clean = {x.doc_id: x.text for x in marked.select("doc_id", "text").collect()}
    assert time.time() - begun < 60
    assert clean[1] == "[SECRET]" and clean[5] == " ".join(["token=[SECRET]"] * 20_000) and clean[2] == texts[2]
