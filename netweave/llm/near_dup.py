"""Jaccard join on word shingles: a MinHash LSH forest proposes, exact verification decides."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, join_back, keyed, text_of, words_of
from netweave.llm.components import components

SHINGLE = 5
TREES, DEPTH = 16, 6
_RNG = np.random.default_rng(20240607)
_A = _RNG.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)
_C = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


def prefix_length(threshold: float, recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """Shorten matched prefixes from the full depth until a pair at the threshold is met with the wanted recall."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(column: pa.Array, size: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of word hashes.

    A row of fewer than ``size`` words has one shingle of them all, a row without words none.
    """
    offsets = column.offsets.to_numpy()
    words = column.values.to_numpy(zero_copy_only=False).view(np.uint64)
    n = max(0, len(words) - size + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(size):
        rolled += words[k : k + n] * _C[k]
    rolled = _mix(rolled)
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= size:
            yield np.unique(rolled[a : b - size + 1])
        elif b > a:
            short = words[a:b] * _C[: b - a]
            yield _mix(short.sum(keepdims=True, dtype=np.uint64) + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least value of the shingles under each of TREES * DEPTH permutations of 32-bit words."""
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(TREES * DEPTH, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 2048):
        out = np.minimum(out, ((low[at : at + 2048, None] ^ _B) * _A).min(axis=0))
    return out


def prefix_keys(sigs: np.ndarray, length: int) -> np.ndarray:
    """A key per tree of the first ``length`` values of each signature (rows x trees)."""
    trees = sigs.reshape(len(sigs), TREES, DEPTH)[:, :, :length].astype(np.uint64)
    keys = (trees * _C[:length]).sum(axis=2, dtype=np.uint64) + np.arange(TREES, dtype=np.uint64) * _C[15]
    return _mix(keys).view(np.int64)


FEATURES = "f long, i long, doc_id long, key binary, n_shingles long, sketch binary, keys array<long>"


def _features(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs = [], [], []
            for s in shingle_sets(batch.column(3)):
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sizes.append(len(s))
                sigs.append(signature(s))
            if not sigs:
                continue
            sigs = np.array(sigs)
            lists = pa.ListArray.from_arrays(np.arange(0, (len(sigs) + 1) * TREES, TREES, dtype=np.int32), prefix_keys(sigs, length).ravel())
            sketch = [x.tobytes() for x in sigs.astype(np.uint8)]
            columns = [*batch.columns[:3], pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sketch, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, ["f", "i", "doc_id", "key", "n_shingles", "sketch", "keys"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[pa.RecordBatch]]:
    """Rows of equal values in the first ``keys`` columns, which come together, as lists of slices."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.column_stack([batch.column(k).to_numpy() for k in range(keys)])
        cuts = [0, *(np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1).tolist(), len(cols)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            key = tuple(cols[a].tolist())
            if key != last and held:
                yield held
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held


def _similar(least: float):
    """Edges that span the graph of members whose sketches agree in a share of at least ``least``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices in _runs(batches, 3):
            ids = np.concatenate([s.column(3).to_numpy() for s in slices])
            sketches = np.concatenate([np.frombuffer(b"".join(s.column(4).to_pylist()), np.uint8).reshape(s.num_rows, -1) for s in slices])
            need = least * sketches.shape[1]
            rest = np.arange(len(ids))
            a: list[np.ndarray] = []
            b: list[np.ndarray] = []
            while len(rest) > 1:
                todo, rest = [rest[0]], rest[1:]
                while todo and len(rest):
                    x = todo.pop()
                    near = (sketches[rest] == sketches[x]).sum(axis=1) >= need
                    found, rest = rest[near], rest[~near]
                    todo.extend(found.tolist())
                    a.append(np.full(len(found), ids[x]))
                    b.append(ids[found])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return run


def _blocks(df: DataFrame, group: str, chunk: str, chunks: str) -> DataFrame:
    """Deal the members of groups into block pairs (group, x, y): chunk x against chunk y, x <= y."""
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col(chunks) - 1)).alias("__o")
    df = df.select("*", other).withColumn("x", F.least(chunk, "__o")).withColumn("y", F.greatest(chunk, "__o")).drop("__o")
    return df.repartition(_parts(df), group, "x", "y").sortWithinPartitions(group, "x", "y")


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([s.tobytes() for s in shingle_sets(batch.column(batch.num_columns - 1))], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sets], [*batch.schema.names[:-1], "sh"])


def overlaps(rows: list[np.ndarray], cols: list[np.ndarray] | None, cells: int = 16_000_000) -> np.ndarray:
    """Sizes of the intersections of each set of ``rows`` with each of ``cols`` (default: ``rows``)."""
    sets = rows + (cols or [])
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, inverse, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    use = shared[inverse]
    owner, place = owner[use], number[inverse[use]]
    width = int(shared.sum())
    step = max(1, cells // len(sets))
    out = np.zeros((len(rows), len(cols) if cols else len(rows)), np.float32)
    order = np.argsort(place, kind="stable") if width > step else None
    if order is not None:
        owner, place = owner[order], place[order]
    for at in range(0, width, step):
        lo, hi = (0, len(place)) if order is None else np.searchsorted(place, [at, at + step])
        m = np.zeros((len(sets), min(step, width - at)), np.float32)
        m[owner[lo:hi], place[lo:hi] - at] = 1
        out += m[: len(rows)] @ (m[len(rows) :] if cols else m).T
    return out


def _verify(threshold: float):
    """(a, n, root): members of a block pair with exact links there, their number, and the least member they hang together with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slices in _runs(batches, 3):
            x, y = slices[0].column(1)[0].as_py(), slices[0].column(2)[0].as_py()
            ids = np.concatenate([s.column(3).to_numpy() for s in slices])
            chunk = np.concatenate([s.column(4).to_numpy() for s in slices])
            sets = [np.frombuffer(v, np.uint64) for s in slices for v in s.column(5).to_pylist()]
            if len(ids) < 2:
                continue
            order = np.argsort(chunk, kind="stable")
            ids, sets = ids[order], [sets[k] for k in order]
            cut = int((chunk == x).sum())
            rows, cols = (np.arange(len(ids)),) * 2 if x == y else (np.arange(cut), np.arange(cut, len(ids)))
            if not len(rows) or not len(cols):
                continue
            common = overlaps(sets, None) if x == y else overlaps(sets[:cut], sets[cut:])
            sizes = np.array([len(s) for s in sets], np.float64)
            linked = common >= threshold * (sizes[rows][:, None] + sizes[cols][None, :] - common) - 1e-6
            if x == y:
                np.fill_diagonal(linked, False)
            n = np.zeros(len(ids), np.int64)
            n[rows] += linked.sum(axis=1)
            if x != y:
                n[cols] += linked.sum(axis=0)
            label = ids.copy()
            r, c = np.nonzero(linked)
            r, c = rows[r], cols[c]
            while len(r):  # least label over the links until nothing changes
                new = label.copy()
                np.minimum.at(new, r, label[c])
                np.minimum.at(new, c, label[r])
                if (new == label).all():
                    break
                label = new
            has = n > 0
            if has.any():
                yield pa.RecordBatch.from_arrays([pa.array(v[has]) for v in (ids, n, label)], ["a", "n", "root"])

    return run


def near_duplicates(
    docs: DataFrame, threshold: float = 0.8, recall: float = 0.9995, bucket: int = 2048, block: int = 512, block_bytes: int = 32 << 20, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """A row for each row: __row, doc_id, class_id, copy_of, n_copies, n_links, n_shingles.

    Texts are sets of hashed shingles of five lower-cased words. Rows of one set are copies and
    are compared once (``copy_of``: their smallest id, ``n_copies``: their number). ``n_links``
    counts the other sets whose Jaccard similarity is at least ``threshold``, exactly; ``class_id``
    is the smallest id in the group that hangs together by links.

    1. Each set gets a MinHash signature, a forest of 16 tries of depth 6. The prefix that must
       match in a trie is shortened until the recall at the threshold is met (4 values: 0.9998).
    2. Sets that share a prefix are compared by sketches of 8 bits a value, at a threshold five
       standard deviations lower; what is similar is joined by a spanning tree, not by all pairs.
       A prefix with more sets than ``bucket`` is dealt by hash into chunks of about that
       many, and each pair of chunks is a unit of work of its own: no pair is left out, and no
       unit has more than about twice ``bucket`` sets, however alike they are.
    3. Connected sets form candidate groups. Within each, all pairs are verified exactly, in block
       pairs of at most ``block`` sets or ``block_bytes`` a side, that return a count for each set
       and the edges of a spanning tree. So the rows moved for a group of m sets are
       m * m / block; its m * m comparisons are products of 0/1 matrices inside the tasks.

    Null and empty texts, and texts of white space, have no shingles and are linked to nothing; each is a
    class of its own. A text of one to four words has a single shingle. Null ids take part and are
    largest among their copies. Repeated rows are copies. An empty table gives no rows.
    """
    docs = scratch.as_files(docs)
    text = F.lower(text_of(text_col))
    hashes = F.transform(words_of(text), lambda w: F.xxhash64(w)).alias("words")
    rows = keyed(docs, col(id_col).cast("long").alias("doc_id"), hashes).select("__row.f", "__row.i", "doc_id", "words")
    length = prefix_length(threshold, recall)
    feats = scratch.materialize(rows.mapInArrow(_features(length), FEATURES), "features")
    some = feats.filter("n_shingles > 0")
    texts = some.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_copies"), F.min("doc_id").alias("copy_of"), F.min(F.struct("f", "i")).alias("at"), F.first("n_shingles").alias("n_shingles"),
        F.first("sketch").alias("sketch"), F.first("keys").alias("keys"),
    )
    texts = scratch.materialize(texts.withColumn("text_id", F.monotonically_increasing_id()), "texts")

    places = texts.select("text_id", F.explode("keys").alias("prefix"))
    counts = places.groupBy(F.col("prefix").alias("__p")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = places.join(counts, F.col("prefix") == F.col("__p")).drop("__p")
    met = met.withColumn("chunks", F.ceil(F.col("n") / F.lit(bucket)).cast("long")).withColumn("chunk", F.pmod(F.xxhash64("text_id"), F.col("chunks")))
    met = met.join(texts.select("text_id", "sketch"), "text_id")
    units = _blocks(met, "prefix", "chunk", "chunks").select("prefix", "x", "y", "text_id", "sketch")
    lowest = threshold - 5 * (threshold * (1 - threshold) / (TREES * DEPTH)) ** 0.5
    coarse = components(units.mapInArrow(_similar(lowest), "a long, b long"))

    members = coarse.withColumnRenamed("root", "group").join(texts.select("text_id", "at", "n_shingles"), F.col("node") == F.col("text_id")).drop("node")
    members = scratch.materialize(members, "members")
    sizes = members.groupBy(F.col("group").alias("__g")).agg(F.count(F.lit(1)).alias("m"), F.sum("n_shingles").alias("s"))
    chunks = F.ceil(F.greatest(F.col("m") / F.lit(block), F.col("s") * 8 / F.lit(block_bytes))).cast("long")
    members = members.join(sizes, F.col("group") == F.col("__g")).select("text_id", "at", "group", chunks.alias("chunks"))
    members = members.withColumn("chunk", F.pmod(F.xxhash64("text_id"), F.col("chunks")))
    texts_of = keyed(docs, text_of(text_col).alias("__text")).withColumnRenamed("__row", "__r")
    # both sides grow with the input, so the plan is the same at every size
    sets = texts_of.join(members.hint("merge"), F.col("__r") == F.col("at")).select(
        "group", "text_id", "chunk", "chunks", F.transform(words_of(F.lower("__text")), lambda w: F.xxhash64(w)).alias("words")
    )
    sets = sets.mapInArrow(_shingles, "group long, text_id long, chunk long, chunks long, sh binary")
    pairs = _blocks(sets, "group", "chunk", "chunks").select("group", "x", "y", "text_id", "chunk", "sh")
    linked = scratch.materialize(pairs.mapInArrow(_verify(threshold), "a long, n long, root long"), "links")
    classes = components(linked.select("a", F.col("root").alias("b")))
    links = linked.groupBy(F.col("a").alias("__a")).agg(F.sum("n").alias("n_links"))
    ids = texts.select("text_id", "key", "copy_of", "n_copies")
    classed = ids.join(classes, F.col("text_id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "text_id"))
    named = classed.groupBy(F.col("root").alias("__root")).agg(F.min("copy_of").alias("class_id"))
    classed = classed.join(named, F.col("root") == F.col("__root")).join(links, F.col("text_id") == F.col("__a"), "left")
    classed = scratch.materialize(classed.select(F.col("key").alias("__k"), "root", "class_id", "copy_of", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links")), "classes")
    out = feats.select("f", "i", "doc_id", "key", "n_shingles").withColumn("key", F.when(F.col("n_shingles") > 0, F.col("key")))
    # rows without shingles are kept apart: a null key would gather them in one task
    found = out.filter("key is not null").join(classed, F.col("key") == F.col("__k"))
    none = out.filter("key is null").withColumns({"root": F.lit(None).cast("long"), "class_id": F.col("doc_id"), "copy_of": F.col("doc_id"), "n_copies": F.lit(1).cast("long"), "n_links": F.lit(0).cast("long")})
    names = ["f", "i", "doc_id", "root", "class_id", "copy_of", "n_copies", "n_links", "n_shingles"]
    both = found.select(*names).unionByName(none.select(*names))
    return both.select(F.struct("f", "i").alias("__row"), *names[2:])


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each class the row with the smallest id, then the first in its file.

    Null ids come last. Rows without words are copies of none and all stay; repeated rows are copies.
    Columns stay as they are, and an empty table gives no rows.
    """
    docs = scratch.as_files(docs)
    found = scratch.materialize(near_duplicates(docs, **options).select("__row", "doc_id", "root"), "classed")
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r"))
    first = found.filter("root is not null").groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.r").alias("__row"))
    rows, _ = join_back(docs, first.unionByName(found.filter("root is null").select("__row")), "left_semi")
    return rows.select(*[col(c) for c in docs.columns])


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "copy_of", "n_copies", "n_links", "n_shingles")
