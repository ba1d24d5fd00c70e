"""Hard negatives: ball trees bound the inner product of a query with all vectors of a node from above and below.

A node is left out for a query if its bounds lie outside the query's score window, or strictly
beneath the k-th best score found so far. The rows are cut into blocks, each with a tree of its own;
the queries meet the blocks in units of one chunk of queries and one slice of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col

#: Rows of a block and of a leaf, queries of a chunk.
BLOCK, LEAF, CHUNK = 4096, 64, 256
#: Scores are integers below 2**53, so doubles hold them exactly.
LOW, HIGH = -float(1 << 53), float(1 << 53)


def ball_tree(vectors: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, spans, centres, radii): a complete binary tree over the rows, whose node k has the children 2k + 1 and 2k + 2.

    A node covers order[spans[k, 0] : spans[k, 1]] and is halved by its rows' places on the line between two rows far apart, so equal vectors
    do no harm. A node of at most ``leaf`` rows is not halved.
    """
    n = len(vectors)
    depth = max(0, int(np.ceil(np.log2(max(1, n) / leaf))))
    nodes = (2 << depth) - 1
    order, spans = np.arange(n), np.zeros((nodes, 2), np.int64)
    centres, radii = np.zeros((nodes, vectors.shape[1])), np.zeros(nodes)
    spans[0] = 0, n
    for k in range(nodes):
        a, b = spans[k]
        if a == b:
            continue
        rows = vectors[order[a:b]]
        centres[k] = rows.mean(axis=0)
        from_centre = ((rows - centres[k]) ** 2).sum(axis=1)
        radii[k] = np.sqrt(from_centre.max())
        if 2 * k + 2 < nodes:
            one = rows[from_centre.argmax()]
            other = rows[((rows - one) ** 2).sum(axis=1).argmax()]
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(rows @ (other - one), middle)]
            spans[2 * k + 1], spans[2 * k + 2] = (a, a + middle), (a + middle, b)
    return order, spans, centres, radii


class Best:
    """The first k rows of each slot by falling score, then id. Slots are (query, window)."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score, self.id = np.full((slots, k), -np.inf), np.full((slots, k), np.iinfo(np.int64).max)

    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, row_id: np.ndarray) -> None:
        held, at = np.unique(slot, return_inverse=True)
        slots = np.concatenate([at, np.repeat(np.arange(len(held)), self.k)])
        scores, ids = np.concatenate([score, self.score[held].ravel()]), np.concatenate([row_id, self.id[held].ravel()])
        order = np.lexsort((ids, -scores, slots))
        starts = np.searchsorted(slots[order], np.arange(len(held)))
        use = order[starts[:, None] + np.arange(self.k)]
        self.score[held], self.id[held] = scores[use], ids[use]


def search(best: Best, queries: dict, block: dict, same: bool) -> int:
    """Go through the tree of a block for all queries at once; returns the number of rows scored, for each query that reached them.

    ``queries``: vector, row, label; slots: of (query), lo, hi. Rows count whose label equals the query's, or differs, as ``same`` says, and the query's own row does not.
    """
    vectors, spans, centres, radii = block["vectors"], block["spans"], block["centres"], block["radii"]
    q, lo, hi, of = queries["vectors"], queries["lo"], queries["hi"], queries["of"]
    norm = np.sqrt((q**2).sum(axis=1))
    scored = 0
    todo = [(0, np.arange(len(of)))]
    while todo:
        node, slots = todo.pop()
        a, b = spans[node]
        if a == b or not len(slots):
            continue
        asked, back = np.unique(of[slots], return_inverse=True)
        middle, spread = q[asked] @ centres[node], norm[asked] * radii[node]
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6  # of rounding; scores are whole numbers
        upper, lower = (middle + spread + slack)[back], (middle - spread - slack)[back]
        slots = slots[(upper >= lo[slots]) & (lower <= hi[slots]) & (upper >= best.kth()[slots])]
        if not len(slots):
            continue
        if 2 * node + 2 < len(spans):
            children = [2 * node + 1, 2 * node + 2]
            near = q[np.unique(of[slots])] @ centres[children].T
            first = int(near[:, 1].sum() > near[:, 0].sum())  # the child of the higher scores is searched first
            todo += [(children[1 - first], slots), (children[first], slots)]
            continue
        asked, back = np.unique(of[slots], return_inverse=True)
        scores = q[asked] @ vectors[a:b].T
        scored += scores.size
        equal = queries["labels"][asked][:, None] == block["labels"][None, a:b]
        fits = (equal if same else ~equal) & (queries["rows"][asked][:, None] != block["rows"][None, a:b])
        mine = scores[back]
        use = fits[back] & (mine >= lo[slots][:, None]) & (mine <= hi[slots][:, None]) & (mine >= best.kth()[slots][:, None])
        s, r = np.nonzero(use)
        if len(s):
            best.add(slots[s], mine[s, r], block["ids"][a:b][r])
    return scored


BLOCKS = "block long, n int, dim int, vectors binary, ids binary, labels binary, rows binary, spans binary, centres binary, radii binary"


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of numbers as a matrix of ``dim`` columns; shorter rows end with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    out[np.repeat(np.arange(len(sizes)), sizes), np.concatenate([np.arange(s) for s in sizes] or [np.zeros(0, int)]).astype(int)] = values
    return out


def _build(dim: int, size: int):
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def block(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        vectors = _matrix(t.column(3), dim)
        order, spans, centres, radii = ball_tree(vectors)
        parts = [vectors[order], *(t.column(k).to_numpy().astype(np.int64)[order] for k in (1, 2, 0)), spans, centres, radii]
        values = [[int(t.column(0)[0].as_py())], pa.array([len(order)], pa.int32()), pa.array([dim], pa.int32()), *([p.tobytes()] for p in parts)]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            while batch.num_rows:
                part = batch.slice(0, size - n)
                held.append(part)
                n += part.num_rows
                batch = batch.slice(part.num_rows)
                if n == size:
                    yield block(held)
                    held, n = [], 0
        if held:
            yield block(held)

    return run


def _block(batch: pa.RecordBatch, k: int) -> dict:
    get = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
    dim = get("dim")
    whole = lambda name: np.frombuffer(get(name), np.int64)
    real = lambda name: np.frombuffer(get(name), np.float64)
    return {
        "vectors": real("vectors").reshape(-1, dim), "ids": whole("ids"), "labels": whole("labels"), "rows": whole("rows"),
        "spans": whole("spans").reshape(-1, 2), "centres": real("centres").reshape(-1, dim), "radii": real("radii"),
    }


PACKED = "chunk int, q_dim int, q_vectors binary, q_rows binary, q_labels binary, q_of binary, q_lo binary, q_hi binary"
HITS = "row long, label long, window int, id long, score long"


def _pack(dim: int):
    """Queries (chunk, row, label, vector, windows), which come chunk by chunk, as a row for each chunk."""
    names = [c.split()[0] for c in PACKED.split(", ")]

    def chunk(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        b = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        windows = b.column(4)
        each = windows.flatten()
        of = np.repeat(np.arange(b.num_rows), np.diff(windows.offsets.to_numpy()))
        parts = [_matrix(b.column(3), dim), b.column(1).to_numpy(), b.column(2).to_numpy(), of, each.field(0).to_numpy(), each.field(1).to_numpy()]
        kinds = [np.float64, np.int64, np.int64, np.int64, np.float64, np.float64]
        values = [b.column(0).slice(0, 1), pa.array([dim], pa.int32()), *(pa.array([p.astype(t).tobytes()]) for p, t in zip(parts, kinds))]
        return pa.RecordBatch.from_arrays(values, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            of = batch.column(0).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column(0)[0].as_py() != of[a]:
                    yield chunk(held)
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield chunk(held)

    return run


def _queries(batch: pa.RecordBatch, k: int) -> dict:
    get = lambda name: batch.column(batch.schema.get_field_index(name))[k].as_py()
    whole = lambda name: np.frombuffer(get(name), np.int64)
    real = lambda name: np.frombuffer(get(name), np.float64)
    return {"vectors": real("q_vectors").reshape(-1, get("q_dim")), "rows": whole("q_rows"), "labels": whole("q_labels"), "of": whole("q_of"), "lo": real("q_lo"), "hi": real("q_hi")}


def _scan(k: int, same: bool):
    """Units (chunk, slice) come row by row, a block each; what was found in earlier blocks of the unit prunes the later ones."""
    names = [c.split()[0] for c in HITS.split(", ")]

    def hits(queries: dict, best: Best) -> pa.RecordBatch:
        slot, r = np.nonzero(best.score > -np.inf)
        first = np.searchsorted(queries["of"], queries["of"])  # the windows of a query stand together
        of = queries["of"][slot]
        window = (np.arange(len(first)) - first)[slot]
        columns = [queries["rows"][of], queries["labels"][of], window.astype(np.int32), best.id[slot, r], best.score[slot, r].astype(np.int64)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, queries, best = None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                now = (batch.column(0)[at].as_py(), batch.column(1)[at].as_py())
                if now != unit:
                    if best is not None:
                        yield hits(queries, best)
                    unit, queries = now, _queries(batch, at)
                    best = Best(len(queries["of"]), k)
                search(best, queries, _block(batch, at), same)
        if best is not None:
            yield hits(queries, best)

    return run


def tree_blocks(rows: DataFrame, dim: int, size: int = BLOCK) -> DataFrame:
    """The rows (row, id, label, vector) in blocks of at most ``size`` rows of a partition, each with its ball tree."""
    return scratch.materialize(rows.select("row", "id", "label", "vector").mapInArrow(_build(dim, size), BLOCKS), "trees")


def first_rows(blocks: DataFrame, queries: DataFrame, k: int, same: bool, dim: int, chunk: int = CHUNK) -> DataFrame:
    """(row, label, window, id, score, rank): for each query (row, label, vector, windows) and window (lo, hi) the first ``k`` rows of the blocks with a score in it.

    Queries are dealt by hash into chunks of about ``chunk``. Each chunk meets all blocks; its blocks are dealt into slices, so
    that there are as many units as shuffle partitions or more. A unit returns at most ``k`` rows for a query and window.
    """
    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    chunks = max(1, -(-queries.count() // chunk))
    slices = max(1, -(-parts // chunks))
    dealt = queries.select(F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int").alias("chunk"), "row", "label", "vector", "windows")
    dealt = dealt.repartition(min(parts, chunks), "chunk").sortWithinPartitions("chunk")
    asked = scratch.materialize(dealt.mapInArrow(_pack(dim), PACKED), "queries").withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    each = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")
    met = blocks.select(each, F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int").alias("slice"), *blocks.columns)
    units = asked.hint("merge").join(met, ["chunk", "slice"])
    found = units.mapInArrow(_scan(k, same), HITS)
    place = F.row_number().over(Window.partitionBy("row", "window").orderBy(F.desc("score"), "id"))
    return scratch.materialize(found.withColumn("rank", place).filter(F.col("rank") <= k), "hits")


def quantised(vectors: DataFrame, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(row, id, label, vector): the rows that take part, numbered, with whole components floor(scale * x)."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    given = vectors.select(col(id_col).cast("long").alias("id"), col(label_col).cast("long").alias("label"), col(vector_col).cast("array<double>").alias("v"))
    given = given.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", finite))
    rows = given.select("id", "label", F.transform("v", lambda x: F.floor(x * F.lit(float(scale))).cast("double")).alias("vector"))
    return scratch.materialize(rows.select(F.monotonically_increasing_id().alias("row"), "*"), "vectors")


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256,
    block: int = BLOCK, chunk: int = CHUNK, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    An anchor's positives are its first ``positives`` other rows of the same label by score; for each, the negatives are the first ``negatives`` rows
    of other labels whose score is ``low`` to ``high`` per cent of the positive's. Scores are inner products of the components floor(scale * x);
    ties go to the smaller id. ``is_anchor`` is a condition on ``id`` and ``label``.

    Rows with a null id, label, vector or component, or a component that is not finite, take no part. Shorter vectors
    end with zeros. Rows that share an id are rows of their own, as anchors and as found rows; equal rows give equal
    results. Scores are exact below 2**53. An empty table, or one without anchors, gives no rows; other columns are not read.
    A label or vector with a large share of the rows costs nothing extra: blocks are cut by place, not by value.
    """
    rows = quantised(vectors, scale, id_col, vector_col, label_col)
    dim = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 1)
    blocks = tree_blocks(rows, dim, block)
    anchors = rows.filter(is_anchor)
    everything = F.array(F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")))
    near = first_rows(blocks, anchors.withColumn("windows", everything), positives, True, dim, chunk)
    found = near.select("row", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    window = F.struct("rank", F.ceil(F.col("positive_score") * low / 100).cast("double").alias("lo"), F.floor(F.col("positive_score") * high / 100).cast("double").alias("hi"))
    windows = found.groupBy("row").agg(F.sort_array(F.collect_list(window)).alias("w")).select("row", F.transform("w", lambda w: F.struct(w["lo"].alias("lo"), w["hi"].alias("hi"))).alias("windows"))
    asked = scratch.materialize(anchors.join(windows, "row"), "asked")
    hard = first_rows(blocks, asked, negatives, False, dim, chunk).select("row", (F.col("window") + 1).alias("at"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("rank").alias("place"))
    out = found.join(hard, (found["row"] == hard["row"]) & (found["rank"] == hard["at"])).select(found["row"], "positive_id", "place", "negative_id", "positive_score", "negative_score")
    names = anchors.select(F.col("row").alias("__row"), F.col("id").alias("anchor_id"))
    return out.join(names, F.col("row") == F.col("__row")).select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose id is divisible by 100 is an anchor; labels of ids divisible by 7 are moved on by one."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(moved, F.col("id") % 100 == 0)


OP13_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id,
       row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other_id)::INTEGER AS rank,
       s.other_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""
