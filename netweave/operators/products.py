"""Sums over common neighbours of many pairs of nodes: blocks of packed rows that meet in tasks, and no row for a common neighbour."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entries of the right rows that a task holds.
BLOCK_ENTRIES = 1 << 22
#: Blocks that there are at least, so that small tables have several tasks.
LEAST_BLOCKS = 8


def packed(rows: DataFrame, key: str, m: str, *values: str) -> DataFrame:
    """(key, ms, further arrays): the nodes ``m`` of each key in order, with their ``values``."""
    held = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(m, *values))).alias("held"))
    return held.select(key, F.col(f"held.{m}").alias("ms"), *[F.col(f"held.{v}").alias(v) for v in values])


class _Block:
    """Right rows of a block; ``codes`` number the nodes that any of them holds."""

    def __init__(self, held: list[pa.RecordBatch]):
        lists = [_flat(b.column(3)) for b in held]
        self.ids, codes = np.unique(np.concatenate([v for v, _ in lists]), return_inverse=True)
        self.codes, self.values = codes.astype(np.int32), np.concatenate([_flat(b.column(4))[0] for b in held])
        lengths = np.concatenate([np.diff(o) for _, o in lists])
        keys = np.concatenate([b.column(2).to_numpy() for b in held])
        order = np.argsort(keys)
        self.keys, self.lengths, self.starts = keys[order], lengths[order], (np.cumsum(lengths) - lengths)[order]
        self.scales = np.concatenate([b.column(5).to_numpy() for b in held])[order]
        self.dense = np.zeros(len(self.ids))

    def sums(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        ms, at = _flat(batch.column(3))
        ws = _flat(batch.column(4))[0]
        ys, to = _flat(batch.column(6))
        code, known = _find(self.ids, ms)
        row, there = _find(self.keys, ys)
        out = np.zeros(len(ys))
        for k in range(batch.num_rows):
            mine, asked = slice(at[k], at[k + 1]), slice(to[k], to[k + 1])
            c, r = code[mine][known[mine]], row[asked][there[asked]]
            if not len(c) or not len(r):
                continue
            self.dense[c] = ws[mine][known[mine]]
            n = self.lengths[r]
            ends = np.cumsum(n)
            places = np.repeat(self.starts[r] - ends + n, n) + np.arange(ends[-1])
            out[np.flatnonzero(there[asked]) + to[k]] = np.add.reduceat(self.dense[self.codes[places]] * self.values[places], ends - n)
            self.dense[c] = 0.0
        met = np.flatnonzero(out != 0)
        of = np.repeat(np.arange(batch.num_rows), np.diff(to))[met]
        return pa.RecordBatch.from_arrays([pa.array(batch.column(2).to_numpy()[of]), pa.array(ys[met]), pa.array(out[met]), pa.array(batch.column(5).to_numpy()[of]), pa.array(self.scales[row[met]])], ["x", "y", "s", "a", "b"])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a column of lists and where each list begins and ends."""
    ends = np.cumsum(np.append(0, column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), ends


def _find(ordered: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(ordered, asked), len(ordered) - 1)
    return at, ordered[at] == asked


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of their block, the right ones of each before the left ones, which are worked off as they come."""
    now, held, block = None, [], None
    for batch in batches:
        keys = np.column_stack([batch.column(k).to_numpy() for k in (0, 1)])
        cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a == b:
                continue
            if keys[a][0] != now:
                now, held, block = keys[a][0], [], None
            if keys[a][1] == 0:
                held.append(batch.slice(a, b - a))
            elif held or block:
                if block is None:
                    block, held = _Block(held), []
                yield block.sums(batch.slice(a, b - a))


def sums(ways: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(x, y, s, a, b): for each of ``ways`` (x, y) the sum of products of the values that both ``left`` (x, ms, ws, a) and ``right`` (y, ms, ws, b) have for a node; rows whose sum is 0 are left out.

    Right rows are cut by ranges of y into blocks that a task can hold. A left row moves to each block that it has ways to, with these, and is worked off as it
    comes. So rows move as arrays, and what moves grows with the rows and the number of blocks their ways reach, not with the neighbours that nodes have in common.
    """
    entries = right.agg(F.sum(F.size("ms"))).first()[0] or 0
    n = max(LEAST_BLOCKS, -(-entries // BLOCK_ENTRIES))
    cuts = right.agg(F.percentile_approx("y", [k / n for k in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))

    def block(y: Column) -> Column:
        return F.size(F.filter(F.lit(cuts).cast("array<bigint>"), lambda c: c < y)) if cuts else F.lit(0)

    asked = ways.select(F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y")).withColumn("block", block(F.col("y"))).groupBy("x", "block").agg(F.collect_set("y").alias("ys"))
    rows = asked.join(left.select("x", "ms", "ws", F.col("a").cast("double").alias("a")), "x").select("block", F.lit(1).alias("turn"), "x", "ms", "ws", "a", "ys")
    held = right.select(block(F.col("y")).alias("block"), F.lit(0).alias("turn"), F.col("y").cast("long").alias("x"), "ms", "ws", F.col("b").cast("double").alias("a"), F.lit(None).cast("array<bigint>").alias("ys"))
    dealt = held.unionByName(rows).repartitionById(len(cuts) + 1, F.col("block")).sortWithinPartitions("block", "turn")
    return dealt.mapInArrow(_meet, "x long, y long, s double, a double, b double")
