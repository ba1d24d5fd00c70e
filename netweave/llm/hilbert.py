"""Sharding along a Hilbert curve over quantised metadata."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, free_name, join_back, keyed, text_of


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, 0 to 2**bits - 1).

    Transposes the axes by undoing excess work from the top bit down, then Gray-encodes and
    interleaves the bits, most significant first.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where(x[n - 1] & q, q - 1, 0)
        q >>= 1
    x ^= t
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def ranked(rows: DataFrame, order: list[Column | str], parts: int, name: str) -> DataFrame:
    """Add __rank, the place of each row in the order, and __total, their number.

    Range partitions are sorted and written with each row's place there; its rank is that place
    plus the sizes of the partitions before, a table with a row per partition.
    """
    at = F.monotonically_increasing_id()
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = rows.withColumn("__part", F.shiftright(at, 33)).withColumn("__at", at.bitwiseAND(F.lit((1 << 33) - 1)))
    placed = scratch.materialize(rows, name)
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
    starts = starts.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    # a row per partition, so its size is bounded by the number of partitions
    return placed.join(F.broadcast(starts), "__part").withColumn("__rank", F.col("__start") + F.col("__at")).drop("__part", "__at", "__start")


def ordinal(df: DataFrame, name: str, out: str, bits: int, parts: int) -> DataFrame:
    """Add the place of a text column among its distinct values, scaled to 0 .. 2**bits - 1; null first.

    Values keep their order, so neighbouring cells hold neighbouring values. The distinct values
    form a table of their own, ranked by range partitions; Spark broadcasts it where it is small enough.
    """
    values = ranked(df.select(F.col(name).alias("__v")).distinct(), [F.col("__v").asc_nulls_first()], parts, "values")
    scale = F.greatest(F.col("__total"), F.lit(1 << bits))
    values = scratch.materialize(values.select("__v", F.floor(F.col("__rank") * F.lit(1 << bits) / scale).cast("int").alias(out)), "cells")
    return df.join(values, F.col(name).eqNullSafe(F.col("__v"))).drop("__v")


def log_cell(size: Column, bits: int) -> Column:
    """Quarter octaves of a size, as a cell."""
    return F.least(F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double")) * 4), F.lit((1 << bits) - 1)).cast("int")


def together(rows: DataFrame, key: list[str], hot: int = 1000) -> DataFrame:
    """Set ``curve`` of each row to the least of its group, the rows of one ``key``.

    Groups of more than one row in ``hot`` of the table are fewer than ``hot``, so they are broadcast; the rows of the others meet
    their group by its key, and no key has more than that share of them.
    """
    names = [f"__g{k}" for k in range(len(key))]
    groups = rows.groupBy(*[F.col(c).alias(n) for c, n in zip(key, names)]).agg(F.min("curve").alias("__least"), F.max("curve").alias("__most"), F.count(F.lit(1)).alias("__n"))
    groups = scratch.materialize(groups.filter("__n > 1"), "groups")
    large = F.col("__n") * hot > rows.count()
    same = [F.col(c) == F.col(n) for c, n in zip(key, names)]
    rows = rows.join(F.broadcast(groups.filter(large).drop("__most", "__n")), same, "left").drop(*names)
    done, rest = rows.filter("__least is not null"), rows.filter("__least is null").drop("__least")
    rest = rest.join(groups.filter(~large & (F.col("__least") < F.col("__most"))).drop("__most", "__n"), same, "left").drop(*names)
    return done.unionByName(rest).withColumn("curve", F.coalesce("__least", "curve")).drop("__least")


def curve_runs(
    docs: DataFrame, shards: int, bits: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang"
) -> DataFrame:
    """Cut the rows, ordered along the curve, into ``shards`` runs whose counts differ by one at most.

    Dimensions: source, language and size in UTF-8 bytes. Equal texts stay together: all of a group
    stand at the least place that one of them has on the curve (``together``). At one place rows
    are ordered by the text's CRC-32 and hash, then by id and row key, so a group lies in one
    shard, or in neighbouring ones where a cut falls into it. The order is
    made by range partitions; each row's place there is written, and its rank is that place
    plus the sizes of the partitions before, a table with a row per partition. A hot cell or group
    spans several partitions, as the row key is part of the order.

    Returns __row, doc_id, size (bytes of the text plus 8; null text has none), text_crc32, cell
    coordinates (the row's own), curve (the place its group stands at), shard, slot. With fewer rows than shards, some shards stay empty; an empty
    table gives no rows. Null ids come first in a cell, null sources and languages have cells of
    their own, and repeated rows stand side by side in the order of their row keys. Null and empty
    texts are equal. Of a very long text only its size, CRC-32 and hash move.
    """
    text = text_of(text_col).cast("binary")
    rows = keyed(
        docs,
        col(id_col).alias("doc_id"),
        col(source_col).cast("string").alias("__source"),
        col(lang_col).cast("string").alias("__lang"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.xxhash64(text).alias("__mark"),
    )
    rows = scratch.materialize(rows, "sizes")
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = ordinal(ordinal(rows, "__source", "source_cell", bits, parts), "__lang", "lang_cell", bits, parts)
    rows = rows.withColumn("size_cell", log_cell(F.col("size"), bits))

    @F.pandas_udf("long")
    def curve(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.column_stack([a, b, c]), bits))

    rows = scratch.materialize(rows.withColumn("curve", curve("source_cell", "lang_cell", "size_cell")), "curve")
    rows = together(rows, ["size", "text_crc32", "__mark"])
    rows = ranked(rows, ["curve", "text_crc32", "__mark", "doc_id", "__row"], parts, "placed")
    shard = F.expr(f"(__rank * {shards}) div __total")
    first = F.expr(f"(shard * __total + {shards - 1}) div {shards}")
    return rows.withColumn("shard", shard.cast("int")).select(
        "__row", "doc_id", "size", "text_crc32", "source_cell", "lang_cell", "size_cell", "curve", "shard", (F.col("__rank") - first).cast("long").alias("slot")
    )


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write ``docs`` as one folder ``shard=N`` per shard, each file a run along the curve, for pruning by several columns.

    A shard is written by as many tasks as its share of the rows, in range pieces. A column of
    ``docs`` that is named shard is kept as shard_.
    """
    docs = scratch.as_files(docs)
    rows, got = join_back(docs, curve_runs(docs, shards, **options).select("__row", "shard", "slot"))
    names = [(c if c.lower() != "shard" else free_name(docs, "shard")) for c in docs.columns]
    slot = free_name(docs.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)]), "__slot")
    rows = rows.select(*[col(c).alias(n) for c, n in zip(docs.columns, names)], got["shard"].alias("shard"), got["slot"].alias(slot))
    parts = max(shards, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows.repartitionByRange(parts, "shard", slot).sortWithinPartitions("shard", slot).drop(slot).write.partitionBy("shard").parquet(path)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return curve_runs(docs, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
