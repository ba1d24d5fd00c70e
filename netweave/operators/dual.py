"""Primal-dual choice with multipliers that are carried from sample to sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave import scratch
from netweave.sources.hyperedges import place_of


def _scan(names: list[str], bounds: dict[str, float], start: dict[str, float], rate: float, most: float, target: float, width: float):
    """One shard after the other, and in each one slot after the other: choose a probe, then move the multipliers by how far its risks are off their bounds."""
    limit = [bounds[n] for n in names]
    begin = [start.get(n, 0.0) for n in names]

    def choose(held: list[tuple], multipliers: list[float]) -> tuple:
        """Plain numbers, as a slot has few probes and an array for each costs more than its sums."""
        best = None
        for probe, hardness, *ratio in held:
            # a multiplier of 0 asks for nothing, not even of an infinite ratio
            penalty = sum([m * r for m, r in zip(multipliers, ratio) if m > 0], 0.0)
            if best is None or hardness - penalty > best[1]:  # the first of equals
                best = probe, hardness - penalty, hardness, penalty, ratio
        moved = [min(max(m + rate * (r - 1.0), 0.0), most) for m, r in zip(multipliers, best[4])]
        return *best[:4], moved

    def ratios(risks: np.ndarray, bound: float) -> np.ndarray:
        return risks / bound if bound > 0 else np.where(risks <= 0, 0.0, np.inf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, slot, multipliers, held = None, None, begin, []
        columns = ["shard", "source_id", "slot", "probe", "objective", "hardness", "penalty", *[f"multiplier_{n}" for n in names]]
        out: list[tuple] = []

        def close() -> None:
            nonlocal multipliers
            if held:
                probe, objective, hardness, penalty, multipliers = choose(held, multipliers)
                out.append((*slot, probe, objective, hardness, penalty, *multipliers))

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
            hardness = -np.abs(batch.column(4).to_numpy() - target) / width
            ratio = [ratios(batch.column(5 + k).to_numpy(), b).tolist() for k, b in enumerate(limit)]
            probes = list(zip(batch.column(3).to_pylist(), hardness.tolist(), *ratio))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                key = tuple(keys[a].tolist())
                if key != slot:
                    close()
                    held = []
                    if shard != key[0]:
                        shard, multipliers = key[0], begin
                    slot = key
                held += probes[a:b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], columns)
                out = []
        close()
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], columns)

    return run


def primal_dual(
    probes: DataFrame, bounds: dict[str, float], start: dict[str, float] | None = None, rate: float = 0.05, most: float = 10.0, target: float = 0.5, band: tuple[float, float] = (0.3, 0.7), hardness_scale: float = 1.0,
    shards: int = 1, blocks: int = 1,
) -> tuple[DataFrame, dict[str, float]]:
    """(chosen, multipliers). Of each slot's probes (source_id, slot, probe, score, the risks of ``bounds``) the one of largest objective.

    The objective is the closeness to the target score, in widths of the band, less the multipliers times the risks over their bounds. After each slot, in order of source and slot, every
    multiplier moves by ``rate`` times how far its ratio is above 1, within 0 .. ``most``; the next slot sees the moved ones. chosen: source_id, slot, probe, objective,
    hardness, penalty, and the multipliers after the slot.

    The slots in order are cut into ``blocks``, one after the other, each from the multipliers that the one before ends with. With one shard this is the loop over
    all slots, however many blocks there are, and a task holds no more than a block. With more ``shards`` (by hash of the source) those of a block run side by side,
    each from the multipliers with which the block starts, and the next block starts from the mean over the shards: another, coarser method. Only
    multipliers come to the driver. Null scores and risks are not allowed; a slot without probes has no row.
    """
    names, spark = list(bounds), probes.sparkSession
    width = max(band[1] - band[0], 1e-9) * max(hardness_scale, 1e-9)
    rows = probes.select("source_id", F.col("slot").cast("long").alias("slot"), F.col("probe").cast("long").alias("probe"), F.col("score").cast("double").alias("score"), *[F.col(n).cast("double").alias(n) for n in names])
    order = place_of(rows.select("source_id", "slot").distinct(), ["source_id", "slot"], "__place")
    n = max(1, order.count())
    rows = rows.join(order, ["source_id", "slot"]).withColumn("block", F.floor(F.col("__place") * blocks / n).cast("int")).drop("__place")
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("source_id"), F.lit(shards)))
    # a folder for each block, so that its turn reads no others
    held, found = scratch.new_path(spark, "probes"), scratch.new_path(spark, "chosen")
    rows.repartition("block").write.partitionBy("block").parquet(held)
    kinds = "shard long, source_id long, slot long, probe long, objective double, hardness double, penalty double, " + ", ".join(f"multiplier_{x} double" for x in names)
    now, parts = dict(start or {}), min(shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = spark.read.schema(rows.schema).parquet(held)
    scan = rows.select("shard", "source_id", "slot", "probe", "score", *names)
    for block in range(blocks):
        own = scan.filter(F.col("block") == block).repartition(parts, "shard").sortWithinPartitions("shard", "source_id", "slot", "probe")
        own.mapInArrow(_scan(names, bounds, now, max(0.0, rate), max(0.0, most), target, width), kinds).write.parquet(f"{found}/block={block}")
        last = spark.read.schema(kinds).parquet(f"{found}/block={block}").groupBy("shard").agg(F.max(F.struct("source_id", "slot", *[f"multiplier_{x}" for x in names])).alias("l"))
        row = last.agg(*[F.avg(f"l.multiplier_{x}").alias(x) for x in names]).first()
        now = {x: (row[x] if row[x] is not None else now.get(x, 0.0)) for x in names}
    return spark.read.schema(kinds).parquet(found).drop("shard", "block"), now


def dual_figures(chosen: DataFrame) -> DataFrame:
    """One row of means: objective, hardness, penalty and each multiplier."""
    return chosen.agg(F.count(F.lit(1)).alias("samples"), *[F.avg(c).alias(f"{c}_mean") for c in chosen.columns if c in ("objective", "hardness", "penalty") or c.startswith("multiplier_")])
