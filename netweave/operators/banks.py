"""Stored banks of negatives: written once with what they belong to, and refused where anything does not fit.

A bank is a folder: ``rows``, Parquet partitioned by protocol (protocol, source_id, slot, nodes), and ``manifest``, one JSON row. It
holds a protocol's negatives for the sources of a split, or, as kind ``replay``, numbered sets of negatives for the training edges.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import edge_key
from netweave.operators import samplers
from netweave.sources.hyperedges import ordered_digest, sequence_digest

FORMAT = "netweave bank 1"
ROWS = "protocol string, source_id long, slot int, nodes array<long>"


def protocol_negatives(sources: DataFrame, known: DataFrame, nodes: int, protocols: tuple[str, ...], per_source: int = 1, seed: int | str = 1, options: dict[str, dict] | None = None) -> DataFrame:
    """(protocol, source_id, slot, nodes, fallback): each protocol's sampler on the same sources, with draws of its own.

    ``fallback`` tells random edges that took the place of what the sampler did not find; null for samplers that have none.
    """
    out = None
    for name in protocols:
        rows = samplers.sampler(name)(sources, known, nodes, per_source=per_source, seed=f"{seed}:{name}", **(options or {}).get(name, {}))
        fallback = F.col("fallback") if "fallback" in rows.columns else F.lit(None).cast("boolean")
        rows = rows.select(F.lit(name).alias("protocol"), "source_id", F.col("slot").cast("int").alias("slot"), "nodes", fallback.alias("fallback"))
        out = rows if out is None else out.unionByName(rows)
    return out


def as_batches(sources: DataFrame, negatives: DataFrame, protocols: tuple[str, ...]) -> DataFrame:
    """(protocol, source_id, slot, nodes, label, pos): for each protocol the sources with label 1 and slot -1, and its negatives with label 0.

    ``pos`` orders the rows of a batch: positives first, by source and slot.
    """
    names = F.explode(F.array(*[F.lit(p) for p in protocols])).alias("protocol")
    known = sources.select(names, F.col("edge_id").alias("source_id"), F.lit(-1).alias("slot"), "nodes", F.lit(1).alias("label"))
    own = negatives.filter(F.col("protocol").isin(*protocols)).select("protocol", "source_id", "slot", "nodes", F.lit(0).alias("label"))
    return known.unionByName(own).withColumn("pos", F.struct((1 - F.col("label")).alias("n"), F.col("source_id").alias("s"), F.col("slot").alias("k")))


def _line():
    return F.concat(F.concat_ws(":", "source_id", "slot", edge_key(F.col("nodes"))), F.lit(";"))


def row_digests(rows: DataFrame) -> DataFrame:
    """(protocol, digest): of each protocol's rows in order of source and slot."""
    return ordered_digest(rows, ["source_id", "slot"], _line(), by="protocol")


def report(rows: DataFrame, sources: DataFrame, positives: DataFrame, protocols: tuple[str, ...], per_source: int, num_nodes: int) -> DataFrame:
    """A row for each protocol with counts that are all 0 where the bank fits.

    sources_missing and sources_unknown: not aligned with the sources; wrong_count: sources without exactly the slots 0 .. ``per_source`` - 1;
    wrong_size: sets of another number of distinct nodes than their source; out_of_range: sets with a node outside 0 .. num_nodes - 1; known_edges:
    sets that are positives. Null or repeated nodes are of the wrong size.
    """
    names = F.explode(F.array(*[F.lit(p) for p in protocols])).alias("protocol")
    want = sources.select(names, F.col("edge_id").alias("source_id"), F.col("size").alias("want"))
    rows = rows.filter(F.col("protocol").isin(*protocols))
    held = rows.groupBy("protocol", "source_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("slot").alias("slots"), F.min("slot").alias("low"), F.max("slot").alias("high"))
    exact = (F.col("n") == per_source) & (F.col("slots") == per_source) & (F.col("low") == 0) & (F.col("high") == per_source - 1)
    aligned = held.join(want, ["protocol", "source_id"], "full").groupBy("protocol").agg(
        F.count_if(F.col("n").isNull()).alias("sources_missing"), F.count_if(F.col("want").isNull()).alias("sources_unknown"), F.count_if(F.col("n").isNotNull() & ~F.coalesce(exact, F.lit(False))).alias("wrong_count"),
    )
    known = positives.select(F.array_sort(F.array_distinct("nodes")).alias("key")).distinct().withColumn("known", F.lit(1))
    sets = rows.select("protocol", "source_id", F.array_sort(F.array_distinct("nodes")).alias("key"), F.size("nodes").alias("listed"))
    sets = sets.join(want, ["protocol", "source_id"], "left").join(known, "key", "left")
    right = (F.size("key") == F.col("want")) & (F.col("listed") == F.col("want")) & ~F.exists("key", lambda v: v.isNull())
    outside = F.exists("key", lambda v: (v < 0) | (v >= num_nodes))
    checked = sets.groupBy("protocol").agg(
        F.count_if(F.col("want").isNotNull() & ~F.coalesce(right, F.lit(False))).alias("wrong_size"), F.count_if(F.coalesce(outside, F.lit(False))).alias("out_of_range"), F.count_if(F.col("known").isNotNull()).alias("known_edges"),
    )
    return aligned.join(checked, "protocol", "left").na.fill(0)


def _one_digest(edges: DataFrame) -> str:
    return sequence_digest(edges.select("edge_id", "nodes", "size")).first()[0]


def write_bank(
    path: str, negatives: DataFrame, sources: DataFrame, positives: DataFrame, num_nodes: int, per_source: int = 1, seed: int = 1, split: str = "validation", kind: str = "protocol",
    metadata: dict[str, dict[str, float]] | None = None,
) -> None:
    """Write negatives (protocol, source_id, slot, nodes) with the digest of their sources (edge_id, nodes, size) and of their own rows. An existing bank raises.

    What is written must fit (``report``), else ValueError and no manifest, so a half-written bank cannot be read.
    """
    spark = negatives.sparkSession
    negatives.select(F.col("protocol").cast("string"), F.col("source_id").cast("long"), F.col("slot").cast("int"), F.col("nodes").cast("array<long>")).write.partitionBy("protocol").parquet(f"{path}/rows")
    rows = _rows(spark, path)
    counts = {r["protocol"]: r["count"] for r in rows.groupBy("protocol").count().collect()}  # a row for each protocol
    _fits(rows, sources, positives, tuple(sorted(counts)), per_source, num_nodes)
    digests = {r["protocol"]: r["digest"] for r in row_digests(rows).collect()}
    listed = [{"protocol": p, "rows": counts[p], "digest": digests[p], "metadata": (metadata or {}).get(p, {})} for p in sorted(counts)]
    manifest = {"format": FORMAT, "kind": kind, "seed": seed, "split": split, "num_nodes": num_nodes, "positive_count": positives.count(), "per_source": per_source, "source_digest": _one_digest(sources), "protocols": listed}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    # protocol names that look like numbers stay text
    return spark.read.schema(ROWS).parquet(f"{path}/rows")


def _fits(rows: DataFrame, sources: DataFrame, positives: DataFrame, protocols: tuple[str, ...], per_source: int, num_nodes: int) -> None:
    for r in report(rows, sources, positives, protocols, per_source, num_nodes).collect():  # a row for each protocol
        if wrong := {k: v for k, v in r.asDict().items() if k != "protocol" and v}:
            raise ValueError(f"the bank does not fit in protocol {r['protocol']}: {wrong}")


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/manifest").first()[0])


def read_bank(
    spark: SparkSession, path: str, sources: DataFrame, positives: DataFrame, num_nodes: int, protocols: tuple[str, ...], per_source: int = 1, seed: int = 1, split: str = "validation", kind: str = "protocol",
) -> tuple[DataFrame, dict[str, dict[str, float]]]:
    """The rows of ``protocols`` and their metadata, after all checks; ValueError names the first that fails.

    Checked are format, kind, seed, split, number of nodes and of positives, negatives a source, the sources in their order (by digest), the protocols, the
    numbers of rows of all protocols in the bank, and of those asked for their rows in their order (by digest), and the rules of ``report``.
    """
    manifest = read_manifest(spark, path)
    wanted = {"format": FORMAT, "kind": kind, "seed": seed, "split": split, "num_nodes": num_nodes, "positive_count": positives.count(), "per_source": per_source}
    for name, value in wanted.items():
        if manifest.get(name) != value:
            raise ValueError(f"the bank has {name} {manifest.get(name)}, not {value}")
    if manifest["source_digest"] != _one_digest(sources):
        raise ValueError(f"the bank's sources are not those of the {split} split")
    listed = {p["protocol"]: p for p in manifest["protocols"]}
    if missing := [p for p in protocols if p not in listed]:
        raise ValueError(f"the bank has no protocol {missing}")
    rows = _rows(spark, path)
    counts = {r["protocol"]: r["count"] for r in rows.groupBy("protocol").count().collect()}  # a row for each protocol
    if wrong := [p for p in {**counts, **listed} if p not in listed or counts.get(p, 0) != listed[p]["rows"]]:
        raise ValueError(f"the bank has not the rows that were written in {wrong}")
    rows = rows.filter(F.col("protocol").isin(*protocols))
    _fits(rows, sources, positives, tuple(protocols), per_source, num_nodes)
    digests = {r["protocol"]: r["digest"] for r in row_digests(rows).collect()}
    if wrong := [p for p in protocols if digests.get(p) != listed[p]["digest"]]:
        raise ValueError(f"the bank's rows were changed in {wrong}")
    return rows, {p: listed[p]["metadata"] for p in protocols}


def write_replay_bank(path: str, banks: DataFrame, train: DataFrame, num_nodes: int, seed: int = 1) -> None:
    """Numbered sets (bank, source_id, nodes) of one negative for each training edge."""
    rows = banks.select(F.col("bank").cast("string").alias("protocol"), "source_id", F.lit(0).alias("slot"), "nodes")
    write_bank(path, rows, train, train, num_nodes, 1, seed, "train", "replay")


def read_replay_bank(spark: SparkSession, path: str, train: DataFrame, num_nodes: int, seed: int = 1) -> DataFrame:
    """(bank, source_id, slot, nodes) of all banks, checked like ``read_bank``; ValueError without any."""
    names = tuple(p["protocol"] for p in read_manifest(spark, path)["protocols"])
    if not names:
        raise ValueError("the replay bank is empty")
    rows, _ = read_bank(spark, path, train, train, num_nodes, names, 1, seed, "train", "replay")
    return rows.select(F.col("protocol").cast("int").alias("bank"), "source_id", "slot", "nodes")


def sampled_metadata(negatives: DataFrame) -> dict[str, dict[str, float]]:
    """Figures of each protocol's sample for its manifest: rows, and the share of fallbacks where the sampler has one."""
    rows = scratch.materialize(negatives.groupBy("protocol").agg(F.count(F.lit(1)).cast("double").alias("rows"), F.avg(F.col("fallback").cast("double")).alias("fallback_rate")), "figures")
    return {r["protocol"]: {k: v for k, v in r.asDict().items() if k != "protocol" and v is not None} for r in rows.collect()}  # a row for each protocol
