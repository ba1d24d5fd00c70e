"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, free_name, keyed, n_words, text_of, unit_hash

#: Bits of the seeded order that a step looks at: a step's windows hold at most 2**STEP rows of a source.
STEP = 12


def water_fill(sources: DataFrame, total: Column, max_epochs: float) -> DataFrame:
    """Targets for rows (source, source_size, weight): level * weight, but at most max_epochs * source_size.

    Sources are clamped in the order of cap / weight; the level is what is left of the total over
    the weights that are left, taken at the first place where no further source is above its cap;
    past that place it only falls, so it is the largest that is at most its own place's ratio.
    The table has one row per source. If all caps together are below the total, all are clamped.
    """
    w = Window.orderBy("ratio", F.col("source").isNull(), "source")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    s = (
        sources.withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", total)
    )
    s = s.withColumn("clamped", F.coalesce(F.sum("cap").over(before), F.lit(0.0))).withColumn(
        "open", F.sum("weight").over(Window.partitionBy()) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    s = s.withColumn("level_here", (F.col("total") - F.col("clamped")) / F.col("open"))
    s = s.withColumn("level", F.max(F.when(F.col("level_here") <= F.col("ratio"), F.col("level_here"))).over(Window.partitionBy()))
    target = F.when(F.col("level").isNull() | (F.col("ratio") <= F.col("level")), F.col("cap")).otherwise(F.col("level") * F.col("weight"))
    return s.select("source", "source_size", "weight", target.alias("target"))


def _place(seed: int, id_col: str) -> list[Column]:
    """The parts of the seeded order that the hash of the id gives, most significant first."""
    h = unit_hash(F.lit(str(seed)), F.coalesce(col(id_col).cast("string"), F.lit("")))
    return [F.shiftright(h, 52 - STEP).alias("k0"), F.shiftright(h, 52 - 2 * STEP).bitwiseAND(F.lit((1 << STEP) - 1)).alias("k1"), h.alias("k2")]


def _by_row(key: Column) -> list[Column]:
    """The parts of the order that tell rows of one id apart."""
    p = F.xxhash64(key["f"], key["i"])
    return [F.shiftrightunsigned(p, 64 - STEP).alias("k3"), p.alias("k4")]


def _plan(docs: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float, seed: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with their sizes and places; each source's target, whole times and the place where its rest is reached; and the rows there that are taken."""
    rows = keyed(docs, col(id_col).alias("doc_id"), col(source_col).cast("string").alias("source"), n_words(text_of(text_col)).alias("size"), *_place(seed, id_col))
    rows = scratch.materialize(rows.select("*", *_by_row(F.col("__row"))), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source"))) - 1) % F.lit(len(weights))
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), place.cast("int") + 1)
    total = F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share))
    targets = water_fill(sources.withColumn("weight", weight), total, max_epochs).drop("weight")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = targets.withColumn("whole", whole.cast("long")).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    # one row per source from here on: the place, part by part, in which the running size passes the rest
    cut = scratch.materialize(targets.withColumn("before", F.lit(0).cast("long")), "targets")
    for k in range(4):
        at = [f"k{i}" for i in range(k)]
        inside = rows if not k else _of_source(rows, cut.filter("rest > 0").select(F.col("source").alias("s"), *[F.col(c).alias(f"c{c}") for c in at]), at)
        sums = inside.groupBy("source", f"k{k}").agg(F.sum("size").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("source").orderBy(f"k{k}"))
        sums = sums.select(F.col("source").alias("s"), F.col(f"k{k}"), "n", (upto - F.col("n")).alias("b"))
        passed = cut.join(sums, F.col("source").eqNullSafe(F.col("s"))).filter((F.col("before") + F.col("b") <= F.col("rest")) & (F.col("before") + F.col("b") + F.col("n") > F.col("rest")))
        passed = passed.filter("rest > 0").select(F.col("source").alias("s"), f"k{k}", F.col("b").alias("more"))
        cut = cut.join(passed, F.col("source").eqNullSafe(F.col("s")), "left").drop("s").withColumn("before", F.col("before") + F.coalesce("more", F.lit(0))).drop("more")
        cut = scratch.materialize(cut, "cut")
    at = ["k0", "k1", "k2", "k3"]
    edge = _of_source(rows, cut.filter("rest > 0").select(F.col("source").alias("s"), "before", "rest", *[F.col(c).alias(f"c{c}") for c in at]), at)
    order = Window.partitionBy("source").orderBy("k4", "doc_id", "size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    upto = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size") / 2.0
    edge = scratch.materialize(edge.withColumn("taken_here", upto <= F.col("rest")).filter("taken_here").select("__row"), "edge")
    return rows, cut, edge


def _of_source(rows: DataFrame, cut: DataFrame, at: list[str]) -> DataFrame:
    """The rows at their source's place, as far as the parts ``at`` tell it."""
    same = F.col("source").eqNullSafe(F.col("s"))
    for c in at:
        same = same & (F.col(c) == F.col(f"c{c}"))
    return rows.join(cut, same).drop("s", *[f"c{c}" for c in at])


def _times(rows: DataFrame, key: str, source: Column, places: list[Column], cut: DataFrame, edge: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``rows`` with repeats, target and source_size joined to them, under names that they do not use.

    The joined tables have a row per source and the rows of one small step per source; Spark
    broadcasts them where they are small enough, so that ``rows``, with their texts, stay where they are.
    """
    at = ["k0", "k1", "k2", "k3"]
    n = {c: free_name(rows, f"__mix_{c}") for c in ("source", "source_size", "target", "whole", "rest", "edge", "repeats", *at)}
    cut = cut.select(*[F.col(c).alias(n[c]) for c in ("source", "source_size", "target", "whole", "rest", *at)])
    out = rows.join(cut, source.eqNullSafe(F.col(n["source"]))).join(edge.select(F.col("__row").alias(n["edge"])), F.col(key) == F.col(n["edge"]), "left")
    before = F.coalesce(F.struct(*places) < F.struct(*[F.col(n[c]) for c in at]), F.lit(False))
    once_more = F.when(F.col(n["rest"]) > 0, (before | F.col(n["edge"]).isNotNull()).cast("long")).otherwise(F.lit(0).cast("long"))
    return out.withColumn(n["repeats"], F.col(n["whole"]) + once_more), {k: F.col(v) for k, v in n.items()}


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """How often the mix takes each row: __row, doc_id, source, size, source_size, target, repeats, taken.

    Sources get the weights in turn, by code point, null last. Each row is taken whole
    floor(target / source_size) times; what is left of the target is filled with rows in a seeded
    order, to the nearest row. The order goes by the hash of the id, then by that of the row's place
    in the input. The place where the target is reached is found in steps of STEP bits: sums per
    source and step, of which a window sees at most 2**STEP rows; only the rows that agree in all
    steps are ordered one by one. So no task sorts a source, nor rows that share an id.

    Null text has size 0. A source at its cap, or without words, has nothing left to fill, so no
    row, empty ones included, is repeated beyond the whole times. Null ids share a hash and are told
    apart by place, as are repeated rows. Of a very long text only its number of words moves. An empty table gives no rows.
    """
    rows, cut, edge = _plan(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    out, got = _times(rows, "__row", F.col("source"), [F.col(f"k{k}") for k in range(4)], cut, edge)
    repeats = got["repeats"]
    return out.select("__row", "doc_id", "source", "size", got["source_size"].alias("source_size"), got["target"].alias("target"), repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def apply_mix(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` takes it, with all their columns and no others.

    Nulls, repeated rows and empty tables as in ``mix``; a row that is taken no time is left out.
    """
    docs = scratch.as_files(docs)
    _, cut, edge = _plan(docs, weights, share, max_epochs, seed, id_col, text_col, source_col)
    key = free_name(docs, "__key")
    rows = scratch.with_row_key(docs, key)
    places = [*_place(seed, id_col), _by_row(F.col(key))[0]]
    rows, got = _times(rows, key, col(source_col).cast("string"), places, cut, edge)
    n = free_name(rows, "__n")
    rows = rows.filter(got["repeats"] > 0).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), got["repeats"])))
    return rows.select(*[col(c) for c in docs.columns])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (
  SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
         source_size * 2.0::DOUBLE AS cap, sum(source_size) OVER () * 1.5::DOUBLE AS total
  FROM s),
q AS (
  SELECT *, cap / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS clamped,
         sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS open
  FROM p),
l AS (SELECT max((total - clamped) / open) AS level FROM q WHERE (total - clamped) / open <= ratio),
t AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR ratio <= level THEN cap ELSE level * weight END AS target
  FROM q CROSS JOIN l),
u AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM t),
o AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS rest,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
           + d.size / 2.0::DOUBLE AS upto
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (whole + CASE WHEN rest > 0 AND upto <= rest THEN 1 ELSE 0 END) * size AS taken FROM o
"""
