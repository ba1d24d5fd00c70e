"""Sets as binary memberships over short candidate lists: gap filling, discrete diffusion, and repair to a fixed size.

Rows are ragged arrays (candidates, membership, anchor) of one length; draws are named, so a retry gives the same sets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import distinct_draws, draw, enough_draws, uniform
from netweave.operators import representations, samplers

LONGS = "array<bigint>"


def smallest_missing(held: Column, count: Column, nodes: int | Column) -> Column:
    """The ``count`` smallest ids of 0 .. nodes - 1 that ``held`` does not have, fewer if there are not so many.

    A set of k ids leaves count ids free below k + count, so no more than these are looked at.
    """
    end = F.least(F.size(held) + count, F.lit(nodes) if isinstance(nodes, int) else nodes)
    below = F.when(end > 0, F.transform(F.sequence(F.lit(0), F.greatest(end, F.lit(1)) - 1), lambda i: i.cast("bigint"))).otherwise(F.array().cast(LONGS))
    return F.slice(F.array_except(below, held), F.lit(1), F.greatest(count, F.lit(0)))


def candidate_lists(edges: DataFrame, nodes: int, width: int, retrieved: DataFrame | None = None, anchors: DataFrame | None = None) -> DataFrame:
    """(edge_id, nodes, candidates, membership, anchor): the edge's nodes, then its retrieved ones (edge_id, found) in order, then the smallest missing ids, up to ``width``.

    An edge of more than ``width`` nodes keeps them all, so each node of an edge is a candidate. ``anchor`` marks the
    nodes of ``anchors`` (edge_id, anchor); all 0 without it. Lists are shorter only where there are fewer ids.
    """
    rows = edges.select("edge_id", F.col("nodes").cast(LONGS).alias("nodes"))
    empty = F.array().cast(LONGS)
    rows = rows.withColumn("found", empty) if retrieved is None else rows.join(retrieved.select("edge_id", F.col("found").cast(LONGS).alias("found")), "edge_id", "left").withColumn("found", F.coalesce("found", empty))
    rows = rows.withColumn("width", F.greatest(F.lit(width), F.size("nodes"))).withColumn("listed", F.slice(F.array_distinct(F.concat("nodes", "found")), F.lit(1), F.col("width")))
    rows = rows.withColumn("candidates", F.concat("listed", smallest_missing(F.col("listed"), F.col("width") - F.size("listed"), nodes)))
    rows = rows.withColumn("a", empty) if anchors is None else rows.join(anchors.select("edge_id", F.col("anchor").cast(LONGS).alias("a")), "edge_id", "left").withColumn("a", F.coalesce("a", empty))
    mark = lambda held: F.transform("candidates", lambda c: F.array_contains(held, c).cast("int"))
    return rows.select("edge_id", "nodes", "candidates", mark(F.col("nodes")).alias("membership"), mark(F.col("a")).alias("anchor"))


def keep_rates(steps: int, beta_start: float = 0.02, beta_end: float = 0.35) -> list[float]:
    """What is left of a membership after 0, 1, ... ``steps`` steps: products of 1 - beta, betas on a line. Each step flips with chance beta / 2."""
    out = [1.0]
    for k in range(steps):
        beta = beta_start if steps == 1 else beta_start + (beta_end - beta_start) * k / (steps - 1)
        out.append(out[-1] * (1.0 - beta))
    return out


def _rate(rates: list[float], t: Column) -> Column:
    return F.element_at(F.array(*[F.lit(float(r)) for r in rates]), t.cast("int") + 1)


def corrupted(rows: DataFrame, rates: list[float], step: Column, seed: int | str = 1, key: str = "edge_id", held: bool = True) -> DataFrame:
    """Add step and state: memberships after ``step`` steps of the forward process, in one draw each: 1 with chance (1 + r) / 2 for a member, (1 - r) / 2 for another, r the rate left.

    Anchors stay members where ``held``.
    """
    rows = rows.withColumn("step", step.cast("int"))
    left = _rate(rates, F.col("step"))

    def one(m: Column, i: Column) -> Column:
        chance = F.when(m == 1, (1 + left) / 2).otherwise((1 - left) / 2)
        state = (uniform(seed, "corrupt", F.col(key), F.col("step"), i) < chance).cast("int")
        return F.when(F.get("anchor", i) == 1, 1).otherwise(state) if held else state

    return rows.withColumn("state", F.transform("membership", one))


def drawn_step(steps: int, seed: int | str = 1, key: str = "edge_id") -> Column:
    """An even draw of 1 .. steps for each row."""
    return draw(seed, "step", F.col(key)) % F.lit(steps) + 1


def posterior(state: Column, member: Column, rates: list[float], t: Column) -> Column:
    """The chance that a membership is 1 one step earlier, from its state at step t and the chance ``member`` that it is 1 at the start.

    For each value at the start, the chances of both values at t - 1 are weighed by how likely they lead to the state; the two results are weighed by ``member``.
    """
    before, now = _rate(rates, t - 1), _rate(rates, t)
    stay = (1 + now / before) / 2  # of one step
    to_state = lambda v: F.when(state == v, stay).otherwise(1 - stay)

    def given(start: int) -> Column:
        one = ((1 + before) / 2 if start else (1 - before) / 2) * to_state(1)
        zero = ((1 - before) / 2 if start else (1 + before) / 2) * to_state(0)
        return one / F.greatest(one + zero, F.lit(1e-8))

    return member * given(1) + (1 - member) * given(0)


def denoised(rows: DataFrame, denoiser: Callable[[DataFrame, int], DataFrame], rates: list[float], seed: int | str = 1, key: str = "edge_id") -> DataFrame:
    """(key, nodes, drawn): sets sampled by the reverse process, with the size of ``nodes``.

    States start even; in each step ``denoiser`` (rows, step) adds ``logits`` (an array over the candidates), and states are drawn from the posterior. At the end the anchors and
    the candidates of the largest last logits (ties: first listed) fill the size. Steps are written to the shared folder, so a chain does not grow the plan.
    """
    even = lambda m, i: F.when(F.get("anchor", i) == 1, 1).otherwise((uniform(seed, "even", F.col(key), i) < 0.5).cast("int"))
    rows = rows.withColumn("state", F.transform("membership", even))
    steps = len(rates) - 1
    if steps < 1:
        raise ValueError("at least one step is needed")
    for t in range(steps, 0, -1):
        rows = scratch.materialize(denoiser(rows.drop("logits"), t), "logits")
        chance = lambda s, i: posterior(s, 1 / (1 + F.exp(-F.get("logits", i))), rates, F.lit(t))  # noqa: B023, E731
        step = lambda s, i: F.when(F.get("anchor", i) == 1, 1).otherwise((uniform(seed, "reverse", F.col(key), t, i) < chance(s, i)).cast("int"))  # noqa: B023, E731
        rows = rows.withColumn("state", F.transform("state", step))
    order = F.array_sort(F.transform("candidates", lambda c, i: F.struct((-F.get("anchor", i)).alias("a"), (-F.round(F.get("logits", i), 9)).alias("l"), i.alias("i"), c.alias("c"))))
    picked = F.slice(order, F.lit(1), F.greatest(F.size("nodes"), F.aggregate("anchor", F.lit(0), lambda a, x: a + x)))
    return rows.select(key, "nodes", F.array_sort(F.transform(picked, lambda s: s["c"])).alias("drawn"))


def members(rows: DataFrame, state: str = "state") -> Column:
    return F.transform(F.filter(F.arrays_zip("candidates", state), lambda z: z[state] == 1), lambda z: z["candidates"])


def corrupted_vectors(edges: DataFrame, vectors: DataFrame, dim: int, width: int, rates: list[float], batches: int, seed: int | str = 1) -> DataFrame:
    """(edge_id, step, rep): mean vectors of forward-corrupted sets, as negatives of a support-risk model; zeros for an empty set.

    Edges are dealt into ``batches``; a list is filled with the smallest other nodes of its batch. Let the number grow with the edges: a batch's nodes are one row.
    """
    rows = edges.select("edge_id", F.col("nodes").cast(LONGS).alias("nodes"), F.pmod(F.xxhash64("edge_id"), F.lit(batches)).alias("batch"))
    most = rows.groupBy("batch").agg(F.max(F.size("nodes")).alias("largest"))
    all_ = rows.select("batch", F.explode("nodes").alias("n")).groupBy("batch").agg(F.array_sort(F.collect_set("n")).alias("universe"))
    rows = rows.join(all_, "batch").join(most, "batch")
    size = F.least(F.size("universe"), F.greatest(F.lit(width), F.col("largest")))
    rows = rows.withColumn("candidates", F.slice(F.concat("nodes", F.array_except("universe", "nodes")), F.lit(1), size))
    rows = rows.withColumn("membership", F.transform("candidates", lambda c: F.array_contains("nodes", c).cast("int"))).withColumn("anchor", F.transform("candidates", lambda c: F.lit(0)))
    rows = corrupted(rows.select("edge_id", "candidates", "membership", "anchor"), rates, drawn_step(len(rates) - 1, seed), seed, held=False)
    rows = scratch.materialize(rows.select("edge_id", "step", members(rows).alias("nodes")), "corrupted")
    met = rows.select("edge_id", "step", F.explode_outer("nodes").alias("node_id")).join(vectors.select("node_id", "vec"), "node_id", "left")
    return representations.means(met, ["edge_id", "step"], "vec", dim)


def repaired(rows: DataFrame, known: DataFrame, nodes: int, tries: int = 100, seed: int | str = 1) -> DataFrame:
    """(source_id, nodes, attempt): new edges of exactly the source's size from (source_id, source, anchor, candidates).

    Each attempt keeps the anchor and adds candidates from outside the source in a seeded order; where these are too few, drawn nodes from outside
    the source. The first attempt that is no known edge is taken; raises RuntimeError if a row has none in ``tries``.
    """
    held = scratch.materialize(rows.select("source_id", F.col("anchor").cast(LONGS).alias("anchor"), F.col("candidates").cast(LONGS).alias("candidates")), "to_repair")
    sources = rows.select(F.col("source_id").alias("edge_id"), F.col("source").cast(LONGS).alias("nodes"), F.size("source").alias("size"))

    def attempt(now: DataFrame) -> DataFrame:
        now = now.join(held, "source_id")
        want = F.col("source_size") - F.size("anchor")
        pool = F.array_except(F.array_except("candidates", "anchor"), "source")
        order = F.array_sort(F.transform(pool, lambda n: F.struct(draw(*samplers.named(seed, "repair"), n).alias("d"), n.alias("n"))))
        outside = F.greatest(F.lit(nodes) - F.col("source_size"), F.lit(1))
        draws = F.ceil(enough_draws(want, outside) * F.lit(nodes) / outside).cast("int")
        more = F.array_except(distinct_draws(draws, nodes, draws, *samplers.named(seed, "more")), F.concat("source", "anchor"))
        fill = F.slice(F.array_distinct(F.concat(F.transform(order, lambda s: s["n"]), more)), F.lit(1), F.greatest(want, F.lit(0)))
        now = scratch.materialize(now.withColumn("nodes", F.array_sort(F.concat("anchor", fill))), "repaired")
        return samplers.first_passing(samplers.unknown(now.filter(F.size("nodes") == F.col("source_size")), known))

    return samplers.in_rounds(sources, 1, tries, attempt).select("source_id", "nodes", "attempt")
