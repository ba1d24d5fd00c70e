"""Negative samplers: source edges in, candidate edges out, every draw named by its place.

A rejection loop is rounds of attempts over the slots that are still open; the first that passes is
taken, so results do not depend on the order of rows, the partitioning or a retry. Output: (source_id, slot, nodes, size, attempt).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave import scratch
from netweave.functions import anchor_size, distinct_draws, draw, enough_draws, set_jaccard, uniform
from netweave.operators import risks
from netweave.operators.indexes import two_section
from netweave.sources.hyperedges import place_of


def slots(sources: DataFrame, per_source: int) -> DataFrame:
    """A row for each slot of each source. Sources are dealt out first: drawing costs more than moving them."""
    rows = sources.select(F.col("edge_id").alias("source_id"), F.col("nodes").alias("source"), F.col("size").alias("source_size"))
    rows = rows.repartition(int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions")), "source_id")
    return rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1))))


def attempts(sources: DataFrame, per_source: int, count: int) -> DataFrame:
    """A row for each attempt of each slot of each source."""
    return slots(sources, per_source).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))


def _still_open(open_: DataFrame, done: DataFrame, sources: DataFrame, per_source: int) -> tuple[DataFrame, int]:
    """The slots of ``open_`` without a row in ``done``, and how many these are. Names alone are compared and written; the nodes come from the sources again."""
    names = scratch.materialize(open_.select("source_id", "slot").join(done.select("source_id", "slot"), ["source_id", "slot"], "left_anti"), "open_slots")
    some = sources.join(names.select(F.col("source_id").alias("edge_id")).distinct(), "edge_id", "left_semi")
    return slots(some, per_source).join(names, ["source_id", "slot"], "left_semi"), names.count()


def once(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with a column computed once a row: the generator keeps filters on it from being put below, where they would compute it again."""
    return rows.withColumn(name, F.explode_outer(F.array(name)))


def in_rounds(sources: DataFrame, per_source: int, tries: int, draw_and_pick: Callable[[DataFrame], DataFrame], needed: bool = True) -> DataFrame:
    """The pick of each slot, drawn in rounds of 1, 4, 16, ... attempts over the slots that are still open.

    As attempts are numbered and the first that passes is taken, rounds do not change what is
    picked. With ``needed``, raises RuntimeError if a slot is open after ``tries`` attempts.
    """
    open_, done, low, width = slots(sources, per_source), None, 0, 1
    while True:
        high = min(tries, low + width)
        rows = open_.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))
        found = scratch.materialize(draw_and_pick(rows), "found")
        done = found if done is None else done.unionByName(found)
        open_, left = _still_open(open_, found, sources, per_source)
        low, width = high, 4 * width
        if not left or low >= tries:
            break
    if left and needed:
        raise RuntimeError(f"{left} slots found no edge in {tries} attempts")
    return done


def rounds(sources: DataFrame, per_source: int, tries: int, attempt: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All attempts that a loop up to the first accepted one would make, and those of its last round: rounds of 1, 4, 16, ... attempts over the slots that are still open.

    ``attempt`` gives for each row its outcome, with ``accepted``; a row that it leaves out is no valid attempt.
    """
    open_, made, low, width = slots(sources, per_source), None, 0, 1
    while True:
        high = min(tries, low + width)
        found = scratch.materialize(attempt(open_.withColumn("attempt", F.explode(F.sequence(F.lit(low), F.lit(high - 1))))), "tried")
        made = found if made is None else made.unionByName(found)
        low, width = high, 4 * width
        if low >= tries:
            return made
        open_, left = _still_open(open_, found.filter("accepted"), sources, per_source)
        if not left:
            return made


def named(seed: int | str, stream: str) -> tuple:
    return seed, stream, F.col("source_id"), F.col("slot"), F.col("attempt")


def unknown(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose node set is no known edge."""
    return rows.join(known.select("nodes").distinct(), "nodes", "left_anti")


def first_passing(rows: DataFrame, passes: Column | None = None, otherwise: Column | None = None) -> DataFrame:
    """Of each slot the first attempt that passes, else the one with the least ``otherwise``, else none."""
    ok = F.lit(True) if passes is None else passes
    rank = F.struct((~ok).alias("a"), F.when(ok, F.lit(0.0)).otherwise(F.lit(0.0) if otherwise is None else otherwise).alias("b"), F.col("attempt").alias("c"))
    rows = rows if otherwise is not None or passes is None else rows.filter(passes)
    best = rows.groupBy("source_id", "slot").agg(F.min(F.struct(rank.alias("r"), F.col("nodes"), ok.alias("ok"))).alias("b"))
    return best.select("source_id", "slot", "b.nodes", F.size("b.nodes").alias("size"), F.col("b.r.c").alias("attempt"), F.col("b.ok").alias("accepted"))


def uniform_edges(sources: DataFrame, known: DataFrame, nodes: int, per_source: int = 1, tries: int = 100, seed: int = 1, low: int = 0, high: int = 0) -> DataFrame:
    """Random edges: of the source's size, or of a random size from ``low`` to ``high`` where given. Fills every slot or raises."""
    size = F.col("source_size") if not high else (draw(*named(seed, "size")) % F.lit(high - low + 1) + low).cast("int")

    def drawn(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("want", size)
        rows = rows.withColumn("nodes", F.sort_array(distinct_draws(F.col("want"), nodes, enough_draws(F.col("want"), F.lit(nodes)), *named(seed, "node"))))
        rows = once(rows.select("source_id", "slot", "attempt", "want", "nodes"), "nodes").filter(F.size("nodes") == F.col("want")).drop("want")
        return first_passing(unknown(rows, known))

    return in_rounds(sources, per_source, tries, drawn)


def with_fallback(found: DataFrame, sources: DataFrame, known: DataFrame, nodes: int, per_source: int, tries: int, seed: int) -> DataFrame:
    """Fill the slots that ``found`` lacks by random edges of the size; only sources that lack some are drawn for. Adds ``fallback``."""
    found = scratch.materialize(found.withColumn("fallback", F.lit(False)), "found")
    full = found.groupBy(F.col("source_id").alias("edge_id")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= per_source)
    short = sources.join(full, "edge_id", "left_anti")
    other = uniform_edges(short, known, nodes, per_source, tries, seed).withColumn("fallback", F.lit(True))
    return found.unionByName(other.join(found.select("source_id", "slot"), ["source_id", "slot"], "left_anti"))


def _drawn(rows: DataFrame, keep: Column, nodes: int, seed: int | str, per_attempt: bool = True) -> DataFrame:
    """Add keep, anchor (the source's first nodes in a seeded order) and fill: as many drawn nodes from outside the source as go, if so many were found."""
    parts = named(seed, "keep") if per_attempt else (seed, "keep", F.col("source_id"), F.col("slot"))
    order = F.sort_array(F.transform("source", lambda n: F.struct(draw(*parts, n).alias("d"), n.alias("n"))))
    rows = rows.withColumn("keep", keep).withColumn("anchor", F.transform(F.slice(order, F.lit(1), F.col("keep")), lambda s: s["n"]))
    need = F.col("source_size") - F.col("keep")
    # the nodes outside are so large a part of all that so many more draws are needed
    outside = F.greatest(F.lit(nodes) - F.col("source_size"), F.lit(1))
    draws = F.ceil(enough_draws(need, outside) * F.lit(nodes) / outside).cast("int")
    return rows.withColumn("fill", distinct_draws(need, nodes, draws, *named(seed, "fill"), outside=F.col("source")))


def _anchored(rows: DataFrame, keep: Column, nodes: int, seed: int | str, per_attempt: bool = True, parts: bool = False) -> DataFrame:
    """Keep the source's first nodes in a seeded order and fill with drawn nodes from outside the source: source_id, slot, attempt, source, nodes; with ``parts`` also source_size, keep, anchor and fill."""
    rows = _drawn(rows, keep, nodes, seed, per_attempt)
    if parts:
        rows = once(once(rows, "fill"), "anchor").withColumn("nodes", F.sort_array(F.concat("anchor", "fill")))
        return rows.filter(F.size("anchor") + F.size("fill") == F.col("source_size"))
    rows = once(rows.select("source_id", "slot", "attempt", "source", F.sort_array(F.concat("anchor", "fill")).alias("nodes")), "nodes")
    return rows.filter(F.size("nodes") == F.size("source"))


def _alike(rows: DataFrame) -> DataFrame:
    """Replace ``source`` by ``alike``, the similarity to it, so that rows move without it."""
    return rows.withColumn("alike", set_jaccard(F.col("nodes"), F.col("source"))).drop("source")


def half_corruption(sources: DataFrame, known: DataFrame, nodes: int, per_source: int = 1, tries: int = 100, seed: int = 1) -> DataFrame:
    """Half of the source's nodes, rounded up, stay. Sources of one node have no slots; every other slot is filled, or it raises."""
    keep = F.ceil(F.col("source_size") / 2).cast("int")
    return in_rounds(sources.filter("size >= 2"), per_source, tries, lambda rows: first_passing(unknown(_anchored(rows, keep, nodes, seed).drop("source"), known)))


def _near_source(bound: float) -> Column:
    return set_jaccard(F.col("nodes"), F.col("source")) <= bound


def anchored(sources: DataFrame, known: DataFrame, nodes: int, ratio: float = 0.25, bound: float = 0.75, per_source: int = 1, tries: int = 100, seed: int = 1, fixed_anchor: bool = True) -> DataFrame:
    """An anchor of the source stays, and the result is at most ``bound`` similar to it. Fills every slot of sources with two nodes or more, or raises."""
    keep = anchor_size(F.col("source_size"), ratio)
    return in_rounds(sources.filter("size >= 2"), per_source, tries, lambda rows: first_passing(unknown(_alike(_anchored(rows, keep, nodes, seed, not fixed_anchor)).filter(F.col("alike") <= bound), known)))


def _scored(rows: DataFrame, edges: DataFrame, with_risks: dict[str, Callable]) -> DataFrame:
    """Join the risks of each attempt; the draws are written first, as each risk reads them. Few attempts repeat a set of their source, so telling these apart costs less than finding them."""
    rows = scratch.materialize(rows.withColumn("cand_id", F.xxhash64("source_id", "slot", F.col("probe" if "probe" in rows.columns else "attempt") if {"probe", "attempt"} & set(rows.columns) else F.lit(0))), "attempts")
    probes = rows.select("cand_id", "nodes", "source", F.size("nodes").alias("size"))
    for name, f in with_risks.items():
        rows = rows.join(f(edges, probes).withColumnRenamed("risk", name), "cand_id")
    return rows


def anchored_safe(sources: DataFrame, known: DataFrame, nodes: int, ratio: float = 0.25, source_bound: float = 0.75, bound: float = 0.5, per_source: int = 1, tries: int = 300, seed: int = 1) -> DataFrame:
    """Anchored, a new anchor at each attempt; the first attempt whose nearest other known edge is within ``bound``, else the least near one of ``tries``, else a random edge of the size.

    ``accepted`` is true for the first kind alone, so every slot of sources with two nodes or more has a row that says what it is.
    """
    keep = anchor_size(F.col("source_size"), ratio)

    def attempt(rows: DataFrame) -> DataFrame:
        rows = unknown(_anchored(rows, keep, nodes, seed).filter(_near_source(source_bound)), known)
        return _scored(rows, known, {"nearest": lambda e, c: risks.nearest(e, c, F.col("source"))}).withColumn("accepted", F.col("nearest") <= bound)

    made = rounds(sources.filter("size >= 2"), per_source, tries, attempt)
    return _filled(first_passing(made, F.col("accepted"), F.col("nearest")), sources, known, nodes, per_source, seed)


def _filled(found: DataFrame, sources: DataFrame, known: DataFrame, nodes: int, per_source: int, seed: int) -> DataFrame:
    """Slots that no attempt filled get a random edge that is not accepted."""
    out = with_fallback(found, sources.filter("size >= 2"), known, nodes, per_source, 100, seed)
    return out.withColumn("accepted", F.col("accepted") & ~F.col("fallback")).drop("fallback")


def fast_safe(sources: DataFrame, known: DataFrame, nodes: int, ratio: float = 0.25, bound: float = 0.5, per_source: int = 1, tries: int = 100, seed: int = 1) -> DataFrame:
    """Anchored with the source bound alone; slots without a passing attempt fall back to random edges of the size."""
    keep = anchor_size(F.col("source_size"), ratio)
    found = in_rounds(sources.filter("size >= 2"), per_source, tries, lambda rows: first_passing(unknown(_alike(_anchored(rows, keep, nodes, seed)).filter(F.col("alike") <= bound), known)), needed=False)
    return with_fallback(found, sources, known, nodes, per_source, tries, seed)


#: Neighbours of a node, counted once for each edge, that stand as one array; sources with a node of more are counted row by row.
HUB = 4096
#: Best candidates of a slot that are held against the known edges first.
FIRST = 4


def _replacements(known: DataFrame, nodes: int) -> Callable[[DataFrame, int], DataFrame]:
    """A function of (sources, per_source, seed, limit): (source_id, slot, gone, new, source), each node that may go with each that may come for it.

    What comes is adjacent to all nodes but the one that goes. A node's neighbours stand as one array. For a pair they are chosen from where they stand, ``limit`` (0: all)
    of least draw; of a larger set the arrays of three nodes move, as what comes is in two of them, and the few such nodes are looked up beside the others.
    """
    held = known.filter("size >= 2").select(F.explode("nodes").alias("x"), "size", F.col("nodes").cast("array<int>" if nodes <= 1 << 31 else "array<bigint>").alias("nodes"))
    hubs = scratch.materialize(held.groupBy("x").agg(F.sum(F.col("size") - 1).alias("d")).filter(F.col("d") > HUB).select("x"), "hubs")
    some_hubs = hubs.count() > 0
    packed = (held.join(hubs, "x", "left_anti") if some_hubs else held).groupBy("x").agg(F.array_distinct(F.flatten(F.collect_list("nodes"))).alias("ys"))

    def pairs(src: DataFrame, per_source: int, seed: int | str, limit: int) -> DataFrame:
        kept = F.explode(F.array(*[F.struct(F.get("source", F.lit(k)).alias("gone"), F.get("source", F.lit(1 - k)).alias("x")) for k in (0, 1)]))
        rows = src.select("source_id", "source", kept.alias("k")).select("source_id", "source", "k.gone", "k.x").join(packed, "x")
        rows = rows.withColumn("ys", F.array_except(F.col("ys").cast("array<bigint>"), "source")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1))))
        news = F.transform("ys", lambda y: F.struct(draw(seed, "new", F.col("source_id"), F.col("slot"), y).alias("d"), y.alias("y")))
        news = F.slice(F.array_sort(news), F.lit(1), F.lit(limit)) if limit else news
        # outer: else a filter on the size of the array is put below and computes it once more
        return rows.select("source_id", "slot", "gone", "source", F.explode_outer(news).alias("n")).filter("n is not null").select("source_id", "slot", "gone", F.col("n.y").alias("new"), "source")

    def larger(src: DataFrame) -> DataFrame:
        lists = src.select("source_id", F.posexplode(F.slice("source", 1, 3)).alias("k", "x")).join(packed, "x").groupBy("source_id")
        lists = lists.agg(*[F.coalesce(F.first(F.when(F.col("k") == k, F.col("ys")), ignorenulls=True), F.array().cast(packed.schema["ys"].dataType)).alias(f"l{k}") for k in range(3)])
        both = [F.array_intersect(f"l{a}", f"l{b}") for a, b in ((0, 1), (0, 2), (1, 2))]
        met = lists.join(src, "source_id").withColumn("new", F.array_union(F.array_union(both[0], both[1]), both[2]))
        met = met.select("source_id", "source", "size", "l0", "l1", "l2", F.explode_outer("new").alias("new")).filter("new is not null")
        in_list = [F.array_contains(f"l{k}", F.col("new")) for k in range(3)]
        n, s = sum(i.cast("long") for i in in_list), sum(F.when(i, F.get("source", F.lit(k))).otherwise(0) for k, i in enumerate(in_list))
        met = scratch.materialize(met.select("source_id", "source", "size", F.col("new").cast("long").alias("new"), n.alias("n"), s.alias("s")).filter(~F.array_contains("source", F.col("new"))), "met")
        rest = met.filter("size > 3").select("source_id", "new", F.explode(F.slice("source", F.lit(4), F.col("size") - 3)).alias("x")).join(packed, "x")
        rest = rest.filter(F.array_contains("ys", F.col("new").cast(packed.schema["ys"].dataType.elementType))).groupBy("source_id", "new").agg(F.count(F.lit(1)).alias("n1"), F.sum("x").alias("s1"))
        return met.join(rest, ["source_id", "new"], "left").select("source_id", "source", "size", "new", (F.col("n") + F.coalesce("n1", F.lit(0))).alias("n"), (F.col("s") + F.coalesce("s1", F.lit(0))).alias("s"))

    def found(of: DataFrame, per_source: int, seed: int | str, limit: int = 0) -> DataFrame:
        src = of.filter("size >= 2").select(F.col("edge_id").alias("source_id"), F.col("nodes").alias("source"), "size")
        plain = src
        if some_hubs:
            inc = src.select("source_id", "size", F.explode("source").alias("x"))
            far = inc.join(hubs, "x", "left_semi").select("source_id").distinct()
            plain = src.join(far, "source_id", "left_anti")
        rows = larger(plain.filter("size > 2"))
        if some_hubs:
            inc = inc.join(far, "source_id", "left_semi")
            met = inc.join(two_section(known), "x").groupBy("source_id", F.col("y").alias("new")).agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), F.max("size").alias("size"))
            met = met.filter(F.col("n") >= F.col("size") - 1).drop("size").join(src, "source_id").filter(~F.array_contains("source", F.col("new")))
            rows = rows.unionByName(met)
        rows = rows.filter(F.col("n") >= F.col("size") - 1)
        total = F.aggregate("source", F.lit(0).cast("long"), lambda a, x: a + x)
        rows = rows.withColumn("gone", F.explode(F.when(F.col("n") == F.col("size"), F.col("source")).otherwise(F.array(total - F.col("s")))))
        rows = rows.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(per_source - 1)))).select("source_id", "slot", "gone", "new", "source")
        return rows.unionByName(pairs(plain.filter("size = 2"), per_source, seed, limit))

    return found


def clique(sources: DataFrame, known: DataFrame, nodes: int, per_source: int = 1, seed: int = 1, tries: int = 100) -> DataFrame:
    """Replace a node by one that is a projected neighbour of all the others.

    The node to go and its replacement are those with the least draws. The first few in that order are held against the known
    edges; only sources where all of these are known have all their others looked up. Slots without one fall back to random edges.
    """
    found = _replacements(known, nodes)

    def proposed(of: DataFrame, limit: int = 0) -> DataFrame:
        rows = found(of, per_source, seed, limit)
        rows = rows.withColumn("nodes", F.array_sort(F.concat(F.array_remove("source", F.col("gone")), F.array("new"))))
        order = F.struct(draw(seed, "gone", F.col("source_id"), F.col("slot"), F.col("gone")).alias("a"), draw(seed, "new", F.col("source_id"), F.col("slot"), F.col("new")).alias("b"), F.col("nodes"))
        return rows.select("source_id", "slot", "nodes", order.alias("order"))

    pick = lambda rows: unknown(rows, known).groupBy("source_id", "slot").agg(F.min("order").alias("b"))
    by = Window.partitionBy("source_id", "slot").orderBy("order")
    first = scratch.materialize(proposed(sources, FIRST).withColumn("r", F.row_number().over(by)).filter(F.col("r") <= FIRST), "proposed")
    best = scratch.materialize(pick(first), "picked")
    open_ = first.filter(F.col("r") == FIRST).join(best, ["source_id", "slot"], "left_anti").select("source_id", "slot")
    left = scratch.materialize(open_, "open_slots")
    if left.count():
        rest = proposed(sources.join(left.select(F.col("source_id").alias("edge_id")).distinct(), "edge_id", "left_semi"))
        best = best.unionByName(pick(rest.join(left, ["source_id", "slot"], "left_semi")))
    best = best.select("source_id", "slot", "b.nodes", F.size("b.nodes").alias("size"), F.lit(0).alias("attempt"), F.lit(True).alias("accepted"))
    return with_fallback(best, sources, known, nodes, per_source, tries, seed)


def motif(sources: DataFrame, known: DataFrame, nodes: int, per_source: int = 1, seed: int = 1, tries: int = 100) -> DataFrame:
    """Grow a connected set on the projection: a drawn start, then in each round the neighbour of the set with the least draw.

    One join per round; sets leave the loop when they have the source's size. Slots that get stuck
    or end at a known edge fall back to random edges.
    """
    near = scratch.materialize(two_section(known), "projection")
    starts = scratch.materialize(place_of(near.select("x").distinct(), ["x"], "k"), "starts")
    n = starts.count()
    rows = attempts(sources.filter("size >= 2"), per_source, 1).withColumn("k", draw(*named(seed, "start")) % F.lit(max(1, n)))
    rows = rows.join(starts, "k").select("source_id", "slot", "source_size", F.array("x").alias("nodes"))
    rows = scratch.materialize(rows, "growing")
    done = rows.filter("source_size = 1")
    largest = rows.agg(F.max("source_size")).first()[0] or 1
    for k in range(1, largest):
        open_ = rows.filter(F.col("source_size") > k)
        out = open_.select("source_id", "slot", "source_size", "nodes", F.explode("nodes").alias("x")).join(near, "x").filter(~F.array_contains("nodes", F.col("y")))
        least = draw(seed, "grow", F.col("source_id"), F.col("slot"), k, F.col("y"))
        # a draw has 32 bits; with the node in the 31 below it the least pair is one number, which is kept by hash and needs no sort
        pick = F.min(F.shiftleft(least, 31) + F.col("y")) if nodes <= 1 << 31 else F.min(F.struct(least.alias("d"), F.col("y")))
        best = out.groupBy("source_id", "slot").agg(pick.alias("b"))
        new = F.col("b").bitwiseAND(F.lit((1 << 31) - 1)) if nodes <= 1 << 31 else F.col("b.y")
        rows = scratch.materialize(open_.join(best, ["source_id", "slot"]).select("source_id", "slot", "source_size", F.concat("nodes", F.array(new)).alias("nodes")), "growing")
        done = done.unionByName(rows.filter(F.col("source_size") == k + 1))
    done = unknown(done.withColumn("nodes", F.array_sort("nodes")), known)
    done = done.select("source_id", "slot", "nodes", F.size("nodes").alias("size"), F.lit(0).alias("attempt"), F.lit(True).alias("accepted"))
    return with_fallback(done, sources, known, nodes, per_source, tries, seed)


def mixed(sources: DataFrame, known: DataFrame, nodes: int, per_source: int = 1, seed: int | str = 1) -> DataFrame:
    """Each slot by one of the random, motif and clique samplers, drawn evenly; adds ``kind``. A sampler gets the sources that have a slot of its kind, and no others."""
    kinds = {"sns": uniform_edges, "mns": motif, "cns": clique}
    chosen = draw(seed, "kind", F.col("source_id"), F.col("slot")) % 3
    drawn = slots(sources, per_source).select("source_id", chosen.alias("kind"))
    out = None
    for k, (name, f) in enumerate(kinds.items()):
        own = sources.join(drawn.filter(F.col("kind") == k).select(F.col("source_id").alias("edge_id")).distinct(), "edge_id", "left_semi")
        part = f(own, known, nodes, per_source=per_source, seed=seed).filter(chosen == k)
        part = part.select("source_id", "slot", "nodes", "size", F.lit(name).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return out


def risk_controlled(
    sources: DataFrame, known: DataFrame, nodes: int, bounds: dict[str, float], budget: float | None = None, caps: dict[str, float] | None = None,
    ratio: float = 0.25, per_source: int = 1, tries: int = 300, seed: int = 1, pool: DataFrame | None = None, pool_share: float = 0.0, every: bool = False,
) -> DataFrame:
    """Anchored proposals in rounds up to ``tries``, scored by the bounded risks; the first within all bounds (or the budget and caps), else the one of least combined risk.

    With ``pool`` (replacement_pool) a share of the attempts fills from the neighbours of the
    source's nodes, topped up by drawn nodes. Adds the risks, score, strategy, and ``valid``: the new edges among the attempts up to the accepted one,
    or with ``every`` among all ``tries``, which are then all made. Slots
    without any new edge have no row; ``mixture.controlled`` fills them and keeps all attempts.
    """
    functions = {
        "nearest": lambda e, c: risks.nearest(e, c, F.col("source")), "closure": risks.closure, "cowalk": risks.co_walk, "hitting": risks.hitting, "residual": risks.residual,
    }
    # written once, as each round reads it
    listed = None if pool is None else scratch.materialize(pool.groupBy(F.col("edge_id").alias("source_id")).agg(F.sort_array(F.collect_list(F.struct("place", "node_id"))).alias("pool")), "pools")

    def attempt(rows: DataFrame) -> DataFrame:
        rows = _anchored(rows, anchor_size(F.col("source_size"), ratio), nodes, seed, parts=listed is not None).withColumn("strategy", F.lit("random"))
        if listed is not None and pool_share > 0:
            near = rows.join(listed, "source_id", "left").withColumn("pool", F.coalesce(F.transform("pool", lambda p: p["node_id"]), F.array().cast("array<bigint>")))
            order = F.array_sort(F.transform("pool", lambda n: F.struct(draw(*named(seed, "pool"), n).alias("d"), n.alias("n"))))
            fill = F.slice(F.array_distinct(F.concat(F.transform(order, lambda s: s["n"]), "fill")), F.lit(1), F.col("source_size") - F.col("keep"))
            use = uniform(*named(seed, "strategy")) < pool_share
            rows = near.withColumn("strategy", F.when(use, "neighborhood").otherwise("random")).withColumn("nodes", F.when(use, F.array_sort(F.concat("anchor", fill))).otherwise(F.col("nodes"))).drop("pool")
        rows = _scored(unknown(rows, known), known, {k: functions[k] for k in bounds}).withColumn("score", F.round(risks.combined(bounds), 9))
        return rows.withColumn("accepted", risks.within(bounds) if budget is None else (F.col("score") <= budget) & risks.within(caps or {}))

    fits = sources.filter("size >= 2")
    made = scratch.materialize(attempt(attempts(fits, per_source, tries)), "tried") if every else rounds(fits, per_source, tries, attempt)
    rank = F.struct((~F.col("accepted")).alias("a"), F.when(F.col("accepted"), F.lit(0.0)).otherwise(F.col("score")).alias("b"), F.col("attempt"), F.col("nodes"), F.col("accepted"), F.col("score"), F.col("strategy"), *[F.col(k) for k in bounds])
    tried = F.sort_array(F.collect_list("attempt"))
    best = made.groupBy("source_id", "slot").agg(F.min(rank).alias("b"), tried.alias("t"))
    valid = F.size(F.filter("t", lambda t: F.lit(every) | ~F.col("b.accepted") | (t <= F.col("b.attempt")))).cast("long")
    return best.select("source_id", "slot", "b.nodes", F.size("b.nodes").alias("size"), "b.attempt", "b.accepted", "b.score", "b.strategy", *[F.col(f"b.{k}").alias(k) for k in bounds], valid.alias("valid"))


def diagnostics(samples: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """One row of means and rates over a risk-controlled sample."""
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.avg(F.col("accepted").cast("double")).alias("accept_rate"), F.avg(F.col("attempt").cast("double")).alias("mean_attempt"),
        F.avg("score").alias("mean_score"), F.avg((F.col("strategy") == "random").cast("double")).alias("random_rate"), *[F.avg(n).alias(f"mean_{n}") for n in names],
    )


SAMPLERS = {
    "random": uniform_edges, "size_matched": uniform_edges, "sns": uniform_edges, "mns": motif, "cns": clique, "mix": mixed, "half_corruption": half_corruption,
    "fast_safe": fast_safe, "anchored_random": anchored, "anchored_safe": anchored_safe, "risk_controlled": risk_controlled, "model_aware_risk_controlled": risk_controlled,
}


def sampler(name: str) -> Callable[..., DataFrame]:
    """A sampler by name; raises ValueError for an unknown one."""
    if name not in SAMPLERS:
        raise ValueError(f"unknown sampler {name}")
    return SAMPLERS[name]
