"""Indexes over hyperedges: pair and triple support, projections and expansion features."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from netweave import scratch
from netweave.sources.hyperedges import degrees, incidence_of


#: Nodes whose pairs with all later ones are listed in one row.
STRIP = 64


def _strip_pairs(nodes: str, strip: Column) -> Column:
    """The pairs of the nodes from place STRIP * ``strip`` on, STRIP of them, with all nodes behind each."""
    n = F.col(nodes)
    start = strip * STRIP
    rest = lambda i: F.slice(n, i + 2, F.greatest(F.size(n) - i - 1, F.lit(0)))
    return F.flatten(F.transform(F.slice(n, start + 1, F.lit(STRIP)), lambda x, k: F.transform(rest(start + k), lambda y: F.struct(x.alias("x"), y.alias("y")))))


def _cyclic_pairs(nodes: str, max_pairs: int) -> Column:
    """A bounded, even choice of pairs: nodes and those a growing offset further on, around the edge."""
    n = F.col(nodes)
    size = F.size(n)
    stride = F.greatest(F.lit(1), F.floor(size / F.lit(max(1, math.isqrt(max_pairs)))).cast("int"))
    places = F.sequence(F.lit(0), size - 1)
    pair = lambda i, j: F.struct(F.least(F.get(n, i), F.get(n, j)).alias("x"), F.greatest(F.get(n, i), F.get(n, j)).alias("y"))
    listed = F.flatten(F.transform(F.sequence(F.lit(1), size - 1, stride), lambda o: F.transform(places, lambda i: pair(i, (i + o) % size))))
    return F.slice(F.array_distinct(listed), 1, max_pairs)


def edge_pairs(edges: DataFrame, max_pairs: int = 0, id_col: str = "edge_id", *extra: str) -> DataFrame:
    """(id, extra columns, x, y) with x < y for each pair of an edge's nodes.

    Edges with more than ``max_pairs`` pairs (0: no bound) give a cyclic choice of that many, so a
    huge edge does not grow with the square of its size. Without a bound, edges are listed strip by strip, so that no row holds all pairs of a huge one.
    """
    fits = edges.filter("size >= 2")
    if max_pairs > 0:
        few = F.col("size") * (F.col("size") - 1) / 2 <= max_pairs
        strips = F.when(few, F.sequence(F.lit(0), F.floor((F.col("size") - 2) / STRIP).cast("int"))).otherwise(F.array(F.lit(-1)))
        pairs = F.when(F.col("__strip") >= 0, _strip_pairs("nodes", F.greatest("__strip", F.lit(0)))).otherwise(_cyclic_pairs("nodes", max_pairs))
    else:
        strips, pairs = F.sequence(F.lit(0), F.floor((F.col("size") - 2) / STRIP).cast("int")), _strip_pairs("nodes", F.col("__strip"))
    rows = fits.select(id_col, *extra, "nodes", *[c for c in ("size",) if c not in extra], F.explode(strips).alias("__strip"))
    return rows.select(id_col, *extra, F.explode(pairs).alias("p")).select(id_col, *extra, "p.x", "p.y")


def pair_support(edges: DataFrame, max_pairs: int = 0) -> DataFrame:
    return edge_pairs(edges, max_pairs).groupBy("x", "y").agg(F.count(F.lit(1)).alias("support"))


def _cyclic_triples(nodes: str, max_triples: int) -> Column:
    """A bounded, even choice of triples: nodes with those one and two growing offsets further on, around the edge."""
    n = F.col(nodes)
    size = F.size(n)
    offsets = F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(size - 1, F.floor(F.lit(max_triples) / size).cast("int") + 1)))
    at = lambda i, o: F.array_sort(F.array(F.get(n, i), F.get(n, (i + o) % size), F.get(n, (i + 2 * o) % size)))
    listed = F.flatten(F.transform(offsets, lambda o: F.transform(F.sequence(F.lit(0), size - 1), lambda i: at(i, o))))
    return F.slice(F.array_distinct(F.filter(listed, lambda t: F.size(F.array_distinct(t)) == 3)), 1, max_triples)


def edge_triples(edges: DataFrame, max_triples: int = 0) -> DataFrame:
    """(edge_id, x, y, z) with x < y < z, listed node by node, so that no row holds all triples of an edge.

    Edges with more than ``max_triples`` triples (0: no bound) give a cyclic choice of at most that many, which do not grow with the third power of their size.
    """
    many = F.col("size") * (F.col("size") - 1) * (F.col("size") - 2) / 6 > max_triples if max_triples > 0 else F.lit(False)
    after = lambda k: F.slice("nodes", F.col(k) + 2, F.greatest(F.size("nodes") - F.col(k) - 1, F.lit(0)))
    rows = edges.filter("size >= 3").filter(~many).select("edge_id", "nodes", F.posexplode("nodes").alias("i", "x"))
    rows = rows.select("edge_id", "x", after("i").alias("nodes")).select("edge_id", "x", "nodes", F.posexplode("nodes").alias("j", "y"))
    rows = rows.select("edge_id", "x", "y", F.explode(after("j")).alias("z"))
    if max_triples <= 0:
        return rows
    chosen = edges.filter("size >= 3").filter(many).select("edge_id", F.explode(_cyclic_triples("nodes", max_triples)).alias("t"))
    return rows.unionByName(chosen.select("edge_id", F.get("t", F.lit(0)).alias("x"), F.get("t", F.lit(1)).alias("y"), F.get("t", F.lit(2)).alias("z")))


def triple_support(edges: DataFrame, max_triples: int = 0) -> DataFrame:
    return edge_triples(edges, max_triples).groupBy("x", "y", "z").agg(F.count(F.lit(1)).alias("support"))


def both_ways(pairs: DataFrame, *extra: str) -> DataFrame:
    back = pairs.select(F.col("y").alias("x"), F.col("x").alias("y"), *extra)
    return pairs.select("x", "y", *extra).unionByName(back)


def two_section(edges: DataFrame) -> DataFrame:
    """(x, y) for each ordered pair of distinct nodes that share an edge."""
    return both_ways(edge_pairs(edges).select("x", "y").distinct())


def clique_expansion(edges: DataFrame, nodes: DataFrame, full: bool = True) -> DataFrame:
    """(x, y, count, value): pair counts with a self loop per node, over the roots of the row sums.

    ``full`` takes all pairs; else the smallest and largest node are tied to each other and to the
    nodes between them.
    """
    if full:
        pairs = edge_pairs(edges).select("x", "y")
    else:
        n = F.col("nodes")
        low, high = F.get(n, F.lit(0)), F.get(n, F.size(n) - 1)
        between = F.slice(n, F.lit(2), F.greatest(F.size(n) - 2, F.lit(0)))
        tie = lambda a, b: F.struct(a.alias("x"), b.alias("y"))
        listed = F.concat(F.array(tie(low, high)), F.transform(between, lambda m: tie(low, m)), F.transform(between, lambda m: tie(m, high)))
        pairs = edges.filter("size >= 2").select(F.explode(listed).alias("p")).select("p.x", "p.y")
    loops = nodes.select(F.col("node_id").alias("x"), F.col("node_id").alias("y"))
    counts = both_ways(pairs).unionByName(loops).groupBy("x", "y").agg(F.count(F.lit(1)).alias("count"))
    rows = counts.groupBy("x").agg(F.sum("count").alias("d"))
    out = counts.join(rows, "x").join(rows.select(F.col("x").alias("y"), F.col("d").alias("e")), "y")
    return out.select("x", "y", "count", (F.col("count") / (F.sqrt(F.greatest("d", F.lit(1))) * F.sqrt(F.greatest("e", F.lit(1))))).alias("value"))


def adjacency(edges: DataFrame, top: int, max_pairs: int = 0, weighted: bool = True) -> DataFrame:
    """(x, y, w): each node's ``top`` neighbours by weight (0: all), ties to the smaller id.

    An edge of size s gives each of its pairs 1 / max(1, s - 1), or 1 if not ``weighted``.
    """
    w = F.lit(1.0) / F.greatest(F.col("size") - 1, F.lit(1)) if weighted else F.lit(1.0)
    pairs = edge_pairs(edges, max_pairs, "edge_id", "size")
    return strongest(pairs.groupBy("x", "y").agg(F.round(F.sum(w), 9).alias("w")), top)


def strongest(sums: DataFrame, top: int) -> DataFrame:
    """(x, y, w): of pairs (x, y, w), read both ways, each node's ``top`` of largest w (0: all), ties to the smaller id. With the pairs' support as w, this is the unweighted ``adjacency``."""
    if top <= 0:
        return both_ways(sums, "w")
    order = Window.partitionBy("x").orderBy(F.desc("w"), "y")
    return both_ways(sums, "w").withColumn("r", F.row_number().over(order)).filter(F.col("r") <= top).drop("r")


def _pack(values: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Each list of ascending numbers as bytes: its steps, seven bits a byte, the last byte of a step below 128."""
    steps = np.diff(values, prepend=0)
    starts = ends[:-1][ends[:-1] < ends[1:]]
    steps[starts] = values[starts]
    left = steps.view(np.uint64).copy()
    length = np.ones(len(left), np.int64)
    for k in range(1, 10):
        length += left >= np.uint64(1 << (7 * k))
    at = np.append(0, np.cumsum(length))
    out = np.zeros(at[-1], np.uint8)
    for k in range(10):
        more = np.flatnonzero(length > k)
        if not len(more):
            break
        out[at[more] + k] = (left[more] & np.uint64(127)) | np.where(length[more] > k + 1, np.uint64(128), np.uint64(0))
        left[more] >>= np.uint64(7)
    cuts, data = at[ends].tolist(), out.tobytes()
    return [data[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def _unpack(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of lists that lie one after the other in ``data``, and the list of each; ``starts``: where each list begins."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.append(0, last[:-1] + 1)
    shift = (np.arange(len(data)) - np.repeat(first, last - first + 1)) * 7
    steps = np.add.reduceat((data & 127).astype(np.uint64) << shift.astype(np.uint64), first).view(np.int64)
    of = np.searchsorted(starts, first, side="right") - 1
    total = np.cumsum(steps)
    opens = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    return total - np.repeat((total - steps)[opens], np.diff(np.append(opens, len(of)))), of


def packed_neighbors(near: DataFrame) -> DataFrame:
    """(x, list): the neighbours of each node in order, as bytes; a step to the next one takes one or two, a number eight."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            ends = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_pack(lists.flatten().to_numpy(zero_copy_only=False), ends), pa.binary())], ["x", "list"])

    rows = near.groupBy("x").agg(F.sort_array(F.collect_list(F.col("y").cast("long"))).alias("ys"))
    return rows.mapInArrow(pack, StructType([rows.schema["x"], StructField("list", BinaryType())]))


def gathered(held: DataFrame, near: DataFrame, key: str) -> DataFrame:
    """(key, met): for each key of ``held`` (key, x) the packed lists of its nodes' neighbours.

    A node's neighbours move as one value and are counted where they arrive, not as a row each.
    """
    return held.join(packed_neighbors(near), "x").groupBy(key).agg(F.collect_list("list").alias("met"))


#: Rows whose lists are counted at once.
COUNTED = 2048


def best_met(rows: DataFrame, own: str, pool: int, count: str) -> DataFrame:
    """A row (node_id, ``count``, place) for each of the ``pool`` nodes that most of the packed lists ``met`` hold and that are not among the ``own`` nodes, ties to the smaller id."""
    names = [c for c in rows.columns if c != "met"]

    def best(batch: pa.RecordBatch) -> pa.RecordBatch:
        mine, lists = batch.column(names.index(own)), batch.column(len(names))
        sizes = np.array([len(x) for x in lists.flatten().to_pylist()], np.int64)
        ids, of = _unpack(np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint8), np.cumsum(sizes) - sizes)
        row = np.repeat(np.arange(batch.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))[of]
        taken = mine.flatten().to_numpy(zero_copy_only=False)
        # nodes by number, so that a row and a node are one number
        nodes, number = np.unique(np.concatenate([ids, taken]), return_inverse=True)
        met, n = np.unique(row * len(nodes) + number[: len(ids)], return_counts=True)
        left = ~np.isin(met, np.repeat(np.arange(batch.num_rows), mine.value_lengths().to_numpy(zero_copy_only=False)) * len(nodes) + number[len(ids) :])
        met, n = met[left], n[left]
        row, node = np.divmod(met, max(1, len(nodes)))
        order = np.lexsort((node, -n, row))
        row, node, n = row[order], node[order], n[order]
        place = np.arange(len(row)) - np.searchsorted(row, row) + 1
        top = place <= pool
        held = [batch.column(k).take(pa.array(row[top])) for k in range(len(names))]
        return pa.RecordBatch.from_arrays([*held, pa.array(nodes[node[top]]), pa.array(n[top]), pa.array(place[top].astype(np.int32))], [*names, "node_id", count, "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, COUNTED):
                yield best(batch.slice(k, COUNTED))

    schema = StructType([rows.schema[c] for c in names] + [StructField("node_id", LongType()), StructField(count, LongType()), StructField("place", IntegerType())])
    return rows.select(*names, "met").mapInArrow(run, schema)


def replacement_pool(edges: DataFrame, top: int = 32, pool: int = 16) -> DataFrame:
    """(edge_id, node_id, anchors, place): nodes outside the edge by how many of its nodes list them among their neighbours."""
    edges = scratch.as_files(edges, "edges")
    near = adjacency(edges, top, weighted=False)
    met = gathered(edges.select("edge_id", F.explode("nodes").alias("x")), near, "edge_id")
    found = best_met(met.join(edges.select("edge_id", "nodes"), "edge_id"), "nodes", pool, "anchors")
    return found.select("edge_id", "node_id", "anchors", "place")


def _three_means(support: DataFrame, order: int) -> DataFrame:
    """Geometric, harmonic and arithmetic mean of the support of an edge's pairs or triples."""
    s = F.col("support")
    inverse = F.sum(F.when(s > 0, F.lit(1.0) / s))
    return support.groupBy("edge_id").agg(
        F.when(F.min(s) == 0, 0.0).otherwise(F.exp(F.avg(F.when(s > 0, F.log(s.cast("double")))))).alias(f"gm{order}"),
        F.when(inverse > 0, F.count(F.lit(1)) / inverse).otherwise(0.0).alias(f"hm{order}"),
        F.avg(s.cast("double")).alias(f"am{order}"),
    )


def expansion_means(edges: DataFrame, max_pairs: int = 0, max_triples: int = 0) -> DataFrame:
    """Means of pair and triple support for each edge; 0 where it has none. Bounds as in ``edge_pairs`` and ``edge_triples``."""
    two = edge_pairs(edges, max_pairs).join(pair_support(edges, max_pairs), ["x", "y"])
    three = edge_triples(edges, max_triples).join(triple_support(edges, max_triples), ["x", "y", "z"])
    out = edges.select("edge_id").join(_three_means(two, 2), "edge_id", "left").join(_three_means(three, 3), "edge_id", "left")
    return out.na.fill(0.0)


def _bits(m: Column) -> list[Column]:
    """The three of 1,024 bits that a node sets."""
    h = F.xxhash64(m)
    return [F.shiftrightunsigned(h, 10 * k).bitwiseAND(F.lit(1023)).cast("int") for k in range(3)]


def met_through(ways: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """(y, m, x, further columns): for each of ``ways`` (x, y) the nodes m that are in both ``left`` (x, m, ...) and ``right`` (y, m, ...).

    Few neighbours of x are neighbours of y. A way carries a Bloom filter of 128 bytes of y's, so that those which are not are left
    out where they are met, and only the others (one in a hundred besides the right ones) move on to be looked up.
    """
    mask = lambda k: reduce(lambda a, b: a.bitwiseOR(b), [F.when(F.shiftright(b, 6) == k, F.call_function("shiftleft", F.lit(1).cast("long"), b.bitwiseAND(F.lit(63)))).otherwise(F.lit(0).cast("long")) for b in _bits(F.col("m"))])
    words = right.groupBy("y").agg(*[F.bit_or(mask(k)).alias(f"w{k}") for k in range(16)])
    filters = words.select("y", F.array(*[f"w{k}" for k in range(16)]).alias("filter"))
    may = reduce(lambda a, b: a & b, [F.getbit(F.get("filter", F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1 for b in _bits(F.col("m"))])
    return ways.join(filters, "y").join(left, "x").filter(may).drop("filter").join(right, ["y", "m"])


def expansion_neighbors(edges: DataFrame) -> DataFrame:
    """(edge_id, cn, jc, aa): common neighbours of an edge's first and last node in the projection, Jaccard and Adamic-Adar."""
    edges = scratch.as_files(edges, "edges")
    # the rows of a node in one task, so that its degree and its filter are made where they stand
    near = scratch.materialize(two_section(edges).repartition("x"), "projection")
    degree = near.groupBy("x").agg(F.count(F.lit(1)).alias("d"))
    ends = edges.filter("size >= 2").select("edge_id", F.get("nodes", F.lit(0)).alias("a"), F.get("nodes", F.col("size") - 1).alias("b"))
    ways = ends.select(F.col("a").alias("x"), F.col("b").alias("y")).distinct()
    common = met_through(ways, near.select("x", F.col("y").alias("m")), near.select(F.col("x").alias("y"), F.col("y").alias("m")))
    common = common.join(degree.select(F.col("x").alias("m"), "d"), "m").groupBy(F.col("x").alias("a"), F.col("y").alias("b"))
    common = common.agg(F.count(F.lit(1)).alias("cn"), F.sum(F.when(F.col("d") > 1, F.lit(1.0) / F.log(F.col("d").cast("double")))).alias("aa"))
    out = ends.join(common, ["a", "b"], "left")
    out = out.join(degree.select(F.col("x").alias("a"), F.col("d").alias("da")), "a", "left").join(degree.select(F.col("x").alias("b"), F.col("d").alias("db")), "b", "left")
    out = out.na.fill(0, ["cn", "da", "db"])
    union = F.col("da") + F.col("db") - F.col("cn")
    out = out.select("edge_id", F.col("cn").cast("double").alias("cn"), F.when(union > 0, F.col("cn") / union).otherwise(0.0).alias("jc"), F.coalesce("aa", F.lit(0.0)).alias("aa"))
    return edges.select("edge_id").join(out, "edge_id", "left").na.fill(0.0)


def third_neighbors(edges: DataFrame) -> DataFrame:
    """(edge_id, cn, jc, aa) of an edge's first and last pair, where pairs are neighbours if a triple of some edge holds both.

    The neighbours of a pair are made of one of its nodes and a third one that some edge holds with both, so twice its thirds are its degree, and rows move for
    pairs and not for links of pairs. Of two pairs without a common node the four cross pairs are the common neighbours, as the edge itself holds these triples. Two pairs of an edge of three nodes
    have the pair of its outer nodes, and its middle node with each third of both. Tables grow with the edges, so all joins are by merge.
    """
    edges = scratch.as_files(edges, "edges")
    fits = edges.filter("size >= 3")
    met = edge_pairs(fits.withColumn("held", F.col("nodes")), 0, "edge_id", "held").groupBy("x", "y").agg(F.array_distinct(F.flatten(F.collect_list("held"))).alias("held"))
    thirds = scratch.materialize(met.select("x", "y", F.array_except("held", F.array("x", "y")).alias("thirds")), "thirds").withColumn("d", 2 * F.size("thirds"))
    n = lambda i: F.get("nodes", i)
    first, last = (n(F.lit(0)), n(F.lit(1))), (n(F.col("size") - 2), n(F.col("size") - 1))
    pair = lambda role, x, y: F.struct(F.lit(role).alias("role"), x.alias("x"), y.alias("y"))
    cross = F.when(F.col("size") > 3, F.array(*[pair("m", x, y) for x in first for y in last])).otherwise(F.array(pair("m", first[0], last[1])))
    asked = fits.select("edge_id", "size", F.explode(F.concat(F.array(pair("a", *first), pair("b", *last)), cross)).alias("p")).select("edge_id", "size", "p.role", "p.x", "p.y")
    found = asked.join(thirds.hint("merge"), ["x", "y"])
    weight = F.when(F.col("d") > 1, F.lit(1.0) / F.log(F.col("d").cast("double")))
    of = lambda role, c: F.max(F.when(F.col("role") == role, c))
    # thirds move for edges of three nodes alone
    ends = found.withColumn("thirds", F.when((F.col("size") == 3) & (F.col("role") != "m"), F.col("thirds"))).groupBy("edge_id").agg(
        of("a", F.col("d")).alias("da"), of("b", F.col("d")).alias("db"), F.count_if(F.col("role") == "m").alias("cn"), F.sum(F.when(F.col("role") == "m", weight)).alias("aa"),
        of("a", F.col("thirds")).alias("ta"), of("b", F.col("thirds")).alias("tb"),
    )
    both = ends.filter("ta is not null").select("edge_id", F.explode(F.array_intersect("ta", "tb")).alias("z")).hint("merge").join(fits.filter("size = 3").select("edge_id", n(F.lit(1)).alias("v")), "edge_id")
    both = both.select("edge_id", F.least("v", "z").alias("x"), F.greatest("v", "z").alias("y")).join(thirds.select("x", "y", "d").hint("merge"), ["x", "y"])
    both = both.groupBy("edge_id").agg(F.count(F.lit(1)).alias("more"), F.sum(weight).alias("aa_more"))
    out = edges.select("edge_id").join(ends.drop("ta", "tb").hint("merge"), "edge_id", "left").join(both.hint("merge"), "edge_id", "left").na.fill(0)
    cn = F.col("cn") + F.col("more")
    union = F.col("da") + F.col("db") - cn
    return out.select("edge_id", cn.cast("double").alias("cn"), F.when(union > 0, cn / union).otherwise(0.0).alias("jc"), (F.col("aa") + F.col("aa_more")).alias("aa"))


def star_share(edges: DataFrame) -> DataFrame:
    """(edge_id, is_star): whether some node of the edge is a projected neighbour of all its others."""
    near = two_section(edges)
    inc = incidence_of(edges)
    a, b = inc.select("edge_id", F.col("node_id").alias("x")), inc.select("edge_id", F.col("node_id").alias("y"))
    met = a.join(b, "edge_id").filter("x <> y").join(near, ["x", "y"], "left_semi").groupBy("edge_id", "x").agg(F.count(F.lit(1)).alias("n"))
    best = met.groupBy("edge_id").agg(F.max("n").alias("n"))
    return edges.join(best, "edge_id", "left").select("edge_id", (F.coalesce("n", F.lit(0)) >= F.col("size") - 1).alias("is_star"))


def incidence_degrees(incidence: DataFrame) -> DataFrame:
    return degrees(incidence)
