"""Hypergraphs as tables: edges(edge_id, nodes, size) and incidence(edge_id, node_id)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netweave.functions import canonical, draw, edge_key, row_normalized
from netweave.session import table


def read_edge_text(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """Edges of a text file, one a line: blank and ``#`` lines skipped, nodes canonical, edges distinct.

    A line with a part that is no integer, or with fewer than two nodes, raises when it is read.
    """
    line = F.trim("value")
    parts = F.split(line, r"\s+" if separator is None else r"\s*\Q" + separator.replace("\\E", r"\E\\E\Q") + r"\E\s*")
    nodes = canonical(F.transform(parts, lambda p: p.try_cast("bigint")))
    edge = (line != "") & ~line.startswith("#")
    rows = spark.read.text(path).filter(edge).select("value", nodes.alias("nodes"))
    bad = edge & (F.exists("nodes", lambda n: n.isNull()) | (F.size("nodes") < 2))
    rows = rows.select(F.when(bad, F.raise_error(F.concat(F.lit("bad edge line: "), "value")).cast("array<bigint>")).otherwise(F.col("nodes")).alias("nodes"))
    return rows.groupBy("nodes").agg(F.count(F.lit(1)).alias("lines")).select(edge_key(F.col("nodes")).alias("edge_id"), "nodes", F.size("nodes").alias("size"))


def baskets(spark: SparkSession, sf_dir: str, edge: str = "l_orderkey", node: str = "l_partkey") -> DataFrame:
    """Incidence of a table of pairs: by default orders as edges over their parts."""
    return table(spark, sf_dir, "lineitem").select(F.col(edge).alias("edge_id"), F.col(node).alias("node_id")).distinct()


def basket_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of ``baskets``. Gathering the nodes leaves repeated ones out, so they are not told apart before."""
    return edges_of(table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("edge_id"), F.col("l_partkey").alias("node_id")))


def edges_of(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("edge_id").agg(F.array_sort(F.collect_set("node_id")).alias("nodes")).withColumn("size", F.size("nodes"))


def incidence_of(edges: DataFrame) -> DataFrame:
    return edges.select("edge_id", F.explode("nodes").alias("node_id"))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge per node set, the smallest id, edges of one node left out."""
    return edges.filter("size >= 2").groupBy("nodes").agg(F.min("edge_id").alias("edge_id"), F.count(F.lit(1)).alias("copies")).withColumn("size", F.size("nodes"))


def violations(edges: DataFrame, num_nodes: int) -> DataFrame:
    """One row that counts the edges that break each rule: empty, repeated node, node out of range, set given twice."""
    bad = lambda c: F.count_if(c)
    sets = edges.groupBy(F.array_sort("nodes").alias("s")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("repeated_sets"))
    rules = edges.agg(
        F.count(F.lit(1)).alias("edges"),
        bad(F.size("nodes") == 0).alias("empty"),
        bad(F.size(F.array_distinct("nodes")) < F.size("nodes")).alias("repeated_nodes"),
        bad(F.exists("nodes", lambda n: (n < 0) | (n >= num_nodes))).alias("out_of_range"),
    )
    return rules.join(F.broadcast(sets))  # two tables of one row


def split_of(key: Column, seed: int) -> Column:
    return draw(seed, "split", key)


def _cuts(ids: DataFrame, places: list[int], seed: int) -> list[tuple | None]:
    """(draw, edge_id) of the edge at each of ``places`` of the seeded order of ``ids``; None behind its end.

    Counts of 65,536 ranges of draws tell in which one a place is, and only the edges of that range are ordered.
    """
    drawn = ids.select("edge_id", split_of(F.col("edge_id").cast("string"), seed).alias("__d"))
    range_ = F.shiftright("__d", 16)
    counts = sorted(tuple(r) for r in drawn.groupBy(range_.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect())
    out = []
    for place in places:
        before, at = 0, None
        for b, n in counts:
            if before + n > place:
                at = drawn.filter(range_ == b).orderBy("__d", "edge_id").offset(place - before).limit(1).collect()[0]
                break
            before += n
        out.append(None if at is None else (at["__d"], at["edge_id"]))
    return out


def _before(cut: tuple | None, key: str) -> Column:
    """Whether the draw in ``__d`` and the id in ``key`` stand before the cut."""
    return F.lit(True) if cut is None else (F.col("__d") < cut[0]) | ((F.col("__d") == cut[0]) & (F.col(key) < cut[1]))


def splitter(edges: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 1) -> Callable[..., DataFrame]:
    """A function of (rows, key) that adds split, that of ``random_split``, to rows with the id of one of ``edges`` in ``key``. Two cuts say it, so no rows move for it."""
    n = edges.count()
    cuts = _cuts(edges, [int(n * train), int(n * train) + int(n * val)], seed)

    def split(rows: DataFrame, key: str = "edge_id") -> DataFrame:
        rows = rows.withColumn("__d", split_of(F.col(key).cast("string"), seed))
        return rows.withColumn("split", F.when(_before(cuts[0], key), "train").when(_before(cuts[1], key), "val").otherwise("test")).drop("__d")

    return split


def random_split(edges: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 1) -> DataFrame:
    """Add split: edges in a seeded order, cut at floor(n * train) and floor(n * val) more (``splitter``)."""
    from netweave import scratch

    edges = scratch.as_files(edges, "edges")
    return splitter(edges, train, val, seed)(edges)


def place_of(df: DataFrame, order: list[str], out: str = "place") -> DataFrame:
    """Add the place of each row in a total order, from 0: range partitions, plus the sizes of those before."""
    from netweave import scratch

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = F.monotonically_increasing_id()
    rows = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    rows = scratch.materialize(rows.withColumn("__p", F.shiftright(at, 33)).withColumn("__a", at.bitwiseAND(F.lit((1 << 33) - 1))), "placed")
    before = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__s"))
    return rows.join(F.broadcast(starts), "__p").withColumn(out, F.col("__s") + F.col("__a")).drop("__p", "__a", "__s")


def degrees(incidence: DataFrame) -> DataFrame:
    return incidence.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))


def num_nodes(incidence: DataFrame) -> int:
    """The largest id plus one, so isolated ids count."""
    largest = incidence.agg(F.max("node_id")).first()[0]
    return 0 if largest is None else largest + 1


def communities(spark: SparkSession, nodes: int, count: int) -> DataFrame:
    return spark.range(nodes).select(F.col("id").alias("node_id"), F.pmod("id", F.lit(count)).alias("community"))


def synthetic(spark: SparkSession, nodes: int, edges: int, communities: int, low: int, high: int, inside: float, seed: int = 1) -> DataFrame:
    """Distinct edges whose nodes are mostly of one community. Draws more than asked for and keeps the first; raises if that is not enough."""
    parts = lambda s: (seed, s, F.col("id"))
    rows = spark.range(edges * 4).withColumn("size", (draw(*parts("size")) % F.lit(high - low + 1) + low).cast("int"))
    rows = rows.withColumn("home", draw(*parts("home")) % F.lit(communities))
    per = max(1, nodes // communities)

    def node(i: Column) -> Column:
        own = F.pmod(draw(seed, "own", F.col("id"), i), F.lit(per)) * communities + F.col("home")
        return F.when(uniform_(seed, "in", F.col("id"), i) < inside, own).otherwise(draw(seed, "any", F.col("id"), i) % F.lit(nodes))

    drawn = F.filter(F.transform(F.sequence(F.lit(0), F.lit(high * 8)), node), lambda n: n < nodes)
    rows = rows.withColumn("nodes", F.array_sort(F.slice(F.array_distinct(drawn), F.lit(1), F.col("size")))).filter(F.size("nodes") == F.col("size"))
    out = rows.groupBy("nodes").agg(F.min("id").alias("id")).orderBy("id").limit(edges)
    if out.count() < edges:
        raise ValueError("too few distinct edges; ask for fewer, or for larger ones")
    return out.select(F.col("id").alias("edge_id"), "nodes", F.size("nodes").alias("size"))


def uniform_(*parts) -> Column:
    return draw(*parts) / F.lit(4294967296.0)


def normalized_features(features: DataFrame) -> DataFrame:
    """(node_id, vec) with each row over its sum; rows whose sum is not above 0 stay."""
    return features.select("node_id", row_normalized(F.col("vec")).alias("vec"))


def cover_aware_split(edges: DataFrame, train: float = 0.6, val: float = 0.2, seed: int = 1) -> DataFrame:
    """Add split so that the train part covers every node where its share allows.

    Edges with a node of degree one go to train. Then a greedy cover: the edge with most uncovered nodes, then
    smallest size and id, is taken until all nodes are covered. The rest is filled by a seeded order.

    Edges that are the best choice of each uncovered node they hold are taken together, as no other choice changes theirs. An edge of fewer
    uncovered nodes is never before one of more, so bands are worked off from above, each down to half the nodes of the last one: an edge
    moves only in the rounds of its band, with its uncovered nodes alone.
    """
    from netweave import scratch

    edges = scratch.as_files(edges, "edges")
    n = edges.count()
    room = int(n * train)
    single = edges.select("edge_id", F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"), F.min("edge_id").alias("edge_id"))
    single = scratch.materialize(single.filter("degree = 1").select("edge_id").distinct(), "taken")
    count = single.count()
    if count > room:
        raise ValueError("edges with a node of their own are more than the train share")
    taken, covered = single, None
    if count:
        covered = scratch.materialize(edges.join(single, "edge_id", "left_semi").select(F.explode("nodes").alias("node_id")).distinct(), "covered")
    held = F.size("nodes")
    waiting = [edges.select("edge_id", "size", "nodes")]
    low, high = None, (edges.agg(F.max(held)).first()[0] or 0) + 1
    while high > 1:
        low = high // 2
        now, fresh, below = None, covered is None, []
        for w in waiting:
            rows = w.filter((held >= low) & (held < high))
            now = rows if now is None else now.unionByName(rows)
        while True:
            if not fresh:  # leave out what is covered by now
                now = now.select("edge_id", "size", F.explode("nodes").alias("node_id")).join(covered, "node_id", "left_anti")
                now = scratch.materialize(now.groupBy("edge_id").agg(F.first("size").alias("size"), F.collect_list("node_id").alias("nodes")), "open")
                below.append(now.filter(held < low))
                now = now.filter(held >= low)
            rank = F.struct((-held).alias("g"), F.col("size").alias("s"), F.col("edge_id").alias("e"))
            best = now.select(rank.alias("r"), F.explode("nodes").alias("node_id")).groupBy("node_id").agg(F.min("r").alias("b"))
            votes = best.groupBy("b").agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") == -F.col("b.g")).select(F.col("b.e").alias("edge_id"))
            new = scratch.materialize(now.join(votes, "edge_id", "left_semi").select("edge_id", "nodes"), "taken")
            more = new.count()
            if not more:  # a round over any edges takes one at least
                break
            count += more
            if count > room:
                raise ValueError("the train share has too few edges to cover all nodes")
            taken = taken.unionByName(new.select("edge_id"))
            nodes = new.select(F.explode("nodes").alias("node_id"))
            covered, fresh = nodes if covered is None else covered.unionByName(nodes), False
        waiting, high = waiting + below, low
    ids = edges.select("edge_id").join(taken, "edge_id", "left_anti")
    cuts = _cuts(scratch.materialize(ids, "rest"), [room - count, room - count + int(n * val)], seed)
    order = edges.join(taken.withColumn("__t", F.lit(True)), "edge_id", "left").withColumn("__d", split_of(F.col("edge_id").cast("string"), seed))
    split = F.when(F.col("__t") | _before(cuts[0], "edge_id"), "train").when(_before(cuts[1], "edge_id"), "val").otherwise("test")
    return order.withColumn("split", split).drop("__t", "__d")


def ordered_digest(rows: DataFrame, order: list[str], line: Column, by: str | None = None, block: int = 4096) -> DataFrame:
    """(by, digest), or (digest) of one row: SHA-256 of the lines of each group in order, over a tree of blocks.

    Blocks of ``block`` lines are digested first, then blocks of so many digests, until one is left; so no task sees more than a block, and the order of rows counts.
    """
    group = ["__by"]
    keyed = rows.select(F.lit(0).alias("__by") if by is None else F.col(by).alias("__by"), *order, line.alias("__line"))
    at = place_of(keyed, ["__by", *order], "__place")
    starts = at.groupBy(*group).agg(F.min("__place").alias("__start"), F.count(F.lit(1)).alias("__n"))
    most = starts.agg(F.max("__n")).first()[0] or 0
    now = at.join(F.broadcast(starts), "__by").select("__by", (F.col("__place") - F.col("__start")).alias("k"), F.col("__line").alias("s"))  # a row for each group
    joined = F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "s"))), lambda x: x["s"]), "").cast("binary"), 256)
    while True:
        now = now.groupBy("__by", F.floor(F.col("k") / block).alias("k")).agg(joined.alias("s"))
        most = -(-most // block)
        if most <= block:
            break
    out = now.groupBy("__by").agg(joined.alias("digest"))
    return out.select("digest") if by is None else out.select(F.col("__by").alias(by), "digest")


def sequence_digest(edges: DataFrame, block: int = 4096) -> DataFrame:
    """SHA-256 of the edges in order of id (``ordered_digest``); each is written as its size, a colon, its nodes and a semicolon."""
    line = F.concat(F.col("size").cast("string"), F.lit(":"), edge_key(F.col("nodes")), F.lit(";"))
    return ordered_digest(edges, ["edge_id"], line, block=block)
