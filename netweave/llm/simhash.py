"""SimHash near-duplicates: pigeonring chains of segments propose, the Hamming distance decides.

A fingerprint is a ring of segments. If two differ in at most ``threshold`` bits, there is a segment from which
every chain of l consecutive segments differs in at most l * threshold / segments bits. The segments at the
start of such a chain are equal, so they are the key that brings candidates together; the rest
of the chain is tested on the candidates, and the whole distance on what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, join_back, keyed, text_of
from netweave.llm.components import components

BITS, SEGMENTS, THRESHOLD = 64, 16, 2
SHINGLE, SEED = 3, 42


def text_fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text: bit k is 1 if it is 1 in over half the hashes of the shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z alone are lowered, and ASCII white space alone separates
    if not words:
        return 0
    joined = b" ".join(words)
    size = min(size, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = [0, *(ends[: len(words) - size] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins, ends[size - 1 :].tolist())), np.uint64, len(begins))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((text_fingerprint(t.as_py()) for t in batch.column(3)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found.view(np.int64))], ["f", "i", "doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(f, i, doc_id, fp): the fingerprint of each row's whole text, as a signed long. Null counts as empty, and a text without words has 0."""
    rows = keyed(docs, col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    return rows.select("__row.f", "__row.i", "doc_id", "text").mapInArrow(_fingerprints, "f long, i long, doc_id long, fp long")


def chain_budgets(threshold: int, segments: int = SEGMENTS, bits: int = BITS) -> list[tuple[int, int]]:
    """(leading bits, differing bits allowed there) of chains of consecutive segments; only the longest chain of each budget is listed."""
    width = bits // segments
    quota = [n * threshold // segments for n in range(1, segments + 2)]
    return [(n * width, quota[n - 1]) for n in range(1, segments + 1) if n == segments or quota[n] > quota[n - 1]]


def _rotated(fp: Column, by: int) -> Column:
    return F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by)) if by else fp


def _turn(values: np.ndarray, left: np.ndarray) -> np.ndarray:
    left = left.astype(np.uint64) % np.uint64(BITS)
    return (values << left) | (values >> ((np.uint64(BITS) - left) % np.uint64(BITS)))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n members the least member it hangs together with by the links a - b."""
    label = np.arange(n)
    while len(a):
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            break
        label = new
    return label


def chain_links(unit: np.ndarray, values: np.ndarray, budgets: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """All links (a, b) between places of one unit; equal units stand together. The chains are tested before the whole distance."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    place = np.arange(len(unit))
    for lag in range(1, len(unit)):
        place = place[place + lag < len(unit)]
        place = place[unit[place] == unit[place + lag]]
        if not len(place):
            break
        near = place
        for bits, allowed in budgets:
            near = near[np.bitwise_count((values[near] ^ values[near + lag]) >> np.uint64(BITS - bits)) <= allowed]
        a.append(near)
        b.append(near + lag)
    return np.concatenate(a), np.concatenate(b)


def midpoint_links(values: np.ndarray, free: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that span the graph of distinct values which differ in at most two of the ``free`` low bits.

    Two values are that close if and only if they are both within one bit of some value; each value
    is listed with its neighbours, and the members of one neighbour are linked in a row. So n values cost n * (free + 1).
    """
    near = np.concatenate([values, *(values ^ np.uint64(1 << k) for k in range(free))])
    owner = np.tile(np.arange(len(values)), free + 1)
    order = np.argsort(near, kind="stable")
    near, owner = near[order], owner[order]
    same = np.flatnonzero(near[1:] == near[:-1])
    return owner[same], owner[same + 1]


def _spanned(budgets: list[tuple[int, int]], bucket: int):
    """(a, b): fingerprints of a unit and the least place of their component there. Units are rows (unit, turn, value) that stand together."""

    def linked(unit: np.ndarray, turn: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(unit)) + 1
        begins, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(unit)]])
        large = (ends - begins > bucket) & (budgets[-1][1] <= 2)
        small = ~np.repeat(large, ends - begins)
        at = np.flatnonzero(small)
        a, b = chain_links(unit[at], value[at], budgets)
        found = [(at[a], at[b])]
        for x, y in zip(begins[large], ends[large]):
            a, b = midpoint_links(value[x:y], BITS - budgets[0][0])
            found.append((a + x, b + x))
        a, b = (np.concatenate([f[k] for f in found]) for k in (0, 1))
        root = _roots(len(unit), a, b)
        use = np.flatnonzero(root != np.arange(len(unit)))
        fp = _turn(value, BITS - turn).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(fp[use]), pa.array(fp[root[use]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy()]) for k, h in enumerate(held)]
            last = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
            if last:  # the last unit may go on in the next batch
                yield linked(held[0][:last], held[1][:last], held[2][:last].view(np.uint64))
                held = [h[last:] for h in held]
        if len(held[0]):
            yield linked(held[0], held[1], held[2].view(np.uint64))

    return run


def links(fps: DataFrame, threshold: int = THRESHOLD, bucket: int = 256) -> DataFrame:
    """(a, b): pairs of distinct fingerprints (column fp) at ``threshold`` or fewer differing bits that span the components of all such pairs.

    Each fingerprint is listed once for each start of a chain, under the segments there that must be equal (for 2
    bits in 16 segments: 7 segments, 28 bits). A key with more than ``bucket`` fingerprints is split further:
    on the next segments of the chain the budget is one bit, so one half of these is equal too and joins the key, once for
    each half. No pair is lost by it. What may still come together in a unit differs in the few bits outside (20 of 64) and in one task
    costs no more than those bits times its size; links are returned as spanning trees, not as pairs.
    """
    if not 0 < threshold < SEGMENTS:
        raise ValueError(f"a threshold of 1 to {SEGMENTS - 1} bits, not {threshold}")
    budgets = chain_budgets(threshold)
    width = BITS // SEGMENTS
    exact = budgets[0][0] if budgets[0][1] == 0 else 0
    if not exact:
        raise ValueError("no segment must be equal")
    turns = F.array(*[F.struct(F.lit(k * width).cast("long").alias("turn"), _rotated(F.col("fp"), k * width).alias("value")) for k in range(SEGMENTS)])
    places = fps.select(F.explode(turns).alias("t")).select(F.xxhash64("t.turn", F.shiftrightunsigned("t.value", BITS - exact)).alias("key"), "t.turn", "t.value")
    counts = places.groupBy(F.col("key").alias("__k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = places.join(counts, F.col("key") == F.col("__k")).drop("__k")
    # the part of the chain with a budget of one bit, in two halves
    until = budgets[1][0]
    middle = (exact + until) // 2
    part = lambda a, b: F.shiftrightunsigned(F.shiftleft("value", a), BITS - (b - a))
    halves = F.array(F.struct(F.lit(1).alias("h"), part(exact, middle).alias("v")), F.struct(F.lit(2).alias("h"), part(middle, until).alias("v")))
    whole = F.array(F.struct(F.lit(0).alias("h"), F.lit(0).cast("long").alias("v")))
    met = met.select("key", "turn", "value", F.explode(F.when(F.col("n") > bucket, halves).otherwise(whole)).alias("p"))
    units = met.select(F.when(F.col("p.h") == 0, F.col("key")).otherwise(F.xxhash64("key", "p.h", "p.v")).alias("unit"), "turn", "value")
    units = units.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "unit").sortWithinPartitions("unit")
    return units.mapInArrow(_spanned(budgets, bucket), "a long, b long")


def near_duplicates(docs: DataFrame, threshold: int = THRESHOLD, bucket: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: __row, doc_id, fingerprint (16 hexadecimal digits), component_id (smallest id reachable by links).

    Null and empty texts, and texts of white space, have fingerprint 0 and are linked like any other. A text of
    one or two words has a single shingle. Very long texts are read whole. Null ids take part; a component of null ids
    alone has a null component_id. Repeated rows and equal texts have equal fingerprints and are compared once.
    Ties cannot occur: a bit set in exactly half the hashes is 0. An empty table gives no rows; other columns are not read.
    """
    rows = scratch.materialize(fingerprints(scratch.as_files(docs), id_col, text_col), "fingerprints")
    fps = scratch.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    classes = components(links(fps.select("fp"), threshold, bucket))
    classed = fps.join(classes, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = classed.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component_id"))
    classed = scratch.materialize(classed.join(named, F.col("root") == F.col("__root")).select(F.col("fp").alias("__fp"), "root", "component_id"), "classes")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(classed, F.col("fp") == F.col("__fp")).select(F.struct("f", "i").alias("__row"), "doc_id", digits, "component_id", "root")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id (null last), then the first in its file."""
    docs = scratch.as_files(docs)
    found = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("__row").alias("r"))
    first = found.groupBy("root").agg(F.min(order).alias("best")).select(F.col("best.r").alias("__row"))
    rows, _ = join_back(docs, first, "left_semi")
    return rows.select(*[col(c) for c in docs.columns])


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "fingerprint", "component_id")
