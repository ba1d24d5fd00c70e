"""Periodic runs of words, by the runs theorem: each run has a Lyndon root that is the longest Lyndon word at its start.

The longest Lyndon words under both orders of the words end before the next smaller and the next
greater value of the inverse suffix array. Each is extended to both sides as far as its period
holds, by longest common prefixes of suffixes of the text and of its reverse: minima of the LCP
array over a range, from a sparse table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, free_name, join_back, keyed, text_of, words_of

#: Least number of words of a run that is reported.
LEAST = 12
#: Words whose suffixes are sorted together.
CHUNK = 1 << 18


def _suffix_order(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, its inverse, LCP of each suffix with the one before it) of a sequence of symbols >= 0, by prefix doubling.

    Suffixes that are told apart leave the rounds, so a round costs as much as there are repeated stretches of its length.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    fresh = np.r_[True, symbols[order][1:] != symbols[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))  # the place of the first of its group
    levels, length = [rank.astype(np.int32)], 1
    while not fresh.all():
        open_ = ~fresh | ~np.r_[fresh[1:], True]
        at = np.flatnonzero(open_)
        who = order[at]
        after = who + length
        second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
        by = np.lexsort((second, rank[who]))
        who, second = who[by], second[by]
        order[at] = who
        fresh[at] |= np.r_[True, (rank[who][1:] != rank[who][:-1]) | (second[1:] != second[:-1])]
        starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank = rank.copy()
        rank[who] = starts[at]
        levels.append(rank.astype(np.int32))
        length *= 2
    inverse = np.empty(n, np.int64)
    inverse[order] = np.arange(n)
    # a common prefix is a sum of the lengths of the rounds in which both still had one rank
    lcp = np.zeros(n, np.int64)
    a, b = order[:-1].copy(), order[1:].copy()
    for k in range(len(levels) - 1, -1, -1):
        use = np.flatnonzero((a < n) & (b < n))
        use = use[levels[k][a[use]] == levels[k][b[use]]]
        a[use] += 1 << k
        b[use] += 1 << k
        lcp[use + 1] += 1 << k
    return order, inverse, lcp


class _Common:
    """Longest common prefixes of any two suffixes: range minima of the LCP array by a sparse table."""

    def __init__(self, inverse: np.ndarray, lcp: np.ndarray):
        self.inverse, self.table = inverse, [lcp.astype(np.int32)]
        while (step := 1 << (len(self.table) - 1)) * 2 <= len(lcp) and self.table[-1].any():
            last = self.table[-1]
            self.table.append(np.minimum(last[:-step], last[step:]))
        self.shape = max(map(len, self.table))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x, y = self.inverse[a], self.inverse[b]
        x, y = np.minimum(x, y) + 1, np.maximum(x, y)
        level = np.frexp((y - x + 1).astype(np.float64))[1] - 1
        out = np.zeros(len(x), np.int64)  # ranges longer than the table goes have a minimum of 0
        for k in np.unique(level):
            if k < len(self.table):
                use = np.flatnonzero(level == k)
                row = self.table[k]
                out[use] = np.minimum(row[x[use]], row[y[use] - (1 << int(k)) + 1])
        return out


def _next_beyond(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the next smaller and the next greater value of each; the length where there is none."""
    listed, n = values.tolist(), len(values)
    smaller, greater = [n] * n, [n] * n
    low: list[int] = []
    high: list[int] = []
    for i, v in enumerate(listed):
        while low and listed[low[-1]] > v:
            smaller[low.pop()] = i
        while high and listed[high[-1]] < v:
            greater[high.pop()] = i
        low.append(i)
        high.append(i)
    return np.array(smaller, np.int64), np.array(greater, np.int64)


def runs_of(sequences: list[np.ndarray], least: int = LEAST) -> list[np.ndarray]:
    """For each sequence of symbols >= 0 its runs, as rows (start, length, period) by start, then period.

    A run has at least ``least`` symbols and twice its smallest period, and no neighbour extends it. The sequences are sorted in one
    pass: symbols of different sequences differ, and one of its own ends each.
    """
    sizes = np.array([len(s) for s in sequences], np.int64)
    if not sizes.sum():
        return [np.zeros((0, 3), np.int64) for _ in sequences]
    widest = max(int(s.max()) if len(s) else 0 for s in sequences) + 2
    # 0 is the end mark, which is smaller than each symbol of its sequence
    joined = np.concatenate([np.append(s.astype(np.int64) + 1, 0) + k * widest for k, s in enumerate(sequences)])
    bounds = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = len(joined)
    owner = np.repeat(np.arange(len(sequences)), sizes + 1)
    end = bounds[owner + 1] - 1
    _, inverse, lcp = _suffix_order(joined)
    forward = _Common(inverse, lcp)
    smaller, greater = _next_beyond(inverse)
    place = np.arange(n)
    a = np.concatenate([place, place])
    b = np.concatenate([smaller, greater])
    real = (a < end[a]) & (b < np.minimum(end[a], n))  # a root that ends with the text has nothing to go on to
    a, b = a[real], b[real]
    period = b - a
    after = forward(a, b)
    _, inverse, lcp = _suffix_order(joined[::-1].copy())
    backward = _Common(inverse, lcp)
    inner = a > bounds[owner[a]]
    before = np.zeros(len(a), np.int64)
    before[inner] = backward(n - a[inner], n - b[inner])  # the words before a and before b, from right to left
    start, length = a - before, before + period + after
    use = length >= np.maximum(2 * period, least)
    rows = np.unique(np.stack([owner[a], start, period, length], axis=1)[use], axis=0)
    cuts = np.searchsorted(rows[:, 0], np.arange(len(sequences) + 1))
    out = []
    for k in range(len(sequences)):
        mine = rows[cuts[k] : cuts[k + 1]]
        out.append(np.stack([mine[:, 1] - bounds[k], mine[:, 3], mine[:, 2]], axis=1))
    return out


def may_repeat(words: np.ndarray, least: int = LEAST) -> bool:
    """Whether some stretch of half a run's least length occurs twice; without one there is no run, as a run of length n and period q repeats n - q words."""
    size = least // 2
    if len(words) < 2 * size:
        return False
    seen = words[: len(words) - size + 1].astype(np.uint64)
    for k in range(1, size):
        seen = seen * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - size + 1 + k].astype(np.uint64)
    seen.sort()
    return bool((seen[1:] == seen[:-1]).any())


def dropped_words(runs: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie in a run after its first period."""
    marks = np.zeros(n + 1, np.int64)
    np.add.at(marks, runs[:, 0] + runs[:, 2], 1)
    np.add.at(marks, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


FOUND = "f long, i long, doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _find(least: int):
    def done(held: list[tuple]) -> pa.RecordBatch:
        try_ = [k for k, (_, _, _, _, ids) in enumerate(held) if may_repeat(ids, least)]
        runs = [np.zeros((0, 3), np.int64)] * len(held)
        for k, found in zip(try_, runs_of([held[k][4] for k in try_], least) if try_ else []):
            runs[k] = found
        texts = []
        for (_, _, _, words, _), r in zip(held, runs):
            if len(r):
                keep = np.flatnonzero(~dropped_words(r, len(words))).tolist()
                words = [words[k] for k in keep]
            texts.append(b" ".join(words))
        sizes = np.cumsum([0, *map(len, runs)]).astype(np.int32)
        flat = np.concatenate(runs)
        listed = pa.ListArray.from_arrays(sizes, pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(_RUN)))
        ids = [pa.array([h[k] for h in held], pa.int64()) for k in range(3)]
        return pa.RecordBatch.from_arrays([*ids, listed, pa.array(texts, pa.binary()).cast(pa.string())], ["f", "i", "doc_id", "runs", "collapsed"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, number = [], 0, {}
        for batch in batches:
            names = zip(*(batch.column(k).to_pylist() for k in range(3)))
            for (f, i, doc_id), text in zip(names, batch.column(3)):
                words = text.as_py().split()  # of bytes: ASCII white space separates
                if size and size + len(words) > CHUNK:
                    yield done(held)
                    held, size, number = [], 0, {}
                ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
                held.append((f, i, doc_id, words, ids))
                size += len(words)
        if held:
            yield done(held)

    return run


def find_runs(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each row: __row, doc_id, runs (start, length, period in words, by start, then period), collapsed.

    ``collapsed`` is the text's words joined by one space, without those in a run after its first period.
    Words are separated by ASCII white space. Null and empty texts have no runs and an empty
    collapsed text. Very long texts are searched whole: a task holds the words of one text, or of texts of together
    ``CHUNK`` words, at about 100 bytes a word and 8 more for each doubling of its longest repeated stretch. Repeated rows give equal rows; runs of one start are
    ordered by period, which no two of them share. Null ids stay null. An empty table gives no rows; other columns are not read.
    """
    docs = scratch.as_files(docs)
    rows = keyed(docs, col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text"))
    found = rows.select("__row.f", "__row.i", "doc_id", "text").mapInArrow(_find(least), FOUND)
    return found.select(F.struct("f", "i").alias("__row"), "doc_id", "runs", "collapsed")


def collapse(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with runs cut to their first period; texts without runs stay as they are, white space included."""
    docs = scratch.as_files(docs)
    found = find_runs(docs, least, id_col, text_col).filter(F.size("runs") > 0).select("__row", "collapsed")
    rows, got = join_back(docs, found, "left")
    return rows.select(*[F.coalesce(got["collapsed"], col(c)).alias(c) if c == text_col else col(c) for c in docs.columns])


def longest(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then period; null without runs."""
    order = lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p"))
    best = F.array_min(F.transform(runs, order))
    return F.when(best.isNotNull(), F.struct(best["s"].alias("start"), (-best["l"]).alias("length"), best["p"].alias("period")))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the longest run with its exponent in thousandths, and digests of the runs and of the collapsed text."""
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest(F.col("runs")).alias("r"), F.array_join(lines, "").alias("lines"), "collapsed")
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return out.select(
        "doc_id", "n_runs", "r.start", "r.length", "r.period", F.floor(F.lit(1000) * F.col("r.length") / F.col("r.period")).alias("exponent_milli"),
        sha("lines").alias("runs_sha256"), sha("collapsed").alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with a periodic end in about a tenth of its texts, chosen, placed and sized by the CRC-32 of the id; rows of a null id stay."""
    chosen, words = free_name(docs, "__chosen"), free_name(docs, "__words")
    h = F.crc32(col(id_col).cast("string").cast("binary"))
    rows = docs.select("*", F.when(F.pmod(h, F.lit(10)) == 0, words_of(text_of(text_col))).alias(words), F.floor(h / 10).alias(chosen))
    w, g = F.col(words), F.col(chosen)
    n = F.size(w).cast("long")
    a = F.pmod(g, n)
    p = 1 + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
    repeated = F.flatten(F.array_repeat(F.slice(w, (a + 1).cast("int"), p.cast("int")), F.ceil((n - a) / p).cast("int")))
    periodic = F.concat(F.slice(w, F.lit(1), a.cast("int")), F.slice(repeated, F.lit(1), (n - a).cast("int")))
    text = F.when(F.size(w) > 0, F.array_join(periodic, " ")).otherwise(col(text_col))
    return rows.select(*[text.alias(c) if c == text_col else col(c) for c in docs.columns])


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(find_runs(planted(docs)))
