"""Packing documents into token sequences: best fit, then a swap-based local search."""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, text_of

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _byte_letters() -> list[str]:
    """The letter by which byte-level BPE writes each byte: printable Latin-1 as itself, the others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


#: Letters of Latin-1 that lower to one such letter, then ASCII marks: the tokenizer splits between the two.
PLAIN = r"^(?P<core>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-/:-@\[-`{-~]*)$"


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` one after another."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(lengths.sum())]


class WordEncoder:
    """Token ids of whole texts.

    The tokenizer drops white space and splits words at it, so a text's ids are those of its words
    in turn. Each distinct word of a call is looked up once. Words of Latin-1 letters with ASCII
    marks behind them are looked up as two: the letters, lower-cased, are one piece for the
    tokenizer's model, and the marks are another. Any other word takes the whole tokenizer. What has
    been looked up is kept for later calls, up to ``entries`` parts; results do not depend on it.
    """

    def __init__(self, path: str, entries: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = dict(enumerate(_byte_letters()))
        self.entries = entries
        self.place: dict[str, int] = {}
        self.ids, self.lengths = array("I"), array("q")

    def _learn(self, parts: list[str]) -> None:
        """Append the ids of parts that are not known yet."""
        tokenize, others = self.model.tokenize, []
        found: dict[str, list[int]] = {}
        for part in parts:
            if not part.isalpha() or max(part) > "\xff" or "\xaa" in part or "\xb5" in part or "\xba" in part:
                others.append(part)
                continue
            piece = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            found[part] = [t.id for t in tokenize(piece)]
        for part, e in zip(others, self.tokenizer.encode_batch_fast(others, add_special_tokens=False)):
            found[part] = e.ids
        for part, ids in found.items():
            self.place[part] = len(self.lengths)
            self.ids.extend(ids)
            self.lengths.append(len(ids))

    def _rows(self, parts: pa.Array) -> np.ndarray:
        """The place of each part in the table, new ones learnt."""
        coded = parts.dictionary_encode()
        names = coded.dictionary.to_pylist()
        if new := [x for x in names if x not in self.place]:
            self._learn(new)
        return np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))[coded.indices.to_numpy()]

    def flat(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in turn, and where each text begins and the last ends."""
        known = len(self.lengths), len(self.ids)
        spaced = pc.replace_substring(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), "\t", " ")
        lists = pc.split_pattern(spaced, " ")
        words = lists.flatten().dictionary_encode()
        names = words.dictionary
        split = pc.extract_regex(names, PLAIN)
        plain = split.is_valid()
        core = self._rows(pc.if_else(plain, pc.utf8_lower(pc.struct_field(split, "core")), names))
        marks = self._rows(pc.if_else(plain, pc.struct_field(split, "marks"), ""))
        ids, lengths = np.array(self.ids, np.uint32), np.array(self.lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        both = np.column_stack([core, marks]).ravel()
        word_ids = gather(ids, starts[both], lengths[both])
        sizes = lengths[core] + lengths[marks]
        at = words.indices.to_numpy()
        bounds = np.concatenate([[0], np.cumsum(sizes[at])])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        if len(self.lengths) > self.entries:  # the table is full: what is new served this call only
            self.place = dict(islice(self.place.items(), known[0]))
            del self.lengths[known[0] :], self.ids[known[1] :]
        return gather(word_ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), bounds

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit bytes."""
        ids, bounds = self.flat(pa.array(texts, pa.string()))
        return [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]


def _chunks(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``most`` bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def tokenize(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, chunk_bytes: int = 4 << 20
) -> DataFrame:
    """Cut each document's ids, closed by ``end_id``, into pieces of at most ``capacity``.

    ``tokenizer`` is a path on the executors, by default the public word BPE of 49k entries. Null
    text counts as empty and gives one piece with the end id alone. Texts are taken whole, in runs of about
    ``chunk_bytes``; a longer text is a run of its own, so the longest bounds the memory. With
    ``with_ids`` the pieces carry their ids.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encoder = WordEncoder(tokenizer or public_tokenizers.path("word_bpe_49k.json"))
        for batch in batches:
            for lo, hi in _chunks(batch.column(1), chunk_bytes):
                docs_, texts = batch.column(0).slice(lo, hi - lo), batch.column(1).slice(lo, hi - lo)
                own, bounds = encoder.flat(texts)
                begins = bounds + np.arange(len(bounds))
                ids = np.empty(begins[-1], "<u4")
                ends = begins[1:] - 1
                inside = np.ones(len(ids), bool)
                inside[ends] = False
                ids[inside], ids[ends] = own, end_id
                n = -(-np.diff(begins) // capacity)
                doc = np.repeat(np.arange(len(n)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                a = begins[:-1][doc] + start
                length = np.minimum(begins[1:][doc] - a, capacity)
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(a.tolist(), (a + length).tolist())]
                columns = [docs_.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crcs, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(a, len(ids)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return docs.select(col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).mapInArrow(run, schema)


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Best fit, longest first: bins as lists of places in ``lengths``."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r is set if a bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
            bins[b].append(i)
        else:
            room, b = capacity, len(bins)
            bins.append([i])
        left = room - size
        by_room[left].append(b)
        rooms |= 1 << left
    return bins


def local_search(bins: list[list[int]], lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Empty bins by exchanges that raise the sum of squared fills.

    The emptiest bin gives: each exchange between it and a fuller bin with room moves a document,
    swaps one for one, two for one or one for two so that the fuller bin gains most. The sum of
    squares rises with each, so it ends. It stops when no fewer bins are possible, or when every bin
    with room has been tried in vain since the last one was emptied.
    """
    size = lengths.tolist()
    bins = [list(b) for b in bins]
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // capacity)
    choices: dict[int, tuple] = {}
    alive = {b for b in range(len(bins)) if bins[b]}
    untried = {b for b in alive if fill[b] < capacity}
    room = sum(capacity - fill[b] for b in alive)
    while len(alive) > least and untried:
        giver = min(untried, key=lambda b: (fill[b], b))
        if room - (capacity - fill[giver]) < fill[giver]:
            break  # nor is there room for any fuller bin
        others = sorted((b for b in alive if b != giver and fill[giver] <= fill[b] < capacity), key=lambda b: (-fill[b], b))
        untried.remove(giver)
        if _empty(giver, others, bins, fill, size, capacity, choices):
            alive.remove(giver)
            room -= capacity
            untried = set(alive)
        untried = {b for b in untried if bins[b] and fill[b] < capacity}
    return [bins[b] for b in sorted(alive)]


def _empty(giver: int, others: list[int], bins: list[list[int]], fill: list[int], size: list[int], capacity: int, choices: dict[int, tuple]) -> bool:
    """Exchange from ``giver`` into the others, fullest first and as often as each gains, until it is empty or no exchange is left."""
    while bins[giver] and others:
        for k in (giver, *others):
            if k not in choices:
                choices[k] = _choices(bins[k], size)
        move = _first_exchange(choices[giver], [choices[b] for b in others], np.array([capacity - fill[b] for b in others]))
        if move is None:
            return False
        at, gain, out, back = move
        b, others = others[at], others[at:]
        bins[giver] = [i for i in bins[giver] if i not in out] + list(back)
        bins[b] = [i for i in bins[b] if i not in back] + list(out)
        fill[b] += gain
        fill[giver] -= gain
        del choices[giver], choices[b]
        if fill[b] == capacity:
            others = others[1:]
    return not bins[giver]


def _choices(ids: list[int], size: list[int]) -> tuple:
    """Sums in ascending order and what makes them: of one document of each length, and of two of each pair of lengths.

    Documents of one length are alike here, and lengths that differ sum to the capacity at most, so there are few.
    """
    of: dict[int, list[int]] = {}
    for i in ids:
        of.setdefault(size[i], []).append(i)
    kinds = sorted(of)
    ones = [(n, (of[n][0],)) for n in kinds]
    twos = [(n + m, (of[n][0], of[m][0])) for k, n in enumerate(kinds) for m in kinds[k + 1 :]] + [(2 * n, tuple(x[:2])) for n, x in of.items() if len(x) > 1]
    twos.sort()
    sums = lambda c: np.array([n for n, _ in c], np.int64)
    return ones, sums(ones), twos, sums(twos)


def _first_exchange(give: tuple, takes: list[tuple], rooms: np.ndarray) -> tuple[int, int, tuple, tuple] | None:
    """The first of the other bins that gains by an exchange: its place, its largest gain, above 0 and at most its room, what goes there and what comes back."""
    found: list[tuple] = []
    ones, twos = [t[1] for t in takes], [t[3] for t in takes]
    nothing = [np.zeros(1, np.int64)] * len(takes)
    for kind, ((outs, a), backs) in enumerate(((give[:2], nothing), (give[:2], ones), (give[2:], ones), (give[:2], twos))):
        counts = np.array([len(b) for b in backs])
        if not outs or not counts.any():
            continue
        owner = np.repeat(np.arange(len(backs)), counts)
        b = np.concatenate(backs)
        at = np.searchsorted(a, b + rooms[owner], "right") - 1  # for each that may come back, the most that may go out
        gain = np.where(at >= 0, a[at] - b, 0)
        gains = np.flatnonzero(gain > 0)
        if len(gains):
            first = owner[gains[0]]
            mine = gains[owner[gains] == first]
            k = int(mine[gain[mine].argmax()])
            back = () if kind == 0 else takes[first][2 if kind == 3 else 0][k - int(counts[:first].sum())][1]
            found.append((int(first), -int(gain[k]), kind, outs[at[k]][1], back))
    if not found:
        return None
    first, gain, _, out, back = min(found, key=lambda x: x[:3])
    return first, -gain, out, back


PACKED = PIECES + ", sequence_id long, offset long"


def _pack_round(pieces: DataFrame, groups: int, capacity: int, tag: int) -> DataFrame:
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "piece", "ids_crc32", "length"], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        for n, ids in enumerate(local_search(best_fit(lengths, capacity), lengths, capacity)):
            sequence[ids] = (tag << 58) | (int(key[0]) << 24) | n
            offset[ids] = np.concatenate([[0], np.cumsum(lengths[ids])[:-1]])
        return pdf.assign(sequence_id=sequence, offset=offset).drop(columns="g")

    # the place in the file is part of it, so rows that share an id do not share a group
    g = F.pmod(F.xxhash64("__row.i", "doc_id", "piece", "start", F.lit(tag)), F.lit(groups))
    # as many partitions as there may be groups: adaptive execution would put them into one task, as their bytes are few
    parts = min(groups, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return scratch.with_row_key(pieces).withColumn("g", g).drop("__row").repartition(parts, "g").groupBy("g").applyInPandas(run, PACKED)


def pack(pieces: DataFrame, capacity: int = 2048, group: int = 4096) -> DataFrame:
    """Put pieces into sequences of at most ``capacity``: adds sequence_id and offset.

    Pieces are dealt by hash into groups of about ``group``, whatever the number of rows, and each
    group is packed by itself. A group's sequences are full but for a few; the pieces of
    sequences with room left are dealt again and packed once more, and again as long as that
    saves sequences and they are too many for one group.
    """
    pieces = scratch.as_files(pieces.select(*[c.split()[0] for c in PIECES.split(", ")]))
    n = pieces.count()
    packed = scratch.materialize(_pack_round(pieces, max(1, -(-n // group)), capacity, 0), "packed")
    done, round_ = None, 0
    while True:
        fills = packed.groupBy("sequence_id").agg(F.sum("length").alias("fill"), F.count(F.lit(1)).alias("n")).filter("fill < %d" % capacity)
        loose_ids = scratch.materialize(fills, "loose")
        before, m = loose_ids.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        ids = loose_ids.select("sequence_id")
        full = packed.join(ids, "sequence_id", "left_anti").select(*packed.columns)
        done = full if done is None else done.unionByName(full)
        loose = scratch.materialize(packed.join(ids, "sequence_id", "left_semi").drop("sequence_id", "offset"), "loose_pieces")
        round_ += 1
        packed = scratch.materialize(_pack_round(loose, max(1, -(-m // group)), capacity, round_), "packed")
        if m <= group or packed.agg(F.countDistinct("sequence_id")).first()[0] >= before:
            return done.unionByName(packed.select(*done.columns))


def assemble(pieces_with_ids: DataFrame, packed: DataFrame) -> DataFrame:
    """The sequences themselves: (sequence_id, ids), from pieces that carry their ids; ids of documents must be unique."""
    rows = pieces_with_ids.select("doc_id", "piece", "ids").join(packed.select("doc_id", "piece", "sequence_id", "offset"), ["doc_id", "piece"])
    rows = rows.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    return rows.select("sequence_id", F.flatten(F.col("p.ids")).alias("ids"))


def pack_documents(docs: DataFrame, capacity: int = 2048, group: int = 4096, **options) -> DataFrame:
    """Tokenize and pack: PIECES plus sequence_id and offset (gapless from 0 in each sequence).

    A repeated row is packed as often as it comes. A null id stays null. Texts of more than
    ``capacity`` ids become several pieces, whatever their length. Of pieces of equal length any may
    come first: which one is decided by id, piece and digest, so reruns agree. Further columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    return pack(scratch.materialize(tokenize(docs, capacity=capacity, **options), "pieces"), capacity, group)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
