"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | context) = P(class | context) * P(word | class). The class softmax has hashed features of
the context: the word before, those two and three before (skips), and the pair before. Within its
class a word has its share of the training counts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave import scratch
from netweave.llm.common import col, keyed, text_of

#: Base smoothing, and the one entry that stands for all unseen words.
ADD = 0.1
#: The end of a text as a word; no other word is empty.
END = b""
SUFFIXES = 4096
BLOCK = 256
FEATURES = 4


def tokens(text: str) -> list[bytes]:
    """The words of a text with A-Z in lower case; the end is not among them."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def is_held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 10 == 0


def word_counts(docs: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(word, label, n): counts over whole texts, the end of each text included. Summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["word", "label", "n"]

        def flush(counts):
            rows = [(w, k, n) for k, c in counts.items() for w, n in c.items()]
            w, k, n = zip(*rows) if rows else ((), (), ())
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(k, pa.string()), pa.array(n, pa.int64())], names)

        counts: dict[str, Counter] = {}
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                c = counts.setdefault(label, Counter())
                c.update(tokens(text))
                c[END] += 1
            if sum(map(len, counts.values())) > 400_000:
                yield flush(counts)
        yield flush(counts)

    rows = docs.select(text_of(text_col).alias("text"), F.coalesce(col(label_col).cast("string"), F.lit("")).alias("label"))
    rows = rows.mapInArrow(run, "word binary, label string, n long")
    return rows.groupBy("word", "label").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The frequent words with their classes, and the totals of all words. Its size is bounded by ``top``."""

    index: dict[bytes, int]
    classes: np.ndarray
    counts: np.ndarray
    class_counts: np.ndarray
    n_tokens: int
    n_words: int
    rare_tokens: int
    rare_words: int

    @property
    def rare_class(self) -> int:
        return len(self.class_counts) - 2

    @property
    def end_class(self) -> int:
        return len(self.class_counts) - 1

    def prior(self) -> np.ndarray:
        p = self.class_counts + ADD
        return (p / p.sum()).astype(np.float64)


def vocabulary(words: DataFrame, top: int, labels: int = 8, bands: int = 4) -> Vocabulary:
    """Classes of the ``top`` most frequent words that were seen twice: the label a word is seen most under, and
    one of ``bands`` ranges of its frequency there, of equal mass. All other words are the rare class; the end is one of its own."""
    total = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.max(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("e")).first()
    best = words.filter((F.col("n") >= 2) & (F.col("word") != F.lit(END))).orderBy(F.col("n").desc(), "word").limit(top).toPandas()
    mass = best.groupby("label")["n"].sum().sort_values(ascending=False, kind="stable")
    labels = max(1, min(labels, len(mass)))  # no classes for labels that are not there
    order = {k: min(i, labels - 1) for i, k in enumerate(mass.index)}
    group = best["label"].map(order).to_numpy(np.int64) if len(best) else np.zeros(0, np.int64)
    counts = best["n"].to_numpy(np.float64)
    band = np.zeros(len(best), np.int64)
    for g in range(labels):
        at = np.flatnonzero(group == g)
        if len(at):
            below = np.cumsum(counts[at]) - counts[at]
            band[at] = np.minimum((below / counts[at].sum() * bands).astype(np.int64), bands - 1)
    classes = group * bands + band
    n_classes = labels * bands + 2
    by_class = np.zeros(n_classes)
    by_class[: labels * bands] = np.bincount(classes, counts, labels * bands)
    ends = int(total["e"] or 0)
    n = int(total["n"] or 0)
    by_class[-2], by_class[-1] = n - ends - counts.sum(), ends
    v = int(total["v"] or 0)
    rare = v - len(best) - (ends > 0)
    return Vocabulary({bytes(w): i for i, w in enumerate(best["word"])}, classes, counts, by_class, n, v, int(by_class[-2]), rare)


class Encoder:
    """Texts as arrays: the class, the word and the feature rows of each token."""

    def __init__(self, vocab: Vocabulary, bits: int):
        self.vocab, self.bits = vocab, bits
        self.top = len(vocab.index)
        self.class_of = np.concatenate([vocab.classes, np.full(SUFFIXES, vocab.rare_class), [vocab.end_class] * 2]).astype(np.int64)

    def rows_of(self, before: list[np.ndarray]) -> np.ndarray:
        """Feature rows (tokens x FEATURES) for the ids one, two and three places before."""
        one, two, three = (b.astype(np.uint64) for b in before)
        parts = (one + np.uint64(1 << 40), two + np.uint64(2 << 40), three + np.uint64(3 << 40), (one << np.uint64(20)) + two + np.uint64(4 << 50))
        out = np.empty((len(one), FEATURES), np.int64)
        for k, x in enumerate(parts):
            x = x * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
            out[:, k] = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - self.bits)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[Counter]]:
        """Of all tokens of the texts: text number, id, feature rows; and each text's rare words.

        Ids: a frequent word's place, then by suffix for rare words, then the end and the start.
        """
        get = self.vocab.index.get
        end, start = self.top + SUFFIXES, self.top + SUFFIXES + 1
        flat: list[int] = []
        doc: list[np.ndarray] = []
        rare: list[Counter] = []
        for k, text in enumerate(texts):
            words = tokens(text)
            ids = [get(w, -1) for w in words]
            unknown: Counter = Counter()
            if -1 in ids:
                for i, x in enumerate(ids):
                    if x < 0:
                        w = words[i]
                        unknown[w] += 1
                        ids[i] = self.top + zlib.crc32(w[-2:]) % SUFFIXES
            rare.append(unknown)
            flat += (start, start, start, *ids, end)
            doc.append(np.full(len(ids) + 4, k))
        ids = np.array(flat, np.int64)
        at = np.flatnonzero(ids != start)
        return np.concatenate(doc)[at], ids[at], self.rows_of([ids[at - 1], ids[at - 2], ids[at - 3]]), rare


def log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def _logits(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = weights[rows[:, 0]] + bias
    for k in range(1, FEATURES):
        out += weights[rows[:, k]]
    return out


_memory: dict[int, np.ndarray] = {}


def _kept(rows: int, width: int) -> np.ndarray:
    """An uninitialised array that calls of this process share."""
    if width not in _memory or len(_memory[width]) < rows:
        _memory[width] = np.empty((rows, width), np.float32)
    return _memory[width][:rows]


def learn(weights: np.ndarray, bias: np.ndarray, squares: np.ndarray, seen: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """One gradient step on a minibatch, with a step size per feature row by its squared gradients so far."""
    g = np.exp(log_softmax(_logits(weights, bias, rows)))
    g[np.arange(len(g)), classes] -= 1
    flat = rows.ravel()
    # rows of 16 bits are sorted by digits, which is faster
    order = np.argsort(flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat, kind="stable")
    flat = flat[order]
    starts = np.flatnonzero(np.concatenate([[True], flat[1:] != flat[:-1]]))
    # into memory that is kept: new pages for each step cost more than the sums
    spread = np.take(g, order // FEATURES, axis=0, out=_kept(len(flat), g.shape[1]), mode="clip")
    sums = np.add.reduceat(spread, starts, axis=0)
    at = flat[starts]
    squares[at] += (sums * sums).mean(axis=1)
    seen[at] += np.diff(np.concatenate([starts, [len(flat)]]))
    weights[at] -= rate * sums / np.sqrt(squares[at] + 1e-6)[:, None]


def train(docs: DataFrame, vocab: Vocabulary, bits: int = 16, rate: float = 0.25, rounds: int = 1, batch: int = 16384, text_col: str = "text") -> np.ndarray:
    """Feature weights (2**bits x classes), by rounds of parameter mixing.

    In a round every task starts from the round's weights, takes gradient steps over all its
    texts, and returns the rows it has changed in blocks, each weighted by how often its features
    were seen. Blocks are summed in two steps, over subsets of tasks and over these, so that no
    task reads more than its share. The weights are of fixed size whatever the input.
    """
    spark = docs.sparkSession
    n_classes = len(vocab.class_counts)
    bias = np.log(vocab.prior()).astype(np.float32)
    weights = np.zeros((1 << bits, n_classes), np.float32)
    source = docs.select(text_of(text_col).alias("text"))
    shared_vocab = spark.sparkContext.broadcast(vocab)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            encoder = Encoder(shared_vocab.value, bits)
            w = shared.value.copy()
            squares, seen = np.full(len(w), 1.0, np.float32), np.zeros(len(w), np.float32)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            n = 0

            def steps():
                rows, classes = (np.concatenate(x) for x in zip(*held))
                for at in range(0, len(rows), batch):
                    learn(w, bias, squares, seen, rows[at : at + batch], classes[at : at + batch], rate)
                held.clear()

            for b in batches:
                for at in range(0, b.num_rows, 64):
                    _, ids, rows, _ = encoder.encode(b.column(0).slice(at, 64).to_pylist())
                    held.append((rows, encoder.class_of[ids]))
                    n += len(ids)
                    if n >= 4 * batch:
                        steps()
                        n = 0
            if held:
                steps()
            part = TaskContext.get().partitionId()
            for k in range(0, len(w), BLOCK):
                if seen[k : k + BLOCK].any():
                    s = seen[k : k + BLOCK]
                    yield pa.RecordBatch.from_pylist([{"block": k // BLOCK, "part": part % 64, "w": (w[k : k + BLOCK]).astype(np.float16).tobytes(), "n": s.tobytes()}])

        def total(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            n = np.zeros(BLOCK)
            w = np.zeros((BLOCK, n_classes))
            for x, y, kind in zip(pdf["w"], pdf["n"], pdf["kind"]):
                s = np.frombuffer(y, np.float32)
                n += s
                w += s[:, None] * np.frombuffer(x, np.float16 if kind == 0 else np.float32).reshape(BLOCK, n_classes)
            mean = w / np.maximum(n, 1)[:, None]
            return pd.DataFrame({"block": [key[0]], "w": [mean.astype(np.float32).tobytes()], "n": [n.astype(np.float32).tobytes()], "kind": [1]})

        blocks = source.mapInArrow(run, "block long, part long, w binary, n binary").withColumn("kind", F.lit(0).cast("long"))
        some = blocks.groupBy("block", "part").applyInPandas(total, "block long, w binary, n binary, kind long")
        merged = some.groupBy("block").applyInPandas(total, "block long, w binary, n binary, kind long").select("block", "w").collect()
        for row in merged:
            weights[row["block"] * BLOCK : (row["block"] + 1) * BLOCK] = np.frombuffer(row["w"], np.float32).reshape(BLOCK, n_classes)
    return weights


PARTIAL = "f long, i long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, rare array<struct<word: binary, n: long>>"


def score(docs: DataFrame, words: DataFrame, vocab: Vocabulary, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Score whole texts: the frequent words in the tasks; rare words, whose table is not bounded, by a join with all counts."""
    spark = docs.sparkSession
    bits = int(np.log2(len(weights)))
    shared = spark.sparkContext.broadcast((vocab, weights))
    denominator = vocab.n_tokens + ADD * (vocab.n_words + 1)
    rare_denominator = vocab.rare_tokens + ADD * (vocab.rare_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, weights = shared.value
        encoder = Encoder(vocab, bits)
        bias = np.log(vocab.prior()).astype(np.float32)
        end = encoder.top + SUFFIXES
        ends = vocab.class_counts[vocab.end_class]
        zeros = np.zeros(SUFFIXES)
        base = np.concatenate([np.log10((vocab.counts + ADD) / denominator), zeros, [np.log10((ends + ADD) / denominator), 0]])
        inside = np.concatenate([np.log10(vocab.counts / vocab.class_counts[vocab.classes]), zeros, [0, 0]])
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(4).to_pylist()
                doc, ids, rows, rare = encoder.encode(texts)
                classes = encoder.class_of[ids]
                logp = np.empty(len(ids))
                for k in range(0, len(ids), 32768):
                    p = log_softmax(_logits(weights, bias, rows[k : k + 32768]))
                    logp[k : k + 32768] = p[np.arange(len(p)), classes[k : k + 32768]]
                sums = lambda x: np.bincount(doc, x, len(texts))
                known = sums((ids < encoder.top) | ((ids == end) & (ends > 0))).astype(np.int64)
                lists = pa.array([[{"word": w, "n": n} for w, n in c.items()] for c in rare], pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())])))
                columns = [*part.columns[:4], pa.array(np.bincount(doc, minlength=len(texts))), pa.array(known), pa.array(sums(base[ids])), pa.array(sums(logp / np.log(10) + inside[ids])), lists]
                yield pa.RecordBatch.from_arrays(columns, ["f", "i", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare"])

    rows = keyed(docs, col(id_col).cast("long").alias("doc_id"), is_held_out(col(id_col)).alias("held_out"), text_of(text_col).alias("text")).select("__row.f", "__row.i", "doc_id", "held_out", "text")
    partial = scratch.materialize(rows.mapInArrow(run, PARTIAL), "partial_scores")
    rare = partial.select("f", "i", F.explode("rare").alias("r")).select("f", "i", "r.word", F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = rare.join(words.select("word", "n"), "word", "left").select(
        "f",
        "i",
        F.when(c > 0, F.col("times")).otherwise(0).alias("n_known"),
        (F.log10((c + ADD) / denominator) * F.col("times")).alias("base_score"),
        (F.log10((c + ADD) / rare_denominator) * F.col("times")).alias("score"),
    )
    rare = rare.groupBy("f", "i").agg(*[F.sum(x).alias(x) for x in ("n_known", "base_score", "score")])
    rare = rare.select(F.col("f").alias("__f"), F.col("i").alias("__i"), F.col("n_known").alias("__n"), F.col("base_score").alias("__b"), F.col("score").alias("__s"))
    out = partial.drop("rare").join(rare, (F.col("f") == F.col("__f")) & (F.col("i") == F.col("__i")), "left")
    plus = lambda a, b: (F.col(a) + F.coalesce(b, F.lit(0))).alias(a)
    return out.select(
        F.struct("f", "i").alias("__row"), "doc_id", "held_out", "n_tokens", plus("n_known", "__n"), F.lit(vocab.n_tokens).cast("long").alias("train_tokens"), plus("base_score", "__b"), plus("score", "__s")
    )


def score_documents(docs: DataFrame, top: int = 200_000, bits: int = 16, rounds: int = 1, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """Train on the documents that are not held out and score all: __row, doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null text is empty and has the end as its only token. A null id counts as empty text for the
    fold. If nothing is left to train on, every token is unseen and the scores are those of the
    smoothing alone. Repeated rows are trained on and scored as often as they come. Very long
    texts are scored whole, in batches of tokens. An empty table gives no rows.

    Classes: at most 8 labels have their own, and ``top`` words in all; the rest share one of each label. Tasks train alone
    and their weights are averaged, so ``score`` depends on how the input is split into tasks.
    """
    docs = scratch.as_files(docs)
    training = docs.filter(~is_held_out(col(id_col)))
    by_label = scratch.materialize(word_counts(training, text_col, label_col), "word_counts")
    words = by_label.groupBy("word").agg(F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("b")).select("word", "n", F.col("b.label").alias("label"))
    words = scratch.materialize(words, "words")
    vocab = vocabulary(words, top)
    weights = train(training, vocab, bits, rounds=rounds, text_col=text_col)
    return score(docs, words, vocab, weights, id_col, text_col)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("__row")
