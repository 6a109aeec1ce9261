"""Scoring texts with a log-bilinear neural language model.

The model predicts a vector from the embeddings of the CONTEXT words before a token, by one learned
matrix for each place, and scores every output by its dot product with the output's embedding plus a
bias. It is trained in numpy by noise-contrastive estimation against the unigram distribution, on every
token of every training text: each task takes a pass over its texts from common parameters, and the
parameters are averaged, weighted by tokens, in ROUNDS rounds, of which the first sees one document
in FIRST_ROUND so as to place the parameters.

Inputs are the INPUTS most frequent words and, for all other words, SHAPES classes by their last
letters. Outputs are the OUTPUTS most frequent words, one by one, and the classes; a word of a class
has the share (count + 1) / (class count + class words + 1) in it, so that the probabilities of all
words, known or not, sum to one. Scoring normalises over all outputs by batched matrix products.

Counts are over all training texts. The HEAD most frequent words are a table of fixed size
and are broadcast; all other words are joined with their counts by Spark, so memory doesn't grow with
the vocabulary.

Defined results: null counts as empty; a text without words is its end alone; rows that repeat an
identifier are scored as one text each; without training texts every count is 0 and all
probabilities come from the empty counts; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import scratch, written

CONTEXT, WIDTH = 2, 16
INPUTS, OUTPUTS, SHAPES = 4000, 160, 96
HEAD = 100_000
NOISE, BATCH, RATE, ROUNDS, FIRST_ROUND = 48, 4096, 0.15, 2, 8
#: Distinct words of a task that are counted or listed together.
COUNTED = 300_000
TOKENS_TOGETHER = 1 << 11
END = b""


def tokens_of(text: bytes | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased, in UTF-8, and the end."""
    return [*(text or b"").lower().split(), END]


def shape(word: bytes) -> int:
    """The class of a word outside the most frequent: by its last three bytes."""
    return zlib.crc32(word[-3:]) % SHAPES


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and their counts, in parts of COUNTED distinct words."""
    counts: Counter = Counter()

    def part() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([*counts.keys()], pa.binary()), pa.array([*counts.values()], pa.int64())], names=["word", "c"])

    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            for text in batch.column(0).slice(at, 200).cast(pa.binary()).to_pylist():
                counts.update(tokens_of(text))
            if len(counts) > COUNTED:
                yield part()
                counts.clear()
    if counts:
        yield part()


@dataclass
class Vocabulary:
    """What is broadcast of the counts: a head of fixed size and a few totals."""

    head: dict[bytes, tuple[int, int, int]]  # word: input, output, count
    total: int
    distinct: int
    outputs: int  # single words among the outputs
    inputs: int
    class_total: np.ndarray
    class_words: np.ndarray
    noise: np.ndarray = field(default_factory=lambda: np.zeros(0))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Totals by class of word, and the head. counts: word, c, rank by class."""
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # The least count that HEAD words reach or exceed at most.
    least, words = 1, 0
    for r in counts.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c")).limit(HEAD).collect():
        if words + r["k"] > HEAD:
            least = r["c"] + 1
            break
        words += r["k"]
    rows = sorted(((-r["c"], bytes(r["word"])) for r in counts.filter(F.col("c") >= least).collect()))
    n_out, n_in = min(OUTPUTS, len(rows)), min(INPUTS, len(rows))
    head = {}
    class_total, class_words = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
    for k, (minus, word) in enumerate(rows):
        s = shape(word)
        head[word] = (k if k < n_in else n_in + s, k if k < n_out else n_out + s, -minus)
        if k >= n_out:
            class_total[s] -= minus
            class_words[s] += 1
    tail = counts.filter(F.col("c") < least).select((F.crc32(F.substring("word", -3, 3)) % SHAPES).alias("s"), "c")
    for r in tail.groupBy("s").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("k")).collect():
        class_total[r["s"]] += r["c"]
        class_words[r["s"]] += r["k"]
    noise = np.concatenate([[-minus for minus, _ in rows[:n_out]], class_total]) + 1.0
    return Vocabulary(head, totals[0], totals[1], n_out, n_in, class_total, class_words, noise / noise.sum())


@dataclass
class Parameters:
    inputs: np.ndarray  # input x WIDTH; the last row stands before a text
    moves: np.ndarray  # CONTEXT x WIDTH x WIDTH
    outputs: np.ndarray
    bias: np.ndarray

    @staticmethod
    def fresh(v: Vocabulary) -> Parameters:
        rng = np.random.default_rng(3)
        small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
        moves = np.stack([np.eye(WIDTH, dtype=np.float32) * 0.7 for _ in range(CONTEXT)])
        return Parameters(small(v.inputs + SHAPES + 1, WIDTH), moves, small(v.outputs + SHAPES, WIDTH), np.log(v.noise).astype(np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in (self.inputs, self.moves, self.outputs, self.bias)])

    def filled(self, flat: np.ndarray) -> Parameters:
        out, at = [], 0
        for x in (self.inputs, self.moves, self.outputs, self.bias):
            out.append(flat[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return Parameters(*out)


class Shapes(dict):
    """Classes by ending."""

    def __missing__(self, ending: bytes) -> int:
        self[ending] = found = zlib.crc32(ending) % SHAPES
        return found


class Ids(dict):
    """Numbers of the head's words; all other words have the number of their class behind them. Only the head is kept."""

    def __init__(self, head: dict[bytes, tuple[int, int, int]]):
        super().__init__(zip(head, range(len(head)), strict=True))
        self.n, self.shapes = len(head), Shapes()

    def __missing__(self, word: bytes) -> int:
        return self.n + self.shapes[word[-3:]]


class Reader:
    """Turns texts into inputs, outputs and counts."""

    def __init__(self, v: Vocabulary):
        self.ids = Ids(v.head)
        classes = [(v.inputs + s, v.outputs + s, -1) for s in range(SHAPES)]
        self.places = np.array([*v.head.values(), *classes], np.int64)

    @staticmethod
    def of(v: Vocabulary) -> Reader:
        """One for all tasks that a worker runs with the same vocabulary."""
        if not hasattr(v, "reader"):
            v.reader = Reader(v)
        return v.reader

    def read(self, texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All tokens, the place of each (input, output, count; -1 outside the head), and the texts' lengths."""
        words = [tokens_of(t) for t in texts]
        lengths = np.array([len(ws) for ws in words])
        flat = [*chain.from_iterable(words)]
        return flat, self.places[np.fromiter(map(self.ids.__getitem__, flat), np.int64, len(flat))], lengths


def contexts(inputs: np.ndarray, lengths: np.ndarray, before: int) -> np.ndarray:
    """The CONTEXT inputs before each token; `before` stands ahead of each text."""
    out = np.empty((CONTEXT, len(inputs)), np.int64)
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(inputs)) - np.repeat(first, lengths)
    for k in range(CONTEXT):
        shifted = np.full(len(inputs), before)
        shifted[k + 1 :] = inputs[: len(inputs) - k - 1]
        out[k] = np.where(place > k, shifted, before)
    return out


def trained_on(p: Parameters, v: Vocabulary, ctx: np.ndarray, target: np.ndarray, rng: np.random.Generator, memory: list[np.ndarray], noise_cdf: np.ndarray) -> None:
    """One AdaGrad step of noise-contrastive estimation per BATCH tokens; the noise of a batch is shared."""
    log_noise = np.log(v.noise * NOISE).astype(np.float32)
    for at in range(0, len(target), BATCH):
        c, y = ctx[:, at : at + BATCH], target[at : at + BATCH]
        drawn = np.searchsorted(noise_cdf, rng.random(NOISE)).clip(0, len(v.noise) - 1)
        seen = [p.inputs[c[k]] for k in range(CONTEXT)]
        r = sum(seen[k] @ p.moves[k] for k in range(CONTEXT))
        true = (r * p.outputs[y]).sum(axis=1) + p.bias[y] - log_noise[y]
        false = r @ p.outputs[drawn].T + p.bias[drawn] - log_noise[drawn]
        g_true = 1 / (1 + np.exp(-true.clip(-30, 30))) - 1
        g_false = 1 / (1 + np.exp(-false.clip(-30, 30)))
        slope_r = g_true[:, None] * p.outputs[y] + g_false @ p.outputs[drawn]
        n = len(y)
        slope_out = sums(y, g_true[:, None] * r, len(p.bias))
        np.add.at(slope_out, drawn, g_false.T @ r)
        slope_bias = np.bincount(y, g_true, len(p.bias))
        np.add.at(slope_bias, drawn, g_false.sum(axis=0))
        slope_in = sum(sums(c[k], slope_r @ p.moves[k].T, len(p.inputs)) for k in range(CONTEXT))
        slope_moves = np.stack([seen[k].T @ slope_r for k in range(CONTEXT)])
        for part, slope, held in zip((p.inputs, p.moves, p.outputs, p.bias), (slope_in, slope_moves, slope_out, slope_bias), memory, strict=True):
            slope = (slope / np.sqrt(n)).astype(np.float32)
            held += slope * slope
            part -= RATE * slope / np.sqrt(held)


def sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """rows summed by index."""
    by = np.argsort(index, kind="stable")
    ordered = index[by]
    first = np.flatnonzero(np.diff(ordered, prepend=-1))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(rows[by], first)
    return out


def trainer(shared, seed: int):
    """Rows of parameters and the tokens that they were trained on, one set from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        v, flat = shared.value
        p = Parameters.fresh(v).filled(flat)
        memory = [np.full(x.shape, 1.0, np.float32) for x in (p.inputs, p.moves, p.outputs, p.bias)]
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        reader, cdf, tokens = Reader.of(v), np.cumsum(v.noise), 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                _, places, lengths = reader.read(batch.column(0).slice(at, 64).cast(pa.binary()).to_pylist())
                order = rng.permutation(len(places))
                ctx = contexts(places[:, 0], lengths, len(p.inputs) - 1)
                trained_on(p, v, ctx[:, order], places[order, 1], rng, memory, cdf)
                tokens += len(places)
        if tokens:
            out = p.flat()
            cuts = np.arange(0, len(out), 1024)
            parts = [out[c : c + 1024].astype(np.float64) * tokens for c in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(parts))), pa.array(parts, pa.list_(pa.float64())), pa.array([tokens] * len(parts), pa.int64())], names=["part", "values", "tokens"])

    return run


def averaged(rows: DataFrame, like: np.ndarray) -> np.ndarray:
    """Weighted mean of the tasks' parameters, summed by Spark; what comes back has the size of one set."""
    each = rows.select("part", "tokens", F.posexplode("values").alias("at", "value"))
    sums_ = each.groupBy("part", "at").agg((F.sum("value") / F.sum("tokens")).alias("mean"))
    flat = like.astype(np.float64).copy()
    for r in sums_.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("at", "mean"))).alias("m")).collect():
        flat[r["part"] * 1024 : r["part"] * 1024 + len(r["m"])] = [x["mean"] for x in r["m"]]
    return flat


@dataclass
class Model:
    vocabulary: Vocabulary
    parameters: Parameters
    counts: DataFrame


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts all rows where train holds, and trains on all of their tokens."""
    spark = docs.sparkSession
    path = scratch(spark, "lbl")
    rows = docs.filter(train).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    texts = rows.select("text")
    partial = texts.mapInArrow(counted, "word binary, c long")
    counts = written(partial.groupBy("word").agg(F.sum("c").alias("c")), f"{path}/counts")
    v = vocabulary(counts)
    p = Parameters.fresh(v)
    flat = p.flat().astype(np.float64)
    some = F.pmod(F.xxhash64("id", F.lit("round")), F.lit(FIRST_ROUND)) == 0
    for k in range(ROUNDS):
        shared = spark.sparkContext.broadcast((v, flat))
        seen = (rows.filter(some) if k == 0 and ROUNDS > 1 else rows).select("text")
        parts = written(seen.mapInArrow(trainer(shared, k), "part long, values array<double>, tokens long"), f"{path}/round{k}")
        flat = averaged(parts, flat)
        shared.unpersist()
    return Model(v, p.filled(flat), counts)


SCORED = "row long, id long, n_tokens long, n_known long, base double, score double, tail array<binary>"


def scorer(shared):
    """By text: tokens, known tokens and sums over the head, the model's class part, and the words outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, p = shared.value
        reader = Reader.of(v)
        log_class = np.log10(v.class_total + v.class_words + 1.0)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                some = batch.slice(at, 128)
                flat, places, lengths = reader.read(some.column(2).cast(pa.binary()).to_pylist())
                first = np.cumsum(lengths) - lengths
                count = places[:, 2]
                known = count >= 0
                log_count = np.log10(np.maximum(count, 0) + 1.0)
                in_class = places[:, 1] >= v.outputs
                got = log_probabilities(p, contexts(places[:, 0], lengths, len(p.inputs) - 1), places[:, 1])
                # A class shares its probability among its words by their counts; those of the tail are added later.
                got += np.where(in_class, log_count * known - log_class[np.where(in_class, places[:, 1] - v.outputs, 0)], 0)
                out = np.flatnonzero(~known)
                tails = pa.ListArray.from_arrays(pa.array(np.searchsorted(out, np.append(first, len(flat))), pa.int32()), pa.array([flat[i] for i in out.tolist()], pa.binary()))
                add = lambda x: np.add.reduceat(x, first)
                columns = [some.column(0), some.column(1), pa.array(lengths), pa.array(add(known.astype(np.int64))), pa.array(add(log_count * known)), pa.array(add(got)), tails]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCORED.split(", ")])

    return run


def log_probabilities(p: Parameters, ctx: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log10 of the probability of each token's output, normalised over all outputs."""
    moved = [p.inputs @ p.moves[k] for k in range(CONTEXT)]
    reach, top = float(np.sqrt((p.outputs**2).sum(axis=1).max())), float(p.bias.max())
    # One product gives the scores less a bound of the largest, so that no exponential overflows.
    wide = np.concatenate([p.outputs, p.bias[:, None], np.ones((len(p.bias), 1), np.float32)], axis=1).T.copy()
    ones, out = np.ones(len(p.bias), np.float32), np.empty(len(target))
    for at in range(0, len(target), TOKENS_TOGETHER):
        block = slice(at, at + TOKENS_TOGETHER)
        r = moved[0][ctx[0, block]]
        for k in range(1, CONTEXT):
            r += moved[k][ctx[k, block]]
        y = target[block]
        bound = np.sqrt(np.einsum("ij,ij->i", r, r)) * reach + top
        scores = np.concatenate([r, np.ones((len(r), 1), np.float32), -bound[:, None]], axis=1) @ wide
        np.exp(scores, out=scores)
        total = (scores @ ones).astype(np.float64)
        for i in np.flatnonzero(total < 1e-25):  # the bound was far above all scores
            total[i] = np.exp((r[i].astype(np.float64) @ p.outputs.T + p.bias) - bound[i]).sum()
        out[block] = np.einsum("ij,ij->i", r, p.outputs[y]) + p.bias[y] - bound - np.log(total)
    return out / np.log(10)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """By row of docs: id, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    v = model.vocabulary
    shared = spark.sparkContext.broadcast((v, model.parameters))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    path = scratch(spark, "scores")
    scored = written(rows.mapInArrow(scorer(shared), SCORED), path)
    tail = scored.select("row", F.explode("tail").alias("word"))
    found = tail.join(model.counts, "word", "left").groupBy("row").agg(
        F.sum(F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0))).alias("more"), F.count("c").alias("known"))
    joined = scored.drop("tail").join(found, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    below = float(np.log10(v.total + v.distinct + 1.0))
    return joined.select(
        F.col("id").alias(id_col), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(int(v.total)).cast("long").alias("train_tokens"),
        (F.col("base") + more - F.col("n_tokens") * below).alias("base_score"), (F.col("score") + more).alias("score"))
