"""Language of words in code-switched text by a linear-chain conditional random field.

A word's features are its affixes and character n-grams (hashed) and its standing in a lexicon learned
for each language. Labels of neighbouring words are tied by learned transitions, and forward-backward
gives each word's label probabilities over the whole text. Training sequences are windows of words
of single-language documents, half of them spliced from two languages, so that switches are seen.

Training takes DOCS_A_LABEL documents of each of the MAX_LABELS most frequent labels, picked by a hash of
the identifier, and WINDOWS windows of WINDOW words of each, spread over the whole text: a bound that
doesn't grow with the corpus.
Prediction covers every word of every text: features are computed once per distinct word of a worker's
cache; chains are cut into stretches whose transfer matrices are multiplied, so that stretches of
many documents advance together and a very long text costs no more a word than a short one.

Defined results: a text that is null or has no letter is UNKNOWN with score 0; labels that are null
are not learned; without any label every text is UNKNOWN; rows that repeat an identifier are
predicted one by one; of equally likely labels the first in order wins; other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import released

UNKNOWN = "und"
DOCS_A_LABEL, WINDOWS, WINDOW = 500, 6, 28
MAX_LABELS = 500
BUCKET_BITS, ORDERS = 16, (2, 3, 4)
LEXICON_WORDS, LEXICON_SHARE = 4000, 0.8
STEPS, RATE, DECAY = 40, 0.25, 1e-5
#: Words that go through forward-backward together, and those a stretch has.
TOGETHER, STRETCH = 1 << 17, 32
CACHE_WORDS = 200_000
LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> list[str]:
    words = LETTERS.findall((text or "").lower())
    return words if any(c.isalpha() for w in words for c in w[:1]) or any(c.isalpha() for w in words for c in w) else []


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed n-grams of the words between marks, the first n-gram of each word, and the words' hashes.

    N-grams that take in a mark are prefixes and suffixes.
    """
    marked = "".join(f"\x02{w}\x03" for w in words)
    chars = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words)) + 2
    first = np.cumsum(length) - length
    left = np.repeat(first + length, length) - np.arange(len(chars))
    rolled, grams, owners = chars.copy(), [], []
    owner = np.repeat(np.arange(len(words)), length)
    for n in range(2, max(ORDERS) + 1):
        rolled = rolled[:-1] * np.uint64(0x9E3779B97F4A7C15) + chars[n - 1 :] * np.uint64(2 * n + 1)
        if n in ORDERS:
            at = np.flatnonzero(left[: len(rolled)] >= n)
            mixed = rolled[at]
            mixed ^= mixed >> np.uint64(29)
            grams.append(((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
            owners.append(owner[at])
    grams, owners = np.concatenate(grams), np.concatenate(owners)
    by = np.argsort(owners, kind="stable")
    begins = np.searchsorted(owners[by], np.arange(len(words)))
    place = (np.arange(len(chars)) - np.repeat(first, length)).astype(np.uint64)
    hashes = np.add.reduceat((chars + np.uint64(7)) * (place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1)) ** np.uint64(3), first)
    return grams[by], begins, hashes


@dataclass
class Crf:
    labels: list[str]
    grams: np.ndarray  # bucket x label
    lexicon: np.ndarray  # lexicon x label
    words: np.ndarray  # sorted hashes of the lexicons' words
    of: np.ndarray  # the lexicon of each
    transitions: np.ndarray
    start: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        grams, begins, hashes = word_features(words)
        return np.add.reduceat(self.grams[grams], begins) + self.lexicon[self.standing(hashes)]

    def standing(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon of each word; the last row stands for none."""
        if not len(self.words):
            return np.full(len(hashes), len(self.labels))
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.of[at], len(self.labels))


def marginals(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of every word of chains laid end to end: forward-backward in stretches."""
    k = emit.shape[1]
    stretches = -(-lengths // STRETCH)
    n = int(stretches.sum())
    first = np.cumsum(stretches) - stretches
    word_at = np.cumsum(lengths) - lengths
    slot = np.arange(len(emit)) - np.repeat(word_at, lengths) + np.repeat(first * STRETCH, lengths)
    grid = np.ones((n * STRETCH, k), np.float32)
    grid[slot] = np.exp(emit - emit.max(axis=1, keepdims=True))
    there = np.zeros(n * STRETCH, bool)
    there[slot] = True
    grid, there = grid.reshape(n, STRETCH, k), there.reshape(n, STRETCH)
    step, opening = np.exp(transitions).astype(np.float32), np.tile(np.exp(start - start.max()).astype(np.float32), (k, 1))
    begins = np.zeros(n, bool)
    begins[first] = True

    def forward(state: np.ndarray, s: int) -> np.ndarray:
        """state: stretch x rows x label, before its s-th word."""
        moved = state @ step
        if s == 0:
            moved[begins] = state[begins] @ opening
        moved *= grid[:, s, None, :]
        moved /= moved.max(axis=(1, 2), keepdims=True)
        return np.where(there[:, s, None, None], moved, state)

    transfer = np.tile(np.eye(k, dtype=np.float32), (n, 1, 1))
    for s in range(STRETCH):
        transfer = forward(transfer, s)
    before, after = np.full((n, 1, k), 1 / k, np.float32), np.ones((n, k, 1), np.float32)
    most = int(stretches.max())
    for j in range(most - 1):
        at = first[stretches > j + 1] + j
        moved = before[at] @ transfer[at]
        before[at + 1] = moved / moved.max(axis=2, keepdims=True)
        at = (first + stretches - 1)[stretches > j + 1] - j
        moved = transfer[at] @ after[at]
        after[at - 1] = moved / moved.max(axis=1, keepdims=True)
    alpha = np.empty((n, STRETCH, k), np.float32)
    for s in range(STRETCH):
        before = forward(before, s)
        alpha[:, s] = before[:, 0]
    beta = after[:, :, 0]
    for s in reversed(range(STRETCH)):
        alpha[:, s] *= beta
        moved = (beta * grid[:, s]) @ step.T
        moved /= moved.max(axis=1, keepdims=True)
        beta = np.where(there[:, s, None], moved, beta)
    gamma = alpha.reshape(-1, k)[slot]
    return gamma / gamma.sum(axis=1, keepdims=True)


# Training


def trained(windows: list[tuple[str, list[str]]], seed: int = 5) -> Crf | None:
    """windows: label and words. Maximises the likelihood of the labels by AdaGrad over the whole sample."""
    labels = sorted({label for label, words in windows if words})
    if not labels:
        return None
    number = {label: i for i, label in enumerate(labels)}
    k, rng = len(labels), np.random.default_rng(seed)
    seen = [Counter() for _ in labels]
    for label, words in windows:
        seen[number[label]].update(words)
    total = Counter()
    for c in seen:
        total.update(c)
    lexicon = {}
    for i, c in enumerate(seen):
        own = sorted((-n, w) for w, n in c.items() if n >= 3 and n >= LEXICON_SHARE * total[w])[:LEXICON_WORDS]
        lexicon |= {w: i for _, w in own}
    sequences = []
    order = rng.permutation(len(windows))
    for a, b in zip(order, np.roll(order, 1), strict=True):
        (la, wa), (lb, wb) = windows[a], windows[b]
        cut, back = (rng.integers(1, max(2, len(wa))), rng.integers(0, max(1, len(wb)))) if rng.random() < 0.5 else (len(wa), len(wb))
        words = [*wa[:cut], *wb[back:]]
        if words:
            sequences.append((words, [number[la]] * len(wa[:cut]) + [number[lb]] * len(wb[back:])))
    types = {w: i for i, w in enumerate(dict.fromkeys(w for words, _ in sequences for w in words))}
    names = [*types]
    grams, begins, hashes = word_features(names)
    model = Crf(labels, np.zeros((1 << BUCKET_BITS, k), np.float32), np.zeros((k + 1, k), np.float32), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros((k, k), np.float32), np.zeros(k, np.float32))
    if lexicon:
        listed = [*lexicon]
        listed_hashes = word_features(listed)[2]
        by = np.argsort(listed_hashes)
        model.words, model.of = listed_hashes[by], np.array([lexicon[w] for w in listed])[by]
    standing = model.standing(hashes)
    owner = np.repeat(np.arange(len(names)), np.diff(np.append(begins, len(grams))))
    token = np.array([types[w] for words, _ in sequences for w in words])
    truth = np.array([y for _, ys in sequences for y in ys])
    lengths = np.array([len(words) for words, _ in sequences])
    first = np.cumsum(lengths) - lengths
    inner = np.setdiff1d(np.arange(len(token)), first)
    true_moves = np.zeros((k, k))
    np.add.at(true_moves, (truth[inner - 1], truth[inner]), 1)
    parts = [model.grams, model.lexicon, model.transitions, model.start]
    memory = [np.full(p.shape, 1e-3, np.float32) for p in parts]
    for _ in range(STEPS):
        by_type = np.add.reduceat(model.grams[grams], begins) + model.lexicon[standing]
        emit = by_type[token]
        gamma, moves = pair_sums(emit, lengths, model.transitions, model.start)
        wrong = gamma.copy()
        wrong[np.arange(len(truth)), truth] -= 1
        type_wrong = np.stack([np.bincount(token, wrong[:, i], len(names)) for i in range(k)], axis=1)
        slopes = [
            np.stack([np.bincount(grams, type_wrong[owner, i], 1 << BUCKET_BITS) for i in range(k)], axis=1),
            np.stack([np.bincount(standing, type_wrong[:, i], k + 1) for i in range(k)], axis=1),
            moves - true_moves, wrong[first].sum(axis=0),
        ]
        for part, slope, held in zip(parts, slopes, memory, strict=True):
            slope = slope / len(lengths) + DECAY * part
            held += slope**2
            part -= (RATE * slope / np.sqrt(held)).astype(np.float32)
    return model


def pair_sums(emit: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label probabilities of every word, and the expected number of each move, of short chains padded to one length."""
    n, most, k = len(lengths), int(lengths.max()), emit.shape[1]
    there = np.arange(most) < lengths[:, None]
    grid = np.ones((n, most, k), np.float32)
    grid[there] = np.exp(emit - emit.max(axis=1, keepdims=True))
    step = np.exp(transitions).astype(np.float32)
    alpha, beta = np.empty((n, most, k), np.float32), np.ones((n, most, k), np.float32)
    state = np.exp(start - start.max()) * grid[:, 0]
    alpha[:, 0] = state = state / state.sum(axis=1, keepdims=True)
    for s in range(1, most):
        moved = (state @ step) * grid[:, s]
        state = np.where(there[:, s, None], moved / moved.sum(axis=1, keepdims=True), state)
        alpha[:, s] = state
    for s in reversed(range(most - 1)):
        moved = (beta[:, s + 1] * grid[:, s + 1]) @ step.T
        beta[:, s] = np.where(there[:, s + 1, None], moved / moved.sum(axis=1, keepdims=True), beta[:, s + 1])
    gamma = alpha * beta
    gamma /= gamma.sum(axis=2, keepdims=True)
    moves = np.zeros((k, k))
    for s in range(1, most):
        pair = alpha[:, s - 1, :, None] * step * (beta[:, s] * grid[:, s])[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        moves += pair[there[:, s]].sum(axis=0)
    return gamma[there], moves


def window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels, out = [], []
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = letter_words(text)
            n = min(WINDOWS, -(-len(words) // WINDOW))
            for j in range(n):
                at = j * max(0, len(words) - WINDOW) // max(1, n - 1)
                labels.append(label)
                out.append(words[at : at + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(labels, pa.string()), pa.array(out, pa.list_(pa.string()))], names=["label", "words"])


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", docs_a_label: int = DOCS_A_LABEL) -> Crf | None:
    """Learns from the rows where train holds. At most about docs_a_label texts of each label are read for it."""
    rows = docs.filter(train & F.col(label_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label"))
    counts = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(MAX_LABELS).collect()
    picked, draw = F.lit(False), F.pmod(F.xxhash64("id", F.lit("crf")), F.lit(1 << 30))
    for r in counts:
        picked |= (F.col("label") == r["label"]) & (draw < F.lit(int(min(1.0, docs_a_label / r["n"]) * (1 << 30))))
    windows = rows.filter(picked).select("text", "label").mapInArrow(released(window_rows), "label string, words array<string>").collect()
    return trained(sorted((r["label"], r["words"]) for r in windows))


# Prediction


class Predictor:
    def __init__(self, model: Crf | None):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.emit = np.zeros((1 << 12, len(self.model.labels) if self.model else 0), np.float32)

    def numbered(self, words: list[str]) -> np.ndarray:
        if new := [*set(words).difference(self.known)]:
            at = len(self.known)
            while at + len(new) > len(self.emit):
                self.emit = np.concatenate([self.emit, np.zeros_like(self.emit)])
            self.emit[at : at + len(new)] = self.model.emissions(new)
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def word_labels(self, text: str | None) -> list[tuple[str, str, float]]:
        """Each word of a text with its likeliest label and the probability of that."""
        words = letter_words(text)
        if not words or not self.model:
            return []
        gamma = marginals(self.emit_of(words), np.array([len(words)]), self.model.transitions, self.model.start)
        return [(w, self.model.labels[i], float(g[i])) for w, g, i in zip(words, gamma, gamma.argmax(axis=1), strict=True)]

    def emit_of(self, words: list[str]) -> np.ndarray:
        ids = self.numbered(words)
        return self.emit[ids]

    def texts(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        """The label with the largest mean probability over a text's words, and that mean."""
        held: list[list[str]] = []
        for text in texts:
            held.append(letter_words(text) if self.model else [])
            if sum(map(len, held)) >= TOGETHER:
                yield from self._judge(held)
                held = []
        if held:
            yield from self._judge(held)

    def _judge(self, held: list[list[str]]) -> Iterator[tuple[str, float]]:
        lengths = np.array([len(words) for words in held])
        full = lengths[lengths > 0]
        if len(full):
            gamma = marginals(self.emit_of([w for words in held for w in words]), full, self.model.transitions, self.model.start)
            mean = np.add.reduceat(gamma, np.cumsum(full) - full) / full[:, None]
        if len(self.known) > CACHE_WORDS:
            self.forget()
        at = 0
        for n in lengths:
            if not n:
                yield UNKNOWN, 0.0
                continue
            best = int(mean[at].argmax())
            yield self.model.labels[best], min(1.0, float(mean[at, best]))
            at += 1


def predict(docs: DataFrame, model: Crf | None, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs with the predicted label and its score; columns of these names are replaced."""
    kept = docs.drop(*names)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predictor = Predictor(shared.value)
        for batch in batches:
            found = [*predictor.texts(batch.column(batch.schema.get_field_index(text_col)).to_pylist())]
            fields = [*batch.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(fields, names=[*batch.schema.names, *names])

    return kept.mapInArrow(released(run), T.StructType([*kept.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))
