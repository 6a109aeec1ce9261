"""Benchmark decontamination by the CGK random-walk embedding and bit sampling.

A text is a sequence of word hashes. The embedding walks along a window: at each step it puts out the
word it stands on and moves on if a bit of that word, another for each step, is set. Walks over windows
at a small edit distance fall into step again after an edit, so the walks differ in few places. A
table samples ARITY places of the walk that lie close together, as places agree together where the
walks are in step, and the tables lie one behind the other along the walk. A window of a document that
agrees with a window of an item in any table is a candidate, is compared in all places of the walk,
and is verified by the exact edit distance, in words, between the item and the best stretch of the
document near it.

Windows begin at every word of every document, and in every item at every STRIDE-th word. A walk goes on
to the item's end, or for LONGEST words, so a window is as long as what it is compared with: tables are
the same for all lengths, and an item uses those whose places its walk reaches. Items of few words are
sampled in fewer places. Chosen such that of items with MAX_EDITS of their words put in, left out or
changed 0.9 or more are found, whatever their length (tests measure it).

Items are held in blocks of ITEMS_A_BLOCK items or WORDS_A_BLOCK words, each block taking a pass over the
documents, so that memory doesn't grow with the benchmark. No rows are shuffled.

Defined results: texts and items without words, or null, match nothing; rows that repeat an identifier,
or have none, are searched one by one; items with equal words are all reported; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import released

WORDS = re.compile(r"[^\W_]+")
#: Words that a walk covers at most, steps between tables, places by length of item, and words between an item's windows.
LONGEST, APART, SEED = 24, 2, 11
ARITY = ((5, 1), (9, 2), (1 << 30, 3))
STRIDE = 1
#: Part of an item's words that may be edited, and places of the walk that agree at least before the edit distance is taken.
MAX_EDITS, LEAST_AGREE = 0.25, 0.15
ITEMS_A_BLOCK, WORDS_A_BLOCK = 5000, 500_000
WINDOWS_TOGETHER = 1 << 16
CACHE_WORDS = 200_000
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def tables(arity: int) -> list[list[int]]:
    """Steps of the walk that each table samples: arity places, two to four steps apart."""
    rng = np.random.default_rng(SEED + arity)
    out = [np.cumsum([first, *rng.integers(2, 5, arity - 1)]).tolist() for first in range(0, 2 * LONGEST, APART)]
    return [steps for steps in out if steps[-1] < 2 * LONGEST]


def walk(sym: np.ndarray, starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Place and word of each step of the walks from starts."""
    at = starts.copy()
    for step in range(2 * LONGEST):
        word = sym[at]
        yield at, word
        at = at + ((word >> np.uint32(step & 31)) & np.uint32(1)).astype(at.dtype)


def keys(words: list[np.ndarray]) -> np.ndarray:
    """One number of the sampled words."""
    key = words[0] * MIX[0]
    for word, mix in zip(words[1:], MIX[1:], strict=False):
        key += word * mix
    return key ^ (key >> np.uint32(15))


def edit_search(item: list[int], stretch: list[int]) -> tuple[int, int]:
    """Least edit distance between item and any part of stretch, and where that part ends (bit-parallel)."""
    m = len(item)
    masks: dict[int, int] = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(stretch, 1):
        eq = masks.get(w, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(xh | plus) & full, plus & xh
        score += bool(up & top) - bool(down & top)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | ~(xv | up) & full, up & xv
        if score < best[0]:
            best = (score, j)
    return best


class Items:
    """A block of benchmark items, keyed for lookups."""

    def __init__(self, rows: list[tuple[int, str | None]], max_edits: float = MAX_EDITS):
        self.max_edits = max_edits
        self.ids, self.words = [], []
        for item, text in rows:
            if words := [*hashed(words_of(text))]:
                self.ids.append(item)
                self.words.append(words)
        pad = [0] * (2 * LONGEST + 1)
        self.sym = np.array([x for words in self.words for x in (*words, *pad)], np.uint32)
        length = np.array([len(words) for words in self.words], np.int64)
        first = np.cumsum(length + len(pad)) - length - len(pad)
        windows = [(n, at) for n, words in enumerate(self.words) for at in range(0, len(words), STRIDE)]
        self.windows = np.array(windows, np.int64).reshape(-1, 2)
        self.starts = first[self.windows[:, 0]] + self.windows[:, 1]
        arity = np.array([next(a for most, a in ARITY if n <= most) for n in length.tolist()], np.int64)[self.windows[:, 0]]
        steps = [*walk(self.sym, self.starts)]
        #: (steps, 16 leading bits of keys that occur, keys in order, their windows)
        self.tables: list[tuple[list[int], np.ndarray, np.ndarray, np.ndarray]] = []
        for a in sorted(set(arity.tolist())):
            for places in tables(a):
                # Places of different words, all inside the item.
                fit = (arity == a) & (steps[places[-1]][1] != 0)
                for p, q in zip(places, places[1:], strict=False):
                    fit &= steps[p][0] < steps[q][0]
                fit = np.flatnonzero(fit)
                if len(fit):
                    key = keys([steps[p][1][fit] for p in places])
                    seen = np.zeros(1 << 16, bool)
                    seen[key >> np.uint32(16)] = True
                    by = np.argsort(key, kind="stable")
                    self.tables.append((places, seen, key[by], fit[by]))

    def candidates(self, sym: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Distinct (place in sym, window) that agree in a table and in LEAST_AGREE of the item's places."""
        pairs, held, due = [], {}, {}
        for table in self.tables:
            due.setdefault(table[0][-1], []).append(table)
        last = max(due, default=-1)
        for step, (_, word) in enumerate(walk(sym, starts)):
            held[step] = word
            held.pop(step - 12, None)
            for places, seen, ordered, window in due.get(step, ()):
                key = keys([held[p] for p in places])
                hit = np.flatnonzero(seen[key >> np.uint32(16)])
                lo, hi = np.searchsorted(ordered, key[hit], "left"), np.searchsorted(ordered, key[hit], "right")
                n = hi - lo
                if n.any():
                    at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    pairs.append(np.repeat(starts[hit], n) * len(self.starts) + window[at])
            if step == last:
                break
        if not pairs:
            return np.zeros((0, 2), np.int64)
        pairs = np.unique(np.concatenate(pairs))
        found = []
        for block in np.array_split(pairs, max(1, len(pairs) >> 14)):
            start, window = np.divmod(block, len(self.starts))
            inside, agree = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
            for (_, ours), (_, theirs) in zip(walk(sym, start), walk(self.sym, self.starts[window]), strict=True):
                inside += theirs != 0
                agree += (theirs != 0) & (ours == theirs)
            right = agree >= LEAST_AGREE * inside
            found.append(np.stack([start[right], window[right]], axis=1))
        return np.concatenate(found)


_known: dict[str, int] = {}


def hashed(words: list[str]) -> Iterator[int]:
    """32-bit hashes, never 0, kept for frequent words."""
    if len(_known) > CACHE_WORDS:
        _known.clear()
    for w in set(words).difference(_known):
        _known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass")) * 0x85EBCA6B % 0xFFFFFFFB + 1 & 0xFFFFFFFF or 1
    return map(_known.__getitem__, words)


def found_in(items: Items, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
    """(number of the text, item, edits, first word near which it begins) for every item within reach, once per text."""
    held, n_held = [], 0
    for number, text in enumerate(texts):
        words = words_of(text)
        if words:
            held.append((number, np.fromiter(hashed(words), np.uint32, len(words))))
            n_held += len(words)
        if n_held >= WINDOWS_TOGETHER:
            yield from _searched(items, held)
            held, n_held = [], 0
    if held:
        yield from _searched(items, held)


def _searched(items: Items, held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[int, int, int, int]]:
    pad = np.zeros(2 * LONGEST + 1, np.uint32)
    sym = np.concatenate([x for _, words in held for x in (words, pad)])
    length = np.array([len(words) for _, words in held])
    first = np.cumsum(length + len(pad)) - length - len(pad)
    starts = np.concatenate([np.arange(f, f + n) for f, n in zip(first, length, strict=True)])
    best: dict[tuple[int, int], tuple[int, int]] = {}
    tried = set()
    for block in np.array_split(starts, max(1, len(starts) // WINDOWS_TOGETHER)):
        found = items.candidates(sym, block)
        docs = np.searchsorted(first, found[:, 0], "right") - 1
        for doc, place, (n, at) in zip(docs.tolist(), found[:, 0].tolist(), items.windows[found[:, 1]].tolist(), strict=True):
            size = len(items.words[n])
            slack = int(size * items.max_edits) + 1
            start = place - at  # may lie before the text: what is left of the item then counts as edits
            near = (doc, n, (start - int(first[doc])) // slack)
            if near in tried or best.get((doc, n), (1, 0))[0] == 0:
                continue
            tried.add(near)
            lo = max(int(first[doc]), start - 2 * slack)
            hi = min(int(first[doc] + length[doc]), start + size + 2 * slack)
            edits, _ = edit_search(items.words[n], sym[lo:hi].tolist())
            if edits <= size * items.max_edits and edits < best.get((doc, n), (size + 1, 0))[0]:
                best[doc, n] = (edits, max(0, start - int(first[doc])))
    for (doc, n), (edits, at) in best.items():
        yield held[doc][0], items.ids[n], edits, at


FOUND = "item_id long, edits int, near_word long"


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, max_edits: float) -> Iterator:
    """The benchmark in blocks of ITEMS_A_BLOCK items or WORDS_A_BLOCK words, one at a time on the driver."""
    held, words = [], 0
    for r in benchmark.select(F.col(item_col).cast("long"), F.col(text_col)).toLocalIterator():
        held.append((r[0], r[1]))
        words += (r[1] or "").count(" ") + 1
        if len(held) == ITEMS_A_BLOCK or words >= WORDS_A_BLOCK:
            yield Items(held, max_edits)
            held, words = [], 0
    if held:
        yield Items(held, max_edits)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """One row per document and item it contains: id, item_id, edits (in words), near_word."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).alias("text"))
    result = None
    for items in item_blocks(benchmark, item_col, item_text, max_edits):
        part = rows.mapInArrow(finder(spark.sparkContext.broadcast(items), id_col), f"{id_col} long, {FOUND}")
        result = part if result is None else result.unionByName(part)
    return spark.createDataFrame([], f"{id_col} long, {FOUND}") if result is None else result


def finder(shared, id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            out = [(ids[k], *rest) for k, *rest in found_in(shared.value, batch.column(1).to_pylist())] if shared.value.tables else []
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=[id_col, "item_id", "edits", "near_word"])

    return released(run, _known)


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", max_edits: float = MAX_EDITS) -> DataFrame:
    """docs without the rows that contain an item, with all their columns; filtered as they stream by."""
    for items in item_blocks(benchmark, item_col, item_text, max_edits):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
                hit = {k for k, *_ in found_in(shared.value, texts)} if shared.value.tables else set()
                yield batch.filter(pa.array([k not in hit for k in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(released(run, _known), docs.schema)
    return docs
