"""Two tokenizers' tokens of the same bytes, aligned, with counts of linked identifiers over all documents.

For tokenizers A and B, np.repeat writes every byte's token index into an owner array each. Where the pair
of owners changes, a new overlap of one A and one B token begins: a link. Where both change at once, both
tokenizers cut. Both arrays are made for many distinct words at once; a word keeps what it became.

A text is cut into words at single blanks behind anything but white space, if both tokenizers' rules allow
that (blanks_cut): then no token crosses such a blank, so a text's tokens, links and groups are its words' ones.
Other tokenizers get whole texts as words.

Each task puts what its documents became into runs: their numbers and digests, their words by number, the words'
links, and how often the run links each pair. Spark sums the pairs over all runs, and the sums go back to
the runs that have the pair, where they are added up by word and by document: texts are read and encoded once,
and never shuffled. A pair has one row for each run, so none is a hot key, and a task holds one run at a time.

Defined results: null and empty texts, and those whose tokens' bytes differ from the blank and the text, have
no tokens, zeros and an empty digest column; rows that repeat each get their result and each count; a null
identifier stays null; an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import os
import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, scratch, written
from .token_codec import BYTE_LETTERS

#: Words of a run, about: a document is never divided.
RUN_WORDS = 2_000_000
#: A worker's words; beyond that it begins anew. Longer words are not kept for the next task.
KEPT_WORDS, KEPT_LENGTH = 400_000, 256
#: Texts of a batch that are looked at together, in characters.
PORTION = 1 << 20
BLANK = "▁"
CUT = re.compile(r"(?<=\S) ")
#: Fixed value: the pattern by which byte-level tokenizers cut texts.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = np.zeros(0, np.int64)
RUNS = "run long, pairs array<long>, counts array<long>, rest binary"
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def blanks_cut(tokenizer, pieces, piece_bytes: list[bytes]) -> bool:
    """Whether tokens never cross a single blank behind anything but white space, and blanks begin tokens.

    A: bytes, unchanged, cut by the pattern of byte-level tokenizers, in which only runs of white space and a first
    character are blank. B: no piece with a blank behind another character, text unchanged but for blanks.
    """
    config = json.loads(tokenizer.to_str())
    cut = config["pre_tokenizer"] or {}
    plain = config["normalizer"] is None and cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"]
    crossing = re.compile(f"[^{BLANK}]{BLANK}")
    kept = all(b"".join(piece_bytes[i] for i in pieces.encode(s)) == (" " + s).encode() for s in ("a  b ", "  ﬁ Ａ ", "Å é ² ½"))
    return plain and kept and not any(crossing.search(pieces.id_to_piece(i)) for i in range(pieces.get_piece_size()))


def letters_bytes() -> dict[str, int]:
    return {letter: byte for byte, letter in BYTE_LETTERS.items()}


def as_ranks(tokenizer, token_bytes: list[bytes]):
    """A coder of the same merges that is faster, or None where they aren't ranked by identifiers: byte-level, without a normaliser, and each merge makes the next token."""
    import tiktoken

    config = json.loads(tokenizer.to_str())
    model, cut = config["model"], config["pre_tokenizer"] or {}
    if config["normalizer"] or cut.get("type") != "ByteLevel" or not cut["use_regex"] or cut["add_prefix_space"]:
        return None
    made = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if model["type"] != "BPE" or made != list(range(256, 256 + len(made))):
        return None
    return tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=dict(zip(token_bytes[: 256 + len(made)], range(256 + len(made)), strict=True)), special_tokens={})


class Aligner:
    """Words with their tokens, links and groups. The lists and arrays hold one entry for each word, by its number."""

    def __init__(self, a_path: str, b_path: str, whole_texts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        of = letters_bytes()
        self.a_bytes = [bytes(of[c] for c in t) if all(c in of for c in t) else t.encode() for t in map(self.a.id_to_token, range(self.a.get_vocab_size()))]
        ids = range(self.b.get_piece_size())
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in zip(ids, map(self.b.id_to_piece, ids), strict=True)]
        self.whole = whole_texts or not blanks_cut(self.a, self.b, self.b_bytes)
        self.ranks = as_ranks(self.a, self.a_bytes)
        self.a_size, self.b_size = (np.array([len(x) for x in every]) for every in (self.a_bytes, self.b_bytes))
        self.a_name, self.b_name = (list(map(str, range(len(every)))) for every in (self.a_bytes, self.b_bytes))
        self.lone = self.b.piece_to_id(BLANK)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.text: list[str] = []
        #: By word: A tokens, B tokens, groups, links, and whether its bytes came out right.
        self.facts = np.zeros((0, 5), np.int64)
        #: Links of all words, A << 32 | B, and where a word's ones begin.
        self.links, self.first = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def words(self, text: str) -> list[str]:
        return [text] if self.whole else CUT.split(text)

    def ids_a(self, texts: list[str]) -> list[list[int]]:
        if self.ranks:
            return list(map(self.ranks.encode_ordinary, texts))
        return [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]

    def encoded_a(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """A's identifiers of all words, and how many each has. Words that end in anything but white space are encoded as one text: they are cut at their blanks."""
        joins = [] if self.whole else [k for k, w in enumerate(new) if w and not w[-1].isspace()]
        apart = sorted(set(range(len(new))).difference(joins))
        ids, sizes = self.ids_a([" " + new[k] for k in apart]), np.zeros(len(new), np.int64)
        sizes[apart] = [len(x) for x in ids]
        flat = np.fromiter(itertools.chain.from_iterable(ids), np.int64)
        if joins:
            text = "".join([" " + new[k] for k in joins])
            together = np.array(self.ids_a([text])[0], np.int64)
            ends = np.cumsum([1 + len(new[k].encode()) for k in joins])
            upto = np.searchsorted(np.cumsum(self.a_size[together]), ends, side="right")
            sizes[joins] = np.diff(upto, prepend=0)
            # In the order of the words: those apart fill in between.
            of, at = np.repeat(np.arange(len(new)), sizes), np.zeros(len(new), bool)
            at[joins] = True
            both, mask = np.empty(len(of), np.int64), at[of]
            both[mask], both[~mask] = together, flat
            flat = both
        return flat, sizes

    def learn(self, new: list[str]) -> None:
        """Adds distinct words, encoded as blank and word."""
        ids_a, n_a = self.encoded_a(new)
        b = [ids or [self.lone] for ids in self.b.encode(new, num_threads=1)]
        n_b = np.fromiter(map(len, b), np.int64, len(b))
        ids_b = np.fromiter(itertools.chain.from_iterable(b), np.int64, int(n_b.sum()))
        raw = [(" " + w).encode() for w in new]
        right = self.right(raw, ids_a, n_a, self.a_size, self.a_bytes) & self.right(raw, ids_b, n_b, self.b_size, self.b_bytes)
        if not right.all():
            # A word that didn't come out right stands as one without tokens.
            ids_a, ids_b = ids_a[np.repeat(right, n_a)], ids_b[np.repeat(right, n_b)]
            n_a, n_b = n_a * right, n_b * right
        owner_a, owner_b = np.repeat(np.arange(len(ids_a)), self.a_size[ids_a]), np.repeat(np.arange(len(ids_b)), self.b_size[ids_b])
        new_a, new_b = np.diff(owner_a, prepend=-1) != 0, np.diff(owner_b, prepend=-1) != 0
        at = np.flatnonzero(new_a | new_b)
        link_a, link_b = owner_a[at], owner_b[at]
        cuts = (new_a & new_b)[at]
        word = np.repeat(np.arange(len(new)), n_a)[link_a] if len(at) else at
        n_links, n_groups = np.bincount(word, minlength=len(new)), np.bincount(word[cuts], minlength=len(new))
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new)), strict=True))
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n_groups, n_links, right], axis=1)])
        self.links = np.concatenate([self.links, ids_a[link_a] << 32 | ids_b[link_b]])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n_links)])
        names_a, names_b = list(map(self.a_name.__getitem__, ids_a.tolist())), list(map(self.b_name.__getitem__, ids_b.tolist()))
        starts_a, starts_b = [*link_a[cuts].tolist(), len(ids_a)], [*link_b[cuts].tolist(), len(ids_b)]
        made = [",".join(names_a[x:y]) + "|" + ",".join(names_b[z:u]) for x, y, z, u in zip(starts_a, starts_a[1:], starts_b, starts_b[1:], strict=False)]
        ends = np.cumsum(n_groups).tolist()
        self.text += [";".join(made[x:y]) for x, y in zip([0, *ends], ends, strict=False)]

    @staticmethod
    def right(raw: list[bytes], ids: np.ndarray, n: np.ndarray, sizes: np.ndarray, token_bytes: list[bytes]) -> np.ndarray:
        """Whether each word's tokens make up its bytes."""
        ends = np.cumsum(n)
        made = np.diff(np.concatenate([[0], np.cumsum(sizes[ids])])[ends], prepend=0)
        if (made == np.fromiter(map(len, raw), np.int64, len(raw))).all() and b"".join(map(token_bytes.__getitem__, ids.tolist())) == b"".join(raw):
            return np.ones(len(raw), bool)
        of = list(map(token_bytes.__getitem__, ids.tolist()))
        return np.array([b"".join(of[x:y]) == r for x, y, r in zip([0, *ends.tolist()], ends.tolist(), raw, strict=False)], bool)

    def numbers(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """The words of each text, by number; None where it has no tokens."""
        split = [self.words(t) if t else [] for t in texts]
        new = sorted(set().union(*split).difference(self.number))
        if new:
            self.learn(new)
        found = [np.fromiter(map(self.number.__getitem__, words), np.int64, len(words)) if words else None for words in split]
        return [n if n is not None and self.facts[n, 4].all() else None for n in found]

    def spans(self, words: np.ndarray) -> np.ndarray:
        """Places in links of all links of some words."""
        n = self.facts[words, 3]
        return np.repeat(self.first[words] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def trim(self) -> None:
        if len(self.number) > KEPT_WORDS or max(map(len, self.number), default=0) > KEPT_LENGTH:
            self.clear()


@functools.lru_cache(maxsize=1)
def aligner(a_path: str, b_path: str, whole_texts: bool) -> Aligner:
    """One for all tasks that a worker runs."""
    return Aligner(a_path, b_path, whole_texts)


def portions(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts with PORTION characters at most, or one text."""
    start = size = 0
    for k, t in enumerate(texts):
        if k > start and size + len(t or "") > PORTION:
            yield start, k
            start, size = k, 0
        size += len(t or "")
    if texts:
        yield start, len(texts)


class Run:
    """Documents of a task that are counted and summed together."""

    def __init__(self, known: Aligner):
        self.known, self.ids, self.words, self.digests, self.size = known, [], [], [], 0

    def add(self, ids: list[int | None], texts: list[str | None]) -> None:
        for i, words in zip(ids, self.known.numbers(texts), strict=True):
            self.ids.append(i)
            self.words.append(NONE if words is None else words)
            self.digests.append("" if words is None else hashlib.sha256(";".join(map(self.known.text.__getitem__, words.tolist())).encode()).hexdigest())
            self.size += len(self.words[-1])

    def packed(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """The run's pairs, how often it links each, and the rest: documents, their words, and the words' links as places among the pairs."""
        known, n_words = self.known, np.array([len(w) for w in self.words], np.int64)
        every = np.concatenate([NONE, *self.words])
        seen = np.bincount(every, minlength=len(known.number))
        used = np.flatnonzero(seen)
        # Frequent words get low numbers, which compress.
        used = used[np.argsort(-seen[used], kind="stable")]
        local = np.zeros(len(known.number), np.int32)
        local[used] = np.arange(len(used), dtype=np.int32)
        n_links = known.facts[used, 3]
        pairs, at = np.unique(known.links[known.spans(used)], return_inverse=True)
        counts = np.bincount(at, np.repeat(seen[used], n_links), len(pairs)).astype(np.int64)
        upto = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(known.facts[every, :4], axis=0)])
        facts = np.diff(upto[np.concatenate([[0], np.cumsum(n_words)])], axis=0)
        # Bytes of equal weight lie together.
        numbers = local[every].view(np.uint8).reshape(-1, 4).T.tobytes()
        rest = (self.ids, facts, self.digests, n_words, numbers, n_links.astype(np.int32), at.astype(np.int32))
        return pairs, counts, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rest, protocol=5))


def encoded_runs(a_path: str, b_path: str, whole_texts: bool):
    """From (id, text): a row for each run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        known, part, n = aligner(a_path, b_path, whole_texts), TaskContext.get().partitionId(), 0

        def row(docs: Run) -> pa.RecordBatch:
            pairs, counts, rest = docs.packed()
            columns = [pa.array([part << 32 | n], pa.int64()), pa.array([pairs], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([rest], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RUNS.split(", ")])

        docs = Run(known)
        try:
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in portions(texts):
                    docs.add(ids[a:b], texts[a:b])
                    if docs.size >= RUN_WORDS or len(known.number) > KEPT_WORDS:
                        yield row(docs)
                        docs, n = Run(known), n + 1
                        if len(known.number) > KEPT_WORDS:
                            known.clear()
            if docs.ids:
                yield row(docs)
        finally:
            known.trim()

    return run


def summed_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (run, place, n, best, rest), a run's pairs in order of place before its rest: the documents' rows."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        is_rest = batch.column(4).is_valid().to_numpy(zero_copy_only=False)
        start = 0
        for end in [*np.flatnonzero(is_rest).tolist(), batch.num_rows]:
            if end > start:
                part = batch.slice(start, end - start)
                held.append((part.column(2).to_numpy(), part.column(3).to_numpy()))
            if end < batch.num_rows:
                ids, facts, digests, n_words, numbers, n_links, at = pickle.loads(zstandard.ZstdDecompressor().decompress(batch.column(4)[end].as_py()))
                words = np.ascontiguousarray(np.frombuffer(numbers, np.uint8).reshape(4, -1).T).view(np.int32).reshape(-1)
                links, docs, sums = np.concatenate([[0], np.cumsum(n_links)]), np.concatenate([[0], np.cumsum(n_words)]), []
                for values in (np.concatenate([x[k] for x in held] or [NONE]) for k in (1, 0)):
                    by_word = np.diff(np.concatenate([[0], np.cumsum(values[at])])[links])
                    sums.append(np.diff(np.concatenate([[0], np.cumsum(by_word[words])])[docs]))
                columns = [pa.array(ids, pa.int64()), *(pa.array(facts[:, k]) for k in range(4)), *map(pa.array, sums), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in RESULT.split(", ")])
                held = []
            start = end + 1


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False) -> DataFrame:
    """A row for each document: tokens of A and B, groups, links, links of pairs that are their B's most frequent, and the sum of counts.

    The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    path = scratch(spark, "alignment")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = written(rows.mapInArrow(encoded_runs(a_path, b_path, whole_texts), RUNS), f"{path}/runs")
    slices = runs.select("run", F.posexplode(F.arrays_zip("pairs", "counts")).alias("place", "x")).select("run", "place", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("n"))
    pairs = written(slices.groupBy("pair").agg(F.sum("n").alias("n")), f"{path}/pairs")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    # One row for each B token: bounded by B's vocabulary.
    most = pairs.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))
    judged = pairs.withColumn("b", b_id).join(F.broadcast(most), "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    back = slices.select("run", "place", "pair").join(judged, "pair").select("run", "place", "n", "best", F.lit(None).cast("binary").alias("rest"))
    none = lambda name, kind: F.lit(None).cast(kind).alias(name)
    both = back.unionByName(runs.select("run", none("place", "int"), none("n", "long"), none("best", "long"), "rest"))
    dealt = both.repartition("run").sortWithinPartitions("run", F.col("rest").isNotNull(), "place")
    result = written(dealt.select("run", "place", "n", "best", "rest").mapInArrow(summed_runs, RESULT), f"{path}-result")
    remove(spark, path)
    return result
