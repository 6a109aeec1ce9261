"""Token ids in Huffman-coded binary files.

Texts are put in order of their identifier, encoded with a given tokenizer, and counted. From the
global counts comes one canonical code with lengths of MAX_BITS at most. Blocks of BLOCK tokens are
coded independently, with the bit offset of every STRIDE-th token, so that a reader can start in
the middle of a block; decoding looks up MAX_BITS bits at a time in a table and advances all
stretches of many blocks together.

A file holds MAGIC, the length of the zlib-compressed code lengths (u32) and these; then blocks:
HEAD (pieces, tokens, checkpoints and payload bytes as u32), identifiers (i64), tokens of each piece
(u32), whether it begins its document (u8), checkpoints (u32) and the payload. All numbers are
little-endian; bits are written from the high end of each byte. Files sort by name in the order of
identifiers. A document may span blocks, and files where Spark reads the pieces of a partition in several
splits: a reader takes a file's documents from where they begin, on into the files behind it.

Defined results: null counts as empty; null identifiers come first and are read back as null; an empty text is the
end id alone; rows that repeat an identifier are kept as they are, side by side; an empty table gives no
files and no rows; other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, resolve, whole_file
from .shared import remove, scratch

MAGIC, HEAD, SUFFIX = b"HUFTOK1\n", "<4I", ".huf"
#: Stands for a null identifier in the files.
NO_ID = -(1 << 63)
BLOCK, STRIDE, MAX_BITS = 1 << 16, 256, 18
#: Tokens a file holds before the next one is begun, between documents.
FILE_TOKENS = 1 << 28
#: Entries of a generation of a worker's cache of encoded words.
CACHE_ENTRIES = 500_000


# The code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Best prefix-code lengths of max_bits at most (package-merge); 0 where the count is 0."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit into {max_bits} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    packages, taken = np.zeros(0), []
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        by = np.argsort(both, kind="stable")
        taken.append(np.cumsum(by < len(leaves)))
        merged = both[by]
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    items = 2 * len(leaves) - 2
    depth = np.zeros(len(leaves) + 1, np.int64)
    for n_leaves in reversed(taken):
        if not items:
            break
        k = n_leaves[items - 1]
        depth[0] += 1
        depth[k] -= 1
        items = 2 * (items - k)
    lengths[order] = np.cumsum(depth[:-1])
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes by id, and by MAX_BITS bits to come the id and its length."""
    codes = np.zeros(len(lengths), np.uint64)
    table = np.zeros(1 << MAX_BITS, np.uint32)
    steps = np.ones(1 << MAX_BITS, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (MAX_BITS - lengths[order].astype(np.int64))).astype(np.int64)
    starts = np.cumsum(spans) - spans
    codes[order] = (starts >> (MAX_BITS - lengths[order].astype(np.int64))).astype(np.uint64)
    end = int(spans.sum())
    table[:end] = np.repeat(order, spans)
    steps[:end] = np.repeat(lengths[order], spans)
    return codes, table, steps


def packed(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Bit offsets of every STRIDE-th token, and the payload."""
    size = lengths[ids].astype(np.int64)
    end = np.cumsum(size)
    at = end - size
    word, room = at >> 6, 64 - (at & 63) - size
    value = codes[ids]
    here = np.where(room >= 0, value << np.maximum(room, 0).astype(np.uint64), value >> np.maximum(-room, 0).astype(np.uint64))
    words = np.zeros((int(end[-1]) + 63) // 64 + 1, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(here, first)
    over = np.flatnonzero(room < 0)
    words[word[over] + 1] |= value[over] << (64 + room[over]).astype(np.uint64)
    return at[::STRIDE].astype("<u4"), words.astype(">u8").tobytes()[: (int(end[-1]) + 7) // 8]


def unpacked(blocks: list[tuple[int, np.ndarray, bytes]], table: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    """The ids of blocks given as (tokens, checkpoints, payload), all stretches in step."""
    raw = np.frombuffer(b"".join(p for _, _, p in blocks) + bytes(STRIDE * MAX_BITS // 8 + 8), np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    base = np.cumsum([0, *(len(p) for _, _, p in blocks)])
    pos = np.concatenate([c.astype(np.int64) + 8 * b for (_, c, _), b in zip(blocks, base, strict=False)])
    out = np.empty((STRIDE, len(pos)), np.uint32)
    mask = np.uint32((1 << MAX_BITS) - 1)
    for k in range(STRIDE):
        bits = (window[pos >> 3] >> (32 - MAX_BITS - (pos & 7)).astype(np.uint32)) & mask
        out[k] = table[bits]
        pos += steps[bits]
    lanes, result = np.ascontiguousarray(out.T), []
    at = 0
    for n, checkpoints, _ in blocks:
        result.append(lanes[at : at + len(checkpoints)].reshape(-1)[:n])
        at += len(checkpoints)
    return result


# Encoding


def byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {**{b: chr(b) for b in printable}, **{b: chr(256 + k) for k, b in enumerate(others)}}


BYTE_LETTERS = byte_letters()


def core(word: str) -> str:
    """The word in lower case without one full stop or comma behind a letter; the word itself if lower-casing
    it isn't a matter of one letter for one, in normal form."""
    plain = word.lower()
    if not word.isascii() and (len(plain) != len(word) or "\u03a3" in word or not unicodedata.is_normalized("NFC", word)):
        return word
    return plain[:-1] if plain[-1:] in (".", ",") and plain[-2:-1].isalpha() else plain


class Words(dict):
    """What words became, in two generations: looking up a new word encodes it."""

    def __init__(self, coder: Encoder, old: dict[str, bytes]):
        super().__init__({"": b""})
        self.coder, self.old = coder, old

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            plain = core(word)
            # Special tokens are looked for in texts as they stand: what lower-casing would make one of stays as it is.
            if plain == word or self.coder.special(plain):
                ids = self.coder.word(word)
            else:
                ids = self[plain] + self[word[-1]] if len(plain) < len(word) else self[plain]
        self[word] = ids
        return ids


#: The pieces of words that tokenizers of this kind look for.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def cuts_at_blanks(tokenizer) -> bool:
    """Whether a tokenizer brings texts into normal form and lower case, blanks for white space, takes letters, digits and
    marks apart without the blanks, and hands their bytes to a model without prefixes."""
    config = json.loads(tokenizer.to_str())
    normal = (config["normalizer"] or {}).get("normalizers", [])
    pieces = (config["pre_tokenizer"] or {}).get("pretokenizers", [])
    return (
        [x["type"] for x in normal] == ["NFC", "Replace", "Lowercase"]
        and normal[1]["pattern"] == {"Regex": r"\s+"} and normal[1]["content"] == " "
        and [x["type"] for x in pieces] == ["Split", "ByteLevel"]
        and pieces[0]["pattern"] == {"Regex": WORD_PIECES} and pieces[0]["behavior"] == "Removed" and pieces[0]["invert"]
        and not pieces[1]["add_prefix_space"] and not pieces[1]["use_regex"]
        and not config["model"].get("continuing_subword_prefix") and not config["truncation"]
        and all(t["special"] and not t["normalized"] and " " not in t["content"] and "\n" not in t["content"] for t in config["added_tokens"])
    )


class Encoder:
    """Encodes texts word by word, keeping what words became.

    This is for lower-casing byte-level tokenizers that drop white space and never join across it
    (cuts_at_blanks): there, cutting at blanks and line ends changes nothing; nor does cutting off one full
    stop or comma behind a letter; and a word of lower-case letters goes to the tokenizer's model as it is.
    Any other tokenizer, and each with whole_texts, encodes texts whole.
    """

    def __init__(self, tokenizer_path: str, end_id: int, whole_texts: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.model = self.tokenizer.model
        self.dtype = np.dtype("<u2" if max(end_id + 1, self.tokenizer.get_vocab_size()) <= 1 << 16 else "<u4")
        self.pack = struct.Struct("<H" if self.dtype.itemsize == 2 else "<I").pack
        self.end = self.pack(end_id)
        # Finds nothing where there are no special tokens.
        self.special = re.compile("|".join(re.escape(t.content.lower()) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.whole, self.words = whole_texts or not cuts_at_blanks(self.tokenizer), Words(self, {})

    def word(self, word: str) -> bytes:
        if word.isalpha() and word.lower() == word and (word.isascii() or unicodedata.is_normalized("NFC", word)):
            letters = word if word.isascii() else word.encode().decode("latin-1").translate(BYTE_LETTERS)
            return b"".join([self.pack(token.id) for token in self.model.tokenize(letters)])
        return b"".join(map(self.pack, self.tokenizer.encode(word, add_special_tokens=False).ids))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        if self.whole:
            return [np.array(e.ids, self.dtype).tobytes() + self.end for e in self.tokenizer.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        if len(self.words) > CACHE_ENTRIES:
            self.words = Words(self, dict(self.words))
        known = self.words.__getitem__
        return [b"".join(map(known, (t or "").replace("\n", " ").split(" "))) + self.end for t in texts]


@functools.lru_cache(maxsize=2)
def encoder(tokenizer_path: str, end_id: int, whole_texts: bool) -> Encoder:
    """One for all tasks that a worker runs."""
    return Encoder(tokenizer_path, end_id, whole_texts)


PIECES = "part int, seq long, ids binary, docs array<long>, lens array<int>, begins array<boolean>, syms array<int>, counts array<long>"


def encode_pieces(tokenizer_path: str, end_id: int, whole_texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        coder = encoder(tokenizer_path, end_id, whole_texts)
        width = coder.dtype.itemsize
        counts = np.zeros(1 << 16, np.int64)
        seq, held, docs, lens, begins = 0, bytearray(), [], [], []

        def row(ids: bytes, syms=None, n=None) -> pa.RecordBatch:
            columns = [[part], [seq], [ids], [docs], [lens], [begins], [syms], [n]]
            kinds = [pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])

        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                for doc, ids in zip(some.column(0).to_pylist(), coder.encode(some.column(1).to_pylist()), strict=True):
                    done, n = 0, len(ids) // width
                    while done < n:
                        take = min(n - done, BLOCK - len(held) // width)
                        held += ids[done * width : (done + take) * width]
                        docs.append(doc), lens.append(take), begins.append(done == 0)
                        done += take
                        if len(held) == BLOCK * width:
                            seen = np.bincount(np.frombuffer(held, coder.dtype))
                            counts = np.concatenate([counts, np.zeros(max(0, len(seen) - len(counts)), np.int64)])
                            counts[: len(seen)] += seen
                            yield row(bytes(held))
                            seq, held, docs, lens, begins = seq + 1, bytearray(), [], [], []
        if held:
            seen = np.bincount(np.frombuffer(held, coder.dtype))
            counts = np.concatenate([counts, np.zeros(max(0, len(seen) - len(counts)), np.int64)])
            counts[: len(seen)] += seen
            yield row(bytes(held))
            docs, lens, begins = [], [], []
        if counts.any():
            seq = -1
            used = np.flatnonzero(counts)
            yield row(b"", used.tolist(), counts[used].tolist())

    return run


def write_files(folder: str, lengths: np.ndarray, width: int):
    """Codes the pieces of each partition; a new file begins wherever the pieces aren't consecutive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, _, _ = canonical(lengths)
        squeezed = zlib.compress(lengths.tobytes(), 6)
        stack, out, last, tokens, name, whole, made = None, None, None, 0, "", True, []
        import contextlib

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or (r["part"], r["seq"] - 1) != last or (tokens >= FILE_TOKENS and r["begins"][0]):
                    if stack:
                        stack.close()
                        made.append((name, tokens, whole))
                    whole = r["begins"][0]
                    name, tokens, stack = f"part-{r['part']:07d}-{r['seq']:010d}{SUFFIX}", 0, contextlib.ExitStack()
                    out = stack.enter_context(whole_file(f"{folder}/{name}"))
                    out.write(MAGIC + struct.pack("<I", len(squeezed)) + squeezed)
                ids = np.frombuffer(r["ids"], f"<u{width}")
                checkpoints, payload = packed(ids, lengths, codes)
                out.write(struct.pack(HEAD, len(r["docs"]), len(ids), len(checkpoints), len(payload)))
                for a, kind in ((r["docs"], "<i8"), (r["lens"], "<u4"), (r["begins"], "u1")):
                    out.write(np.array(a, kind).tobytes())
                out.write(checkpoints.tobytes())
                out.write(payload)
                last, tokens = (r["part"], r["seq"]), tokens + len(ids)
        if stack:
            stack.close()
            made.append((name, tokens, whole))
        kinds = {"file": pa.string(), "tokens": pa.int64(), "whole": pa.bool_()}
        yield pa.RecordBatch.from_pydict({c: pa.array([m[k] for m in made], kind) for k, (c, kind) in enumerate(kinds.items())})

    return run


def encode_documents(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", whole_texts: bool = False) -> DataFrame:
    """Writes the files under folder; returns one row per file: file, tokens, and whether it begins with a document (whole)."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    ordered = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.col(text_col).alias("text")).repartitionByRange("doc").sortWithinPartitions("doc")
    ordered.mapInArrow(encode_pieces(tokenizer_path, end_id, whole_texts), PIECES).write.option("compression", "zstd").parquet(path)
    pieces = spark.read.parquet(path)
    # One row per id of the vocabulary comes back, whatever the number of documents.
    counted = pieces.filter("seq = -1").select(F.explode(F.arrays_zip("syms", "counts")).alias("x")).groupBy("x.syms").agg(F.sum("x.counts").alias("n")).collect()
    counts = np.zeros(max([0, *(r["syms"] for r in counted)]) + 1, np.int64)
    for r in counted:
        counts[r["syms"]] = r["n"]
    width = Encoder(tokenizer_path, end_id, whole_texts).dtype.itemsize
    blocks = pieces.filter("seq >= 0").select("part", "seq", "ids", "docs", "lens", "begins")
    path_made = scratch(spark, "token-files")
    blocks.mapInArrow(write_files(folder, code_lengths(counts), width), "file string, tokens long, whole boolean").write.parquet(path_made)
    remove(spark, path)
    return spark.read.parquet(path_made)


# Reading


def blocks_of(uri: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray, bytes, np.ndarray]]:
    fs, path = resolve(uri)
    with fs.open_input_stream(path, compression=None) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        lengths = np.frombuffer(zlib.decompress(f.read(struct.unpack("<I", f.read(4))[0])), np.uint8)
        while head := f.read(struct.calcsize(HEAD)):
            docs, tokens, checkpoints, payload = struct.unpack(HEAD, head)
            fields = [np.frombuffer(f.read(n * np.dtype(k).itemsize), k) for n, k in ((docs, "<i8"), (docs, "<u4"), (docs, "u1"), (checkpoints, "<u4"))]
            yield fields[0], fields[1], fields[2], tokens, fields[3], f.read(payload), lengths


def decoded(uri: str, together: int = 32) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Pieces of documents in order: identifier, whether the document begins here, ids."""
    code, held = None, []

    def flush():
        for (docs, lens, begins, *_), ids in zip(held, unpacked([(h[3], h[4], h[5]) for h in held], *code), strict=True):
            at = 0
            for doc, n, new in zip(docs.tolist(), lens.tolist(), begins.tolist(), strict=True):
                yield doc, bool(new), ids[at : at + n]
                at += n

    for block in blocks_of(uri):
        code = code or canonical(block[6])[1:]
        held.append(block)
        if len(held) == together:
            yield from flush()
            held = []
    if held:
        yield from flush()


def documents_of(folder: str, names: list[str]) -> Iterator[tuple[int, bool, np.ndarray]]:
    """Pieces of the documents that begin in the first file; the last of them may go on in the other files.

    What the first file holds of a document before comes first, with None for its identifier.
    """
    begun = False
    for k, name in enumerate(names):
        for doc, new, ids in decoded(f"{folder}/{name}"):
            if new and k:
                return
            begun |= new
            yield doc if begun else None, new, ids
        if not begun:
            return


def digests(folder: str):
    """Per document: identifier, first id's place, number of ids and their CRC-32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for names, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[list[int]] = []
                at = base
                for doc, new, ids in documents_of(folder, names):
                    if doc is None:
                        at += len(ids)
                        continue
                    raw = ids.astype("<u4").tobytes()
                    if new:
                        if len(rows) >= 10_000:
                            yield table(rows)
                            rows = []
                        rows.append([doc, at, len(ids), zlib.crc32(raw)])
                    else:
                        rows[-1][2] += len(ids)
                        rows[-1][3] = zlib.crc32(raw, rows[-1][3])
                    at += len(ids)
                yield table(rows)

    def table(rows: list[list[int]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([None if r[k] == NO_ID else r[k] for r in rows], pa.int64()) for k in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_digests(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, from the files in order of their names.

    The list of files is small: one row per FILE_TOKENS tokens or partition.
    """
    made = {r["file"]: r for r in files.collect()}
    base, rows = 0, []
    names = [name for name, _ in listed(folder, SUFFIX)]
    for k, name in enumerate(names):
        # Ids ahead of the first document that begins here belong to one before.
        following = k + 1
        while following < len(names) and not made[names[following]]["whole"]:
            following += 1
        rows.append((names[k:following], base))
        base += made[name]["tokens"]
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not rows:
        return spark.createDataFrame([], schema)
    return spark.createDataFrame(rows, "files array<string>, base long").repartition(len(rows)).mapInArrow(digests(folder), schema)
