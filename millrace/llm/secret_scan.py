"""Secrets in texts: fixed shapes, and random strings told by how badly a tokenizer compresses them.

A vocabulary of byte pairs packs words into few tokens, whatever the language; random strings take a token
for every character or two. A run of at least LEAST characters is random where its characters for each token are
fewer than RATIO, judged in stretches of WINDOW characters so that long runs are judged all along and in
linear time. Known digests and identifiers are left out first (KNOWN), and so are runs that could
be words: letters of one case, or with one capital at the start.

Defined results: a null text counts as empty; spans are counted in code points; random spans that touch a
span of a fixed shape are left to that; rows that repeat stay, each with its result; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shapes of secrets. ASCII letters of ASSIGN stand in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 8, 16, 32
#: Words without which no assignment is there, as ASSIGN needs one of them.
CUES = ("passw", "secret", "token", "api")

#: Runs are looked at from 16 characters on, since an access key may be that short; random ones are longer.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST, WINDOW = 20, 64
#: Characters for each token. Random letters and digits lie near 1.4, hexadecimal near 1.7, words above 2.
RATIO = 1.8

#: Lengths of digests in hexadecimal (MD5, SHA-1, SHA-224 to SHA-512, and their cuts), and identifiers.
KNOWN = re.compile(
    r"(?:[0-9a-f]{24}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{48}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}"
    r"|[0-9A-F]{24}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{48}|[0-9A-F]{56}|[0-9A-F]{64}|[0-9A-F]{96}|[0-9A-F]{128}"
    r"|[A-Z2-7]{32}=*"  # SHA-1 in base32
    r"|sha(?:256-[A-Za-z0-9+/]{43}=|384-[A-Za-z0-9+/]{64}|512-[A-Za-z0-9+/]{86}==)"
    r"|[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"  # UUID
    r"|[0-7][0-9A-HJKMNP-TV-Z]{25}"  # ULID
    r"|[A-Z]{2}[0-9]{2}[A-Z0-9]{4}[0-9]{7,22}"  # account numbers
    r"|[0-9T+/_=:-]+)"  # numbers, dates
)
PLAIN = re.compile(r"[+/_=-]*(?:[A-Za-z]?[a-z]*|[A-Z]*)(?:[+/_=-]+(?:[A-Za-z]?[a-z]*|[A-Z]*))*")


@functools.lru_cache(maxsize=2)
def encoding(ranks_path: str, pattern: str):
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def fixed_spans(text: str, runs: list[re.Match]) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed shapes; access keys and hexadecimal stand within runs."""
    found = []
    lowered = text.lower()
    if any(cue in lowered for cue in CUES):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    for run in runs:
        for kind, shape, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
            found += [(m.start(), kind, m.end()) for m in shape.finditer(text, run.start(), run.end()) if m.end() - m.start() >= least]
    return found


def random_spans(text: str, runs: list[re.Match], tokens) -> list[tuple[int, int]]:
    """Stretches that a tokenizer packs badly, joined where they meet."""
    found: list[tuple[int, int]] = []
    for run in runs:
        word = run[0]
        if len(word) < LEAST or KNOWN.fullmatch(word) or PLAIN.fullmatch(word):
            continue
        # All stretches are near WINDOW long, so that none is too short to judge.
        n = max(1, round(len(word) / WINDOW))
        cuts = [len(word) * k // n for k in range(n + 1)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a < RATIO * tokens(word[a:b]):
                start, end = run.start() + a, run.start() + b
                if found and found[-1][1] == start:
                    found[-1] = (found[-1][0], end)
                else:
                    found.append((start, end))
    return found


def spans(text: str, tokens) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The spans of fixed shapes, and all spans, each in order of start, kind and end; tokens counts a string's tokens."""
    runs = list(RUN.finditer(text))
    base = sorted(fixed_spans(text, runs))
    starts, ends = [start for start, _, _ in base], list(itertools.accumulate((end for _, _, end in base), max))
    # The furthest end of all spans that begin before b.
    reach = lambda b: ends[k - 1] if (k := bisect.bisect_left(starts, b)) else 0
    return base, sorted(base + [(a, 3, b) for a, b in random_spans(text, runs, tokens) if reach(b) <= a])


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in found)


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def scan_batches(ranks_path: str, pattern: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(ranks_path, pattern)
        tokens = lambda s: len(coder.encode_ordinary(s))
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, every = spans(text.as_py() or "", tokens)
                n = [sum(k == kind for _, k, _ in every) for kind in range(len(KINDS))]
                rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(), joined(every)))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[c.split()[0] for c in RESULT.split(", ")])

    return run


def scan(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts by kind, the digest of the fixed shapes' spans, and all spans.

    ranks_path is a rank file for tiktoken that every worker can read, pattern what splits text before its merges.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan_batches(ranks_path, pattern), RESULT)
