"""Lines of texts: broken sentences joined, and the least stretch of lines that stands once in its text."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space but for line ends.
GAP = r"[ \t\x0B\f\r\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: What a blank line consists of.
BLANKS = " \t\r\x0b\x0c"


def joined_lines(text: Column) -> Column:
    """Lines without white space behind them; one that begins in lower case goes behind the line before it, unless that is blank or ends a sentence.

    Whether two lines are joined depends on their neighbouring ends alone, so two patterns do, each in one pass.
    """
    bare = F.regexp_replace(text, rf"(?<!{GAP}){GAP}++(?=\n|\z)", "")
    return F.regexp_replace(bare, r"(?<=[^.!?:;\n])\n(?=\p{IsLowercase})", " ")


#: Characters of texts that are cut into lines at once, in whole texts.
CHARS_AT_ONCE = 4_000_000


def least_blocks(texts: list[str], most: int) -> tuple[np.ndarray, ...]:
    """Places of text, line, first line and number of lines of the least stretch around each line, as unique_blocks() has them, counted from 0.

    Equal stretches of a text get equal numbers: those of one line by its text, longer ones by the number of what is one line
    shorter and that of their last line. Each length takes a sort of the numbers, and nothing is held but a few of these by line.
    """
    cut = [t.split("\n") for t in texts]
    sizes = np.array([len(x) for x in cut])
    every = [x for lines in cut for x in lines]
    of, total = np.repeat(np.arange(len(cut)), sizes), len(every)
    begin, end = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(np.cumsum(sizes), sizes)
    known: dict[str, int] = {}
    line = np.array([known.setdefault(x, len(known)) for x in every], dtype=np.int64)
    said = np.array([x.strip(BLANKS) != "" for x in every])
    at, n, block, any_said = np.arange(total), len(known), of.astype(np.int64), np.zeros(total, dtype=bool)
    first, span = np.full(total, -1), np.zeros(total, dtype=np.int64)
    for size in range(1, most + 1):
        whole = np.flatnonzero(at + size <= end)
        _, block[whole], counts = np.unique(block[whole] * n + line[whole + size - 1], return_inverse=True, return_counts=True)
        any_said[whole] |= said[whole + size - 1]
        once = np.zeros(total, dtype=bool)
        once[whole] = (counts[block[whole]] == 1) & any_said[whole]
        for back in range(size - 1, -1, -1):
            open_ = np.flatnonzero((first < 0) & (at - back >= begin))
            hit = open_[once[open_ - back]]
            first[hit], span[hit] = hit - back, size
    hit = np.flatnonzero(first >= 0)
    return of[hit], hit - begin[hit], first[hit] - begin[hit], span[hit]


def unique_blocks(docs: DataFrame, id_col: str, text_col: str, most: int = 12) -> DataFrame:
    """id, line_no, first, span: around every line the shortest stretch of lines that stands once in its document, the earliest of equal ones.

    Lines are counted from 1. Lines that are in no such stretch of `most` lines have none; blank stretches don't count. A
    document is one row, so nothing is dealt anew: a task holds the lines of some documents at a time.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("text is not null")

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.utf8_length(batch.column("text")).to_numpy(zero_copy_only=False)) // CHARS_AT_ONCE
            for part in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(ends)) + 1):
                some = batch.slice(part[0], len(part)) if len(part) else batch
                text, line, first, span = least_blocks(some.column("text").to_pylist(), most)
                yield pa.RecordBatch.from_arrays([some.column("id").take(pa.array(text, pa.int64())), *(pa.array(x, pa.int64()) for x in (line + 1, first + 1, span))], ["id", "line_no", "first", "span"])

    return rows.mapInArrow(blocks, f"id {rows.schema['id'].dataType.simpleString()}, line_no long, first long, span long")
