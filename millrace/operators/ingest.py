"""Documents into chunks: cleaning, sections, windows, and first-wins deduplication by content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def content_hash(text: Column, tag: Column) -> Column:
    """Of the lower-cased text with white space collapsed, within a tag."""
    return F.sha2(F.concat_ws("||", F.lower(T.collapsed(text)), tag), 256)


def without_repeated_lines(docs: DataFrame, id_col: str, text_col: str, least_repeats: int = 4, most_chars: int = 70) -> DataFrame:
    """Text without short lines that stand least_repeats times or more in their document: one row per document, nothing is shuffled."""
    short = lambda x: (F.trim(x) != "") & (F.length(F.trim(x)) <= most_chars)

    def without(lines: Column) -> Column:
        # Sorted, a line that repeats stands at both ends of a stretch of least_repeats.
        by = lambda keys: F.array_distinct(F.filter(keys, lambda k, i: k == F.get(keys, i + (least_repeats - 1))))
        keys = F.array_sort(F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: short(x)))
        return T.once(T.once(keys, by), lambda often: F.array_join(F.filter(lines, lambda x: ~(short(x) & F.array_contains(often, F.trim(x)))), "\n"))

    return docs.withColumn(text_col, T.once(F.split(F.col(text_col), "\n"), without))


def chunks(docs: DataFrame, id_col: str, text_col: str, size: int = 180, overlap: int = 40, least_words: int = 6) -> DataFrame:
    """id, chunk_no, chunk: windows of words of at least least_words."""
    each = docs.select(F.col(id_col).alias("id"), F.posexplode(T.word_windows(F.col(text_col), size, overlap)).alias("chunk_no", "chunk"))
    return each.filter(F.size(F.split("chunk", " ")) >= least_words)


def first_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key: a minimum, which combines on the map side, however large the group."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.min(F.struct(order, *rest)).alias("_first"))
    return best.select(*keys, "_first.*")


def last_by(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key: an upsert's result."""
    rest = [c for c in rows.columns if c not in keys and c != order]
    best = rows.groupBy(*keys).agg(F.max(F.struct(order, *rest)).alias("_last"))
    return best.select(*keys, "_last.*")


def merged(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = ()) -> DataFrame:
    """old with the rows of new: values of new win but for the columns of keep_old; nulls of new keep the old value."""
    rest = [c for c in old.columns if c not in keys]
    joined = old.alias("o").join(new.alias("n"), keys, "full_outer")
    pick = lambda c: F.coalesce(f"o.{c}", f"n.{c}") if c in keep_old else F.coalesce(f"n.{c}", f"o.{c}")
    return joined.select(*keys, *[pick(c).alias(c) for c in rest])


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, digest: str) -> DataFrame:
    """key, change: added, removed or modified."""
    b, a = before.select(key, F.col(digest).alias("_b")), after.select(key, F.col(digest).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(F.col("_a") != F.col("_b"), "modified")
    return b.join(a, key, "full_outer").withColumn("change", change).filter(F.col("change").isNotNull()).select(key, "change")


def numbered_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, line_no, line, heading: each line with the last heading before it (a line in capitals, numbered, or with #)."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("line_no", "line"))
    is_heading = F.col("line").rlike(r"^#{1,6} \S|^\d+(\.\d+)*\.? [A-Z]") | (F.col("line").rlike("^[^a-z]*$") & F.col("line").rlike("[A-Z].*[A-Z].*[A-Z]") & (F.length("line") <= 70))
    heading = F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(Window.partitionBy("id").orderBy("line_no"))
    return lines.withColumn("heading", heading)
