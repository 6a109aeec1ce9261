"""Changes to files: edits that quote the text they replace, and what speaks against a change."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.claims import protected_path
from ..functions.text import once

#: What a change that hides a fault adds: skipped tests, errors passed over, endings forced.
SHORTCUTS = (r"(?m)^\s*except\s*:", r"(?m)^\s*except\s+Exception\s*:\s*\n?\s*pass\b", r"pytest\.(?:mark\.)?skip", r"\bxfail\b", r"#\s*type:\s*ignore", r"\bsys\.exit\(0\)")
NUMBERS = r"\b\d+(?:\.\d+)?\b"


def occurrences(text: Column, part: Column) -> Column:
    """How often a part stands in a text, side by side."""
    return F.when(F.length(part) > 0, ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")).otherwise(0)


def edited(text: Column, old: Column, new: Column) -> Column:
    """struct(text, status) of one edit: invalid (nothing to replace, or by itself), not_found, ambiguous, or applied, and then only there."""

    def judged(n: Column) -> Column:
        status = F.when(F.coalesce(old == new, F.lit(True)) | (old == ""), "invalid").when(n == 0, "not_found").when(n > 1, "ambiguous").otherwise("applied")
        return F.struct(F.when(status == "applied", F.replace(text, old, new)).otherwise(text).alias("text"), status.alias("status"))

    return once(occurrences(text, old), judged)


def apply_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text, statuses: files (path, text) after their edits (path, place, old_text, new_text), each on what the one before left.

    A file's edits are folded in order of place, in one row; files without edits stay, with none. Edits of files that
    aren't there have the status missing, and a null text.
    """
    listed = edits.groupBy("path").agg(F.array_sort(F.collect_list(F.struct("place", F.coalesce("old_text", F.lit("")).alias("old"), F.coalesce("new_text", F.lit("")).alias("new")))).alias("edits"))
    both = files.select("path", F.col("text")).join(listed, "path", "full_outer")
    start = F.struct(F.col("text").alias("text"), F.array().cast("array<string>").alias("statuses"))
    step = lambda s, e: once(edited(s["text"], e["old"], e["new"]), lambda r: F.struct(r["text"].alias("text"), F.concat(s["statuses"], F.array(r["status"])).alias("statuses")))
    made = F.when(F.col("text").isNull(), F.struct(F.lit(None).cast("string").alias("text"), F.transform("edits", lambda e: F.lit("missing")).alias("statuses"))).otherwise(
        F.aggregate(F.coalesce("edits", F.array().cast(dict(listed.dtypes)["edits"])), start, step))
    return both.select("path", made.alias("m")).select("path", "m.text", "m.statuses")


def copied_literals(new: Column, old: Column, tests: Column) -> Column:
    """Numbers that a change added and that its tests state: the mark of answers that are written down instead of computed."""
    added = F.filter(F.array_distinct(F.regexp_extract_all(new, F.lit(NUMBERS), F.lit(0))), lambda n: ~F.contains(old, n))
    return F.array_sort(F.filter(added, lambda n: F.contains(tests, n)))


def shortcuts(new: Column, old: Column) -> Column:
    """Patterns of SHORTCUTS that stand more often after a change than before."""
    more = [F.when(F.regexp_count(new, F.lit(p)) > F.regexp_count(old, F.lit(p)), F.lit(p)) for p in SHORTCUTS]
    return F.filter(F.array(*more), lambda p: p.isNotNull())


def judged_changes(before: DataFrame, after: DataFrame, tests: DataFrame, protected: Sequence[str]) -> DataFrame:
    """path, change, forbidden, copied, shortcuts of every file (path, text) that was added, modified or removed.

    forbidden tells files that no change may touch (patterns of paths); tests (path, text) are what a change is held against.
    """
    old, new = before.select("path", F.col("text").alias("old")), after.select("path", F.col("text").alias("new"))
    both = old.join(new, "path", "full_outer").join(tests.select("path", F.col("text").alias("tests")), "path", "left")
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "modified")
    was, now = F.coalesce("old", F.lit("")), F.coalesce("new", F.lit(""))
    rows = both.withColumn("change", change).filter("change is not null")
    return rows.select("path", "change", protected_path(F.col("path"), protected).alias("forbidden"), copied_literals(now, was, F.coalesce("tests", F.lit(""))).alias("copied"), shortcuts(now, was).alias("shortcuts"))
