"""Rows as text: tables in Markdown, and what a prompt says of a table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def cell(value: Column) -> Column:
    """A value in one line, with its strokes kept from ending the cell; nothing for null."""
    return F.replace(F.regexp_replace(F.coalesce(value.cast("string"), F.lit("")), r"\s*\n\s*", " "), F.lit("|"), F.lit("\\|"))


def markdown(rows: Column, names: Sequence[str], most: int = 50) -> Column:
    """An array of structs with these fields as a table; beyond `most` rows a line says how many are left out."""
    head = "| " + " | ".join(names) + " |\n|" + "---|" * len(names)
    line = lambda r: F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(r[n]) for n in names]), F.lit(" |"))
    shown = F.transform(F.slice(rows, 1, most), line)
    more = F.when(F.size(rows) > most, F.concat(F.lit("... "), (F.size(rows) - most).cast("string"), F.lit(" more rows")))
    return F.concat_ws("\n", F.lit(head), F.array_join(shown, "\n"), more)


def described(name: Column, columns: Column, n_rows: Column, references: Column) -> Column:
    """A table in a few lines for a prompt: its columns, rows, and what it points at, if anything (arrays of strings)."""
    points = F.when(F.size(references) > 0, F.concat(F.lit("\n  joins "), F.array_join(references, ", ")))
    return F.concat(F.lit("table "), name, F.lit(" ("), n_rows.cast("string"), F.lit(" rows)\n  "), F.array_join(columns, ", "), F.coalesce(points, F.lit("")))
