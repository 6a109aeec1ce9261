"""Passages as the numbered blocks of a prompt, and prompts read back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once

#: The fences of the blocks, what stands before the question, and a block's first line.
START, END, ASKED = "<<<CONTEXT", ">>>END CONTEXT", "QUESTION:"
HEADER = r"(?m)^[ \t]*\[(\d+)\][ \t]*title:[ \t]*(.*?)[ \t]*\|[ \t]*source:[ \t]*(.*?)[ \t]*$"


def context_blocks(passages: Column) -> Column:
    """The blocks of an array of structs (title, source, text), numbered from 1, between fences."""
    block = lambda p, k: F.concat(F.lit("["), (k + 1).cast("string"), F.lit("] title: "), F.coalesce(p["title"], F.lit("untitled")), F.lit(" | source: "), F.coalesce(p["source"], F.lit("unknown")), F.lit("\n"), F.trim(F.coalesce(p["text"], F.lit(""))), F.lit("\n"))
    return F.array_join(F.concat(F.array(F.lit(START)), F.transform(passages, block), F.array(F.lit(END))), "\n")


def context_section(prompt: Column) -> Column:
    """What stands between the fences; all behind the first one where the second is missing, '' where the first is."""
    begun = F.locate(START, prompt)
    rest = F.substring(prompt, begun + len(START), F.length(prompt))
    return F.when(begun > 0, F.substring_index(rest, END, 1)).otherwise("")


def parsed_blocks(prompt: Column) -> Column:
    """An array of structs (marker, title, source, text): each block's lines, without blank ones, behind one another."""

    def blocks(section: Column) -> Column:
        part = lambda k: F.regexp_extract_all(section, F.lit(HEADER), F.lit(k))
        bodies = F.slice(F.split(section, HEADER), F.lit(2), F.size(F.split(section, HEADER)))
        said = F.transform(bodies, lambda b: F.array_join(F.filter(F.transform(F.split(b, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != ""), " "))
        return F.transform(F.arrays_zip(part(1).alias("marker"), part(2).alias("title"), part(3).alias("source"), said.alias("text")), lambda x: F.struct(x["marker"].cast("int").alias("marker"), x["title"].alias("title"), x["source"].alias("source"), x["text"].alias("text")))

    return once(context_section(prompt), blocks)


def question_of(prompt: Column) -> Column:
    """The question of the first line that begins with QUESTION:, '' without one."""
    return F.trim(F.regexp_extract(prompt, rf"(?m)^[ \t]*{ASKED}(.*)$", 1))
