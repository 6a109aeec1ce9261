"""License scans by diagonal voting.

Every rolling pair of words of a text is joined, by hash, to the places of that pair in the license
templates. A match votes for the diagonal text place minus template place. Votes are gathered by
diagonal; a diagonal on which every pair of the template votes is an exact place. For templates of
LONG words or more, neighbouring diagonals are merged, which bridges words put in or left out, and
the merged span is verified by the part of the template's places that its words match, each counted
once, and by its length.

Defined results: a null text has no words and no licenses; empty labels are ''; votes are told apart by
identifier and text, so rows that repeat an identifier are judged each by its own text, those without
one too; an empty table gives no rows; the template table is a bounded parameter and is broadcast;
other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .license_texts import NOTICES
from .shared import ascii_lower, remove, scratch, written

#: Words after A-Z are lower-cased.
LICENSE_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels that every scan reports.
BASE = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Labels of the method's own: notices and opening sentences of common licenses.
OWN = [
    ("cc by nc", "cc-by-nc"),
    ("cc by sa", "cc-by-sa"),
    ("cc by nd", "cc-by-nd"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("mozilla public license", "mpl"),
    ("bsd license", "bsd"),
    ("all rights reserved", "all-rights-reserved"),
    ("creative commons attribution", "cc-by"),
    *NOTICES,
]
LONG = 8
#: Diagonals this far apart are merged in long templates.
NEAR = 3
#: Part of a long template's pairs that a span covers at least, and length against the template's at most.
COVER, STRETCH = 0.7, 1.5
MAX_TEMPLATE_WORDS = 1_000_000


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(LICENSE_WORD), 0)


def template_places(spark, base: Sequence[tuple[str, str]], own: Sequence[tuple[str, str]]) -> DataFrame:
    """One row per place of a pair of words in a template: pair, tpl, label, is_base, at, pairs."""
    rows = []
    for n, (phrase, label) in enumerate([*base, *own]):
        words = re.findall(LICENSE_WORD, phrase.lower())
        rows += [(f"{a} {b}", n, label, n < len(base), at, len(words) - 1) for at, (a, b) in enumerate(zip(words, words[1:], strict=False))]
    if len(rows) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates are too large to broadcast")
    return spark.createDataFrame(rows, "pair string, tpl int, label string, is_base boolean, at int, pairs int").withColumn("h", F.xxhash64("pair"))


def text_key(id_: Column, text: Column) -> Column:
    """With the identifier, tells rows apart whose texts differ."""
    return F.xxhash64(F.coalesce(text, F.lit("")), id_.isNull())


def diagonal_votes(docs: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Votes by row, template and diagonal: the template's places that voted, with the first and last place in the text, and the row's words.

    Rows equal in identifier and text vote for the same places, which count once. Only words that begin a pair of a
    template are paired at all. Each row with words has a vote for no template, which carries their number, so that texts are
    cut into words once.
    """
    words = words_of(F.col(text_col))
    worded = docs.select(F.col(id_col).alias("id"), text_key(F.col(id_col), F.col(text_col)).alias("key"), words.alias("words"))
    placed = worded.select("id", "key", "words", F.size("words").alias("n_words"), F.posexplode("words").alias("pos", "w"))
    # The templates are a bounded parameter, and so are their words.
    begins = [r["w"] for r in templates.select(F.substring_index("pair", " ", 1).alias("w")).distinct().collect()]
    some = placed.filter((F.col("pos") == 0) | F.col("w").isin(begins))
    pairs = some.select("id", "key", "n_words", "pos", F.concat_ws(" ", "w", F.get("words", F.col("pos") + 1)).alias("words_here")).withColumn("h_here", F.xxhash64("words_here"))
    votes = pairs.join(F.broadcast(templates), (F.col("h_here") == F.col("h")) & (F.col("words_here") == F.col("pair")), "left").filter((F.col("pos") == 0) | F.col("tpl").isNotNull())
    return votes.groupBy("id", "key", "tpl", (F.col("pos") - F.col("at")).alias("diagonal")).agg(
        F.collect_set("at").alias("places"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.first("label").alias("label"), F.first("is_base").alias("is_base"),
        F.first("pairs").alias("pairs"), F.max("n_words").cast("long").alias("n_words"))


def spans(votes: DataFrame) -> DataFrame:
    """Verified spans of diagonal_votes(): id, key, tpl, label, is_base, start, words (length in the text), cover (0 to 1)."""
    order = Window.partitionBy("id", "key", "tpl").orderBy("diagonal")
    exact = F.col("pairs") + 1 < LONG
    # Diagonals of a short template are places or nothing, and stay apart.
    votes = votes.filter(F.col("tpl").isNotNull() & (~exact | (F.size("places") == F.col("pairs"))))
    begins = F.when(exact | F.lag("diagonal").over(order).isNull() | (F.col("diagonal") - F.lag("diagonal").over(order) > NEAR), 1).otherwise(0)
    grouped = votes.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = grouped.groupBy("id", "key", "tpl", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("covered"), F.min("first").alias("start"), (F.max("last") + 2 - F.min("first")).alias("words"),
        F.first("label").alias("label"), F.first("is_base").alias("is_base"), F.first("pairs").alias("pairs"))
    cover = F.col("covered") / F.col("pairs")
    right = exact | ((cover >= COVER) & (F.col("words") <= (F.col("pairs") + 1) * STRETCH))
    return merged.filter(right).select("id", "key", "tpl", "label", "is_base", "start", "words", cover.alias("cover"))


def scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, own: Sequence[tuple[str, str]] = OWN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the share of a template that the best span covers, 0 without a span.
    """
    spark = docs.sparkSession
    path = scratch(spark, "licenses")
    votes = written(diagonal_votes(docs, template_places(spark, base, own), id_col, text_col), f"{path}/votes")
    at_base = F.when(F.col("is_base"), F.col("start"))
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")  # noqa: E731  of a few labels at most
    by_span = spans(votes).groupBy("id", "key").agg(
        F.count(at_base).alias("n_base"), F.min(at_base).cast("long").alias("first_word"), F.max(at_base).cast("long").alias("last_word"),
        listed(F.when(F.col("is_base"), F.col("label"))).alias("base_labels"), listed(F.col("label")).alias("labels"), F.max("cover").alias("score"))
    lengths = votes.groupBy(F.col("id").alias("of"), F.col("key").alias("of_key")).agg(F.max("n_words").alias("n_words"))
    by_doc = lengths.join(by_span, F.col("of").eqNullSafe(F.col("id")) & (F.col("of_key") == F.col("key")), "left").drop("id", "key")
    by_doc = written(by_doc, f"{path}-result")
    remove(spark, path)
    rows = docs.select(F.col(id_col).alias("doc"), text_key(F.col(id_col), F.col(text_col)).alias("text_key"))
    rows = rows.join(by_doc, F.col("doc").eqNullSafe(F.col("of")) & (F.col("text_key") == F.col("of_key")), "left")
    return rows.select(
        F.col("doc").alias(id_col), F.coalesce("n_words", F.lit(0).cast("long")).alias("n_words"), F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
