"""Conversations: recent turns, summaries of the rest, intents by weighted phrases, escalation, first-win effects."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import stretches


def recent_and_old(turns: DataFrame, conv: str, pos: str, role: str, recent: int) -> DataFrame:
    """turns with is_recent: the last `recent` user turns of a conversation and all that follows them."""
    ahead = Window.partitionBy(conv).orderBy(F.desc(pos)).rowsBetween(Window.unboundedPreceding, 0)
    users = F.sum((F.col(role) == "user").cast("int")).over(ahead)
    # A turn behind the cut has fewer than `recent` user turns from it on, or is itself the last one that counts.
    return turns.withColumn("is_recent", (users < recent) | ((users == recent) & (F.col(role) == "user")))


def phrase_scores(text: Column, phrases: Sequence[tuple[str, float]]) -> Column:
    """Sum of the weights of the phrases that the lower-cased text contains."""
    low = F.lower(text)
    out = F.lit(0.0)
    for phrase, weight in phrases:
        out = out + F.when(F.contains(low, F.lit(phrase)), float(weight)).otherwise(0.0)
    return out


def classified(text: Column, rules: Sequence[tuple[str, Sequence[tuple[str, float]]]], otherwise: str) -> Column:
    """struct(label, score): the largest score; of equal ones the first rule; `otherwise` without any."""
    scores = F.array(*[F.struct(phrase_scores(text, phrases).alias("score"), F.lit(-k).alias("order"), F.lit(label).alias("label")) for k, (label, phrases) in enumerate(rules)])
    best = F.array_max(scores)
    return F.struct(F.when(best["score"] > 0, best["label"]).otherwise(otherwise).alias("label"), best["score"].alias("score"))


def first_effects(effects: DataFrame, key: str, order: str) -> DataFrame:
    """effects with is_first: of those that share a key, the first by order takes effect. The minimum combines on the map side."""
    first = effects.groupBy(key).agg(F.min(order).alias("_first"))
    return effects.join(first, key).withColumn("is_first", F.col(order) == F.col("_first")).drop("_first")


def next_positions(log: DataFrame, conv: str, order: str) -> DataFrame:
    """log with position, from 0 in each conversation, which may span any number of tasks."""
    rows = stretches.folded(log, [conv], [order], sums={"position": F.lit(1)})
    return rows.withColumn("position", F.coalesce("position", F.lit(0)))


def summary_lines(turns: DataFrame, conv: str, pos: str, role: str, text: str, names: str, most: int = 160) -> DataFrame:
    """conv, pos, line: what is kept of each message without a model: the user's words, replies that name something, and what tools looked up. names is a pattern of what must not get lost."""
    said = F.trim(F.col(text), F.lit(" \n\t"))
    head = F.left(said, F.lit(most))
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(names), F.lit(0)), lambda x: F.upper(x)))
    line = (
        F.when(F.col(role) == "user", F.concat(F.lit("Customer asked: "), head))
        .when((F.col(role) == "assistant") & F.col(text).rlike(names), F.concat(F.lit("Agent said: "), head))
        .when((F.col(role) == "tool") & (F.size(found) > 0), F.concat(F.lit("Looked up: "), F.array_join(found, ", ")))
    )
    return turns.select(conv, pos, F.when(said != "", line).alias("line")).filter("line is not null")


def summaries(lines: DataFrame, conv: str, most: int = 12) -> DataFrame:
    """conv, summary, lines: the last `most` lines in order. Of a long conversation no more than these ever meet."""
    pos = next(c for c in lines.columns if c not in (conv, "line"))
    back = F.row_number().over(Window.partitionBy(conv).orderBy(F.desc(pos)))
    kept = lines.withColumn("back", back).filter(F.col("back") <= most)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(pos, "line"))), lambda x: x["line"])
    return kept.groupBy(conv).agg(F.array_join(ordered, "\n").alias("summary"), F.count(F.lit(1)).alias("lines"))


def missing_names(turns: DataFrame, kept: DataFrame, conv: str, text: str, names: str) -> DataFrame:
    """conv, missing: names of a conversation's messages that its summary (conv, summary) doesn't hold, in any case."""
    said = turns.select(conv, F.explode(F.regexp_extract_all(text, F.lit(names), F.lit(0))).alias("name")).select(conv, F.upper("name").alias("name")).distinct()
    lost = said.join(kept.select(conv, F.upper("summary").alias("said")), conv).filter(~F.contains("said", "name"))
    return lost.groupBy(conv).agg(F.sort_array(F.collect_list("name")).alias("missing"))
