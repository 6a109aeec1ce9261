"""Append-only records: entries that are submitted once or again, numbered behind one another, and marks on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stretches


def appended(log: DataFrame, entries: DataFrame) -> DataFrame:
    """key, at, entry_id, outcome, entry_no of every entry: what becomes of it when it is added to a log.

    log: key, digest, entry_no. entries: key, at, entry_id, digest. The first entry of a key that the log hasn't is appended,
    ties by entry_id, with the next number in order of (at, entry_id). A key comes in once: whoever submits it again, with the
    same digest, has the number that it got (repeated), and with another digest is refused (conflict). Entries without a
    key can't be told from repeats and are refused, too. Numbers are given out by ranges, so that no task sees all entries.
    """
    known = log.groupBy("key").agg(F.min(F.struct("entry_no", "digest")).alias("old"))
    last = log.agg(F.coalesce(F.max("entry_no"), F.lit(0)).alias("last"))
    first = entries.filter("key is not null").groupBy("key").agg(F.min(F.struct("at", "entry_id", "digest")).alias("first"))
    fresh = first.join(known, "key", "left_anti").select("key", F.col("first.at").alias("at"), F.col("first.entry_id").alias("entry_id"), F.col("first.digest").alias("digest"))
    counted = stretches.folded(fresh.withColumn("all", F.lit(1)), ["all"], ["at", "entry_id"], sums={"before": F.lit(1)})
    numbered = counted.crossJoin(F.broadcast(last)).select("key", F.struct((F.col("last") + F.coalesce("before", F.lit(0)) + 1).alias("entry_no"), "digest", "entry_id").alias("new"))
    both = entries.join(known, "key", "left").join(numbered, "key", "left")
    same = F.coalesce(F.coalesce("old.digest", "new.digest").eqNullSafe(F.col("digest")), F.lit(False))
    added = F.col("old").isNull() & (F.col("new.entry_id") == F.col("entry_id"))
    outcome = F.when(F.col("key").isNull(), "conflict").when(added, "appended").when(same, "repeated").otherwise("conflict")
    return both.select("key", "at", "entry_id", outcome.alias("outcome"), F.when(outcome != "conflict", F.coalesce("old.entry_no", "new.entry_no")).alias("entry_no"))


def outstanding(effects: DataFrame, marks: DataFrame) -> DataFrame:
    """run, effects, compensated, left (count), next: what each run has still to undo, the last effect first.

    effects: run, effect_no, kind; marks: run, effect_no, a row for each time that an effect was undone. Undoing twice counts
    once, and marks of effects that never took place count nothing.
    """
    done = marks.select("run", "effect_no").distinct().withColumn("done", F.lit(True))
    rows = effects.select("run", "effect_no", "kind").join(done, ["run", "effect_no"], "left")
    still = F.when(F.col("done").isNull(), F.struct("effect_no", "kind"))
    out = rows.groupBy("run").agg(F.count(F.lit(1)).alias("effects"), F.count("done").alias("compensated"), F.max(still).alias("x"))
    return out.select("run", "effects", "compensated", (F.col("effects") - F.col("compensated")).alias("left"), F.col("x.effect_no").alias("next"), F.col("x.kind").alias("next_kind"))
