"""Mixing sources to target weights with hash-threshold histograms.

Every row has a hash of its id. For each source the words are summed by the leading bits of that
hash, the bucket in which the source's budget runs out is found from the running sum, and only the
rows of that boundary bucket are summed again by the next bits, until the bucket holds one hash.
What remains is a threshold per source: rows below it are taken once more than the rest. Budgets
are nested, since a smaller budget keeps a prefix of the same hash order, and rows are never sorted.

Defined results: a null text has size 0; null sources form a source of their own, last in order;
rows that repeat an id share its hash and are taken together; an empty table gives no rows. Columns
other than the three that are named are never read by ``fit_mix`` and pass through ``apply_mix``, which
replaces those that have the names of its own, and unchanged through ``mixed``. Running sums over
sources, of which there is one row each, are one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import remove, scratch, word_count, written

#: The hash has 60 bits, read 12 at a time.
HASH_BITS, DIGIT_BITS = 60, 12


def hash60(id_col: Column) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Sorts as the sources do by code point, null last, and is never null."""
    return F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float], ratio: float, max_repeat: int) -> DataFrame:
    """sizes (src, source_size) with the target of each source.

    Targets are shares of ratio times all words by weight; one above max_repeat times its source's
    size stops there, and the excess is shared by weight among the others. In order of cap over
    weight the capped sources come first, so one running sum settles it. There is one row per
    source, never one per document.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    total = sizes.agg((F.coalesce(F.sum("source_size"), F.lit(0)) * F.lit(float(ratio))).alias("total"))
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy("src")) - 1)
    ranked = ranked.withColumn("weight", F.get(cycle, (F.col("rank") % len(weights)).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(float(max_repeat))).crossJoin(F.broadcast(total))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "src")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    leveled = ranked.withColumn("level", level).withColumn("capped", F.col("cap") < F.col("level") * F.col("weight"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_open = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "src", "level"))).over(everything)
    leveled = leveled.withColumn("common", F.coalesce(first_open.getField("level"), F.lit(0.0)))
    target = F.when(F.col("capped"), F.col("cap")).otherwise(F.least("cap", F.col("common") * F.col("weight")))
    return leveled.select("src", "source_size", target.alias("target"))


def fit_mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[float] = (5, 2, 1), ratio: float = 1.0, max_repeat: int = 3,
) -> DataFrame:
    """One row per source: src, source_size, target, full (copies of every row) and threshold (rows
    whose hash is at most this are taken once more; -1: none)."""
    spark = docs.sparkSession
    path = scratch(spark, "mixing")
    base = docs.select(source_key(F.col(source_col)).alias("src"), hash60(F.col(id_col)).alias("h"), word_count(F.col(text_col)).alias("size"))
    base = written(base, f"{path}/base")
    shift = HASH_BITS - DIGIT_BITS
    counts = written(summed(base, shift), f"{path}/digit0")
    sizes = counts.groupBy("src").agg(F.sum("size").alias("source_size"))
    full = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(0).cast("long")
    plan = source_targets(sizes, weights, ratio, max_repeat).withColumn("full", full)
    plan = plan.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    plan = written(plan.withColumn("threshold", F.lit(-1).cast("long")).withColumn("spent", F.lit(0).cast("long")), f"{path}/plan0")
    level = 0
    while True:
        level += 1
        plan = written(narrowed(plan, counts), f"{path}/plan{level}")
        open_ = plan.filter("lo < hi")
        if shift == 0 or open_.isEmpty():
            break
        shift -= DIGIT_BITS
        inside = base.join(open_.select("src", F.col("bucket").alias("b"), "lo", "hi"), "src").filter("h between lo and hi")
        counts = written(summed(inside.select("src", "h", "size"), shift), f"{path}/digit{level}")
    closest = F.col("bucket_size").isNotNull() & (F.col("spent") + F.col("bucket_size") - F.col("rest") < F.col("rest") - F.col("spent"))
    result = written(plan.select("src", "source_size", "target", "full", F.when(closest, F.col("hi")).otherwise(F.col("threshold")).alias("threshold")), f"{path}-thresholds")
    remove(spark, path)
    return result


def summed(rows: DataFrame, shift: int) -> DataFrame:
    """Words by source and hash bucket, with the least and largest hash in the bucket."""
    return rows.groupBy("src", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("size"), F.min("h").alias("lo"), F.max("h").alias("hi"))


def narrowed(plan: DataFrame, counts: DataFrame) -> DataFrame:
    """plan with the bucket of counts in which each source's rest runs out, and what lies before it.

    A source has at most 4,096 buckets here, so the running sum stays small.
    """
    spent = "coalesce(p.spent, 0)"
    rows = counts.alias("c").join(plan.alias("p"), "src").select("src", "c.bucket", "c.size", "c.lo", "c.hi", F.expr(spent).alias("base"), "p.rest", "p.threshold")
    running = F.sum("size").over(Window.partitionBy("src").orderBy("bucket")) + F.col("base")
    rows = rows.withColumn("after", running)
    within = F.col("after") <= F.col("rest")
    found = rows.groupBy("src").agg(
        F.greatest(F.max("threshold"), F.max(F.when(within, F.col("hi")))).alias("threshold"),
        F.greatest(F.max("base"), F.max(F.when(within, F.col("after")))).alias("spent"),
        F.min(F.when(~within, F.struct("bucket", "lo", "hi", F.col("size").alias("bucket_size")))).alias("at"),
    )
    # A source whose boundary is settled has no counts at this level and stays as it is.
    old = plan.columns
    has = "bucket" in old
    kept = plan.select("src", "source_size", "target", "full", "rest", F.col("threshold").alias("t0"), F.col("spent").alias("s0"), *([F.struct("bucket", "lo", "hi", "bucket_size").alias("a0")] if has else []))
    joined = kept.join(found, "src", "left")
    fresh = F.col("spent").isNotNull()
    at = F.when(fresh, F.col("at")).otherwise(F.col("a0")) if has else F.col("at")
    return joined.select(
        "src", "source_size", "target", "full", "rest",
        F.coalesce("threshold", "t0").alias("threshold"), F.coalesce("spent", "s0").alias("spent"),
        *[at.getField(f).alias(f) for f in ("bucket", "lo", "hi", "bucket_size")],
    )


def measured(docs: DataFrame, thresholds: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """row (all columns of docs), size, source_size, target and times, the copies that the mix takes.

    The thresholds have a row per source; Spark broadcasts them while its own size check allows and
    otherwise splits the hot sources of a sort-merge join.
    """
    named = docs.select(F.struct(*docs.columns).alias("row"), source_key(F.col(source_col)).alias("src"), word_count(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h"))
    times = F.col("full") + (F.col("h") <= F.col("threshold")).cast("long")
    return named.join(thresholds, "src", "left").select("row", "size", "source_size", "target", times.alias("times"))


def apply_mix(docs: DataFrame, thresholds: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target, mix_times (copies that the mix takes)."""
    added = ("size", "source_size", "target", "times")
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in {f"mix_{a}" for a in added}]
    return measured(docs, thresholds, id_col, text_col, source_col).select(*kept, *[F.col(a).alias(f"mix_{a}") for a in added])


def mixed(docs: DataFrame, thresholds: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: rows of docs, repeated as often as they are taken, with the columns of docs."""
    taken = measured(docs, thresholds, id_col, text_col, source_col).filter("times > 0")
    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy")
    return taken.select("row", copies).select("row.*")
