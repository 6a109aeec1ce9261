"""Summaries of a request log: totals, groups, percentiles, spending, limits and cache use."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import nearest_rank
from ..session import seconds
from . import stretches


def totals(log: DataFrame, value: str, conditions: dict[str, Column]) -> DataFrame:
    """Rows, sum and mean of value, and rows under each condition, in one pass; 0 where nothing matches."""
    count = F.count(F.lit(1)).alias("n")
    some = [F.coalesce(F.count_if(c), F.lit(0)).alias(name) for name, c in conditions.items()]
    return log.agg(count, F.coalesce(F.sum(value), F.lit(0.0)).alias("total"), F.coalesce(F.avg(value), F.lit(0.0)).alias("mean"), *some)


def by_key(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    return log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))


def latency_percentiles(log: DataFrame, keys: list[str], value: str) -> DataFrame:
    return nearest_rank(log, keys, value, {"p50": 0.5, "p95": 0.95, "most": 1.0})


def daily_spend(log: DataFrame, owner: str, at: str, value: str) -> DataFrame:
    """By owner and day: the day's sum, and the running sum of the owner's days."""
    days = log.groupBy(owner, F.to_date(at).alias("day")).agg(F.sum(value).alias("spent"))
    return days.withColumn("so_far", F.sum("spent").over(Window.partitionBy(owner).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))


def over_budget(log: DataFrame, owner: str, at: str, value: str, order: str, daily: float) -> DataFrame:
    """Rows that come after their owner's day has spent daily or more. An owner's day may span any number of tasks."""
    days = log.withColumn("_day", F.to_date(at))
    spent = stretches.folded(days, [owner, "_day"], [at, order], sums={"spent_before": F.col(f"_row.{value}")}).drop("_day")
    return spent.withColumn("spent_before", F.coalesce("spent_before", F.lit(0.0))).filter(F.col("spent_before") >= daily)


def fallbacks(log: DataFrame, owner: str, at: str, order: str, kind: str) -> DataFrame:
    """Rows whose owner's row before was of another kind, with that kind."""
    rows = stretches.folded(log, [owner], [at, order], lasts={"_last": F.struct(F.col(f"_row.{kind}").alias("kind"))})
    return rows.withColumn("before", F.col("_last.kind")).drop("_last").filter(F.col("before").isNotNull() & (F.col("before") != F.col(kind)))


def token_bucket(log: DataFrame, owner: str, at: str, order: str, capacity: float, a_second: float) -> DataFrame:
    """By row: whether a bucket of its owner that refills a_second and starts full had a token left to take.

    Owners are dealt over tasks and their rows sorted there, on disk if need be; a task walks through them with
    the tokens and time of one owner as its only state, so an owner of any size takes no memory. Rows without
    an owner share a bucket; rows of one time go by order.
    """
    rows = log.select(F.col(owner).alias("owner"), F.col(order).alias("id"), seconds(F.col(at)).alias("t"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, tokens, last = object(), capacity, 0.0
        for batch in batches:
            allowed = []
            for who, t in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if who != current:
                    current, tokens, last = who, capacity, t
                tokens, last = min(capacity, tokens + (t - last) * a_second), t
                allowed.append(tokens >= 1)
                tokens -= allowed[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(allowed, pa.bool_())], names=[owner, order, "allowed"])

    kinds = dict(rows.dtypes)
    dealt = rows.repartition("owner").sortWithinPartitions("owner", "t", "id")
    return dealt.mapInArrow(walk, f"{owner} {kinds['owner']}, {order} {kinds['id']}, allowed boolean")


def cache_hits(log: DataFrame, key: list[str], at: str, order: str, ttl_seconds: float) -> DataFrame:
    """Rows whose key was last seen within ttl_seconds: exact cache hits, if each request stores its answer anew. A key may span any number of tasks."""
    rows = stretches.folded(log, key, [at, order], lasts={"_seen": F.col(f"_row.{at}")})
    age = seconds(F.col(at)) - seconds(F.col("_seen"))
    return rows.withColumn("hit", F.coalesce(age <= ttl_seconds, F.lit(False))).drop("_seen")
