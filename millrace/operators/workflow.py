"""Workflow state folded from event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import seconds
from . import stretches


def state_of(events: DataFrame, run: str, order: str, kind: str, terminal: list[str]) -> DataFrame:
    """By run: the first terminal event if there is one, else the last event, and the number of events."""
    done = F.col(kind).isin(*terminal)
    first_done = F.min(F.when(done, F.struct(order, kind)))
    last = F.max(F.struct(order, kind))
    return events.groupBy(run).agg(F.coalesce(first_done, last)[kind].alias("state"), F.count(F.lit(1)).alias("n_events"))


def first_decisions(events: DataFrame, key: list[str], order: str, decision: str) -> DataFrame:
    """The first decision stands; later ones are ignored."""
    return events.groupBy(*key).agg(F.min_by(decision, order).alias("decision"))


def attempts(events: DataFrame, run: str, order: str, kind: str, failure: str, most: int) -> DataFrame:
    """Failures with their number in the run, and whether another attempt follows, with its back-off in seconds. A run may span any number of tasks."""
    failed = stretches.folded(events.filter(F.col(kind) == failure), [run], [order], sums={"attempt": F.lit(1)})
    failed = failed.withColumn("attempt", F.coalesce("attempt", F.lit(0)) + 1)
    delay = F.least(F.lit(60.0), F.pow(F.lit(2.0), F.col("attempt") - 1))
    return failed.withColumn("retried", F.col("attempt") < most).withColumn("delay", F.when(F.col("attempt") < most, delay))


def compensations(effects: DataFrame, run: str, order: str) -> DataFrame:
    """Effects in the order in which they are undone, the last first."""
    rows = stretches.folded(effects, [run], [f"-{order}"], sums={"undo_no": F.lit(1)})
    return rows.withColumn("undo_no", F.coalesce("undo_no", F.lit(0)) + 1)


def expired_leases(steps: DataFrame, run: str, at: str, order: str, lease_seconds: float) -> DataFrame:
    """Steps after which nothing of their run happened within the lease, though something came later."""
    rows = stretches.folded(steps, [run], [f"-{at}", f"-{order}"], lasts={"_next": F.col(f"_row.{at}")})
    return rows.withColumn("idle", seconds(F.col("_next")) - seconds(F.col(at))).drop("_next").filter(F.col("idle") > lease_seconds)


def steps_in_order(events: DataFrame, run: str, order: str, kind: str, done: str) -> DataFrame:
    """events with position (from 0) and state: done up to the run's last event of the kind `done`, the one behind it ready, the rest blocked."""
    last = events.filter(F.col(kind) == done).groupBy(F.col(run).alias("_run")).agg(F.max(order).alias("_done"))
    rows = stretches.folded(events, [run], [order], sums={"position": F.lit(1)}, lasts={"_before": F.col(f"_row.{order}")})
    both = rows.join(last, F.col(run) == F.col("_run"), "left").drop("_run")
    is_done = lambda c: F.coalesce(F.col(c) <= F.col("_done"), F.lit(False))
    state = F.when(is_done(order), "done").when(F.col("_before").isNull() | is_done("_before"), "ready").otherwise("blocked")
    return both.withColumn("state", state).withColumn("position", F.coalesce("position", F.lit(0))).drop("_before", "_done")


def approvals(events: DataFrame, run: str, at: str, order: str, kind: str, asks: str, decisions: dict[str, str], expiry_seconds: float, now: float) -> DataFrame:
    """run, order, state, waited of every event that asks for approval: approved or rejected by the first decision of its run behind it, if that came in time, else expired or pending.

    decisions gives the state that each kind of event decides on; now is in seconds. A decision answers what its run asks
    for by then and no later question; waited is seconds until it. A run may span any number of tasks.
    """
    some = events.select(run, at, order, kind).filter(F.col(kind).isin(asks, *decisions))
    state = F.coalesce(*[F.when(F.col(f"_row.{kind}") == k, F.lit(v)) for k, v in decisions.items()])
    ahead = stretches.folded(some, [run], [f"-{at}", f"-{order}"], lasts={"_next": F.when(state.isNotNull(), F.struct(state.alias("state"), F.col(f"_row.{at}").alias("at")))})
    asked = ahead.filter(F.col(kind) == asks)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    waited = (micros("_next.at") - micros(at)) / 1e6
    decided = F.coalesce(waited <= expiry_seconds, F.lit(False))
    late = seconds(F.col(at)) + expiry_seconds < now
    return asked.select(run, order, F.when(decided, F.col("_next.state")).when(late, "expired").otherwise("pending").alias("state"), F.when(decided, waited).alias("waited"))


def resumed(asked: DataFrame, run: str) -> DataFrame:
    """run, state, answered, open of approvals(): a run goes on once all that it asked for is approved, ends with a rejection or an expiry, and else waits."""
    by = asked.groupBy(run).agg(F.count_if(F.col("state").isin("approved", "rejected")).alias("answered"), F.count_if(F.col("state") == "pending").alias("open"), F.max(F.col("state") == "rejected").alias("_no"), F.max(F.col("state") == "expired").alias("_late"))
    state = F.when(F.col("_no"), "cancelled").when(F.col("_late"), "failed").when(F.col("open") > 0, "waiting").otherwise("running")
    return by.select(run, state.alias("state"), "answered", "open")
