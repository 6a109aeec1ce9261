"""Leases of steps as keyed state: compare-and-set, attempts, and timers that give steps back.

A ready step can be claimed; only who claimed it can start it, which counts the attempt before any work; a
lease that isn't renewed runs out, and the step is ready again. The state is folded in order of time: within a batch
rows of a step are sorted, and between batches the watermark says how late they may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "state string, holder long, expires long, attempts long"
RESULT = "step long, event_id long, at timestamp, kind string, accepted boolean, state string, attempts long"


@dataclass(frozen=True)
class Lease:
    """A step: ready, claimed, running or done; its holder, when the lease runs out (microseconds), and attempts so far."""

    state: str = "ready"
    holder: int = -1
    expires: int = -1
    attempts: int = 0

    def at(self, now: int) -> Lease:
        """The step at a time: ready again where its lease has run out."""
        return replace(self, state="ready", holder=-1, expires=-1) if 0 <= self.expires <= now else self

    def after(self, kind: str, worker: int, now: int, lease: int) -> tuple[Lease, bool]:
        """The step after an event, and whether the event was accepted. Events of other kinds change nothing."""
        if kind == "claim" and self.state == "ready":
            return replace(self, state="claimed", holder=worker, expires=now + lease), True
        if kind == "start" and self.state == "claimed" and self.holder == worker:
            return replace(self, state="running", attempts=self.attempts + 1), True
        if kind == "renew" and self.state in ("claimed", "running") and self.holder == worker:
            return replace(self, expires=now + lease), True
        if kind == "finish" and self.state == "running" and self.holder == worker:
            return replace(self, state="done", holder=-1, expires=-1), True
        return self, False


class Leases(StatefulProcessor):
    """One step's lease; a timer stands where it runs out."""

    def __init__(self, lease_seconds: float):
        self.lease = int(lease_seconds * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.kept = handle, handle.getValueState("lease", STATE)

    def held(self) -> Lease:
        return Lease(*self.kept.get()) if self.kept.exists() else Lease()

    def keep(self, before: Lease, now: Lease) -> None:
        self.kept.update((now.state, now.holder, now.expires, now.attempts))
        if before.expires != now.expires:
            if before.expires >= 0:
                self.handle.deleteTimer(timer(before))
            if now.expires >= 0:
                self.handle.registerTimer(timer(now))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        before = step = self.held()
        for r in sorted(rows, key=lambda r: (r["micros"], r["event_id"])):
            fresh = step.at(r["micros"])
            if fresh is not step:
                yield released(key, step)
            step, accepted = fresh.after(r["kind"], r["worker"], r["micros"], self.lease)
            yield Row(step=key[0], event_id=r["event_id"], at=moment(r["micros"]), kind=r["kind"], accepted=accepted, state=step.state, attempts=step.attempts)
        self.keep(before, step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        step = self.held()
        if step.expires >= 0 and timer(step) <= expiredTimerInfo.getExpiryTimeInMs():
            yield released(key, step)
            # The timer that fired is gone already.
            now = step.at(step.expires)
            self.kept.update((now.state, now.holder, now.expires, now.attempts))

    def close(self) -> None:
        pass


def timer(step: Lease) -> int:
    """Milliseconds, not before the lease runs out."""
    return -(-step.expires // 1000)


def moment(micros: int):
    import datetime

    return datetime.datetime.fromtimestamp(micros // 1_000_000, datetime.UTC) + datetime.timedelta(microseconds=micros % 1_000_000)


def released(key, step: Lease) -> Row:
    return Row(step=key[0], event_id=None, at=moment(step.expires), kind="released", accepted=True, state="ready", attempts=step.attempts)


def leased(events: DataFrame, lease_seconds: float, late: str = "1 hour") -> DataFrame:
    """Every event with whether it was accepted and what its step came to, and a row of kind "released" where a lease ran out.

    events, a stream: step long, event_id long, at timestamp, micros long (of at), kind string, worker long. Needs the RocksDB
    state store. A lease that nothing follows is given back when the watermark has passed its end.
    """
    known = events.select("step", "event_id", "at", "micros", "kind", "worker").withWatermark("at", late)
    return known.groupBy("step").transformWithState(statefulProcessor=Leases(lease_seconds), outputStructType=RESULT, outputMode="Append", timeMode="EventTime")
