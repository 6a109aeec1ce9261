"""Queries over the request log (events) and experiments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stats
from ..operators import conversations, ingest, traces, workflow
from ..session import table

EVENTS = "events"
VARIANTS = [("control", 0.5), ("short", 0.3), ("long", 0.2)]


def events(spark, sf):
    return table(spark, sf, EVENTS)


def traces_totals(spark, sf):
    kind = F.col("event_type")
    return traces.totals(events(spark, sf), "value", {"errors": kind == "error", "purchases": kind == "purchase", "large": F.col("value") > 100}).select("n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "errors", "purchases", "large")


def traces_by_model(spark, sf):
    return traces.by_key(events(spark, sf), ["event_type"], "value").select("event_type", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def traces_by_owner(spark, sf):
    return traces.by_key(events(spark, sf), ["user_id"], "value").select("user_id", "n", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"))


def latency_percentiles(spark, sf):
    return traces.latency_percentiles(events(spark, sf), [], "value")


def latency_by_type(spark, sf):
    return traces.latency_percentiles(events(spark, sf), ["event_type"], "value")


def daily_spend(spark, sf):
    return traces.daily_spend(events(spark, sf), "user_id", "ts", "value").select("user_id", F.col("day").cast("string").alias("day"), F.round("spent", 4).alias("spent"), F.round("so_far", 4).alias("so_far"))


def over_budget(spark, sf):
    return traces.over_budget(events(spark, sf), "user_id", "ts", "value", "event_id", 100.0).select("event_id", "user_id", F.round("spent_before", 4).alias("spent_before"))


def fallbacks(spark, sf):
    return traces.fallbacks(events(spark, sf), "user_id", "ts", "event_id", "event_type").groupBy("before", "event_type").agg(F.count(F.lit(1)).alias("n"))


def token_bucket(spark, sf):
    return traces.token_bucket(events(spark, sf), "user_id", "ts", "event_id", 2.0, 1 / 86400)


def cache_hits(spark, sf):
    log = events(spark, sf).withColumn("k", F.from_json("props", "k int")["k"])
    return traces.cache_hits(log, ["event_type", "k"], "ts", "event_id", 86400.0).groupBy("event_type").agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("n"))


def props_by_key(spark, sf):
    return events(spark, sf).withColumn("k", F.from_json("props", "k int")["k"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("owners"))


def recent_events(spark, sf):
    return events(spark, sf).filter("event_type = 'error'").orderBy(F.desc("ts"), "event_id").limit(100).select("event_id", "user_id", F.round("value", 6).alias("value"))


def latest_by_owner(spark, sf):
    return ingest.last_by(events(spark, sf).select("user_id", F.struct("ts", "event_id").alias("o"), "event_type"), ["user_id"], "o").select("user_id", F.col("o.event_id").alias("event_id"), "event_type")


def hourly_windows(spark, sf):
    w = F.window("ts", "1 hour")
    return events(spark, sf).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def sessions(spark, sf):
    """Sessions of an owner end with a pause of a day."""
    s = events(spark, sf).groupBy(F.session_window("ts", "1 day"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.max("n").alias("longest"))


def experiment_assignment(spark, sf):
    unit = stats.unit_fraction("prompt", F.col("user_id"))
    return events(spark, sf).select("user_id").distinct().select("user_id", F.round(unit, 9).alias("fraction"), stats.assigned(unit, VARIANTS).alias("variant"))


def experiment_arms(spark, sf):
    labels = table(spark, sf, "labels")
    variant = stats.assigned(stats.unit_fraction("quality", F.col("doc_id")), [("a", 0.5), ("b", 0.5)])
    arms = labels.groupBy(variant.alias("variant")).agg(F.count(F.lit(1)).alias("samples"), F.sum("quality").cast("long").alias("successes"))
    return arms.withColumn("rate", F.round(F.try_divide("successes", "samples"), 6))


def experiment_verdict(spark, sf):
    arms = experiment_arms(spark, sf)
    of = lambda v, c: F.coalesce(F.max(F.when(F.col("variant") == v, F.col(c))), F.lit(0))
    one = arms.agg(of("a", "successes").alias("sa"), of("a", "samples").alias("na"), of("b", "successes").alias("sb"), of("b", "samples").alias("nb"))
    z = stats.pooled_z(F.col("sa"), F.col("na"), F.col("sb"), F.col("nb"))
    return one.select("sa", "na", "sb", "nb", F.round(z, 6).alias("z"), F.round(2 * (1 - stats.normal_cdf(F.abs(z))), 4).alias("p"))


def workflow_states(spark, sf):
    return workflow.state_of(events(spark, sf), "user_id", "event_id", "event_type", ["purchase"])


def first_decisions(spark, sf):
    return workflow.first_decisions(events(spark, sf).filter("event_type in ('purchase', 'error')"), ["user_id"], "event_id", "event_type")


def retry_attempts(spark, sf):
    return workflow.attempts(events(spark, sf), "user_id", "event_id", "event_type", "error", 3).select("event_id", F.col("attempt").cast("long").alias("attempt"), "retried", "delay")


def compensation_order(spark, sf):
    return workflow.compensations(events(spark, sf).filter("event_type = 'purchase'"), "user_id", "event_id").select("event_id", F.col("undo_no").cast("long").alias("undo_no"))


def expired_leases(spark, sf):
    return workflow.expired_leases(events(spark, sf), "user_id", "ts", "event_id", 86400.0).select("event_id", "user_id")


def first_effects(spark, sf):
    log = events(spark, sf).withColumn("key", F.sha2(F.concat_ws("|", F.col("user_id").cast("string"), "event_type"), 256))
    return conversations.first_effects(log, "key", "event_id").groupBy("event_type").agg(F.count_if("is_first").alias("effects"), F.count_if(~F.col("is_first")).alias("replayed"))


def event_positions(spark, sf):
    return conversations.next_positions(events(spark, sf), "user_id", "event_id").select("event_id", F.col("position").cast("long").alias("position"))


PCT = "SELECT {k} min(CASE WHEN r > round_even((n - 1) * 0.5, 0) THEN value END) AS p50, min(CASE WHEN r > round_even((n - 1) * 0.95, 0) THEN value END) AS p95, max(value) AS most FROM (SELECT {k} value, row_number() OVER ({p} ORDER BY value) AS r, count(*) OVER ({p}) AS n FROM events) {g}"
UNIT = "('0x' || substr(sha256('{e}|' || {u}::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE"
ARMS = f"SELECT CASE WHEN {UNIT.format(e='quality', u='doc_id')} < 0.5 THEN 'a' ELSE 'b' END AS variant, count(*) AS samples, sum(quality)::BIGINT AS successes FROM labels GROUP BY 1"
BOTH = f"SELECT max(CASE WHEN variant = 'a' THEN successes END) AS sa, max(CASE WHEN variant = 'a' THEN samples END) AS na, max(CASE WHEN variant = 'b' THEN successes END) AS sb, max(CASE WHEN variant = 'b' THEN samples END) AS nb FROM ({ARMS})"
VERDICT = f"WITH b AS ({BOTH}), z AS (SELECT *, (sb / nb - sa / na) / sqrt((sa + sb) / (na + nb) * (1 - (sa + sb) / (na + nb)) * (1 / na + 1 / nb)) AS z FROM b), t AS (SELECT *, 1 / (1 + 0.2316419::DOUBLE * abs(z)) AS t FROM z) SELECT sa, na, sb, nb, round(z, 6) AS z, round(2 * exp(-z * z / 2) / sqrt(6.283185307179586::DOUBLE) * (t * (0.319381530::DOUBLE + t * (-0.356563782::DOUBLE + t * (1.781477937::DOUBLE + t * (-1.821255978::DOUBLE + t * 1.330274429::DOUBLE))))), 4) AS p FROM t"
HAVE = "least(2.0::DOUBLE, b.tokens + (e.t - b.t) * (1::DOUBLE / 86400))"
BUCKET = f"WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events), b AS (SELECT user_id, event_id, n, t, 1.0::DOUBLE AS tokens, true AS allowed FROM e WHERE n = 1 UNION ALL SELECT e.user_id, e.event_id, e.n, e.t, CASE WHEN {HAVE} >= 1 THEN {HAVE} - 1 ELSE {HAVE} END, {HAVE} >= 1 FROM b JOIN e ON e.user_id = b.user_id AND e.n = b.n + 1) SELECT user_id, event_id, allowed FROM b"
QUERIES = {
    "traces_totals": (traces_totals, "SELECT count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases, count(*) FILTER (value > 100) AS large FROM events"),
    "traces_by_model": (traces_by_model, "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "traces_by_owner": (traces_by_owner, "SELECT user_id, count(*) AS n, round(sum(value), 4) AS total, round(avg(value), 6) AS mean FROM events GROUP BY 1"),
    "latency_percentiles": (latency_percentiles, PCT.format(k="", p="", g="")),
    "latency_by_type": (latency_by_type, PCT.format(k="event_type,", p="PARTITION BY event_type", g="GROUP BY event_type")),
    "daily_spend": (daily_spend, "SELECT user_id, day::VARCHAR AS day, round(spent, 4) AS spent, round(sum(spent) OVER (PARTITION BY user_id ORDER BY day), 4) AS so_far FROM (SELECT user_id, ts::DATE AS day, sum(value) AS spent FROM events GROUP BY 1, 2)"),
    "over_budget": (over_budget, "SELECT event_id, user_id, round(b, 4) AS spent_before FROM (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM events) WHERE b >= 100"),
    "fallbacks": (fallbacks, "SELECT before, event_type, count(*) AS n FROM (SELECT event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) WHERE before <> event_type GROUP BY 1, 2"),
    "token_bucket": (token_bucket, BUCKET),
    "cache_hits": (cache_hits, "SELECT event_type, count(*) FILTER (hit) AS hits, count(*) AS n FROM (SELECT event_type, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY event_type, (props->>'k')::INT ORDER BY ts, event_id)) <= 86400000000, false) AS hit FROM events) GROUP BY 1"),
    "props_by_key": (props_by_key, "SELECT (props->>'k')::INT AS k, count(*) AS n, count(DISTINCT user_id) AS owners FROM events GROUP BY 1"),
    "recent_events": (recent_events, "SELECT event_id, user_id, round(value, 6) AS value FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 100"),
    "latest_by_owner": (latest_by_owner, "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"),
    "hourly_windows": (hourly_windows, "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2"),
    "sessions": (sessions, "SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(CASE WHEN p IS NULL OR ts - p >= INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT user_id, ts, event_id, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)) GROUP BY 1, 2) GROUP BY 1"),
    "experiment_assignment": (experiment_assignment, f"SELECT user_id, round(f, 9) AS fraction, CASE WHEN f < 0.5 THEN 'control' WHEN f < 0.8 THEN 'short' WHEN f < 1.0 THEN 'long' END AS variant FROM (SELECT DISTINCT user_id, {UNIT.format(e='prompt', u='user_id')} AS f FROM events)"),
    "experiment_arms": (experiment_arms, f"SELECT *, round(successes / samples, 6) AS rate FROM ({ARMS})"),
    "experiment_verdict": (experiment_verdict, VERDICT),
    "workflow_states": (workflow_states, "SELECT user_id, coalesce(arg_min(event_type, event_id) FILTER (event_type = 'purchase'), arg_max(event_type, event_id)) AS state, count(*) AS n_events FROM events GROUP BY 1"),
    "first_decisions": (first_decisions, "SELECT user_id, arg_min(event_type, event_id) AS decision FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1"),
    "retry_attempts": (retry_attempts, "SELECT event_id, a AS attempt, a < 3 AS retried, CASE WHEN a < 3 THEN least(60.0, pow(2.0, a - 1)) END AS delay FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS a FROM events WHERE event_type = 'error')"),
    "compensation_order": (compensation_order, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS undo_no FROM events WHERE event_type = 'purchase'"),
    "expired_leases": (expired_leases, "SELECT event_id, user_id FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE epoch_us(nxt) - epoch_us(ts) > 86400000000"),
    "first_effects": (first_effects, "SELECT event_type, count(*) FILTER (event_id = f) AS effects, count(*) FILTER (event_id <> f) AS replayed FROM (SELECT *, min(event_id) OVER (PARTITION BY user_id, event_type) AS f FROM events) GROUP BY 1"),
    "event_positions": (event_positions, "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS position FROM events"),
}
