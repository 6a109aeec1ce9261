"""Queries over stores of records: lookups, lists, state from logs, permissions, limits, arguments and summaries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import arguments, ingest, workflow
from ..session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
KEYS = (("nation", "n_regionkey", "region", "r_regionkey"), ("customer", "c_nationkey", "nation", "n_nationkey"), ("supplier", "s_nationkey", "nation", "n_nationkey"), ("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("labels", "doc_id", "documents", "doc_id"))
NOW = "2024-02-01 00:00:00"


def events(spark, sf):
    return table(spark, sf, "events")


def by_owner(*order):
    return Window.partitionBy("user_id").orderBy(*order)


# Lookups and lists


def order_lookups(spark, sf):
    """Requested orders by identifiers as people type them; those that don't exist come back empty."""
    asked = table(spark, sf, "customer").select("c_custkey", F.concat(F.lit(" ord-"), (F.col("c_custkey") * 7).cast("string")).alias("asked"))
    key = F.regexp_extract(F.upper(F.trim("asked")), r"^ORD-(\d+)$", 1).try_cast("long")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return asked.select("c_custkey", key.alias("o_orderkey")).join(orders, "o_orderkey", "left").select("c_custkey", "o_orderkey", "o_orderstatus", F.col("o_orderstatus").isNotNull().alias("found"))


def customer_orders(spark, sf):
    """Orders of each customer, newest first."""
    order = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), "o_orderkey")
    return table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.row_number().over(order).cast("long").alias("place"))


def messages_in_order(spark, sf):
    order = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", (F.row_number().over(order) - 1).cast("long").alias("position"), F.length("text").cast("long").alias("chars"))


def audit_pages(spark, sf):
    """The latest 20 of the log, and the first five of each owner's: opposite orders."""
    latest = events(spark, sf).orderBy(F.desc("ts"), F.desc("event_id")).limit(20).select(F.lit("latest").alias("page"), "event_id")
    first = events(spark, sf).withColumn("n", F.row_number().over(by_owner("ts", "event_id"))).filter("n <= 5").select(F.lit("first").alias("page"), "event_id")
    return latest.unionByName(first)


def open_tickets(spark, sf):
    """Errors that no purchase of their owner followed, newest first by owner."""
    later = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(Window.partitionBy("user_id"))
    rows = events(spark, sf).withColumn("last", later).filter("event_type = 'error' and (last is null or last < event_id)")
    return rows.select("user_id", "event_id", F.row_number().over(by_owner(F.desc("event_id"))).cast("long").alias("place"))


def trace_lookups(spark, sf):
    """Traces by request, with what their JSON holds; bad JSON is empty."""
    asked = table(spark, sf, "customer").select((F.col("c_custkey") * 3).alias("event_id"))
    broken = F.when(F.col("event_id") % 5 == 0, F.concat("props", F.lit("}{"))).otherwise(F.col("props"))
    k = F.coalesce(F.from_json(F.when(~F.endswith(broken, F.lit("}{")), broken), "k int")["k"], F.lit(-1))
    return asked.join(events(spark, sf), "event_id").select("event_id", "event_type", k.alias("k"))


def seen_history(spark, sf):
    """What was seen before: not the rejected ones, the newest 50 of each source."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id", "left").filter("coalesce(toxic, 0) = 0")
    order = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    return docs.withColumn("n", F.row_number().over(order)).filter("n <= 50").select("source", "doc_id")


def oldest_reviews(spark, sf):
    """Documents that wait for a review, oldest first: 100."""
    waiting = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id").filter("quality = 0")
    return waiting.orderBy("doc_id").limit(100).select("doc_id")


def document_chunk_counts(spark, sf):
    """Documents a caller may see with the number of their chunks, those without any too."""
    docs = table(spark, sf, "documents").filter("lang in ('en', 'fr')").select("doc_id", "lang")
    chunks = ingest.chunks(table(spark, sf, "documents"), "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return docs.join(chunks, "doc_id", "left").select("doc_id", "lang", F.coalesce("n", F.lit(0)).alias("chunks"))


# The catalog


def table_columns(spark, sf):
    """Columns of every table in order, with the rows that have none of their value, by one pass over each table."""
    out = None
    for t in TABLES:
        rows = table(spark, sf, t)
        one = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in rows.columns])
        each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(n + 1).cast("long").alias("position"), F.col(c).alias("n_null")) for n, c in enumerate(rows.columns)])).alias("x")
        one = one.select(F.lit(t).alias("table_name"), each).select("table_name", "x.*")
        out = one if out is None else out.unionByName(one)
    return out


def table_counts(spark, sf):
    counted = [table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n") for t in TABLES]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


def foreign_keys(spark, sf):
    """Columns, what they point at, and rows that point at nothing."""
    out = None
    for t, c, other, key in KEYS:
        lost = table(spark, sf, t).join(table(spark, sf, other).select(F.col(key).alias("_key")).distinct(), F.col(c) == F.col("_key"), "left_anti")
        one = lost.agg(F.count(F.lit(1)).alias("lost")).select(F.lit(f"{t}.{c}").alias("column_name"), F.lit(f"{other}.{key}").alias("target"), "lost")
        out = one if out is None else out.unionByName(one)
    return out


# State from logs


def run_steps(spark, sf):
    """Steps of each run in order: the first is ready, those behind it are blocked until it is done."""
    rows = workflow.steps_in_order(events(spark, sf).select("user_id", "event_id", "event_type"), "user_id", "event_id", "event_type", "purchase")
    return rows.select("user_id", "event_id", "position", "state")


def next_steps(spark, sf):
    """The step each worker type claims next: of runs that don't end in an error, the first view by time; ties by identifier."""
    bad = events(spark, sf).groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("last")).filter("last = 'error'").select("user_id")
    ready = events(spark, sf).filter("event_type = 'view'").join(bad, "user_id", "left_anti")
    return ready.groupBy(F.col("event_id") % 4).agg(F.min(F.struct("ts", "event_id")).alias("x")).select((F.col("x.event_id") % 4).alias("worker"), F.col("x.event_id").alias("event_id"))


def pending_approvals(spark, sf):
    """The latest request of each run and kind that no later decision answers, with hours waiting."""
    kind = F.col("event_type").isin("click", "view")
    latest = events(spark, sf).filter(kind).groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("x"))
    decided = events(spark, sf).filter("event_type = 'purchase'").groupBy("user_id").agg(F.max("ts").alias("at"))
    both = latest.join(decided, "user_id", "left").filter("at is null or at < x.ts")
    hours = F.round((F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("x.ts").cast("timestamp"))) / 3.6e9, 2)
    return both.select("user_id", "event_type", F.col("x.event_id").alias("event_id"), hours.alias("hours"), (hours > 240).alias("expired"))


def conversation_state(spark, sf):
    """Partial updates: of each conversation the last value of every column that an update sets."""
    c = table(spark, sf, "conversations")
    short = F.when(F.length("text") < 200, F.md5("text"))
    return c.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by("role", "turn").alias("role"), F.max_by(short, F.when(short.isNotNull(), F.col("turn"))).alias("note"))


def merged_contexts(spark, sf):
    """Contexts of runs: keys of later additions win."""
    first = events(spark, sf).groupBy("user_id").agg(F.min_by("props", "event_id").alias("a"), F.max_by("event_type", "event_id").alias("b"))
    old = F.map_concat(F.from_json("a", "map<string,string>"), F.create_map(F.lit("state"), F.lit("new")))
    merged = F.map_concat(F.map_filter(old, lambda k, v: k != "state"), F.create_map(F.lit("state"), F.col("b")))
    return first.select("user_id", merged["k"].alias("k"), merged["state"].alias("state"))


def cascade_deletes(spark, sf):
    """Chunks that go with deleted documents, and those that stay, by source."""
    chunks = ingest.chunks(table(spark, sf, "documents"), "doc_id", "text").groupBy(F.col("id").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    gone = table(spark, sf, "labels").filter("toxic = 1").select("doc_id", F.lit(True).alias("deleted"))
    rows = table(spark, sf, "documents").select("doc_id", "source").join(chunks, "doc_id", "left").join(gone, "doc_id", "left")
    return rows.groupBy("source", F.coalesce("deleted", F.lit(False)).alias("deleted")).agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("chunks"))


def purged_cache(spark, sf):
    """Entries of the cache by scope: the newest by key, kept or expired after ten days."""
    newest = events(spark, sf).groupBy("event_type", "user_id").agg(F.max("ts").alias("at"))
    expired = F.unix_micros(F.lit(NOW).cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp")) > 10 * 86400 * 1_000_000
    return newest.groupBy("event_type").agg(F.count_if(expired).alias("purged"), F.count_if(~expired).alias("kept"))


def cache_candidates(spark, sf):
    """Live entries of a scope, the newest five."""
    order = Window.partitionBy("event_type").orderBy(F.desc("ts"), "event_id")
    live = events(spark, sf).filter(F.col("ts") >= F.lit("2024-01-15").cast("timestamp"))
    return live.withColumn("n", F.row_number().over(order)).filter("n <= 5").select("event_type", "event_id", F.col("n").cast("long").alias("place"))


def remembered_scores(spark, sf):
    """Grades that arrive late update their trace: the last grade of each, traces without one stay without. Clicks grade the trace of their ten events."""
    grades = events(spark, sf).filter("event_type = 'click'").select((F.col("event_id") - F.col("event_id") % 10).alias("request"), F.struct("event_id").alias("o"), F.round("value", 3).alias("score"))
    last = ingest.last_by(grades, ["request"], "o").select("request", "score")
    traces = events(spark, sf).filter("event_id % 10 = 0").select(F.col("event_id").alias("request"), "user_id")
    return traces.join(last, "request", "left").select("request", "user_id", "score")


# Permissions, limits, arguments


def resolved_tags(spark, sf):
    """What callers ask for and may have: all that is permitted where nothing is asked for."""
    k = F.col("c_custkey")
    permitted = F.when(k % 3 == 0, F.array(F.lit("public"))).otherwise(F.array(F.lit("public"), F.lit("internal")))
    asked = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, F.array(F.lit("internal"))).otherwise(F.array(F.lit("secret"), F.lit("public")))
    granted = F.when(F.size(asked) == 0, permitted).otherwise(F.array_intersect(asked, permitted))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(F.sort_array(granted), ",").alias("tags"))


def acting_callers(spark, sf):
    """Orders that callers load: staff any, customers their own; missing and forbidden ones look alike, and only forbidden ones leave a note."""
    asked = table(spark, sf, "customer").select(F.col("c_custkey").alias("caller"), (F.col("c_custkey") % 10 == 0).alias("staff"), (F.col("c_custkey") * 7 + F.col("c_custkey") % 13).alias("o_orderkey"))
    both = asked.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", "left")
    own = F.col("staff") | (F.col("o_custkey") == F.col("caller"))
    return both.select("caller", F.when(F.col("o_custkey").isNotNull() & own, "order").otherwise("not found").alias("reply"), F.coalesce(F.col("o_custkey").isNotNull() & ~own, F.lit(False)).alias("noted"))


def budget_limits(spark, sf):
    """The first limit that an owner's use has exhausted: seconds, then tokens less a reserve, then calls."""
    used = events(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("tokens"), F.count_if(F.col("event_type") == "error").alias("errors"))
    limit = F.when(F.col("errors") * 30 >= 60, "seconds").when(F.col("tokens") >= 1000 * 0.85, "tokens").when(F.col("calls") >= 15, "calls").otherwise("none")
    return used.groupBy(limit.alias("limit")).agg(F.count(F.lit(1)).alias("owners"))


def failure_routes(spark, sf):
    """What follows a failure by its kind: another attempt, another route, or neither."""
    kind = F.when(F.col("value") < 10, "bad_request").when(F.col("value") < 40, "timeout").when(F.col("value") < 80, "rate_limited").otherwise("auth")
    failed = events(spark, sf).filter("event_type = 'error'").select(kind.alias("kind"))
    return failed.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.first(F.col("kind").isin("timeout", "rate_limited")).alias("retried"), F.first(F.col("kind") != "bad_request").alias("falls_back"))


REFUND = (arguments.Argument("order_id", required=True), arguments.Argument("amount", "number", required=True), arguments.Argument("quantity", "integer"))


def argument_checks(spark, sf):
    """Calls made of orders against a schema: what is missing or of another kind, and the arguments made clean."""
    k = F.col("o_orderkey")
    text = k.cast("string")
    order = F.when(k % 7 == 0, '"order_id": "  "').when(k % 7 == 1, '"order_id": null').when(k % 7 == 2, F.concat(F.lit('"order_id": '), text)).when(k % 7 == 4, '"order_id": [1]').when(k % 7 != 3, F.concat(F.lit('"order_id": " ORD-'), text, F.lit(' "')))
    amount = F.concat(F.lit('"amount": '), F.when(k % 5 == 0, "true").when(k % 5 == 1, '"12.5"').when(k % 5 == 2, '"much"').otherwise(text))
    quantity = F.when(k % 11 == 0, '"quantity": 2.5').when(k % 11 == 1, '"quantity": "3"').when(k % 11 == 2, '"quantity": "x"').when(k % 11 == 3, '"quantity": true').when(k % 11 != 4, F.concat(F.lit('"quantity": '), (k % 9).cast("string")))
    listed = F.when(k % 2 == 0, F.concat_ws(", ", order, amount, quantity, F.lit('"other": {}'))).otherwise(F.concat_ws(", ", F.lit('"other": 1'), quantity, amount, order))
    calls = table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("{"), listed, F.lit("}")).alias("call"))
    made = calls.select("o_orderkey", arguments.problem(F.col("call"), REFUND).alias("problem"), arguments.cleaned(F.col("call"), REFUND).alias("a"))
    return made.select("o_orderkey", "problem", "a.*")


def escalations(spark, sf):
    """Conversations that a person takes over, by the first rule that holds: asked for, abuse, turns, failures, anger."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("turns"), F.count_if(F.length("text") < 40).alias("failures"), F.max(F.contains(F.lower("text"), F.lit("person"))).alias("asked"), F.max(F.contains(F.lower("text"), F.lit("!"))).alias("angry"))
    reason = F.when(F.col("asked"), "asked").when(F.col("turns") >= 8, "turns").when(F.col("failures") >= 3, "failures").when(F.col("angry") & ((F.col("turns") >= 3) | (F.col("failures") >= 1)), "angry").otherwise("none")
    return c.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


# Summaries


def usage_breakdown(spark, sf):
    """Cost by stage from partial sums of each day, merged."""
    parts = events(spark, sf).groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("tokens"))
    merged = parts.groupBy("event_type").agg(F.sum("calls").alias("calls"), F.sum("tokens").alias("tokens"))
    price = F.when(F.col("event_type") == "purchase", 0.6).when(F.col("event_type") == "click", 0.15).otherwise(0.0)
    return merged.select("event_type", "calls", F.round("tokens", 3).alias("tokens"), F.round(F.col("tokens") / 1e6 * price, 9).alias("cost"))


def metrics_snapshot(spark, sf):
    """Counters and rates of the log in one row."""
    kind = F.col("event_type")
    one = events(spark, sf).agg(F.count(F.lit(1)).alias("requests"), F.count_if(kind == "view").alias("hits"), F.count_if(kind == "error").alias("failures"), F.avg("value").alias("mean"))
    rate = lambda c: F.round(F.coalesce(F.try_divide(c, "requests"), F.lit(0.0)), 4)
    return one.select("requests", rate("hits").alias("hit_rate"), rate("failures").alias("failure_rate"), F.round("mean", 4).alias("mean"))


def evaluation_summary(spark, sf):
    """Checks of labelled documents: passes, failures that matter, and rates by source, with a total."""
    rows = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels"), "doc_id")
    summed = rows.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.sum("quality").cast("long").alias("passed"), F.sum("toxic").cast("long").alias("critical"))
    return summed.select(F.coalesce("source", F.lit("all")).alias("source"), "n", "passed", "critical", F.round(F.col("passed") / F.col("n"), 4).alias("rate"))


def regressions(spark, sf):
    """Two runs of the same checks: what broke, vanished, was mended or is new. A baseline by labels, a second run by even identifiers."""
    before = table(spark, sf, "labels").select("doc_id", (F.col("quality") == 1).alias("was"))
    after = table(spark, sf, "documents").filter("doc_id % 3 <> 0").select("doc_id", (F.col("doc_id") % 2 == 0).alias("now"))
    both = before.join(after, "doc_id", "full_outer")
    change = F.when(F.col("was") & F.col("now").isNull(), "vanished").when(F.col("was") & ~F.col("now"), "broken").when(~F.col("was") & F.col("now"), "mended").when(F.col("was").isNull(), "new").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count(F.lit(1)).alias("n"))


def chosen_owners(spark, sf):
    """Ranked owners that reach a sixth of the best score and 2.5, by score and identifier, the first twelve."""
    scored = events(spark, sf).groupBy("user_id").agg(F.round(F.sum("value"), 3).alias("score"))
    best = scored.agg(F.max("score").alias("best"))
    kept = scored.join(F.broadcast(best)).filter(F.col("score") >= F.greatest(F.col("best") * 0.15, F.lit(2.5)))
    return kept.orderBy(F.desc("score"), "user_id").limit(12).select("user_id", "score")


def equivalents(spark, sf):
    """Names that stand for one another: those of one group, both ways."""
    n = table(spark, sf, "nation").select("n_regionkey", F.lower("n_name").alias("word"))
    return n.join(n.select("n_regionkey", F.col("word").alias("other")), "n_regionkey").filter("word <> other").select("word", "other").distinct()


def equal_results(spark, sf):
    """Whether two ways of asking give the same multiset of rows, by nation."""
    c = table(spark, sf, "customer")
    a = c.groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("v"))
    b = c.groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("s")).groupBy("c_nationkey").agg(F.round(F.sum("s") + F.when(F.col("c_nationkey") % 5 == 0, 1).otherwise(0), 2).alias("w"))
    return a.join(b, "c_nationkey").select("c_nationkey", (F.abs(F.col("v") - F.col("w")) < 0.02).alias("equal"))


# Identifiers and prices


def identifiers(spark, sf):
    """Keys made from records: of documents, scopes, calls and effects."""
    k, name = F.col("c_custkey").cast("string"), F.col("c_name")
    scope = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("team-"), k)).otherwise(name)
    call = F.to_json(F.map_from_entries(F.sort_array(F.map_entries(F.create_map(F.lit("order"), k, F.lit("amount"), F.lit("5"))))))
    cut = lambda c, n: F.substring(F.sha2(c, 256), 1, n)
    return table(spark, sf, "customer").select(
        "c_custkey", cut(F.concat_ws("||", F.lit("file"), name), 16).alias("document"), scope.alias("scope"), call.alias("arguments"),
        cut(F.concat_ws("|", name, F.lit("refund"), call), 32).alias("effect"), F.concat(F.lit("LAP-"), F.upper(cut(name, 10))).alias("device"),
        F.round(F.conv(cut(F.concat_ws("||", F.lit("fail"), k), 12), 16, 10).cast("long") / F.lit(float(16**12)), 9).alias("unit"))


PRICES = [("view", 0.15, 0.6), ("click", 2.5, 10.0), ("purchase", 0.02, 0.0)]


def call_costs(spark, sf):
    """Costs by kind of call: kinds without a price are free in one account and take the dearest price in another."""
    prices = spark.createDataFrame(PRICES, "event_type string, input double, output double")
    used = events(spark, sf).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor("value")).cast("long").alias("tokens"))
    both = used.join(F.broadcast(prices), "event_type", "left")
    cost = lambda i, o: F.round(F.col("tokens") / 1e6 * F.coalesce("input", F.lit(i)) + F.col("n") / 1e6 * F.coalesce("output", F.lit(o)), 8)
    return both.select("event_type", "tokens", cost(0.0, 0.0).alias("cost"), cost(2.5, 10.0).alias("with_fallback"), F.col("input").isNotNull().alias("known"))


def page_media(spark, sf):
    """Pages by the kind of file that their path names."""
    path = F.coalesce(F.parse_url("url", F.lit("PATH")), F.lit(""))
    suffix = F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.when(suffix.isin(".html", ".htm", ""), "html").when(suffix.isin(".txt", ".md"), "text").when(suffix == ".pdf", "pdf").when(suffix.isin(".png", ".jpg", ".jpeg", ".webp"), "image").otherwise("other")
    return table(spark, sf, "pages").groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


CHUNKS = "WITH w AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS n FROM documents), s AS (SELECT doc_id, n, unnest(CASE WHEN n = 0 THEN [] ELSE list_filter(range(0, greatest(0, n - 41) + 1, 140), lambda s: s = 0 OR n - s - 40 >= 12) END) AS s FROM w), ch AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, CASE WHEN s = max(s) OVER (PARTITION BY doc_id) THEN n - s ELSE 180 END AS k FROM s) WHERE k >= 6 GROUP BY 1)"
BAD = ["CASE WHEN o % 7 = 4 THEN 'order_id must be text' END", "CASE WHEN o % 5 IN (0, 2) THEN 'amount must be a number' END", "CASE WHEN o % 11 IN (0, 2, 3) THEN 'quantity must be a whole number' END"]
#: The tables' columns, so that SQL can count each.
NAMES = {
    "region": "r_regionkey r_name", "nation": "n_nationkey n_name n_regionkey", "customer": "c_custkey c_name c_nationkey c_acctbal c_mktsegment", "supplier": "s_suppkey s_name s_nationkey s_acctbal",
    "part": "p_partkey p_name p_brand p_type p_size p_retailprice", "orders": "o_orderkey o_custkey o_orderstatus o_totalprice o_orderdate o_orderpriority",
    "lineitem": "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax l_returnflag l_linestatus l_shipdate", "events": "event_id ts user_id event_type value props",
    "documents": "doc_id text lang source n_chars", "embeddings": "vec_id embedding label", "pages": "page_id url html", "benchmark": "item_id text", "labels": "doc_id quality toxic", "conversations": "conv_id turn role text",
}
COLUMN_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {n + 1} AS position, count(*) FILTER ({c} IS NULL) AS n_null FROM {t}" for t in TABLES for n, c in enumerate(NAMES[t].split()))
QUERIES = {
    "order_lookups": (order_lookups, "SELECT c_custkey, c_custkey * 7 AS o_orderkey, o_orderstatus, o_orderstatus IS NOT NULL AS found FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7"),
    "customer_orders": (customer_orders, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS place FROM orders"),
    "messages_in_order": (messages_in_order, "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position, len(text) AS chars FROM conversations"),
    "audit_pages": (audit_pages, "(SELECT 'latest' AS page, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20) UNION ALL SELECT 'first', event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 5"),
    "open_tickets": (open_tickets, "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS place FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS l FROM events) WHERE event_type = 'error' AND (l IS NULL OR l < event_id)"),
    "trace_lookups": (trace_lookups, "SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN -1 ELSE coalesce((props->>'k')::INT, -1) END AS k FROM events JOIN customer ON event_id = c_custkey * 3"),
    "seen_history": (seen_history, "SELECT source, doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE coalesce(toxic, 0) = 0 QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) <= 50"),
    "oldest_reviews": (oldest_reviews, "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE quality = 0 ORDER BY doc_id LIMIT 100"),
    "document_chunk_counts": (document_chunk_counts, f"{CHUNKS} SELECT doc_id, lang, coalesce(n, 0) AS chunks FROM documents LEFT JOIN ch USING (doc_id) WHERE lang IN ('en', 'fr')"),
    "table_columns": (table_columns, COLUMN_SQL),
    "table_counts": (table_counts, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in TABLES)),
    "foreign_keys": (foreign_keys, " UNION ALL ".join(f"SELECT '{t}.{c}' AS column_name, '{o}.{k}' AS target, count(*) AS lost FROM {t} WHERE NOT EXISTS (SELECT 1 FROM {o} x WHERE x.{k} = {t}.{c})" for t, c, o, k in KEYS)),
    "run_steps": (run_steps, "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS d FROM events) SELECT user_id, event_id, n - 1 AS position, CASE WHEN event_id <= d THEN 'done' WHEN n = min(CASE WHEN d IS NULL OR event_id > d THEN n END) OVER (PARTITION BY user_id) THEN 'ready' ELSE 'blocked' END AS state FROM r"),
    "next_steps": (next_steps, "SELECT worker, event_id FROM (SELECT event_id % 4 AS worker, event_id, row_number() OVER (PARTITION BY event_id % 4 ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'view' AND user_id NOT IN (SELECT user_id FROM events GROUP BY 1 HAVING arg_max(event_type, event_id) = 'error')) WHERE n = 1"),
    "pending_approvals": (pending_approvals, f"WITH l AS (SELECT user_id, event_type, ts, event_id FROM events WHERE event_type IN ('click', 'view') QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1), d AS (SELECT user_id, max(ts) AS decided FROM events WHERE event_type = 'purchase' GROUP BY 1), h AS (SELECT l.*, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(ts)) / 3.6e9::DOUBLE, 2) AS hours FROM l LEFT JOIN d USING (user_id) WHERE decided IS NULL OR decided < ts) SELECT user_id, event_type, event_id, hours, hours > 240 AS expired FROM h"),
    "conversation_state": (conversation_state, "SELECT conv_id, max(turn) AS turn, arg_max(role, turn) AS role, arg_max(md5(text), turn) FILTER (len(text) < 200) AS note FROM conversations GROUP BY 1"),
    "merged_contexts": (merged_contexts, "SELECT user_id, arg_min(props, event_id)->>'k' AS k, arg_max(event_type, event_id) AS state FROM events GROUP BY 1"),
    "cascade_deletes": (cascade_deletes, f"{CHUNKS} SELECT source, coalesce(toxic = 1, false) AS deleted, count(*) AS documents, coalesce(sum(n), 0)::BIGINT AS chunks FROM documents LEFT JOIN ch USING (doc_id) LEFT JOIN labels USING (doc_id) GROUP BY 1, 2"),
    "purged_cache": (purged_cache, f"SELECT event_type, count(*) FILTER (old) AS purged, count(*) FILTER (NOT old) AS kept FROM (SELECT event_type, user_id, epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts)) > 864000000000 AS old FROM events GROUP BY 1, 2) GROUP BY 1"),
    "cache_candidates": (cache_candidates, "SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id) AS place FROM events WHERE ts >= TIMESTAMP '2024-01-15' QUALIFY place <= 5"),
    "remembered_scores": (remembered_scores, "SELECT t.event_id AS request, t.user_id, score FROM events t LEFT JOIN (SELECT event_id - event_id % 10 AS request, round(arg_max(value, event_id), 3) AS score FROM events WHERE event_type = 'click' GROUP BY 1) g ON g.request = t.event_id WHERE t.event_id % 10 = 0"),
    "resolved_tags": (resolved_tags, "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN CASE WHEN c_custkey % 3 = 0 THEN 'public' ELSE 'internal,public' END WHEN c_custkey % 4 = 1 THEN CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'internal' END ELSE 'public' END AS tags FROM customer"),
    "acting_callers": (acting_callers, "SELECT c_custkey AS caller, CASE WHEN o_custkey IS NOT NULL AND (c_custkey % 10 = 0 OR o_custkey = c_custkey) THEN 'order' ELSE 'not found' END AS reply, coalesce(o_custkey IS NOT NULL AND NOT (c_custkey % 10 = 0 OR o_custkey = c_custkey), false) AS noted FROM customer LEFT JOIN orders ON o_orderkey = c_custkey * 7 + c_custkey % 13"),
    "budget_limits": (budget_limits, "SELECT CASE WHEN e * 30 >= 60 THEN 'seconds' WHEN t >= 850 THEN 'tokens' WHEN c >= 15 THEN 'calls' ELSE 'none' END AS \"limit\", count(*) AS owners FROM (SELECT user_id, count(*) AS c, sum(value) AS t, count(*) FILTER (event_type = 'error') AS e FROM events GROUP BY 1) GROUP BY 1"),
    "failure_routes": (failure_routes, "SELECT kind, count(*) AS n, kind IN ('timeout', 'rate_limited') AS retried, kind <> 'bad_request' AS falls_back FROM (SELECT CASE WHEN value < 10 THEN 'bad_request' WHEN value < 40 THEN 'timeout' WHEN value < 80 THEN 'rate_limited' ELSE 'auth' END AS kind FROM events WHERE event_type = 'error') GROUP BY 1"),
    "argument_checks": (argument_checks, f"SELECT o_orderkey, CASE WHEN o % 7 IN (0, 1, 3) THEN 'missing: order_id' WHEN o % 2 = 0 THEN coalesce({BAD[0]}, {BAD[1]}, {BAD[2]}, '') ELSE coalesce({BAD[2]}, {BAD[1]}, {BAD[0]}, '') END AS problem, CASE o % 7 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN o::VARCHAR WHEN 3 THEN NULL WHEN 4 THEN '[1]' ELSE 'ORD-' || o END AS order_id, CASE o % 5 WHEN 0 THEN 0 WHEN 1 THEN 12.5 WHEN 2 THEN 0 ELSE o END::DOUBLE AS amount, CASE o % 11 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 0 WHEN 3 THEN 0 WHEN 4 THEN NULL ELSE o % 9 END::BIGINT AS quantity FROM (SELECT o_orderkey, o_orderkey AS o FROM orders)"),
    "escalations": (escalations, "SELECT CASE WHEN asked THEN 'asked' WHEN turns >= 8 THEN 'turns' WHEN failures >= 3 THEN 'failures' WHEN angry AND (turns >= 3 OR failures >= 1) THEN 'angry' ELSE 'none' END AS reason, count(*) AS n FROM (SELECT conv_id, count(*) FILTER (role = 'user') AS turns, count(*) FILTER (len(text) < 40) AS failures, bool_or(contains(lower(text), 'person')) AS asked, bool_or(contains(text, '!')) AS angry FROM conversations GROUP BY 1) GROUP BY 1"),
    "usage_breakdown": (usage_breakdown, "SELECT event_type, count(*) AS calls, round(sum(value), 3) AS tokens, round(sum(value) / 1e6 * CASE event_type WHEN 'purchase' THEN 0.6 WHEN 'click' THEN 0.15 ELSE 0 END::DOUBLE, 9) AS cost FROM events GROUP BY 1"),
    "metrics_snapshot": (metrics_snapshot, "SELECT count(*) AS requests, round(count(*) FILTER (event_type = 'view') / count(*), 4) AS hit_rate, round(count(*) FILTER (event_type = 'error') / count(*), 4) AS failure_rate, round(avg(value), 4) AS mean FROM events"),
    "evaluation_summary": (evaluation_summary, "SELECT coalesce(source, 'all') AS source, count(*) AS n, sum(quality)::BIGINT AS passed, sum(toxic)::BIGINT AS critical, round(sum(quality) / count(*), 4) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (source)"),
    "regressions": (regressions, "SELECT CASE WHEN was AND now IS NULL THEN 'vanished' WHEN was AND NOT now THEN 'broken' WHEN NOT was AND now THEN 'mended' WHEN was IS NULL THEN 'new' ELSE 'same' END AS change, count(*) AS n FROM (SELECT doc_id, quality = 1 AS was FROM labels) b FULL JOIN (SELECT doc_id, doc_id % 2 = 0 AS now FROM documents WHERE doc_id % 3 <> 0) a USING (doc_id) GROUP BY 1"),
    "chosen_owners": (chosen_owners, "WITH s AS (SELECT user_id, round(sum(value), 3) AS score FROM events GROUP BY 1) SELECT user_id, score FROM s WHERE score >= greatest(0.15::DOUBLE * (SELECT max(score) FROM s), 2.5) ORDER BY score DESC, user_id LIMIT 12"),
    "equivalents": (equivalents, "SELECT DISTINCT lower(a.n_name) AS word, lower(b.n_name) AS other FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_name <> b.n_name"),
    "identifiers": (identifiers, "SELECT c_custkey, substr(sha256('file||' || c_name), 1, 16) AS document, CASE WHEN c_custkey % 3 = 0 THEN 'team-' || c_custkey ELSE c_name END AS scope, a AS arguments, substr(sha256(c_name || '|refund|' || a), 1, 32) AS effect, 'LAP-' || upper(substr(sha256(c_name), 1, 10)) AS device, round(('0x' || substr(sha256('fail||' || c_custkey), 1, 12))::BIGINT / 281474976710656.0::DOUBLE, 9) AS unit FROM (SELECT *, '{\"amount\":\"5\",\"order\":\"' || c_custkey || '\"}' AS a FROM customer)"),
    "call_costs": (call_costs, f"WITH p(event_type, i, o) AS (VALUES {', '.join(map(str, PRICES))}), u AS (SELECT event_type, count(*) AS n, sum(floor(value))::BIGINT AS tokens FROM events GROUP BY 1) SELECT event_type, tokens, round(tokens / 1e6 * coalesce(i, 0)::DOUBLE + n / 1e6 * coalesce(o, 0)::DOUBLE, 8) AS cost, round(tokens / 1e6 * coalesce(i, 2.5)::DOUBLE + n / 1e6 * coalesce(o, 10)::DOUBLE, 8) AS with_fallback, i IS NOT NULL AS known FROM u LEFT JOIN p USING (event_type)"),
    "page_media": (page_media, r"SELECT CASE WHEN s IN ('.html', '.htm', '') THEN 'html' WHEN s IN ('.txt', '.md') THEN 'text' WHEN s = '.pdf' THEN 'pdf' WHEN s IN ('.png', '.jpg', '.jpeg', '.webp') THEN 'image' ELSE 'other' END AS kind, count(*) AS n FROM (SELECT lower(regexp_extract(regexp_extract(url, '://[^/?#]+([^?#]*)', 1), '(\.[A-Za-z0-9]+)$', 1)) AS s FROM pages) GROUP BY 1"),
    "equal_results": (equal_results, "SELECT c_nationkey, c_nationkey % 5 <> 0 AS equal FROM customer GROUP BY 1"),
}
