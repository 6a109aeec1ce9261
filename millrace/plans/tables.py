"""Queries over streams, merges, searches by field, and tables as text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tables as B
from ..functions import text as T
from ..operators import ingest, retrieval
from ..session import table
from ..storage import remove, scratch, written
from ..streaming import logs as stream
from .stores import KEYS, NAMES

#: All files at once: rows of one batch are never late.
WHOLE = 1_000_000


def streamed(spark, sf, build, columns):
    """What a stream over the event log has given out once it has taken in all of it; columns are read from that."""
    path, source = scratch(spark, "stream"), f"{sf}/events.parquet"
    # A pattern, since a stream takes a single file only from one.
    log = stream.event_stream(spark, f"{source[:-1]}[{source[-1]}]", spark.read.parquet(source).schema, WHOLE)
    stream.run_into(build(log), f"{path}/out", f"{path}/state")
    result = written(spark.read.parquet(f"{path}/out").select(*columns), f"{path}-result")
    remove(spark, path)
    return result


def streamed_windows(spark, sf):
    """Totals by sliding hours and type, of windows that can't get any more rows."""
    build = lambda log: stream.windowed_totals(log, "1 hour", "30 minutes")
    return streamed(spark, sf, build, [F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 4).alias("total")])


def streamed_sessions(spark, sf):
    """Sessions of owners, ended by a pause of twelve hours, that can't get any longer."""
    build = lambda log: stream.sessions(log, "12 hours")
    rows = streamed(spark, sf, build, ["user_id", "n", F.unix_micros("session_window.start").alias("start")])
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("events"), F.max("n").alias("longest"))


def merged_balances(spark, sf):
    """Customers' records brought up to date with their orders: new values win, unknown ones leave what was there, names stay, and strangers come in."""
    old = table(spark, sf, "customer").filter("c_custkey % 4 <> 3").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.round("c_acctbal", 2).alias("balance"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.lit("from orders").alias("name"), F.round(F.sum("o_totalprice"), 2).alias("balance"))
    new = new.withColumn("balance", F.when(F.col("k") % 5 != 0, F.col("balance")))
    return ingest.merged(old, new, ["k"], keep_old=["name"])


def part_search(spark, sf):
    """For each nation's list of words, made of a part's name and another's type, the parts that hold most of them; names count double."""
    words = lambda c: T.words(F.col(c))
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), words("p_name").alias("name"), F.concat(words("p_type"), words("p_brand")).alias("body"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("query_id"))
    of = lambda key, c: n.join(table(spark, sf, "part"), F.col("p_partkey") == key).select("query_id", F.explode(words(c)).alias("term"))
    asked = of(F.col("query_id") + 1, "p_name").unionByName(of(F.col("query_id") * 3 + 2, "p_type")).filter("query_id % 6 <> 5").unionByName(n.filter("query_id % 6 = 5").withColumn("term", F.lit("nowhere")))
    return retrieval.field_search(parts, asked, 5).select("query_id", F.col("id").alias("p_partkey"), "score", F.col("rank").cast("long").alias("rank"))


def nation_tables(spark, sf):
    """Each region's nations with their customers as a table in Markdown, three lines long."""
    c = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"), F.min("c_name").alias("first"))
    rows = table(spark, sf, "nation").join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left").select("n_regionkey", F.struct(F.col("n_name").alias("nation"), "customers", F.concat("first", F.lit("|x\n y")).alias("first")).alias("r"))
    made = rows.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("r")).alias("rows"))
    return made.select("n_regionkey", B.markdown(F.col("rows"), ("nation", "customers", "first"), 3).alias("text"))


def table_prompts(spark, sf):
    """What a prompt says of every table: its columns, its rows as counted, and what it joins."""
    out = None
    for name, columns in NAMES.items():
        points = [f"{c} = {other}.{key}" for t, c, other, key in KEYS if t == name]
        listed = lambda x: F.array(*map(F.lit, x)).cast("array<string>")
        one = table(spark, sf, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), B.described(F.lit(name), listed(columns.split()), F.col("n"), listed(points)).alias("text"))
        out = one if out is None else out.unionByName(one)
    return out


MARK = "(SELECT max(epoch_us(ts)) FROM events) - 600000000"
WINDOWED = f"WITH w AS (SELECT event_type, value, unnest([epoch_us(ts) // 1800000000 * 1800000000, epoch_us(ts) // 1800000000 * 1800000000 - 1800000000]) AS s FROM events) SELECT strftime(make_timestamp(s), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w WHERE s + 3600000000 <= {MARK} GROUP BY s, event_type"
SESSIONS = f"WITH p AS (SELECT user_id, epoch_us(ts) AS t, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events), g AS (SELECT *, sum(CASE WHEN b IS NULL OR t - b >= 43200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM p), z AS (SELECT user_id, s, count(*) AS n FROM g GROUP BY 1, 2 HAVING max(t) + 43200000000 <= {MARK}) SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events, max(n) AS longest FROM z GROUP BY 1"
TERMS = "regexp_extract_all(lower({c}), '[a-z0-9]+')"
SEARCHED = f"""
WITH i AS (SELECT p_partkey AS id, {TERMS.format(c='p_name')} AS name, {TERMS.format(c='p_type')} || {TERMS.format(c='p_brand')} AS body FROM part),
q AS (SELECT DISTINCT n_nationkey::BIGINT AS query_id, unnest({TERMS.format(c='p_name')}) AS term FROM nation JOIN part ON p_partkey = n_nationkey + 1 WHERE n_nationkey % 6 <> 5 UNION SELECT DISTINCT n_nationkey, unnest({TERMS.format(c='p_type')}) FROM nation JOIN part ON p_partkey = n_nationkey * 3 + 2 WHERE n_nationkey % 6 <> 5 UNION SELECT n_nationkey, 'nowhere' FROM nation WHERE n_nationkey % 6 = 5),
s AS (SELECT query_id, id, sum(CASE WHEN list_contains(name, term) THEN 2 ELSE 1 END)::DOUBLE AS score FROM q JOIN i ON list_contains(name, term) OR list_contains(body, term) GROUP BY 1, 2),
f AS (SELECT query_id, id, 0::DOUBLE AS score FROM (SELECT DISTINCT query_id FROM q WHERE query_id NOT IN (SELECT query_id FROM s)), (SELECT id FROM i ORDER BY id LIMIT 5))
SELECT query_id, id AS p_partkey, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT * FROM s UNION ALL SELECT * FROM f) QUALIFY rank <= 5"""
MARKED = r"WITH c AS (SELECT c_nationkey, count(*) AS n, min(c_name) AS f FROM customer GROUP BY 1), r AS (SELECT n_regionkey, n_name, '| ' || n_name || ' | ' || coalesce(n::VARCHAR, '') || ' | ' || coalesce(f || '\|x y', '') || ' |' AS line, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_name) AS k, count(*) OVER (PARTITION BY n_regionkey) AS total FROM nation LEFT JOIN c ON c_nationkey = n_nationkey) SELECT n_regionkey, '| nation | customers | first |' || chr(10) || '|---|---|---|' || chr(10) || string_agg(line, chr(10) ORDER BY k) FILTER (k <= 3) || CASE WHEN any_value(total) > 3 THEN chr(10) || '... ' || (any_value(total) - 3) || ' more rows' ELSE '' END AS text FROM r GROUP BY 1"
POINTS = {t: ", ".join(f"{c} = {o}.{k}" for x, c, o, k in KEYS if x == t) for t in NAMES}
PROMPTS = " UNION ALL ".join(f"SELECT '{t}' AS table_name, 'table {t} (' || count(*) || ' rows)' || chr(10) || '  {', '.join(c.split())}'" + (f" || chr(10) || '  joins {POINTS[t]}'" if POINTS[t] else "") + f" AS text FROM {t}" for t, c in NAMES.items())

QUERIES = {
    "streamed_windows": (streamed_windows, WINDOWED),
    "streamed_sessions": (streamed_sessions, SESSIONS),
    "merged_balances": (merged_balances, "WITH o AS (SELECT c_custkey AS k, c_name AS name, round(c_acctbal, 2) AS balance FROM customer WHERE c_custkey % 4 <> 3), n AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 5 <> 0 THEN round(sum(o_totalprice), 2) END AS balance FROM orders GROUP BY 1) SELECT coalesce(o.k, n.k) AS k, coalesce(name, 'from orders') AS name, coalesce(n.balance, o.balance) AS balance FROM o FULL JOIN n ON o.k = n.k"),
    "part_search": (part_search, SEARCHED),
    "nation_tables": (nation_tables, MARKED),
    "table_prompts": (table_prompts, PROMPTS),
}
