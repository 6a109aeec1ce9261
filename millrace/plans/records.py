"""Queries over records in order of time, and over tables as wholes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vector as V
from ..operators import catalog, lines, stretches, vector_index
from ..session import spread, table
from ..storage import remove, scratch, written
from ..streaming import leases
from .stores import KEYS, foreign_keys

LEASE, TTL, ALIKE = 21_600.0, 200.0, 0.9
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def payments(spark, sf):
    """doc_id, supplier, at, account, decision: an invoice for each order, of suppliers one of which has a third of all.

    A supplier's account changes every third year; some invoices name none, and some a stranger's.
    """
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    supplier = F.when(F.col("o_custkey") % 3 == 0, "Central Goods").otherwise(F.concat_ws(" ", "c_mktsegment", "c_nationkey"))
    account = F.when(k % 13 == 5, None).when(k % 101 == 7, F.concat(F.lit("stranger "), k.cast("string"))).otherwise(F.concat_ws(" / ", supplier, F.floor(F.year("o_orderdate") / 3).cast("string")))
    decision = F.when(k % 50 == 0, "reject").when((k % 6 == 1) | (k % 202 == 7), "needs_review").otherwise("auto_approve")
    return rows.select(k.alias("doc_id"), supplier.alias("supplier"), F.col("o_orderdate").alias("at"), account.alias("account"), decision.alias("decision"))


def changed_accounts(spark, sf):
    """Invoices of suppliers that were paid to another account before: the last such, the invoice that it stood on, and whether it was the last one paid at all."""
    path = scratch(spark, "accounts")
    found = stretches.last_different(payments(spark, sf), "supplier", ["at", "doc_id"], "account", F.col("decision") == "auto_approve", f"{path}/rows")
    return found.select("doc_id", "account", F.col("expected.account").alias("expected"), F.col("expected.doc_id").alias("seen_on"), "since_last")


def semantic_cache_hits(spark, sf):
    """Stored vectors as a cache with a lifetime: every twentieth asks again for an earlier one in other words, some too late."""
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("scope"), F.col("vec_id").alias("at"))
    ago = F.when(F.col("at") % 60 == 0, 300).otherwise(7)
    asked = e.filter("at % 20 = 0").select(F.col("id").alias("request_id"), F.col("vector").alias("own"), F.col("at").alias("now"), (F.col("at") - ago).alias("id"))
    mixed = F.zip_with("vector", "own", lambda a, b: a.cast("double") * 0.95 + b.cast("double") * 0.3)
    requests = asked.join(e, "id").select(F.col("request_id").alias("id"), V.normalised(mixed).alias("vector"), "scope", F.col("now").alias("at"))
    return vector_index.live_matches(e, requests, TTL, ALIKE).select("request_id", F.col("id").alias("vec_id"), "score")


def step_events(events):
    """Events as those of workers on steps: views and sign-ups claim, clicks start, purchases finish, errors renew."""
    kind = F.when(F.col("event_type").isin("view", "signup"), "claim").when(F.col("event_type") == "click", "start").when(F.col("event_type") == "purchase", "finish").otherwise("renew")
    at = F.col("ts").cast("timestamp")
    return events.select(F.col("user_id").alias("step"), "event_id", at.alias("at"), F.unix_micros(at).alias("micros"), kind.alias("kind"), (F.col("event_id") % 2).alias("worker"))


def lease_log(spark, sf):
    """The event log as a stream of claims, starts and finishes: which were accepted, and what each step came to."""
    path, source = scratch(spark, "leases"), f"{sf}/events.parquet"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        # A pattern, since a stream takes a single file only from one. All files make one batch, which is sorted by step.
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source[:-1]}[{source[-1]}]")
        out = leases.leased(step_events(stream), LEASE).writeStream.format("parquet").outputMode("append")
        out.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass") if before is None else spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    found = spark.read.parquet(f"{path}/out").filter("event_id is not null")
    result = written(found.select("step", "event_id", "kind", "accepted", "state", "attempts"), f"{path}-result")
    remove(spark, path)
    return result


def join_paths(spark, sf):
    """How any two tables are joined, over the foreign keys that the rows bear out."""
    held = foreign_keys(spark, sf).filter("lost = 0")
    name = lambda c: F.substring_index(c, ".", 1)
    # As a table, a row for each key: the recursion reads the edges again and again.
    edges = written(held.select(name("column_name").alias("a"), name("target").alias("b")), scratch(spark, "edges"))
    return catalog.join_paths(edges)


#: Columns by table: i whole numbers, s text, d numbers to hundredths, t times, v vectors.
COLUMNS = {
    "region": "r_regionkey:i r_name:s", "nation": "n_nationkey:i n_name:s n_regionkey:i", "customer": "c_custkey:i c_name:s c_nationkey:i c_acctbal:d c_mktsegment:s",
    "supplier": "s_suppkey:i s_name:s s_nationkey:i s_acctbal:d", "part": "p_partkey:i p_name:s p_brand:s p_type:s p_size:i p_retailprice:d",
    "orders": "o_orderkey:i o_custkey:i o_orderstatus:s o_totalprice:d o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:i l_partkey:i l_suppkey:i l_linenumber:i l_quantity:d l_extendedprice:d l_discount:d l_tax:d l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:i ts:t user_id:i event_type:s value:d props:s", "documents": "doc_id:i text:s lang:s source:s n_chars:i", "embeddings": "vec_id:i embedding:v label:i",
    "pages": "page_id:i url:s html:s", "benchmark": "item_id:i text:s", "labels": "doc_id:i quality:i toxic:i", "conversations": "conv_id:i turn:i role:s text:s",
}
IN_SPARK = {"i": F.col, "s": F.col, "d": lambda c: F.round(F.col(c) * 100).cast("long"), "t": lambda c: F.unix_micros(F.col(c).cast("timestamp")), "v": lambda c: F.array_join(F.transform(c, lambda x: F.round(x.cast("double") * 1e6).cast("long")), ",")}
IN_SQL = {"i": "{c}", "s": "{c}", "d": "round({c} * 100)::BIGINT", "t": "epoch_us({c})", "v": "array_to_string(list_transform({c}, lambda x: round(x::DOUBLE * 1000000::DOUBLE)::BIGINT), ',')"}


def table_fingerprints(spark, sf):
    """Rows of every table, and a digest that changes with any of them, whatever their order."""
    out = None
    for name, columns in COLUMNS.items():
        made = [IN_SPARK[kind](c) for c, kind in (x.split(":") for x in columns.split())]
        one = catalog.fingerprint(table(spark, sf, name), made).select(F.lit(name).alias("table_name"), "n_rows", "total")
        out = one if out is None else out.unionByName(one)
    return out


def fingerprint_sql(name: str) -> str:
    made = [f"coalesce('=' || {IN_SQL[kind].format(c=c)}, '-')" for c, kind in (x.split(":") for x in COLUMNS[name].split())]
    return f"SELECT '{name}' AS table_name, count(*) AS n_rows, (coalesce(sum(('0x' || substr(md5({' || chr(1) || '.join(made)}), 1, 15))::BIGINT::HUGEINT), 0) % 1152921504606846976::HUGEINT)::BIGINT AS total FROM {name}"


def broken_lines(spark, sf):
    """Documents with the lines that sentences were broken into joined again."""
    text = lines.joined_lines(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.length(text).cast("long").alias("chars"), F.size(F.split(text, "\n")).cast("long").alias("n_lines"), F.md5(text).alias("digest"))


def quotable_lines(spark, sf):
    """The least stretch of lines around each line that stands once in its document: where it begins and how long it is."""
    found = lines.unique_blocks(spread(table(spark, sf, "documents")), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "line_no", "first", "span")


EDGES = " UNION ".join(f"SELECT '{t}' AS a, '{other}' AS b FROM (SELECT 1) WHERE NOT EXISTS (SELECT 1 FROM {t} WHERE {t}.{c} IS NULL OR {t}.{c} NOT IN (SELECT {other}.{key} FROM {other} WHERE {other}.{key} IS NOT NULL))" for t, c, other, key in KEYS)
PAYMENTS = "SELECT o_orderkey AS doc_id, s AS supplier, o_orderdate AS at, CASE WHEN o_orderkey % 13 = 5 THEN NULL WHEN o_orderkey % 101 = 7 THEN 'stranger ' || o_orderkey ELSE s || ' / ' || (year(o_orderdate) // 3) END AS account, o_orderkey % 50 <> 0 AND o_orderkey % 6 <> 1 AND o_orderkey % 202 <> 7 AS paid FROM (SELECT *, CASE WHEN o_custkey % 3 = 0 THEN 'Central Goods' ELSE c_mktsegment || ' ' || c_nationkey END AS s FROM orders JOIN customer ON o_custkey = c_custkey)"
LINES = "SELECT doc_id, string_split(text, chr(10)) AS x FROM documents"

QUERIES = {
    "changed_accounts": (changed_accounts, f"WITH p AS ({PAYMENTS}) SELECT a.doc_id, a.account, arg_max(b.account, (b.at, b.doc_id)) FILTER (b.account <> a.account) AS expected, arg_max(b.doc_id, (b.at, b.doc_id)) FILTER (b.account <> a.account) AS seen_on, arg_max(b.account <> a.account, (b.at, b.doc_id)) AS since_last FROM p a JOIN p b ON b.supplier = a.supplier AND b.paid AND b.account IS NOT NULL AND a.account IS NOT NULL AND (b.at, b.doc_id) < (a.at, a.doc_id) GROUP BY 1, 2 HAVING count(*) FILTER (b.account <> a.account) > 0"),
    "semantic_cache_hits": (semantic_cache_hits, "WITH r AS (SELECT q.vec_id AS request_id, e.label, list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * 0.95::DOUBLE + q.embedding[i]::DOUBLE * 0.3::DOUBLE) AS v FROM embeddings q JOIN embeddings e ON e.vec_id = q.vec_id - CASE WHEN q.vec_id % 60 = 0 THEN 300 ELSE 7 END WHERE q.vec_id % 20 = 0), s AS (SELECT request_id, vec_id, round(list_dot_product(v, embedding::DOUBLE[]) / sqrt(list_dot_product(v, v)), 4) AS score FROM r JOIN embeddings e ON e.label = r.label AND vec_id < request_id AND vec_id + 200 > request_id) SELECT * FROM s WHERE score >= 0.9 QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY score DESC, vec_id) = 1"),
    "lease_log": (lease_log, f"""
WITH RECURSIVE e AS (
  SELECT user_id AS step, event_id, epoch_us(ts) AS t, event_id % 2 AS worker, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS n,
         CASE WHEN event_type IN ('view', 'signup') THEN 'claim' WHEN event_type = 'click' THEN 'start' WHEN event_type = 'purchase' THEN 'finish' ELSE 'renew' END AS kind FROM events),
f AS (
  SELECT step, 0::BIGINT AS n, NULL::BIGINT AS event_id, '' AS kind, false AS accepted, 'ready' AS state, -1::BIGINT AS holder, -1::BIGINT AS expires, 0::BIGINT AS attempts FROM (SELECT DISTINCT step FROM e)
  UNION ALL
  SELECT step, n, event_id, kind, ok, CASE WHEN NOT ok THEN state WHEN kind = 'claim' THEN 'claimed' WHEN kind = 'start' THEN 'running' WHEN kind = 'finish' THEN 'done' ELSE state END,
         CASE WHEN ok AND kind = 'claim' THEN worker WHEN ok AND kind = 'finish' THEN -1 ELSE holder END,
         CASE WHEN ok AND kind IN ('claim', 'renew') THEN t + {int(LEASE)}000000 WHEN ok AND kind = 'finish' THEN -1 ELSE expires END, CASE WHEN ok AND kind = 'start' THEN attempts + 1 ELSE attempts END
  FROM (SELECT *, CASE kind WHEN 'claim' THEN state = 'ready' WHEN 'start' THEN state = 'claimed' AND holder = worker WHEN 'finish' THEN state = 'running' AND holder = worker ELSE state IN ('claimed', 'running') AND holder = worker END AS ok
        FROM (SELECT e.*, attempts, CASE WHEN expires BETWEEN 0 AND t THEN 'ready' ELSE state END AS state, CASE WHEN expires BETWEEN 0 AND t THEN -1 ELSE holder END AS holder, CASE WHEN expires BETWEEN 0 AND t THEN -1 ELSE expires END AS expires
              FROM f JOIN e ON e.step = f.step AND e.n = f.n + 1)))
SELECT step, event_id, kind, accepted, state, attempts FROM f WHERE n > 0"""),
    "join_paths": (join_paths, f"WITH RECURSIVE g AS ({EDGES}), x AS (SELECT a, b FROM g UNION SELECT b, a FROM g), w AS (SELECT DISTINCT a AS s, a AS u, [a] AS path FROM x UNION ALL SELECT s, b, list_append(path, b) FROM w JOIN x ON u = a WHERE NOT list_contains(path, b)), r AS (SELECT *, row_number() OVER (PARTITION BY s, u ORDER BY len(path), path) AS k FROM w WHERE s < u) SELECT s AS first, u AS second, array_to_string(path, ' > ') AS path, array_to_string(path[2:len(path) - 1], ',') AS between FROM r WHERE k = 1"),
    "table_fingerprints": (table_fingerprints, " UNION ALL ".join(map(fingerprint_sql, COLUMNS))),
    "broken_lines": (broken_lines, r"SELECT doc_id, len(t) AS chars, len(string_split(t, chr(10))) AS n_lines, md5(t) AS digest FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '[ \t\r\f\v]+(\n|$)', '\1', 'g'), '([^.!?:;\n])\n(\p{Ll})', '\1 \2', 'g'), '([^.!?:;\n])\n(\p{Ll})', '\1 \2', 'g') AS t FROM documents)"),
    "quotable_lines": (quotable_lines, f"WITH d AS ({LINES}), b AS (SELECT doc_id, i, s, array_to_string(x[i:i + s - 1], chr(10)) AS block FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1)) AS i FROM d), range(1, 13) t(s) WHERE i + s - 1 <= len(x)), u AS (SELECT doc_id, s, any_value(i) AS i FROM b GROUP BY doc_id, s, block HAVING count(*) = 1 AND regexp_matches(block, '\\S')), c AS (SELECT doc_id, i, s, unnest(range(i, i + s)) AS line_no FROM u) SELECT doc_id, line_no, i AS first, s AS span FROM c QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY s, i) = 1"),
}
