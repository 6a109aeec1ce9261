"""Questions to the sales warehouse: revenue, counts, averages, rankings and returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table



def lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").withColumn("revenue", F.expr("l_extendedprice * (1 - l_discount)"))


def sales(spark: SparkSession, sf: str) -> DataFrame:
    """Lines with their order and its customer."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderpriority", "o_orderstatus")
    customer = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    return lines(spark, sf).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customer, F.col("o_custkey") == F.col("c_custkey"))


SALES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"
money = lambda c: F.round(F.sum(c), 4)


def revenue_by_segment(spark, sf):
    return sales(spark, sf).groupBy("c_mktsegment").agg(money("revenue").alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def revenue_by_nation(spark, sf):
    nation = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return sales(spark, sf).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(money("revenue").alias("revenue"))


def revenue_by_month(spark, sf):
    return sales(spark, sf).groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(money("revenue").alias("revenue"), F.count(F.lit(1)).alias("n"))


def revenue_by_brand(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    return lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(money("revenue").alias("revenue"), F.sum("l_quantity").alias("quantity"))


def top_parts(spark, sf, n: int = 5):
    part = table(spark, sf, "part").select("p_partkey", "p_name")
    sold = lines(spark, sf).groupBy("l_partkey").agg(money("revenue").alias("revenue"))
    return sold.join(part, F.col("l_partkey") == F.col("p_partkey")).select("p_partkey", "p_name", "revenue").orderBy(F.desc("revenue"), "p_partkey").limit(n)


def orders_by_priority(spark, sf):
    return table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


def average_order_value(spark, sf):
    by_order = lines(spark, sf).groupBy("l_orderkey").agg(F.sum("revenue").alias("value"))
    return by_order.agg(F.round(F.avg("value"), 4).alias("average_order_value"), F.count(F.lit(1)).alias("n_orders"))


def customers_by_segment(spark, sf):
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("mean_balance"))


def order_count(spark, sf):
    return table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"))


def customers_without_orders(spark, sf):
    """Customers without an urgent order since 2000."""
    urgent = table(spark, sf, "orders").filter("o_orderdate >= '2000-01-01' and o_orderpriority like '1%'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_name")


def customers_with_returns(spark, sf):
    returned = sales(spark, sf).filter("l_returnflag = 'R'").groupBy("c_custkey").agg(F.count(F.lit(1)).alias("returned"), money("revenue").alias("lost"))
    return returned.filter("returned >= 3")


def return_rate_by_brand(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", "p_brand")
    joined = lines(spark, sf).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.col("l_returnflag") == "R") / F.count(F.lit(1)), 6).alias("rate"))


def pricing_summary(spark, sf):
    return lines(spark, sf).filter("l_shipdate <= timestamp'2000-09-02'").groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("l_quantity").alias("sum_qty"), money("l_extendedprice").alias("sum_base"), money("revenue").alias("sum_disc"),
        F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def line_item_maths(spark, sf):
    """Lines whose total differs from quantity times unit price by more than two hundredths."""
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    joined = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    gap = F.round(F.abs(F.col("l_quantity") * F.col("p_retailprice") - F.col("l_extendedprice")), 2)
    return joined.withColumn("gap", gap).filter("gap > 0.02").groupBy("l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("largest"))


def order_totals_check(spark, sf):
    """Orders whose lines with discount and tax miss the order's total by more than five hundredths, by status."""
    summed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum(F.expr("l_extendedprice * (1 - l_discount) * (1 + l_tax)")).alias("summed"))
    orders = table(spark, sf, "orders")
    joined = orders.join(summed, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    wrong = F.abs(F.coalesce("summed", F.lit(0.0)) - F.col("o_totalprice")) > 0.05
    return joined.groupBy("o_orderstatus").agg(F.count_if(wrong).alias("wrong"), F.count(F.lit(1)).alias("n"))


def suppliers_by_nation(spark, sf):
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    s = table(spark, sf, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return s.groupBy("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


def segments_union(spark, sf):
    """UNION of two arms, each over allowed tables."""
    a = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("nation"))
    return a.union(b).distinct()


def nations_set_operations(spark, sf):
    """Nations of rich customers that have poor suppliers too, and those that haven't."""
    a = table(spark, sf, "customer").filter("c_acctbal > 9000").select(F.col("c_nationkey").alias("nation"))
    b = table(spark, sf, "supplier").filter("s_acctbal < 1000").select(F.col("s_nationkey").alias("nation"))
    both, only = a.intersect(b).withColumn("kind", F.lit("both")), a.exceptAll(a.join(b, "nation", "left_semi")).distinct().withColumn("kind", F.lit("only"))
    return both.unionByName(only)


def month_series(spark, sf):
    """A recursive common table expression: months of 1995 with their orders, empty ones included."""
    table(spark, sf, "orders").createOrReplaceTempView("mr_orders")
    return spark.sql("""
        WITH RECURSIVE months(m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM months WHERE m < 12)
        SELECT m AS month, count(o_orderkey) AS n FROM months
        LEFT JOIN mr_orders ON year(o_orderdate) = 1995 AND month(o_orderdate) = m GROUP BY m""")


R = "l_extendedprice * (1 - l_discount)"
QUERIES = {
    "revenue_by_segment": (revenue_by_segment, f"SELECT c_mktsegment, round(sum({R}), 4) AS revenue, count(DISTINCT o_orderkey) AS n_orders {SALES} GROUP BY 1"),
    "revenue_by_nation": (revenue_by_nation, f"SELECT n_name, round(sum({R}), 4) AS revenue {SALES} JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
    "revenue_by_month": (revenue_by_month, f"SELECT strftime(o_orderdate, '%Y-%m') AS month, round(sum({R}), 4) AS revenue, count(*) AS n {SALES} GROUP BY 1"),
    "revenue_by_brand": (revenue_by_brand, f"SELECT p_brand, round(sum({R}), 4) AS revenue, sum(l_quantity) AS quantity FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "top_parts": (top_parts, f"SELECT p_partkey, p_name, round(sum({R}), 4) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2 ORDER BY 3 DESC, 1 LIMIT 5"),
    "orders_by_priority": (orders_by_priority, "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1"),
    "average_order_value": (average_order_value, f"SELECT round(avg(v), 4) AS average_order_value, count(*) AS n_orders FROM (SELECT l_orderkey, sum({R}) AS v FROM lineitem GROUP BY 1)"),
    "customers_by_segment": (customers_by_segment, "SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 4) AS mean_balance FROM customer GROUP BY 1"),
    "order_count": (order_count, "SELECT count(*) AS n FROM orders"),
    "customers_without_orders": (customers_without_orders, "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderpriority LIKE '1%')"),
    "customers_with_returns": (customers_with_returns, f"SELECT c_custkey, count(*) AS returned, round(sum({R}), 4) AS lost {SALES} WHERE l_returnflag = 'R' GROUP BY 1 HAVING count(*) >= 3"),
    "return_rate_by_brand": (return_rate_by_brand, "SELECT p_brand, count(*) AS n, round(count(*) FILTER (l_returnflag = 'R') / count(*), 6) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1"),
    "pricing_summary": (pricing_summary, f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 4) AS sum_base, round(sum({R}), 4) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '2000-09-02' GROUP BY 1, 2"),
    "line_item_maths": (line_item_maths, "SELECT l_linestatus, count(*) AS n, max(gap) AS largest FROM (SELECT l_linestatus, round(abs(l_quantity * p_retailprice - l_extendedprice), 2) AS gap FROM lineitem JOIN part ON l_partkey = p_partkey) WHERE gap > 0.02 GROUP BY 1"),
    "order_totals_check": (order_totals_check, "SELECT o_orderstatus, count(*) FILTER (abs(coalesce(s, 0.0) - o_totalprice) > 0.05) AS wrong, count(*) AS n FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"),
    "suppliers_by_nation": (suppliers_by_nation, "SELECT r_name, n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2"),
    "segments_union": (segments_union, "SELECT c_nationkey AS nation FROM customer UNION SELECT s_nationkey FROM supplier"),
    "nations_set_operations": (nations_set_operations, "SELECT nation, CASE WHEN nation IN (SELECT s_nationkey FROM supplier WHERE s_acctbal < 1000) THEN 'both' ELSE 'only' END AS kind FROM (SELECT DISTINCT c_nationkey AS nation FROM customer WHERE c_acctbal > 9000)"),
    "month_series": (month_series, "WITH RECURSIVE months(m) AS (SELECT 1 UNION ALL SELECT m + 1 FROM months WHERE m < 12) SELECT m AS month, count(o_orderkey) AS n FROM months LEFT JOIN orders ON year(o_orderdate) = 1995 AND month(o_orderdate) = m GROUP BY m"),
}
