"""Tables as a whole: the ways to join them, and fingerprints of what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A path over foreign keys, walked both ways, never through a table twice.
WALK = """
WITH RECURSIVE walked(start, at, path) AS (
  SELECT DISTINCT a, a, array(a) FROM both
  UNION ALL
  SELECT start, b, concat(path, array(b)) FROM walked JOIN both ON at = a WHERE NOT array_contains(path, b))
SELECT start, at, path FROM walked WHERE start < at
"""


def join_paths(edges: DataFrame) -> DataFrame:
    """first, second, path, between: for every two tables that can be joined, the shortest way over foreign keys (edges: a, b), by name where several are.

    between holds the tables that must come along, though no one asked for them.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    walked = edges.sparkSession.sql(WALK.replace("both", "{both}"), both=both)
    best = walked.groupBy("start", "at").agg(F.min(F.struct(F.size("path").alias("n"), "path")).alias("x"))
    path = F.col("x.path")
    return best.select(F.col("start").alias("first"), F.col("at").alias("second"), F.array_join(path, " > ").alias("path"), F.array_join(F.slice(path, F.lit(2), F.size(path) - 2), ",").alias("between"))


def fingerprint(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """n_rows and total: the sum of a 60-bit digest of each row's columns (text), modulo 2^60.

    Independent of order and partitions, and summed part by part; one row that is changed, missing or there twice
    changes it. Nulls differ from empty text.
    """
    text = F.concat_ws("\x01", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in columns])
    part = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), (F.coalesce(F.sum(part), F.lit(0)) % F.lit(1 << 60).cast("decimal(38,0)")).cast("long").alias("total"))
