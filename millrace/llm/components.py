"""Connected components of a graph whose edges are rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import remove, scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, comp for every node of an edge; comp is the smallest node of its component.

    Each round hooks a node to the least of its neighbours, follows the hooks to their ends, and goes on
    with the edges between those: at most half of the nodes are left, and groups around a node vanish
    at once. A node with many neighbours is a group of a minimum, which Spark combines on the map side.
    Ends are looked up once for each distinct hook, so that a component with most of the nodes is no hot key.
    """
    spark = edges.sparkSession
    path = scratch(spark, "components")
    left = edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).filter("x <> y").distinct()
    left, hooks = written(left, f"{path}/edges0"), []
    while True:
        turn = len(hooks)
        low = left.groupBy(F.col("y").alias("n")).agg(F.min("x").alias("end"))
        ends = low.unionByName(left.select(F.col("x").alias("n"), F.col("x").alias("end"))).groupBy("n").agg(F.min("end").alias("end"))
        hooks.append(followed(written(ends, f"{path}/hooks{turn}"), f"{path}/hooks{turn}"))
        to = lambda c: hooks[-1].select(F.col("n").alias(c), F.col("end").alias(f"end_{c}"))
        moved = left.join(to("x"), "x").join(to("y"), "y").select(F.least("end_x", "end_y").alias("x"), F.greatest("end_x", "end_y").alias("y"))
        left = written(moved.filter("x <> y").distinct(), f"{path}/edges{turn + 1}")
        if left.isEmpty():
            break
    result = hooks[0]
    for further in hooks[1:]:
        step = further.select(F.col("n").alias("end"), F.col("end").alias("next"))
        result = result.join(step, "end", "left").select("n", F.coalesce("next", "end").alias("end"))
    result = written(result.select(F.col("n").alias("node"), F.col("end").alias("comp")), f"{path}-result")
    remove(spark, path)
    return result


def followed(hooks: DataFrame, path: str) -> DataFrame:
    """n, end: hooks whose ends hook on to nothing; chains shorten by halves."""
    turn = 0
    while True:
        used = hooks.select("end").distinct()
        leads = written(used.join(hooks.select(F.col("n").alias("end"), F.col("end").alias("next")), "end").filter("next < end"), f"{path}-leads{turn}")
        if leads.isEmpty():
            return hooks
        turn += 1
        hooks = written(hooks.join(leads, "end", "left").select("n", F.coalesce("next", "end").alias("end")), f"{path}-{turn}")
