"""Folds over ordered rows of a key, where one key may hold most of the rows.

Rows are dealt by ranges of (key, order), so a key with many rows spans many stretches. Each stretch is
folded by itself, and what the stretches before it come to is carried in: only keys that cross a boundary
have such a carry, fewer than there are partitions, so carries are broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import scratch, written


def ordered(order: list[str]) -> list[Column]:
    """Names as columns to sort by; "-" before all of them turns the order around."""
    return [F.desc_nulls_last(n[1:]) if n.startswith("-") else F.asc_nulls_first(n) for n in order]


def in_stretches(rows: DataFrame, key: str, order: list[str], path: str | None = None) -> DataFrame:
    """rows with the column stretch, as a table at path or a fresh one. The order must tell a key's rows apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return written(rows.repartitionByRange(parts, key, *ordered(order)).withColumn("stretch", F.spark_partition_id()), path or scratch(rows.sparkSession, "stretches"))


def before(rows: DataFrame, key: str, order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows (of in_stretches) with sums and last values that aren't null, over the rows of their key that come before.

    A sum over no rows is null, as is a last value that no earlier row has.
    """
    sums, lasts = sums or {}, lasts or {}
    earlier = Window.partitionBy(key, "stretch").orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, -1)
    here = rows.select("*", *[F.sum(c).over(earlier).alias(f"{n}_here") for n, c in sums.items()], *[F.last(c, ignorenulls=True).over(earlier).alias(f"{n}_here") for n, c in lasts.items()])
    at, back = F.struct(*[n.removeprefix("-") for n in order]), order[0].startswith("-")
    final = lambda c: (F.min_by if back else F.max_by)(c, F.when(c.isNotNull(), at))
    totals = rows.groupBy(key, "stretch").agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[final(c).alias(n) for n, c in lasts.items()])
    names = [*sums, *lasts]
    all_ = F.array_sort(F.collect_list(F.struct("stretch", *names)))
    crossing = totals.groupBy(key).agg(F.count(F.lit(1)).alias("stretches"), all_.alias("all")).filter("stretches > 1")
    each = crossing.select(F.col(key).alias("_key"), F.explode("all").alias("one"), "all")
    past = lambda n: F.filter(F.transform(F.filter("all", lambda x: x["stretch"] < F.col("one.stretch")), lambda x: x[n]), lambda v: v.isNotNull())
    total = lambda n: F.aggregate(F.slice(past(n), F.lit(2), F.greatest(F.lit(0), F.size(past(n)) - 1)), F.try_element_at(past(n), F.lit(1)), lambda a, x: a + x)
    carried = each.select("_key", F.col("one.stretch").alias("_stretch"), *[total(n).alias(f"{n}_carried") for n in sums], *[F.try_element_at(past(n), F.lit(-1)).alias(f"{n}_carried") for n in lasts])
    joined = here.join(F.broadcast(carried), here[key].eqNullSafe(carried["_key"]) & (here["stretch"] == carried["_stretch"]), "left")
    both = lambda n: F.when(F.col(f"{n}_here").isNotNull() & F.col(f"{n}_carried").isNotNull(), F.col(f"{n}_here") + F.col(f"{n}_carried")).otherwise(F.coalesce(f"{n}_here", f"{n}_carried"))
    return joined.select(*rows.columns, *[both(n).alias(n) for n in sums], *[F.coalesce(f"{n}_here", f"{n}_carried").alias(n) for n in lasts])


def folded(rows: DataFrame, keys: list[str], order: list[str], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None) -> DataFrame:
    """rows with sums and last values over the rows of their keys that come before, in any number of tasks. Other columns stay as they are.

    Expressions read a row's columns through the struct _row.
    """
    kept = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(*keys).alias("_keys"), *sorted({n.removeprefix("-") for n in order}))
    cut = in_stretches(kept, "_keys", order)
    out = before(cut, "_keys", order, sums, lasts)
    return out.select("_row.*", *(sums or {}), *(lasts or {}))


def last_different(rows: DataFrame, key: str, order: list[str], value: str, trusted: Column, path: str | None = None) -> DataFrame:
    """Rows whose key has an earlier trusted row with another value: key, order, value, expected (a struct of the last such row's value and
    order), and since_last, whether that row was the last trusted one at all.

    Only trusted rows set what is known. An as-of join without a range join: the last trusted row is carried
    along, and where it differs from a trusted row the one before is kept, so that the last two different
    values are at hand for each row.
    """
    some = in_stretches(rows.filter(F.col(value).isNotNull() & F.col(key).isNotNull()), key, order, path)
    known = before(some, key, order, lasts={"known": F.when(trusted, F.struct(value, *order))})
    changed = trusted & (F.col("known")[value] != F.col(value))
    both = before(known, key, order, lasts={"other": F.when(changed, F.col("known"))})
    differs = F.col("known")[value] != F.col(value)
    return both.select(key, *order, value, F.when(differs, F.col("known")).otherwise(F.col("other")).alias("expected"), differs.alias("since_last")).filter("expected is not null")
