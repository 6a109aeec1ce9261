"""Nearest-rank percentiles, hashed assignment and comparisons of rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, keys: list[str], value: str, fractions: dict[str, float], buckets: int = 1024) -> DataFrame:
    """By keys, the value at index round((n - 1) f), half to even, of the sorted values.

    Values are counted in equal-width buckets between each key's extremes; only the values of the buckets
    in which the ranks fall are counted one by one. Both counts combine on the map side, so a key that
    holds most rows is as many rows as it has buckets, and no array of its values is built.
    """
    one = [] if keys else ["_all"]
    rows = df.filter(F.col(value).isNotNull()).withColumn("_all", F.lit(1)).select(*keys, *one, value)
    keys_ = [*keys, *one]
    ends = rows.groupBy(*keys_).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    place = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0))
    binned = rows.join(ends, keys_).withColumn("_b", F.least(F.floor(place * buckets), F.lit(buckets - 1)))
    counts = binned.groupBy(*keys_, "_b").agg(F.count(F.lit(1)).alias("_k"))
    group = Window.partitionBy(*keys_)
    running = counts.withColumn("_upto", F.sum("_k").over(group.orderBy("_b"))).withColumn("_n", F.sum("_k").over(group))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.bround((F.col("_n") - 1) * F.lit(f)).cast("long").alias("rank")) for name, f in fractions.items()]))
    hit = running.withColumn("_w", wanted).filter((F.col("_upto") > F.col("_w.rank")) & (F.col("_upto") - F.col("_k") <= F.col("_w.rank")))
    hit = hit.select(*keys_, "_b", F.col("_w.name").alias("_name"), (F.col("_w.rank") - F.col("_upto") + F.col("_k")).alias("_within"))
    values = binned.join(hit.select(*keys_, "_b").distinct(), [*keys_, "_b"], "left_semi").groupBy(*keys_, "_b", value).agg(F.count(F.lit(1)).alias("_k"))
    values = values.withColumn("_upto", F.sum("_k").over(Window.partitionBy(*keys_, "_b").orderBy(value)))
    found = hit.join(values, [*keys_, "_b"]).filter(F.col("_upto") > F.col("_within"))
    return found.groupBy(*keys_).agg(*[F.min(F.when(F.col("_name") == name, F.col(value))).alias(name) for name in fractions]).drop("_all")


def unit_fraction(experiment: str, unit: Column) -> Column:
    """The first twelve hexadecimal digits of SHA-256 of "experiment|unit", over 16^12."""
    digest = F.sha2(F.concat(F.lit(f"{experiment}|"), unit.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") / F.lit(float(16**12))


def assigned(fraction: Column, variants: list[tuple[str, float]]) -> Column:
    """The variant whose share of the running sum of weights the fraction falls into; null without weight."""
    total = sum(max(0.0, w) for _, w in variants)
    out, running, pairs = F.lit(None).cast("string"), 0.0, []
    for name, weight in variants:
        running += max(0.0, weight)
        pairs.append((name, running / total if total else 0.0))
    for name, upto in reversed(pairs):
        out = F.when(fraction < upto, F.lit(name)).otherwise(out)
    return out if total else F.lit(None).cast("string")


def normal_cdf(z: Column) -> Column:
    """Abramowitz and Stegun's rational approximation 26.2.17 (error below 7.5e-8)."""
    t = 1 / (1 + F.lit(0.2316419) * F.abs(z))
    poly = t * (F.lit(0.319381530) + t * (F.lit(-0.356563782) + t * (F.lit(1.781477937) + t * (F.lit(-1.821255978) + t * F.lit(1.330274429)))))
    tail = F.exp(-z * z / 2) / F.sqrt(F.lit(6.283185307179586)) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def pooled_z(successes_a: Column, n_a: Column, successes_b: Column, n_b: Column) -> Column:
    """z of the difference of two rates under their pooled rate; 0 where that has no spread."""
    rate = F.try_divide(successes_a + successes_b, n_a + n_b)
    error = F.sqrt(rate * (1 - rate) * (F.try_divide(F.lit(1.0), n_a) + F.try_divide(F.lit(1.0), n_b)))
    difference = F.try_divide(successes_b, n_b) - F.try_divide(successes_a, n_a)
    return F.coalesce(F.try_divide(difference, error), F.lit(0.0))


def normal_quantile(p: float) -> float:
    """The value below which a standard normal number lies with probability p; -8 and 8 at the ends."""
    from statistics import NormalDist

    return -8.0 if p <= 0 else 8.0 if p >= 1 else NormalDist().inv_cdf(p)


def samples_needed(rate_a: Column, rate_b: Column, confidence: float = 0.95, power: float = 0.8) -> Column:
    """Samples of each arm that tell two rates apart; 0 where they hardly differ."""
    reach = (normal_quantile(1 - (1 - confidence) / 2) + normal_quantile(power)) ** 2
    spread = rate_a * (1 - rate_a) + rate_b * (1 - rate_b)
    needed = F.ceil(F.lit(reach) * spread / F.pow(rate_b - rate_a, 2))
    return F.when(F.abs(rate_b - rate_a) < 0.0001, F.lit(0).cast("long")).otherwise(needed)


def compared_rates(successes_a: Column, n_a: Column, successes_b: Column, n_b: Column, confidence: float = 0.95) -> Column:
    """struct(rate_a, rate_b, difference, p_value, interval_low, interval_high, significant, samples_needed); rates of empty arms are null and nothing is significant.

    The test takes the pooled rate, the interval each arm's own.
    """
    a, b = F.try_divide(successes_a, n_a), F.try_divide(successes_b, n_b)
    z = pooled_z(successes_a, n_a, successes_b, n_b)
    p = F.round(2 * (1 - normal_cdf(F.abs(z))), 5)
    reach = normal_quantile(1 - (1 - confidence) / 2) * F.sqrt(F.try_divide(a * (1 - a), n_a) + F.try_divide(b * (1 - b), n_b))
    significant = F.coalesce(p < 1 - confidence, F.lit(False))
    return F.struct(
        F.round(a, 4).alias("rate_a"), F.round(b, 4).alias("rate_b"), F.round(b - a, 4).alias("difference"), p.alias("p_value"), F.round(b - a - reach, 4).alias("interval_low"),
        F.round(b - a + reach, 4).alias("interval_high"), significant.alias("significant"), F.when(significant, F.lit(0).cast("long")).otherwise(samples_needed(a, b)).alias("samples_needed"))
