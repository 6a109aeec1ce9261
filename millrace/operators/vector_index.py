"""Lookups of vectors that came before and are still live, through an index of hyperplane signatures.

A vector's signature in a table tells on which side of BITS random planes it lies. Vectors at the similarity asked for
agree on a bit with a known probability, so the number of tables follows from the recall asked for at that similarity;
closer ones are found more surely. Every vector is in every table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vector as V
from ..storage import remove, scratch, written

#: Vectors that share a signature by chance, about, and bits of a signature at most.
BY_CHANCE, MOST_BITS = 32, 24


def tables_for(rows: int, least: float, recall: float) -> tuple[int, int]:
    """Bits of a signature and number of tables, so that a pair at similarity least meets in one of them with the recall asked for."""
    bits = min(MOST_BITS, max(4, math.ceil(math.log2(max(1, rows) / BY_CHANCE))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - agree))


def signed(rows: DataFrame, bits: int, tables: int, seed: int = 7) -> DataFrame:
    """id, signatures (one number a table) of rows with id and vector; vectors that are null or empty have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            vectors = batch.column(1)
            lengths = np.diff(vectors.offsets.to_numpy())
            lengths[~vectors.is_valid().to_numpy(zero_copy_only=False)] = 0
            values, starts = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64), vectors.offsets.to_numpy()[:-1]
            found: list[list[int]] = [[] for _ in range(batch.num_rows)]
            for n in np.unique(lengths[lengths > 0]).tolist():
                if n not in planes:
                    planes[n] = np.random.default_rng([seed, n]).standard_normal((n, bits * tables))
                some = np.flatnonzero(lengths == n)
                sides = (np.nan_to_num(values[starts[some][:, None] + np.arange(n)]) @ planes[n] > 0).reshape(len(some), tables, bits)
                for k, codes in zip(some.tolist(), (sides @ (1 << np.arange(bits))).tolist(), strict=True):
                    found[k] = codes
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "signatures"])

    return rows.select("id", "vector").mapInArrow(run, f"id {dict(rows.dtypes)['id']}, signatures array<long>")


def live_matches(entries: DataFrame, requests: DataFrame, ttl: float, least: float, recall: float = 0.999) -> DataFrame:
    """request_id, id, score: the entry most like each request, among those of its scope that came before and are live; none below least.

    entries and requests: id, vector (of length 1), scope, at (seconds). An entry lives for ttl seconds. Ties go to the
    entry stored first, then to the least id. An entry meets requests of its own stretch of ttl seconds and the next
    one only, so that a signature that many entries share makes no more pairs than are live at once.
    """
    spark = entries.sparkSession
    path = scratch(spark, "vectors")
    e, r = (written(x.select("id", "vector", "scope", F.col("at").cast("double").alias("at")), f"{path}/{n}") for x, n in ((entries, "entries"), (requests, "requests")))
    bits, tables = tables_for(e.count(), least, recall)
    codes = lambda x: x.select("id", "scope", "at").join(signed(x, bits, tables), "id").select("id", "scope", "at", F.posexplode("signatures").alias("table", "code"))
    span = F.floor(F.col("at") / ttl)
    stored = codes(e).withColumn("span", span)
    asked = codes(r).select(F.col("id").alias("request_id"), "scope", F.col("at").alias("asked"), "table", "code", F.explode(F.array(F.floor(F.col("at") / ttl), F.floor(F.col("at") / ttl) - 1)).alias("span"))
    pairs = asked.join(stored, ["scope", "table", "code", "span"]).filter((F.col("at") < F.col("asked")) & (F.col("at") + ttl > F.col("asked"))).select("request_id", "id").distinct()
    vectors = pairs.join(r.select(F.col("id").alias("request_id"), F.col("vector").alias("asked")), "request_id").join(e.select("id", "vector", "at"), "id")
    scored = vectors.select("request_id", "id", "at", F.round(V.dot(F.col("vector"), F.col("asked")), 4).alias("score")).filter(F.col("score") >= least)
    best = scored.groupBy("request_id").agg(F.min(F.struct((-F.col("score")).alias("by"), "at", "id")).alias("x"))
    result = written(best.select("request_id", F.col("x.id").alias("id"), (-F.col("x.by")).alias("score")), f"{path}-result")
    remove(spark, path)
    return result
