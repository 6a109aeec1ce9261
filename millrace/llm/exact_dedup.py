"""Exact deduplication as a stateful stream.

Rows are read as a stream and keyed by the digest of their normalised text. The state lives in
RocksDB, is never expired, and holds per digest the stable identifier of the row that stays, its
content locator (file and row position) and the number of rows. Running again with the same state
folder takes in new files only. A digest seen more than once is a hit; for hits the full bytes are
compared by grouping on the text itself, which Spark combines on the map side, so a group of any size
is one row per task. Should two texts share a digest, each text becomes a group of its own.

Defined results: null counts as empty, and empty texts are equal to one another; of equal texts the
row with the largest identifier stays, null is less than any, and of rows that share it the last by file
and position; so one row of each group stays; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ascii_lower, scratch, written

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LEAST_PARTITIONS, ROWS_A_PARTITION = 16, 1_000_000


def normalised(text: Column) -> Column:
    return ascii_lower(F.coalesce(text, F.lit("")))


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)


def ingest(
    spark: SparkSession, source: str, state: str, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state_partitions: int | None = None,
) -> DataFrame:
    """Runs the stream over all files of source that state hasn't seen; returns the state:
    digest, keep_id, keep_file, keep_row, group_size.

    The number of state partitions is fixed by the first run, as RocksDB takes some 4 MB for each:
    one for each ROWS_A_PARTITION rows, LEAST_PARTITIONS at least.
    """
    partitions = state_partitions or max(LEAST_PARTITIONS, spark.read.parquet(source).count() // ROWS_A_PARTITION)
    stream = spark.readStream.schema(spark.read.parquet(source).select(id_col, text_col).schema)
    if files_per_batch:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)
    # A pattern, since a stream takes a single file only from one.
    rows = stream.parquet(source if re.search(r"[*?\[{]", source) else f"{source[:-1]}[{source[-1]}]").select(
        digest(normalised(F.col(text_col))).alias("digest"), F.col(id_col).alias("id"),
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"),
    )
    keyed = rows.groupBy("digest").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("n"))
    wanted = {"spark.sql.streaming.stateStore.providerClass": PROVIDER, "spark.sql.streaming.internal.stateStore.partitions": str(partitions)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        query = keyed.writeStream.outputMode("update").format("noop").option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    held = spark.read.format("statestore").load(state)
    keep, n = (f"value.`{f.name}`" for f in held.schema["value"].dataType.fields)
    return held.select(F.col("key.digest").alias("digest"), F.col(f"{keep}.id").alias("keep_id"), F.col(f"{keep}.file").alias("keep_file"), F.col(f"{keep}.row").alias("keep_row"), F.col(n).alias("group_size"))


def hit_filter(hits: DataFrame, max_bits: int = 1 << 28) -> tuple[DataFrame, int]:
    """A bitmap of the hits' digests, as rows of 4 KB, that may be broadcast: 8 to 16 bits a hit and
    max_bits (32 MB) at most. A bit set in vain only sends a text to the comparison needlessly."""
    bits = 1 << 16
    n = hits.count()
    while bits < min(8 * n, max_bits):
        bits *= 2
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    return hits.groupBy(F.bitmap_bucket_number(spot).alias("bitmap_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("bitmap")), bits


def located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """id, locator (file, row), bytes and digest of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"), normalised(F.col(text_col)).alias("bytes"))
    return rows.withColumn("digest", digest(F.col("bytes")))


def compared(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """Groups of equal bytes among rows whose digest was seen more than once: digest, bytes, keep (id, file, row), group_size."""
    bitmap, bits = hit_filter(hits)
    spot = F.pmod(F.xxhash64("digest"), F.lit(bits))
    rows = rows.withColumn("bitmap_bucket", F.bitmap_bucket_number(spot)).withColumn("bit", F.bitmap_bit_position(spot)).join(F.broadcast(bitmap), "bitmap_bucket")
    byte = "cast(conv(hex(substring(bitmap, cast(bit div 8 as int) + 1, 1)), 16, 10) as int)"
    maybe = rows.filter(F.expr(f"shiftright({byte}, cast(bit % 8 as int)) % 2 = 1"))
    return maybe.groupBy("digest", "bytes").agg(F.max(F.struct("id", "file", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))


def deduplicate(
    spark: SparkSession, source: str, id_col: str = "doc_id", text_col: str = "text", state: str | None = None,
    digest: Callable[[Column], Column] = sha256, files_per_batch: int | None = None, state_partitions: int | None = None,
) -> DataFrame:
    """Every row of source: id, keep_id, group_size, kept, text_sha256, keep_file, keep_row."""
    path = scratch(spark, "dedup")
    held = ingest(spark, source, state or f"{path}/state", id_col, text_col, digest, files_per_batch, state_partitions)
    keep = F.struct(F.col("keep_id").alias("id"), F.col("keep_file").alias("file"), F.col("keep_row").alias("row"))
    hits = written(held.filter("group_size > 1").select("digest", keep.alias("keep"), "group_size"), f"{path}/hits")
    rows = located(spark.read.parquet(source), id_col, text_col, digest)
    sized = written(compared(rows, hits).select("digest", F.sha2("bytes", 256).alias("text_sha256"), "keep", "group_size"), f"{path}/groups")
    texts = sized.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"), F.max("keep").alias("only_keep"), F.max("group_size").alias("only_size"))
    # The state stands where the bytes bear it out; where a digest has several texts, the texts decide.
    judged = hits.join(texts, "digest").withColumn("alone", (F.col("texts") == 1) & (F.col("only_keep") == F.col("keep")) & (F.col("only_size") == F.col("group_size")))
    judged = written(judged, f"{path}/judged")
    rows = rows.select("id", "file", "row", "digest", F.sha2("bytes", 256).alias("text_sha256"))
    shared = judged.filter("not alone").select("digest")
    joined = rows.join(judged.filter("alone").select("digest", "keep", "group_size"), "digest", "left")
    if not shared.isEmpty():
        split = sized.join(shared, "digest", "left_semi")
        joined = joined.join(shared, "digest", "left_anti").unionByName(rows.join(split, ["digest", "text_sha256"]))
    at = F.coalesce("keep", F.struct("id", "file", "row"))
    return joined.select(
        F.col("id").alias(id_col), at["id"].alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        ((at["file"] == F.col("file")) & (at["row"] == F.col("row"))).alias("kept"), "text_sha256", at["file"].alias("keep_file"), at["row"].alias("keep_row"))
