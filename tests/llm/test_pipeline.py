"""The pipeline against what its stages must do, on the smallest tables and on planted rows."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "benchmark_decontamination", "source_mix", "shards"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_pipeline_keeps_clean_rows_and_drops_planted_ones(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    clean = docs.filter("doc_id = 5").first()["text"]
    planted = spark.createDataFrame([(9001, None, "en", "s", 0), (9002, "123 456", "en", "s", 7), (9003, clean, "en", "s", 1), (9004, f"Some words before. {item} And after.", "en", "s", 1)], docs.schema)
    rows, left = docs.unionByName(planted), {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows.count()
        out = stage(spark, rows, SF)
        rows = spark.createDataFrame(out.collect(), out.schema)
        left[name] = {r["doc_id"] for r in rows.select("doc_id").collect()}
        assert set(docs.columns) <= set(rows.columns) and rows.count() <= 3 * before
    assert not {9001, 9002} & left["language_id"] and {9003, 9004} <= left["language_id"]
    assert 9003 not in left["near_duplicates"] and 5 in left["near_duplicates"] and 9004 in left["near_duplicates"]
    assert 9004 not in left["benchmark_decontamination"]
    assert set(rows.select(F.col("shard_no")).distinct().toPandas()["shard_no"]) <= set(range(8))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name_of in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM read_parquet('{SF}/{name_of}.parquet')")
    found = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    got = queries.QUERIES[name](spark, SF).select(*columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, found.fetchall()))


def test_pipeline_keeps_columns_whatever_their_names(spark, tmp_path):
    """Columns named like those that stages use on their way keep their values."""
    names = ["_lang", "_lang_score", "label", "score", "key", "__key", "once", "__once", "row", "shard_no", "size", "times", "node", "id", "copy"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    wide = docs.select("*", *(F.concat(F.lit(f"{n} of "), F.col("doc_id").cast("string")).alias(n) for n in names))
    wide.write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*wide.columns, "_shard_no"]
    rows = out.collect()
    assert rows and all(r[n] == f"{n} of {r['doc_id']}" for r in rows for n in names)
    assert {r["_shard_no"] for r in rows} <= set(range(8))
