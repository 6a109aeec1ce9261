"""From documents to shards of training data: five stages, each over all that the one before it kept.

Every stage takes the documents as a DataFrame and returns one with the same columns, but for the last,
which adds the shard. Columns beyond those of documents pass through all stages, whatever their names: stages
name their own columns apart from them, and the shard is shard_no, with underscores before it where that is taken.

Defined results: language_id drops null and empty texts, as those have no letters. In the later stages
null and empty texts would link with nothing, contain nothing and have size 0. Rows without an identifier are never compared and stay. Of rows equal
in identifier and text one stays; other rows that share an identifier are told apart by their texts. Long texts are read
whole. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import crf_language, decontamination, mixing, ngram_join, sharding
from millrace.llm.shared import scratch, table, unused, written

#: A text none of whose languages holds this mean probability is rejected, as is one without letters.
LEAST_SCORE = 0.3
SHARDS = 8


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without letters and those that no learned language fits."""
    model = crf_language.fit(docs, F.lit(True))
    label, score = (unused(name, docs.columns) for name in ("label", "score"))
    judged = crf_language.predict(docs, model, names=(label, score))
    return judged.filter((F.col(label) != crf_language.UNKNOWN) & (F.col(score) >= LEAST_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least identifier of each group of near copies."""
    return ngram_join.one_of_each(docs, ngram_join.NgramJoin(docs).labelled())


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain a benchmark item."""
    return decontamination.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each source's share: rows are left out, or repeated, to come near its target."""
    return mixing.mixed(docs, mixing.fit_mix(docs))


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds shard_no, 0 to 7, near equal in bytes."""
    return sharding.shard_documents(docs, leaves=SHARDS, name=unused("shard_no", docs.columns))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mix", source_mix),
    ("shards", shards),
]
#: Training, hashing and edit distances are beyond SQL; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{path}/{name}")
    return docs
