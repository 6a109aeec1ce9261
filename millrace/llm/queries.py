"""The registered queries of this subpackage, opN_<name>, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, crf_language, decontamination, exact_dedup, lbl_model, licenses, mixing, ngram_join, prefix_trie, secret_scan, sharding, token_codec, warc
from .shared import scratch, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(spark, f"{sf_dir}/documents.parquet").drop("keep_file", "keep_row")


OP1_SQL = """
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (
  SELECT doc_id, sha256(t) AS text_sha256, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM normal)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM grouped
"""


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.shard_documents(docs, leaves=8)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = placed.select("doc_id", sharding.byte_size(F.col("text")).alias("size"), crc.alias("text_crc32"), "shard_no")
    rows = sharding.numbered(rows)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard_no").alias("shard"), F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = crf_language.fit(docs, ~held_out)
    # The text stays behind: only what the result needs leaves the workers.
    return crf_language.predict(docs.select("doc_id", held_out.alias("held_out"), "text"), model).drop("text")


def op4_lbl_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    model = lbl_model.fit(docs, ~held_out)
    return lbl_model.score(docs, model).withColumn("held_out", held_out)


def op5_huffman_tokens(spark: SparkSession, sf_dir: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    import public_tokenizers

    folder = scratch(spark, "huffman")
    files = token_codec.encode_documents(table(spark, sf_dir, "documents"), folder, public_tokenizers.path(tokenizer), end_id)
    return token_codec.read_digests(spark, folder, files)


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    warc.archive(pages, folder)
    return warc.look_up(pages, folder).drop("url")


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    join = ngram_join.NgramJoin(table(spark, sf_dir, "documents"))
    return join.labelled().select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    rows = mixing.apply_mix(docs, mixing.fit_mix(docs))
    return rows.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_times")).alias("taken"))


OP10_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         CASE WHEN source IS NULL THEN 'n' ELSE 'a' || source END AS src,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
sources AS (
  SELECT src, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY src) - 1) % 3 AS k FROM base GROUP BY src),
weighted AS (
  SELECT src, source_size, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][k + 1] AS weight, source_size * 3.0::DOUBLE AS cap,
         (SELECT sum(size)::DOUBLE FROM base) AS total FROM sources),
leveled AS (
  SELECT *, (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighted),
targets AS (
  SELECT src, source_size, CASE WHEN cap < level * weight THEN cap ELSE least(cap, weight *
         (SELECT arg_min(level, (cap / weight, src)) FROM leveled WHERE NOT cap < level * weight)) END AS target FROM leveled),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS copies FROM targets),
running AS (
  SELECT b.*, p.source_size, p.target, p.copies, p.target - p.copies * p.source_size AS rest,
         sum(b.size) OVER (PARTITION BY b.src ORDER BY b.h) AS after FROM base b JOIN plan p USING (src)),
judged AS (
  SELECT *, max(CASE WHEN after <= rest THEN after ELSE 0 END) OVER (PARTITION BY src) AS spent,
         min(CASE WHEN after > rest THEN after END) OVER (PARTITION BY src) AS first_over FROM running)
SELECT doc_id, size, source_size, target,
       (size * (copies + CASE WHEN after <= rest OR (after = first_over AND after - rest < rest - spent) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM judged
"""

def op11_secret_scan(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    import public_tokenizers

    return secret_scan.scan(table(spark, sf_dir, "documents"), public_tokenizers.path(ranks), public_tokenizers.PATTERN)


def op12_token_alignment(spark: SparkSession, sf_dir: str, a: str = "byte_bpe_50k.json", b: str = "piece_bpe_32k.model") -> DataFrame:
    import public_tokenizers

    return alignment.align(table(spark, sf_dir, "documents"), public_tokenizers.path(a), public_tokenizers.path(b))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH crc AS (
  -- The remainders of all bytes, and from them crc32 of the decimal identifier, byte by byte.
  SELECT list(r ORDER BY i) AS of FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS r FROM range(256) t(i))),
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY p) AS turns FROM turns GROUP BY conv_id),
hashed AS (
  SELECT conv_id, turns, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, [ascii(c)::BIGINT FOR c IN string_split(conv_id::VARCHAR, '')]),
                         lambda c, b: xor(c >> 8, crc.of[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM own, crc),
paths AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM hashed a LEFT JOIN own b ON b.conv_id = a.base),
members AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM paths),
nodes AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE len(turns) = depth), '')) AS ends_sha256
  FROM members GROUP BY 1, 2),
children AS (SELECT path[1:depth - 1] AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
valued AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(n.path[depth].t) END AS saved
  FROM nodes n LEFT JOIN children c ON c.path = n.path),
above AS (SELECT path, n_children, saved, unnest(range(depth + 1)) AS up FROM valued),
sums AS (SELECT path[1:up] AS path, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens, v.ends_sha256
FROM valued v JOIN sums s ON s.path = v.path LEFT JOIN nodes p ON v.depth > 0 AND p.path = v.path[1:v.depth - 1]
"""

QUERIES = {"op1_exact_dedup": op1_exact_dedup, "op2_kd_shards": op2_kd_shards, "op3_crf_language": op3_crf_language, "op4_lbl_scores": op4_lbl_scores, "op5_huffman_tokens": op5_huffman_tokens, "op6_cgk_decontamination": op6_cgk_decontamination, "op7_license_scan": op7_license_scan, "op8_warc_index": op8_warc_index, "op9_ngram_join": op9_ngram_join, "op10_mix_sources": op10_mix_sources, "op11_secret_scan": op11_secret_scan, "op12_token_alignment": op12_token_alignment, "op13_prefix_trie": op13_prefix_trie}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op10_mix_sources": OP10_SQL, "op13_prefix_trie": OP13_SQL}
