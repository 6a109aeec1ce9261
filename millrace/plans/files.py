"""Queries over files: tables are written as files in the shared folder and read back by the readers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..sources import files
from ..storage import remove, scratch, written
from .stores import events
from .texts import HTML

#: Endings of pages' files by identifier: the last is of no kind that can be read.
ENDINGS = ("html", "txt", "HTM", "md", "bin")


def kept(spark, out, path):
    """out as a table of its own, without the files that it was read from."""
    result = written(out, f"{path}-result")
    remove(spark, path)
    return result


def page_files(spark, sf):
    """Pages as files of several kinds, read back: what kind each is, what it is called by its content, and its title and text."""
    k, path = F.col("page_id"), scratch(spark, "pages")
    ending = F.element_at(F.array(*map(F.lit, ENDINGS)), (k % len(ENDINGS) + 1).cast("int"))
    rows = table(spark, sf, "pages").select(F.concat(F.lit("page-"), k.cast("string"), F.lit("."), ending).alias("name"), "html")
    written(files.write_files(rows.select("name", F.col("html").cast("binary").alias("content")), f"{path}/files"), f"{path}/made")
    found = files.binary_files(spark, f"{path}/files").select("path", "name", "kind", "document_id", F.coalesce("error", F.lit("")).alias("error"))
    texts = files.text_documents(spark, f"{path}/files").select("path", "title", F.length("text").cast("long").alias("chars"), F.md5("text").alias("digest"))
    return kept(spark, found.join(texts, "path", "left").drop("path"), path)


def corpus_files(spark, sf):
    """Documents as objects of a hundred each in files of JSON, read back as rows."""
    path = scratch(spark, "corpus")
    group = F.struct("doc_id", "text", "lang", "source")
    objects = table(spark, sf, "documents").groupBy(F.floor(F.col("doc_id") / 100).alias("part")).agg(F.collect_list(group).alias("documents"))
    objects.select(F.to_json(F.struct("documents")).alias("value")).write.text(f"{path}/files")
    rows = files.json_corpus(spark, f"{path}/files", lines=True)
    return kept(spark, rows.select("doc_id", F.md5("text").alias("digest"), "lang", "source"), path)


def repository_files(spark, sf):
    """Items as the files of a project, some in folders that are no part of it or of kinds that aren't sources: what a snapshot holds."""
    k, path = F.col("item_id"), scratch(spark, "repository")
    folder = F.when(k % 5 == 3, ".git/").when(k % 5 == 4, "lib/node_modules/x/").when(k % 2 == 0, "src/deep/er/").otherwise("")
    name = F.concat(folder, F.lit("f"), k.cast("string"), F.when(k % 7 == 6, ".png").otherwise(".py"))
    rows = table(spark, sf, "benchmark").select(name.alias("name"), F.col("text").cast("binary").alias("content"))
    written(files.write_files(rows, f"{path}/files"), f"{path}/made")
    found = files.repository(spark, f"{path}/files")
    return kept(spark, found.select(F.substring_index("path", "/files/", -1).alias("path"), "digest", F.length("source").cast("long").alias("chars")), path)


def log_outcomes(spark, sf):
    """Lines of a test log, made of events, among others that say nothing: outcomes by file."""
    said = F.when(F.col("event_type") == "error", "FAILED").when(F.col("event_type") == "signup", "ERROR").when(F.col("event_type") == "view", "skipped").otherwise("PASSED")
    line = F.concat(F.lit("tests/test_"), (F.col("user_id") % 10).cast("string"), F.lit(".py::test_"), F.col("event_id").cast("string"), F.lit(" "), said, F.lit("   [ 5%]"))
    out = files.test_outcomes(events(spark, sf).select(F.when(F.col("event_id") % 9 != 0, line).otherwise("== warnings ==").alias("value")))
    return out.groupBy(F.substring_index("test", "::", 1).alias("file"), "outcome").agg(F.count(F.lit(1)).alias("n"))


NAME = f"'page-' || page_id || '.' || {list(ENDINGS)}[page_id % {len(ENDINGS)} + 1]"
TITLE = "trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1))"
PAGES = f"""
WITH p AS (SELECT {NAME} AS name, page_id % {len(ENDINGS)} AS n, page_id, html, {TITLE} AS title, array_to_string({HTML}, chr(10)) AS t FROM pages)
SELECT name, ['html', 'text', 'html', 'text', NULL][n + 1] AS kind, 'doc_' || substr(sha256(html), 1, 16) AS document_id, CASE WHEN n = 4 THEN 'unsupported' ELSE '' END AS error,
  CASE WHEN n = 4 THEN NULL WHEN n IN (0, 2) AND title <> '' THEN title ELSE 'page-' || page_id END AS title, CASE n WHEN 4 THEN NULL WHEN 0 THEN len(t) WHEN 2 THEN len(t) ELSE len(html) END AS chars,
  CASE n WHEN 4 THEN NULL WHEN 0 THEN md5(t) WHEN 2 THEN md5(t) ELSE md5(html) END AS digest FROM p"""

QUERIES = {
    "page_files": (page_files, PAGES),
    "corpus_files": (corpus_files, "SELECT doc_id, md5(text) AS digest, lang, source FROM documents"),
    "repository_files": (repository_files, "SELECT CASE WHEN item_id % 2 = 0 THEN 'src/deep/er/' ELSE '' END || 'f' || item_id || '.py' AS path, sha256(text) AS digest, len(text) AS chars FROM benchmark WHERE item_id % 5 < 3 AND item_id % 7 <> 6"),
    "log_outcomes": (log_outcomes, "SELECT 'tests/test_' || user_id % 10 || '.py' AS file, CASE event_type WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'error' ELSE 'passed' END AS outcome, count(*) AS n FROM events WHERE event_id % 9 <> 0 AND event_type <> 'view' GROUP BY 1, 2"),
}
