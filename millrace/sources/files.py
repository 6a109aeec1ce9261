"""Readers of files: plain text, pages, JSON corpora and repositories, one row per file, bad files as rows with an error."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

#: Kinds of files by suffix.
KINDS = {"txt": "text", "md": "text", "csv": "text", "html": "html", "htm": "html", "pdf": "pdf", "png": "image", "jpg": "image", "jpeg": "image"}
SKIPPED = r"/(\.git|__pycache__|node_modules|\.venv|\.pytest_cache)/"


def binary_files(spark: SparkSession, folder: str, most_bytes: int | None = None) -> DataFrame:
    """path, name, kind, document_id (by content), content, error; sorted order is left to what follows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(~F.col("path").rlike(SKIPPED))
    kinds = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    name = F.element_at(F.split("path", "/"), -1)
    kind = F.try_element_at(kinds, F.lower(F.regexp_extract(name, r"\.(\w+)$", 1)))
    error = F.when(kind.isNull(), "unsupported").when(F.lit(most_bytes is not None) & (F.col("length") > (most_bytes or 0)), "too large")
    return files.select("path", name.alias("name"), kind.alias("kind"), F.concat(F.lit("doc_"), F.substring(F.sha2("content", 256), 1, 16)).alias("document_id"), "content", error.alias("error"))


def text_documents(spark: SparkSession, folder: str) -> DataFrame:
    """document_id, path, title, text of the text and HTML files of a folder; bytes that aren't UTF-8 become marks."""
    files = binary_files(spark, folder).filter("kind in ('text', 'html')")
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    is_html = F.col("kind") == "html"
    stem = F.regexp_replace("name", r"\.\w+$", "")
    title = F.when(is_html & (T.html_title(raw) != ""), T.html_title(raw)).otherwise(stem)
    return files.select("document_id", "path", title.alias("title"), F.when(is_html, T.html_text(raw)).otherwise(raw).alias("text"))


def json_corpus(spark: SparkSession, path: str, field: str = "documents", lines: bool = False) -> DataFrame:
    """The rows of an array in JSON files, each of which is one object, or has one on every line."""
    return spark.read.json(path, multiLine=not lines).select(F.explode(field).alias("d")).select("d.*")


def repository(spark: SparkSession, folder: str, pattern: str = r"\.(py|toml|md|txt|json)$") -> DataFrame:
    """path, digest, source of the source files under a folder."""
    return binary_files(spark, folder).filter(F.col("path").rlike(pattern)).select("path", F.sha2("content", 256).alias("digest"), F.make_valid_utf8(F.col("content").cast("string")).alias("source"))


def test_outcomes(log_lines: DataFrame, line: str = "value") -> DataFrame:
    """test, outcome from the lines of a verbose test log."""
    shape = r"^(\S+::\S+)\s+(PASSED|FAILED|ERROR)"
    found = log_lines.select(F.regexp_extract(line, shape, 1).alias("test"), F.lower(F.regexp_extract(line, shape, 2)).alias("outcome"))
    return found.filter("test <> ''")


def write_files(rows: DataFrame, folder: str) -> DataFrame:
    """Writes a file for each row (name, which may hold folders, and content, bytes) below a folder that all workers reach; returns name and bytes.

    A file is written under a name of its own and moved when whole, so a task that runs again leaves the same files. The
    result is what was written, so it must be read for the files to be there. Null names and contents make no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        where = "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder
        fs, base = pafs.FileSystem.from_uri(where)
        for batch in batches:
            done = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                path = f"{base}/{name}"
                fs.create_dir(path.rpartition("/")[0], recursive=True)
                draft = f"{path}.{uuid.uuid4().hex}.draft"
                with fs.open_output_stream(draft, compression=None) as out:
                    out.write(content)
                fs.move(draft, path)
                done.append((name, len(content)))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["name", "bytes"])

    some = rows.select(F.col("name").cast("string"), F.col("content").cast("binary")).filter("name is not null and content is not null")
    return some.mapInArrow(run, "name string, bytes long")
