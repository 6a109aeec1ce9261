"""WARC archives with revisit records and a two-level capture index.

One record is written per page. Of pages with equal payloads the one with the largest identifier is
the response and the others revisit it. Rows are put in order of their reversed-host URL key, so each
task writes one archive of gzip members and one index of the captures in it: lines of the index are
gathered in compressed blocks, and a sparse directory keeps the first key of every block. A lookup
finds the archive by its first key and the block by binary search in the archive's directory,
decompresses one block, finds the lines by binary search, and reads one byte range of the archive for
each. Lookups of many captures are put in the same order and dealt over tasks, each of which holds
one directory and one block at a time.

Defined results: null html counts as empty; null urls have an empty key; white space and control
characters of a key are percent-encoded; pages that repeat an identifier all become records of the same
kind, each once; a null identifier is written as None, and such pages sort first under their key; an
empty table gives no archives; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import listed, resolve, whole_file
from .shared import scratch, written

INDEX_LINES = 2000
#: Bytes of one read of a scan.
READ_BYTES = 1 << 16
#: Bytes of an archive that lookups of neighbouring captures share.
WINDOW_BYTES = 1 << 20
#: The file that lists a folder's archives with their first keys.
ARCHIVES = "archives.json"
DATE = "2000-01-01T00:00:00Z"


def url_key(url: str | None) -> str:
    """Host labels reversed and comma-joined, then ')' and path and query; scheme, port, user and fragment go."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").lower()
    except ValueError:
        host = ""
    key = (url or "").lower()
    if host:
        key = ",".join(reversed(host.split("."))) + ")" + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02x}", key)


def key_column(url: Column) -> Column:
    """url_key over batches."""

    @F.pandas_udf("string")
    def keys(urls):
        return urls.map(url_key)

    return keys(url)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, whose Content-Length is that of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    one_line = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Target-URI: {one_line}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(raw: bytes) -> dict:
    """Fields of a record: type, page_id, url, digest, refers_to, payload_bytes, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    http_fields = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    of = lambda x: None if x == "<urn:page:None>" else int(x[10:-1])
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "record_type": fields["WARC-Type"], "page_id": of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": of(fields["WARC-Refers-To"]) if revisit else None, "payload_bytes": int(http_fields["Content-Length"]), "payload": None if revisit else payload,
    }


def revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, digest, refers_to of the pages that repeat the payload of another one. No payload is moved.

    Payloads are told apart by SHA-1 and length. Groups are counted on the map side; the pages of
    a large group meet its one row in a join that Spark may split.
    """
    narrow = pages.filter(F.octet_length("html") >= least_bytes).select("page_id", "url", "digest")
    groups = narrow.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    return narrow.join(groups, "digest").filter("refers_to <> page_id")


INDEX = "archive string, records long, bytes long, blocks long, first_key string, first_id long"


def capture_of(line: str) -> tuple[str, int | None]:
    """Key and identifier of a line of the index."""
    key, page_id, _ = line.split(" ", 2)
    return key, None if page_id == "None" else int(page_id)


def order_of(key: str, page_id: int | None) -> tuple[str, bool, int]:
    """Captures in the order of the archives: null identifiers first."""
    return key, page_id is not None, page_id or 0


def write_archives(folder: str):
    """Each partition, in order of keys: an archive, its index of compressed blocks, and the directory of the blocks.

    A page that revisits another comes right behind a row that says so.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name, at, n, lines, directory = f"part-{TaskContext.get().partitionId():07d}", 0, 0, [], []
        index_at, marked = 0, (None, None, None)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with whole_file(f"{folder}/{name}.warc.gz") as out, whole_file(f"{folder}/{name}.cdx.gz") as index:

            def close_block() -> None:
                nonlocal index_at, lines
                block = gzip.compress("".join(f"{line}\n" for line in lines).encode(), 6, mtime=0)
                index.write(block)
                directory.append([*capture_of(lines[0]), index_at, len(block), len(lines)])
                index_at, lines = index_at + len(block), []

            for batch in chained(first, batches):
                for key, page_id, digest, is_page, url, html, refers_to in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                    if not is_page:
                        marked = (page_id, digest, refers_to)
                        continue
                    refers_to = marked[2] if marked[:2] == (page_id, digest) else None
                    member = gzip.compress(record(page_id, url, html.encode(), refers_to), 6, mtime=0)
                    out.write(member)
                    lines.append(f"{key} {page_id} " + json.dumps({"offset": at, "length": len(member), "type": "response" if refers_to is None else "revisit"}))
                    at, n = at + len(member), n + 1
                    if len(lines) == INDEX_LINES:
                        close_block()
            if lines:
                close_block()
        with whole_file(f"{folder}/{name}.idx") as out:
            out.write("".join(json.dumps(d) + "\n" for d in directory).encode())
        first_key, first_id, *_ = directory[0]
        columns = {"archive": [name], "records": [n], "bytes": [at], "blocks": [len(directory)], "first_key": [first_key]}
        yield pa.RecordBatch.from_pydict({**columns, "first_id": pa.array([first_id], pa.int64())})

    return run


def chained(first: pa.RecordBatch, rest: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def archive(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes the archives and their index under folder; returns one row per archive."""
    plain = pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    plain = plain.withColumn("digest", F.concat(F.sha1(F.col("html").cast("binary")), F.lit("-"), F.octet_length("html").cast("string")))
    key = key_column(F.col("url"))
    records = plain.select(key.alias("key"), "page_id", "digest", F.lit(True).alias("is_page"), "url", "html", F.lit(None).cast("long").alias("refers_to"))
    marks = revisits(plain, least_bytes).distinct().select(key.alias("key"), "page_id", "digest", F.lit(False).alias("is_page"), F.lit("").alias("url"), F.lit("").alias("html"), "refers_to")
    # The identifier spreads a host or URL that holds a large part of the pages.
    order = ["key", "page_id", "digest"]
    ordered = records.unionByName(marks).repartitionByRange(*order).sortWithinPartitions(*order, "is_page")
    made = written(ordered.mapInArrow(write_archives(folder), INDEX), scratch(pages.sparkSession, "archives"))
    # One line for each archive, as many as the folder has files.
    listing = sorted((order_of(r["first_key"], r["first_id"]), r["archive"]) for r in made.select("first_key", "first_id", "archive").collect())
    with whole_file(f"{folder}/{ARCHIVES}") as out:
        out.write(json.dumps(listing).encode())
    return made


def members(stream) -> Iterator[bytes]:
    """The gzip members of an archive one after another, without holding more than one and READ_BYTES."""
    left, inflate, parts = b"", zlib.decompressobj(31), []
    while chunk := left or stream.read(READ_BYTES):
        parts.append(inflate.decompress(chunk))
        left = b""
        if inflate.eof:
            yield b"".join(parts)
            left, inflate, parts = inflate.unused_data, zlib.decompressobj(31), []


RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"


def record_batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()], names=[*kinds])


def verified(r: dict) -> dict:
    """A record whose payload, if it has one, has the digest and length that it states."""
    if r["payload"] is not None and (payload_digest(r["payload"]), len(r["payload"])) != (r["payload_digest"], r["payload_bytes"]):
        raise ValueError(f"record {r['page_id']} doesn't match its digest")
    return r


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Every record of the archives by a scan: page_id, payload_bytes, payload_digest, record_type, refers_to, url."""
    names = [(n,) for n, _ in listed(folder, ".warc.gz")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, path = resolve(f"{folder}/{name}")
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for raw in members(stream):
                        rows.append(verified(parsed(raw)))
                        if len(rows) == 5000:
                            yield record_batch(rows)
                            rows = []
                yield record_batch(rows)

    if not names:
        return spark.createDataFrame([], RECORD)
    return spark.createDataFrame(names, "name string").repartition(len(names)).mapInArrow(run, RECORD)


class CaptureIndex:
    """Lookups of captures. The list of archives has a line for each; of the directories and blocks one is held at a time."""

    def __init__(self, folder: str):
        self.folder = folder
        fs, path = resolve(f"{folder}/{ARCHIVES}")
        with fs.open_input_stream(path, compression=None) as f:
            listing = json.loads(f.read())
        self.firsts, self.archives = [tuple(order) for order, _ in listing], [name for _, name in listing]
        self.directory: tuple[str | None, list, list] = (None, [], [])
        self.block: tuple[tuple | None, list, list] = (None, [], [])
        self.window: tuple[str | None, int, bytes] = (None, 0, b"")

    def _range(self, name: str, at: int, length: int) -> bytes:
        """Bytes of a file; those of WINDOW_BYTES are kept for what lies behind."""
        held, start, raw = self.window
        if held != name or not start <= at <= at + length <= start + len(raw):
            fs, path = resolve(f"{self.folder}/{name}")
            with fs.open_input_file(path) as f:
                f.seek(at)
                start, raw = at, f.read(max(length, WINDOW_BYTES))
            self.window = (name, start, raw)
        return raw[at - start : at - start + length]

    def _directory(self, name: str) -> tuple[list, list]:
        """First captures and places of an archive's index blocks."""
        if self.directory[0] != name:
            fs, path = resolve(f"{self.folder}/{name}.idx")
            with fs.open_input_stream(path, compression=None) as f:
                rows = [json.loads(line) for line in f.read().decode().split("\n") if line]
            self.directory = (name, [order_of(r[0], r[1]) for r in rows], [r[2:4] for r in rows])
        return self.directory[1:]

    def _block(self, name: str, at: int, length: int) -> tuple[list, list]:
        """Captures and lines of a block."""
        if self.block[0] != (name, at):
            fs, path = resolve(f"{self.folder}/{name}.cdx.gz")
            with fs.open_input_file(path) as f:
                f.seek(at)
                lines = gzip.decompress(f.read(length)).decode().split("\n")[:-1]
            self.block = ((name, at), [order_of(*capture_of(line)) for line in lines], lines)
        return self.block[1:]

    def between(self, low: tuple, high: tuple) -> Iterator[dict]:
        """The records from the capture low to the capture high, in order."""
        archive = max(0, bisect.bisect_left(self.firsts, low) - 1)
        while archive < len(self.firsts) and self.firsts[archive] <= high:
            name = self.archives[archive]
            firsts, places = self._directory(name)
            at = max(0, bisect.bisect_left(firsts, low) - 1)
            while at < len(firsts) and firsts[at] <= high:
                captures, lines = self._block(name, *places[at])
                for line in lines[bisect.bisect_left(captures, low) : bisect.bisect_right(captures, high)]:
                    where = json.loads(line.split(" ", 2)[2])
                    yield verified(parsed(gzip.decompress(self._range(f"{name}.warc.gz", where["offset"], where["length"]))))
                at += 1
            archive += 1

    def captures(self, url: str) -> list[dict]:
        """All records of a URL's key, in order."""
        key = url_key(url)
        return [*self.between((key, False, 0), (key, True, float("inf")))]


def look_up(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """The records of the captures that rows of pages name by identifier and URL, through the index: those of read_archives().

    Rows that name the same capture look it up once. Captures are dealt in the order of the archives, so each task
    walks through neighbouring blocks, also where one host or URL has a large part of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, rows = None, []
        for batch in batches:
            for key, page_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                index = index or CaptureIndex(folder)
                capture = order_of(key, page_id)
                for r in index.between(capture, capture):
                    rows.append({**r, "payload": None})
                    if len(rows) == 5000:
                        yield record_batch(rows)
                        rows = []
        yield record_batch(rows)

    wanted = pages.select(key_column(F.coalesce(F.col(url_col), F.lit(""))).alias("key"), F.col(id_col).cast("long").alias("page_id")).distinct()
    return wanted.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id").mapInArrow(run, RECORD)
