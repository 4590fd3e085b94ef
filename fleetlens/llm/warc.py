"""Operator 3, WARC archives with a two-level capture index.

Writing: every row becomes a gzip member of a WARC/1.1 file, a ``response`` with its payload or, for a payload of at least
``revisit_from`` bytes that a smaller id has too, a ``revisit`` that names the response. Each task writes a file of its
own in the shared folder and hands on a line for each record: reversed-host key, file, offset, length.

Index, lower level: the lines of all records, sorted by reversed-host URL key and id over all tasks, in compressed blocks
of ``BLOCK`` lines. Upper level: a sparse directory with the first key, file, offset and length of each block. A look-up
is a binary search in the directory, the range read of one block, a binary search in the block, and the range read of
the record (``look_up``). Reading all captures back walks the directory's blocks instead, each of them once.

Files are written under names of their own and renamed when they are complete; only names in the written lists count,
so a task that runs again after a loss leaves nothing behind that is read.

Nulls and edges: a null payload is empty; a null URL has the empty key; rows with a null id can't be named by others
and are always responses; rows that share an id are written each; an empty table gives no rows; other columns are never
read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import shared_dir, written

BLOCK, REVISIT_FROM = 512, 100
DATE = "2024-01-01T00:00:00Z"
LINE = "key string, id long, row long, file string, offset long, length long"


def url_key(url: Column) -> Column:
    """Reversed host, then path and query, in lower case: com,example,www)/path?query."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), r"#.*$", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), F.lower(rest)), F.lit(""))


def _record(kind: str, url: str, name: str, digest: str, payload: bytes, more: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{name}>"), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(url.split())), ("WARC-Payload-Digest", f"sha256:{digest}"), *more, ("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + payload + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one gzip member."""
    raw = gzip.decompress(data)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"no WARC record: {first[:40]!r}")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    n = int(headers["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return headers, rest[:n]


class _File:
    """A file that gets its name when it is complete."""

    def __init__(self, folder: str, kind: str) -> None:
        self.fs, where = pafs.FileSystem.from_uri(folder)
        self.name = f"{where}/{kind}-{uuid.uuid4().hex}.gz"
        self.stream, self.at = self.fs.open_output_stream(f"{self.name}.tmp", compression=None), 0

    def add(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def done(self) -> None:
        self.stream.close()
        self.fs.move(f"{self.name}.tmp", self.name)


def write(pages: DataFrame, folder: str, *, revisit_from: int = REVISIT_FROM, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Writes the archives below ``folder`` (a URI); returns the lines of all records, unsorted."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.select("id", "url", "payload", F.sha2(F.col("payload").cast("binary"), 256).alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    large = rows.where(F.col("size") >= revisit_from).select("id", "digest")
    # ids alone are shuffled to find the smallest of each payload; those of which there is one need no more
    firsts = large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    revisits = large.join(firsts, "digest").where("id <> refers_to").select("id", "digest", "refers_to").distinct()
    # as a table their size is known, so the payloads are shuffled only where the revisits are too many to be sent to all
    revisits = written(revisits, "revisits")
    rows = rows.join(revisits, ["id", "digest"], "left").withColumn("key", url_key(F.col("url")))
    place = pafs.FileSystem.from_uri(folder)
    place[0].create_dir(place[1], recursive=True)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        n = 0
        for batch in batches:
            lines: list[list] = [[], [], [], [], [], []]
            for i, url, payload, digest, size, refers, key in zip(*(batch[c].to_pylist() for c in ("id", "url", "payload", "digest", "size", "refers_to", "key")), strict=True):
                out = out or _File(folder, "warc")
                if refers is None:
                    data = _record("response", url or "", str(i), digest, payload.encode(), [])
                else:
                    data = _record("revisit", url or "", str(i), digest, b"", [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(size))])
                offset, length = out.add(gzip.compress(data, 4, mtime=0))
                for col, v in zip(lines, (key, i, n, out.name, offset, length), strict=True):
                    col.append(v)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array(lines[0], pa.string()), pa.array(lines[1], pa.int64()), pa.array(lines[2], pa.int64()), pa.array(lines[3], pa.string()), pa.array(lines[4], pa.int64()), pa.array(lines[5], pa.int64())], names=["key", "id", "row", "file", "offset", "length"])
        if out:
            out.done()

    return written(rows.select("id", "url", "payload", "digest", "size", "refers_to", "key").mapInArrow(save, LINE), "lines")


def build_index(lines: DataFrame, folder: str, *, block: int = BLOCK) -> DataFrame:
    """Sorts the lines into compressed blocks; returns the directory: the first and last entry of each block and its place."""
    order = [F.col("key"), F.col("id").asc_nulls_first(), F.col("file"), F.col("offset")]
    dealt = lines.select("key", "id", "file", "offset", "length").repartitionByRange(*order).sortWithinPartitions(*order)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = None, []

        def flush() -> list:
            nonlocal out, held
            out = out or _File(folder, "index")
            offset, length = out.add(zlib.compress("\n".join(map(json.dumps, held)).encode(), 5))
            row = [held[0][0], held[0][1], held[-1][0], out.name, offset, length, len(held)]
            held = []
            return row

        def as_batch(rows: list) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["first", "first_id", "last", "file", "offset", "length", "lines"])

        for batch in batches:
            rows = []
            for line in zip(*(batch[c].to_pylist() for c in ("key", "id", "file", "offset", "length")), strict=True):
                held.append(line)
                if len(held) == block:
                    rows.append(flush())
            if rows:
                yield as_batch(rows)
        if held:
            yield as_batch([flush()])
        if out:
            out.done()

    return written(dealt.mapInArrow(save, "first string, first_id long, last string, file string, offset long, length long, lines long"), "directory")


class Reader:
    """Look-ups in the two levels; keeps the last block it read. The directory has a row a block and is held sorted."""

    def __init__(self, folder: str, directory: list[tuple]) -> None:
        self.fs, _ = pafs.FileSystem.from_uri(folder)
        self.directory = sorted(directory, key=lambda r: (r[0], -1 if r[1] is None else r[1], r[3], r[4]))
        self.firsts = [r[0] for r in self.directory]
        self.open: dict[str, pa.NativeFile] = {}
        self.block: tuple[int, list] = (-1, [])

    def _range(self, name: str, offset: int, length: int) -> bytes:
        if name not in self.open:
            if len(self.open) >= 64:
                self.open.popitem()[1].close()
            self.open[name] = self.fs.open_input_file(name)
        return self.open[name].read_at(length, offset)

    def captures(self, key: str) -> Iterator[list]:
        """The lines of a key: from the last block that begins before it on."""
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.directory) and self.firsts[k] <= key:
            if self.directory[k][2] >= key:
                yield from self.lines(k, key)
            k += 1

    def lines(self, k: int, key: str | None = None) -> list:
        if self.block[0] != k:
            _, _, _, name, offset, length, _ = self.directory[k]
            self.block = (k, [json.loads(x) for x in zlib.decompress(self._range(name, offset, length)).decode().split("\n")])
        rows = self.block[1]
        if key is None:
            return rows
        return rows[bisect.bisect_left(rows, key, key=lambda r: r[0]) : bisect.bisect_right(rows, key, key=lambda r: r[0])]

    def record(self, line: list) -> tuple[dict[str, str], bytes]:
        return parse_record(self._range(line[2], line[3], line[4]))


def read_all(directory: DataFrame, folder: str) -> DataFrame:
    """Every capture, by way of the index: each task takes some blocks of the directory and reads their records."""

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for entry in batch.to_pylist():
                reader = Reader(folder, [(entry["first"], entry["first_id"], entry["last"], entry["file"], entry["offset"], entry["length"], entry["lines"])])
                rows: list[list] = [[], [], [], [], []]
                for line in sorted(reader.lines(0), key=lambda r: (r[2], r[3])):
                    headers, payload = reader.record(line)
                    kind = headers["WARC-Type"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"the payload of {headers['WARC-Record-ID']} is damaged")
                    refers = headers.get("WARC-Refers-To")
                    size = len(payload) if kind == "response" else int(headers["X-Payload-Length"])
                    for col, v in zip(rows, (line[1], size, digest, kind, int(refers[len("<urn:page:") : -1]) if refers else None), strict=True):
                        col.append(v)
                for f in reader.open.values():
                    f.close()
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    n = directory.count()
    return directory.repartition(max(1, min(n, 4096))).mapInArrow(load, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def look_up(folder: str, directory: DataFrame, url: str) -> list[tuple[dict[str, str], bytes]]:
    """All captures of one URL. The directory is collected: one row for ``BLOCK`` captures."""
    key = directory.sparkSession.range(1).select(url_key(F.lit(url)).alias("k")).first()["k"]
    reader = Reader(folder, [tuple(r) for r in directory.where((F.col("first") <= key) & (F.col("last") >= key)).collect()])
    return [reader.record(x) for x in reader.captures(key)]


def archive(pages: DataFrame, **options: object) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` as read back from the archives."""
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    lines = write(pages, folder, **options)  # type: ignore[arg-type]
    return read_all(build_index(lines, folder), folder)
