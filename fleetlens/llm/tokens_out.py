"""Operator 10, token-id output: Parquet list columns with chosen encodings, row groups and page indexes.

Documents are dealt into ranges of ids and sorted, each range is one file in the shared folder. A file has small
metadata columns (doc_id and n_tokens, delta-encoded) beside the list column of ids (dictionary-encoded, which with a
vocabulary is bit-packed; or delta-encoded), row groups of a bounded number of tokens and a page index, so that a
reader takes the metadata, one row group or one document without the rest. A task writes to a name of its own
and renames at the end; the names that count are those in the written list of files, so a task that runs again after
an executor was lost leaves nothing behind that is read.

Nulls and edges: a null or empty text is the end id alone; documents with a null id come first; rows that share an id
are written each, in the order of their text's hash; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import sys
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.bpe import Encoder
from fleetlens.llm.common import shared_dir, with_text, written

#: Tokens in a row group and bytes in a data page, at about.
GROUP_TOKENS, PAGE_BYTES = 1 << 20, 1 << 18
#: Bytes of text a file holds, at about.
FILE_BYTES = 64 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.field("element", pa.int32(), nullable=False)))])
FILES = "file string, part int, docs long, tokens long"


def _rows(ids: list, lens: list, flat: list[bytes]) -> pa.Table:
    data = b"".join(flat)
    offsets = np.concatenate([[0], np.cumsum(np.array(lens, np.int64))]).astype(np.int32)
    values = pa.Array.from_buffers(pa.int32(), len(data) // 4, [None, pa.py_buffer(data)])
    lists = pa.ListArray.from_arrays(pa.array(offsets), values, type=SCHEMA[2].type)
    return pa.Table.from_arrays([pa.array(ids, pa.int64()), pa.array(lens, pa.int64()), lists], schema=SCHEMA)


def write(docs: DataFrame, path: str, folder: str, *, end_id: int = 2, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Writes the files below ``folder`` (a URI) and returns the list of them, in order of their documents."""
    rows = with_text(docs, id_col, text_col)
    if parts is None:
        total = rows.select(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(1, -(-total // FILE_BYTES), rows.sparkSession.sparkContext.defaultParallelism)
    place = pafs.FileSystem.from_uri(folder)
    place[0].create_dir(place[1], recursive=True)
    options = {"use_dictionary": ["ids.list.element"]} if encoding == "dictionary" else {"use_dictionary": False}
    plain = {"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"} | ({} if encoding == "dictionary" else {"ids.list.element": "DELTA_BINARY_PACKED"})

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        files, where = pafs.FileSystem.from_uri(folder)
        name = f"{where}/tokens-{uuid.uuid4().hex}.parquet"
        writer, part, n_docs, n_tokens, end = None, 0, 0, 0, end_id.to_bytes(4, "little")
        ids: list = []
        lens: list[int] = []
        flat: list[bytes] = []

        def flush() -> None:
            nonlocal writer, n_docs, n_tokens
            if not ids:
                return
            if writer is None:
                writer = pq.ParquetWriter(f"{name}.tmp", SCHEMA, filesystem=files, compression="zstd", version="2.6", write_page_index=True, data_page_size=PAGE_BYTES, column_encoding=plain, **options)
            writer.write_table(_rows(ids, lens, flat), row_group_size=len(ids))
            n_docs, n_tokens = n_docs + len(ids), n_tokens + sum(lens)
            for x in (ids, lens, flat):
                x.clear()

        held = 0
        for batch in batches:
            for doc, found, part in zip(batch["id"].to_pylist(), encoder.all_ids(batch["text"]), batch["part"].to_pylist(), strict=True):  # noqa: B007
                got = found + end
                ids.append(doc)
                lens.append(len(got) // 4)
                flat.append(got)
                held += lens[-1]
                if held >= GROUP_TOKENS:
                    flush()
                    held = 0
        flush()
        if writer is None:
            return
        writer.close()
        files.move(f"{name}.tmp", name)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([part], pa.int32()), pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64())], names=["file", "part", "docs", "tokens"])

    sort = [F.col("id").asc_nulls_first(), "h"]
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(parts, *sort).sortWithinPartitions(*sort).select("id", "text", F.spark_partition_id().alias("part"))
    return written(dealt.mapInArrow(save, FILES), "files")


def read(spark: SparkSession, files: DataFrame, folder: str, columns: tuple[str, ...] = ("doc_id", "n_tokens", "ids")) -> DataFrame:
    """Selected columns of the files in the list; with ids, also each document's crc32 instead of the list itself.

    ``start`` is the number of ids of all documents before; the list of files is collected for that, one row a file.
    """
    listed = files.orderBy("part").collect()
    starts, at = {}, 0
    for r in listed:
        starts[r["file"]] = at
        at += r["tokens"]

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch["file"].to_pylist(), batch["base"].to_pylist(), strict=True):
                store, _ = pafs.FileSystem.from_uri(folder)
                with store.open_input_file(name) as f:
                    source = pq.ParquetFile(f)
                    for g in range(source.num_row_groups):
                        t = source.read_row_group(g, columns=[*{"doc_id", "n_tokens", *(("ids",) if "ids" in columns else ())}])
                        n = t["n_tokens"].to_numpy()
                        start = base + np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
                        base += int(n.sum())
                        out = [t["doc_id"].combine_chunks(), pa.array(start), pa.array(n)]
                        if "ids" in columns:
                            ids = t["ids"].combine_chunks()
                            flat = np.ascontiguousarray(ids.flatten().to_numpy().astype("<u4"))
                            ends = np.concatenate([[0], np.cumsum(n)])
                            data = memoryview(flat).cast("B")
                            out.append(pa.array([zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64()))
                        yield pa.RecordBatch.from_arrays(out, names=["doc_id", "start", "n_tokens", "ids_crc32"][: len(out)])

    ddl = "doc_id long, start long, n_tokens long" + (", ids_crc32 long" if "ids" in columns else "")
    if not listed:
        return spark.createDataFrame([], ddl)
    rows = spark.createDataFrame([(r["file"], starts[r["file"]]) for r in listed], "file string, base long").repartition(len(listed))
    return rows.mapInArrow(load, ddl)


def document_ids(spark: SparkSession, files: DataFrame, folder: str, doc_id: int) -> list[list[int]]:
    """The ids of one document. The files are sorted by id, so Spark's reader drops row groups by their statistics and, by the
    page index, the pages of all columns that can't hold it.
    """
    base, names = folder.rstrip("/"), [r["file"].rsplit("/", 1)[1] for r in files.orderBy("part").collect()]
    if not names:
        return []
    rows = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(*(f"{base}/{n}" for n in names))
    return [list(r["ids"]) for r in rows.where(F.col("doc_id") == doc_id).select("ids").collect()]


def token_table(docs: DataFrame, path: str, **options: object) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document, as read back from the files."""
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/tokens"
    return read(spark, write(docs, path, folder, **options), folder)  # type: ignore[arg-type]


assert sys.byteorder == "little", "ids are written as the machine's 32-bit integers"
