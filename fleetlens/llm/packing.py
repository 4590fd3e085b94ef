"""Operator 6, best-fit packing: bound-certified repacking.

Items (tokenised documents, long ones cut into full pieces and a rest) are dealt into partitions of a bounded number of
items. Each partition packs its own by best-fit decreasing and holds the bin count against the largest of several
dual-feasible-function lower bounds. Where they are equal the partition is certified and stays as it is. The documents
of partitions with a gap are exchanged: they are dealt anew, fewer partitions together, and packed again; a round
counts only if it takes fewer bins. Best-fit decreasing works on one counter for each free length, so that a partition
costs O(items * log capacity).

Nulls and edges: a null text is an empty text; an empty text is one piece of length 1 (the end id); a null id is packed
like any other; repeated rows are packed each; an empty table gives no rows; columns other than the two named are
never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe import Encoder
from fleetlens.llm.common import with_text, written

CAPACITY = 2048
#: Items that one task packs.
GROUP = 50_000
ROUNDS = 3
#: Numbers that a partition has for its bins; a group must not be larger.
MOST_BINS = 1 << 20
PIECES = "row long, doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece of each document's ids, with the crc32 of its little-endian unsigned 32-bit ids."""
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.at(path)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for row, doc, ids in zip(batch["row"].to_pylist(), batch["id"].to_pylist(), encoder.all_ids(batch["text"]), strict=True):
                data = memoryview(ids + end_id.to_bytes(4, "little"))
                total = len(data) // 4
                for k, at in enumerate(range(0, total, capacity)):
                    n = min(capacity, total - at)
                    for col, v in zip(rows, (row, doc, k, at, n, zlib.crc32(data[4 * at : 4 * (at + n)])), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    rows = with_text(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    return rows.mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The most bins that some dual feasible function proves necessary.

    Used are the identity, the function that rounds by thresholds (large items count whole, small ones not at all) for
    every threshold that occurs, and the family that counts multiples of capacity / k.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    total = int((counts * size).sum())
    best = -(-total // capacity)
    # thresholds e <= capacity / 2: items over capacity - e count as whole bins, those under e as nothing
    above = np.cumsum(counts[::-1])[::-1]
    mass = np.cumsum((counts * size)[::-1])[::-1]
    e = np.arange(1, capacity // 2 + 1)
    whole = above[capacity - e + 1]
    between = mass[e] - mass[capacity - e + 1]
    best = max(best, int((whole + -(-between // capacity)).max()))
    for k in range(1, 100):
        # u_k(x) = x if (k + 1) x / C is whole, else floor((k + 1) x / C) C / k, here in units of C / k and C (k + 1)
        m = (k + 1) * size
        units = np.where(m % capacity == 0, k * size, (m // capacity) * capacity)
        best = max(best, int(-(-(counts * units).sum() // (k * capacity))))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Ties keep the items' order."""
    order = np.argsort(-lengths, kind="stable")
    bin_of, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(capacity + 1)]  # the bins with so much left
    have = 0  # bit r: some bin has r left
    n = 0
    for i in order.tolist():
        size = int(lengths[i])
        fits = have >> size
        if fits:
            left = size + ((fits & -fits).bit_length() - 1)
            b = free[left].pop()
            if not free[left]:
                have &= ~(1 << left)
        else:
            left, b = capacity, n
            n += 1
        bin_of[i], offset[i] = b, capacity - left
        if left > size:
            free[left - size].append(b)
            have |= 1 << (left - size)
    return bin_of, offset, n


def packed(items: DataFrame, *, capacity: int = CAPACITY, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """``items``: a written table with ``row``, ``piece``, ``length`` (1 to capacity) and any other columns.

    Adds ``sequence_id`` and ``offset``. Full items are sequences of their own and never move.
    """
    short = items.where(F.col("length") < capacity)
    n = short.count()
    parts = max(1, -(-n // group))
    keys = short.select("row", "piece", "length", F.pmod(F.xxhash64("row", "piece"), F.lit(parts)).alias("part"))
    schema = "row long, piece int, length long, part long, bin long, offset long, bins long, bound long"

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row", "piece"], ascending=[False, True, True], ignore_index=True)
        lengths = pdf["length"].to_numpy()
        pdf["bin"], pdf["offset"], bins = best_fit_decreasing(lengths, capacity)
        pdf["bins"], pdf["bound"] = bins, lower_bound(lengths, capacity)
        return pdf[["row", "piece", "length", "part", "bin", "offset", "bins", "bound"]]

    now = written(keys.groupBy("part").applyInPandas(pack, schema), "packed")
    done: list[DataFrame] = []
    for r in range(rounds):
        if parts == 1:
            break
        # documents of partitions with a gap: of these, full bins stay, the others are exchanged
        state = now.groupBy("part", "bin").agg(F.sum("length").alias("used"), F.first("bins").alias("bins"), F.first("bound").alias("bound"))
        loose = state.where((F.col("bins") > F.col("bound")) & (F.col("used") < capacity)).select("part", "bin")
        loose = written(loose, "loose")
        before = loose.count()
        if before < 2:
            break
        moving = now.join(loose, ["part", "bin"], "left_semi")
        staying = now.join(loose, ["part", "bin"], "left_anti")
        parts = max(1, -(-moving.count() // group))
        base = (r + 1) << 24
        again = written(moving.select("row", "piece", "length", (F.lit(base) + F.pmod(F.xxhash64("row", "piece", F.lit(r)), F.lit(parts))).alias("part")).groupBy("part").applyInPandas(pack, schema), "packed")
        after = again.select("part", "bin").distinct().count()
        if after >= before:
            break
        done.append(staying)
        now = again
    for x in done:
        now = now.unionByName(x)
    # a short sequence is numbered by (round and part, bin), a full piece by a negative number
    at = now.select("row", "piece", (F.col("part") * F.lit(MOST_BINS) + F.col("bin")).alias("sequence_id"), "offset")
    full = items.where(F.col("length") >= capacity).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return short.join(at, ["row", "piece"]).unionByName(full)


def pack_documents(docs: DataFrame, path: str, *, capacity: int = CAPACITY, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group: int = GROUP) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset``: where each piece of each document lies."""
    items = written(pieces(docs, path, capacity=capacity, end_id=end_id, id_col=id_col, text_col=text_col), "pieces")
    return packed(items, capacity=capacity, group=group).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
