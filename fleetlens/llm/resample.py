"""Operator 12, target-distribution importance resampling: an external sort-count of hashed n-grams.

Each block of documents is written as one packed stream of uint16 buckets, those of one document after those of
another, with the documents' offsets. For the counts, each stream is sorted and run-length encoded, and the runs of all
blocks are added up by Spark: that is ``BUCKETS`` numbers for the documents and as many for the target, whatever the
input's size. The gains of the buckets then go to the tasks, which read the streams again, gather a gain for each
feature and add up a document's by ``np.add.reduceat``; no text is read twice. A document's key is its weight plus Gumbel
noise from its id, so the largest keys are a draw without replacement. For the ranks the keys are sorted by ranges, and a
row's rank is its place in its range after the sizes of the ranges before.

Nulls and edges: a null or empty text has no features and weight 0; very long texts are read in pieces, whole; a null id
has the noise of an empty string and loses ties; rows that share an id are drawn each, their ranks among equals in any
order; without a target every bucket has its count of 0 there; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, claim, dropped, with_text, written

BUCKETS, WIDTH, SEED = 10_000, 3, 42
#: A document with fewer words is never drawn; so many of a hundred others are.
LEAST_WORDS, PERCENT = 20, 5
#: Features in a block, at about; bytes of text that are split at a time.
BLOCK, PIECE = 1 << 16, 1 << 20
_WORDS = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64())), ("stream", pa.binary())])


def features(text: bytes | None, width: int = WIDTH, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """Buckets of all runs of 1 to ``width`` words, as uint16, and the number of words."""
    data, at, total = (text or b"").translate(_WORDS), 0, 0
    out: list[np.ndarray] = []
    kept: list[bytes] = []  # the last words of the piece before
    while at < len(data):
        end = data.find(b" ", at + PIECE) if len(data) - at > PIECE else -1
        end = len(data) if end < 0 else end
        fresh = data[at:end].split()
        words, old, at = kept + fresh, len(kept), end
        total += len(fresh)
        rest = [b" " + w for w in words]
        now = [crc32(w) for w in words]
        for k in range(width):
            if k:
                now = list(map(crc32, rest[k:], now))  # a crc goes on where that of the run without its last word ended
            new = now[max(0, old - k) :]
            out.append((np.fromiter(new, np.uint32, len(new)) % buckets).astype(np.uint16))
        kept = words[len(words) - width + 1 :] if width > 1 and len(words) >= width else words[len(words) :] if width == 1 else words
    return np.concatenate(out) if out else np.zeros(0, np.uint16), total


def streams(docs: DataFrame, *, width: int = WIDTH, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: ``ids, words``, the ``ends`` of each one's features in the ``stream``, and that."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("a bucket must fit 16 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("resample")
        ids, words, sizes, parts, held = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal held
            row = [[list(ids)], [list(words)], [np.cumsum(sizes).tolist()], [np.concatenate(parts).astype("<u2").tobytes()]]
            for x in (ids, words, sizes, parts):
                x.clear()
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            for i, text in zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                got, n = features(text, width, buckets)
                ids.append(i)
                words.append(n)
                sizes.append(len(got))
                parts.append(got)
                held += len(got) + 8
                if held >= BLOCK:
                    yield block()
        if ids:
            yield block()

    return with_text(docs, id_col, text_col).mapInArrow(run, "ids array<long>, words array<long>, ends array<long>, stream binary")


def _stream(cell: pa.BinaryScalar) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "<u2")


def counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs: runs of the sorted streams, added up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.sort(np.concatenate([np.zeros(0, np.uint16), *map(_stream, batch["stream"])]), kind="stable")
            first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])[: len(x)])
            n = np.diff(np.append(first, len(x)))
            yield pa.RecordBatch.from_arrays([pa.array(x[first].astype(np.int32)), pa.array(n.astype(np.int64))], names=["bucket", "n"])

    got = blocks.select("stream").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the source, rounded down."""
    s, t, k = source.astype(np.float64), target.astype(np.float64), len(source)
    return np.floor(1000 * np.log(((t + 1) * (s.sum() + k)) / ((s + 1) * (t.sum() + k)))).astype(np.int64)


def weighed(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``id, words, n_features, weight`` of each document."""
    held = blocks.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, words, ends, stream in zip(batch["ids"], batch["words"], batch["ends"], batch["stream"], strict=True):
                ends = ends.values.to_numpy()
                starts = np.concatenate([[0], ends[:-1]])
                weight, full = np.zeros(len(ends), np.int64), ends > starts
                if full.any():  # reduceat takes an empty range for the one number there
                    weight[full] = np.add.reduceat(held.value[_stream(stream)], starts[full])
                yield pa.RecordBatch.from_arrays([ids.values, words.values, pa.array(ends - starts), pa.array(weight)], names=["id", "words", "n_features", "weight"])

    return blocks.mapInArrow(run, "id long, words long, n_features long, weight long")


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of a hash of seed and id, rounded down."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """The rows with ``place`` (from 1) by this order; they are sorted by ranges, and sizes of ranges come to the driver."""
    spark = rows.sparkSession
    # the number tells the range in the bits above 33 and the place in it below
    table = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright("at", 33)
    before, total = [], 0
    for r in sorted(table.groupBy(part.alias("part")).count().collect()):
        before.append((r["part"], total))
        total += r["count"]
    first = F.broadcast(spark.createDataFrame(before, "part long, before long"))  # a row for each range
    return table.withColumn("part", part).join(first, "part").withColumn("place", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "before", "at")


def resample(docs: DataFrame, target: DataFrame, *, width: int = WIDTH, buckets: int = BUCKETS, least: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text") -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document; rank is null for those not drawn."""
    blocks = written(streams(docs, width=width, buckets=buckets, id_col=id_col, text_col=text_col), "streams")
    aim = streams(target, width=width, buckets=buckets, id_col=target_id, text_col=target_text)
    rows = written(weighed(blocks, gains(counts(blocks, buckets), counts(aim, buckets))), "weighed")
    dropped(blocks)
    rows = rows.withColumns({"score": F.col("weight") + gumbel("id", seed), "fits": F.col("words") >= least})
    drawn = rows.where("fits").count() * percent // 100
    out = ranked(rows, [F.col("fits").desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("n_features").asc()], "ranked")
    dropped(rows)
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", F.when(F.col("fits") & (F.col("place") <= drawn), F.col("place")).alias("rank"))
