"""What the operators share: tables, written intermediate results, byte views of text, bit filters of a fixed size.

Intermediate results are Parquet tables in the folder of ``spark.checkpoint.dir``; so a lost executor costs a
reread, never a rerun of the whole lineage. Only a local session may do without that setting; it uses a local folder.
"""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a filter that is sent to all workers: 4 MB, whatever the input's size.
FILTER_BITS = 1 << 25
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most BATCH_ROWS rows, which bounds what a worker and its JVM hold."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, BATCH_ROWS + 1):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints")
    elif "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/fleetlens-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables, or unions of such, that ``written`` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            folder = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


_held: dict[str, Callable[[], None]] = {}


def claim(owner: str, release: Callable[[], None] = lambda: None) -> None:
    """Tasks call this first. A worker lives on from stage to stage: what another operator keeps in it is released, and
    the memory goes back to the system, so a worker holds the caches of one operator, not the sum of all.
    """
    others = [k for k in _held if k != owner]
    for k in others:
        _held.pop(k)()
    _held[owner] = release
    if others:
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def with_text(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns an operator uses, as ``id``, ``text`` and ``more``; other columns can't clash with its own."""
    small_batches(df.sparkSession)
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), *more)


def rows_kept(df: DataFrame, text_col: str, make: Callable[[], Callable[[list[bytes | None]], np.ndarray]]) -> DataFrame:
    """The rows, with all their columns, whose text the test wants that ``make`` makes for a task; nothing is shuffled."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("rows_kept")
        keep = make()
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield part.filter(pa.array(keep(as_bytes(part[text_col]))))

    return df.mapInArrow(run, df.schema)


def as_long(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser of 64-bit hashes (constants of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def filter_bits(df: DataFrame, col: str) -> np.ndarray:
    """A filter of ``FILTER_BITS`` bits with the longs of a column, made by the executors and merged word by word.

    The driver receives at most FILTER_BITS / 64 words. False positives are possible, misses are not.
    """
    words = (
        df.where(F.col(col).isNotNull()).select(F.pmod(F.xxhash64(F.col(col)), F.lit(FILTER_BITS)).alias("bit"))
        .select(F.expr("cast(bit div 64 as int)").alias("w"), F.expr("shiftleft(1L, cast(bit % 64 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(FILTER_BITS // 64, dtype=np.int64)
    rows = words.toArrow()
    out[rows["w"].to_numpy()] = rows["b"].to_numpy()
    return out
