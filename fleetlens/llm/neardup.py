"""Operator 5, embedding near-dedup: iterative quantisation and multi-index Hamming tables, reranked exactly.

On a bounded sample of unit vectors (``SAMPLE`` rows, chosen by hash) rotations are learned that balance binary codes:
the sign of each rotated, centred coordinate is a bit. Two rotations from different starts give 2 x d bits; random
rotations are added until there are bits for all tables. The bits are cut into chunks, as wide as the largest label's
number of vectors in binary (``WIDTHS``, so up to 4 billion vectors of a label), so that a bucket holds a few vectors. Each
chunk is a table: a vector is stored under its chunk, and looked up under its chunk and all chunks that differ in one bit,
within its label. What is shuffled for a look-up is label, table and chunk, the vector's id and its packed code, of which
the chunks of all tables are read off. A pair found in several tables is kept in the first only, which the codes tell without
a shuffle; pairs whose codes differ in more than ``FAR`` of their bits go; all others are verified on the original vectors
in double precision. At a
cosine of 0.93 a bit differs with probability 0.12; there are so many tables that a pair at the threshold is missed with a
probability of ``MISS`` at most by the arithmetic of independent bits. Found links are exact.

Equal vectors of one label are one class with a count, so a vector that is repeated ever so often costs one entry.

Nulls and edges: a vector that is null, empty, zero, or holds null or non-finite components, or a null label, or a null
id, links with nothing and is returned with 0 links and its own id; vectors of other lengths than a label's usual one
link only with vectors of their own length; repeated rows count as copies; an empty table gives no rows; other columns
are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, written
from fleetlens.llm.graph import components
from fleetlens.llm.kmeans import iterative_quantisation

SAMPLE, ROTATIONS, FAR, MISS = 20_000, 2, 0.36, 2e-4
#: Least and largest width of a chunk in bits.
WIDTHS = (8, 32)
#: Lengths whose results are gathered in one plan.
TOGETHER = 50


def usable(vector: str) -> Column:
    """Neither null nor empty nor zero, all components finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector(df: DataFrame, col: str) -> Column:
    """The column as it is if of floats, else in doubles, so that nothing is rounded."""
    kind = df.schema[col].dataType.simpleString()
    return F.col(col) if kind == "array<float>" else F.col(col).cast("array<double>")


def tables_for(threshold: float, chunk: int, miss: float = MISS) -> int:
    """So many chunks that two vectors at the threshold are within one bit in none of them with probability ``miss`` at most."""
    p = np.arccos(min(max(threshold, -1.0), 1.0)) / np.pi
    found = (1 - p) ** chunk + chunk * p * (1 - p) ** (chunk - 1)
    return 1 if found >= 1 else max(1, int(np.ceil(np.log(miss) / np.log(1 - found))))


def over_lengths(classes: DataFrame, empty: DataFrame, find: Callable[[DataFrame, int], DataFrame]) -> DataFrame:
    """The union of ``find(classes of length d, d)`` over all lengths ``d``; of many lengths parts are written, so plans stay small."""
    lengths = sorted(r["d"] for r in classes.select("d").distinct().collect())
    parts = [empty]
    for a in range(0, len(lengths), TOGETHER):
        part = reduce(DataFrame.unionByName, [find(classes.where(F.col("d") == d), d) for d in lengths[a : a + TOGETHER]])
        parts.append(written(part, "lengths") if len(lengths) > TOGETHER else part)
    return reduce(DataFrame.unionByName, parts)


def near_duplicates(vectors: DataFrame, *, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept``; links join vectors of equal labels with a cosine of ``threshold`` or more."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector(vectors, vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    fit = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))
    classes = written(fit.groupBy("label", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")).withColumn("d", F.size("v")), "vectors")
    read: list[DataFrame] = []
    links = over_lengths(classes, spark.createDataFrame([], "a long, b long, na long, nb long"), lambda own, d: _links(own, d, threshold, read))
    links = written(links, "links")
    dropped(*read)
    part = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    ends = links.select(F.col("a").alias("rep"), F.col("nb").alias("n")).unionByName(links.select(F.col("b").alias("rep"), F.col("na").alias("n")))
    counts = ends.groupBy("rep").agg(F.sum("n").alias("n"))
    of = classes.join(counts, "rep", "left").join(part.withColumnRenamed("id", "rep"), "rep", "left")
    of = of.select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    # the vector itself is the key only of the classes; rows meet their class by label and vector
    out = fit.join(of, ["label", "v"], "left").select("id", "n_links", "component_id")
    rest = rows.where(~(F.col("id").isNotNull() & F.col("label").isNotNull() & usable("v"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _links(classes: DataFrame, d: int, threshold: float, read: list[DataFrame]) -> DataFrame:
    """Links of vectors of one length; the table that they are made from is added to ``read``."""
    spark = classes.sparkSession
    sample = classes.select("v").orderBy(F.xxhash64("v"), "v").limit(SAMPLE).toArrow()
    x = np.array(sample["v"].to_pylist(), np.float64).reshape(-1, d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0) if len(x) else np.zeros(d)
    largest = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 1
    chunk = min(max(int(largest).bit_length(), WIDTHS[0]), WIDTHS[1])
    tables = tables_for(threshold, chunk)
    rotations = max(ROTATIONS, -(-tables * chunk // d))
    # learned ones may end alike where there are few dimensions; without rows they are random
    held = spark.sparkContext.broadcast((mean, np.hstack([iterative_quantisation(x - mean if s < ROTATIONS else x[:0], seed=s) for s in range(rotations)])))
    # as many whole chunks as fit lie side by side in a long of the code
    per = 63 // chunk
    words = -(-tables // per)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, rotation = held.value
        for batch in batches:
            v = batch["v"].flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
            v /= np.linalg.norm(v, axis=1, keepdims=True)
            on = ((v - centre) @ rotation[:, : tables * chunk]) >= 0
            padded = np.zeros((len(on), words * per * chunk), bool)
            padded[:, : tables * chunk] = on
            longs = padded.reshape(-1, words, per * chunk) @ (np.int64(1) << np.arange(per * chunk, dtype=np.int64))
            ends = pa.array(np.arange(0, longs.size + 1, words, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch["rep"], batch["label"], pa.ListArray.from_arrays(ends, pa.array(longs.astype(np.int64).ravel()))], names=["rep", "label", "code"])

    coded = written(classes.select("rep", "label", "v").mapInArrow(code, "rep long, label string, code array<long>"), "codes")
    read.append(coded)
    chunk_of = lambda longs, i: f"shiftrightunsigned({longs}, cast({i} % {per} * {chunk} as int)) & {(1 << chunk) - 1}L"
    stored = coded.select("rep", "label", "code", F.explode(F.array(*map(F.lit, range(tables)))).alias("t"))
    stored = stored.withColumn("key", F.expr(f"shiftleft(cast(t as bigint), 32) | ({chunk_of(f'code[cast(t div {per} as int)]', 't')})"))
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << k).cast("long") for k in range(chunk)))
    asked = stored.select(F.col("rep").alias("rep2"), "label", F.col("code").alias("code2"), F.explode(F.transform(flips, lambda f: F.col("key").bitwiseXOR(f))).alias("key"))
    apart = F.aggregate(F.zip_with("code", "code2", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    # in no earlier table are the two chunks within one bit
    both = f"code[cast(i div {per} as int)] ^ code2[cast(i div {per} as int)]"
    met = F.expr(f"exists(slice(array({', '.join(map(str, range(tables)))}), 1, t), i -> bit_count({chunk_of(both, 'i')}) <= 1)")
    pairs = stored.join(asked, ["label", "key"]).where((F.col("rep") < F.col("rep2")) & (apart <= int(FAR * tables * chunk)) & ~met)
    pairs = pairs.select(F.col("rep").alias("a"), F.col("rep2").alias("b"))
    side = lambda end, v, n: classes.select(F.col("rep").alias(end), F.col("v").alias(v), F.col("copies").alias(n))
    near = pairs.join(side("a", "x", "na"), "a").join(side("b", "y", "nb"), "b")
    cosine = dot("x", "y") / (F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y")))
    return near.where(cosine >= threshold).select("a", "b", "na", "nb")
