"""Operator 2, approximate nearest neighbours by inner product: inverted lists of product-quantised residuals.

On a bounded sample (``SAMPLE`` rows, chosen by hash) coarse centroids are learned and, for the residuals, a codebook
for each pair of dimensions. Every vector is filed under its centroid as one byte a subspace. The index lies in shards of
at most ``SHARD`` vectors and of whole lists whose centroids are near each other; a longer list is dealt to several shards,
so no list, however popular, is one task's. A query goes to the shards that hold lists that it probes, and to no other, in
blocks of ``BLOCK``: the lists whose centroids have the largest inner products are scanned with its asymmetric distance
tables (as the inner product is linear, one table serves all lists: q.c + q.r). An entry knows how far its codes are from
its vector, so its sum bounds its score. The best ``RERANK`` by these sums are scored exactly, on the original vectors in double
precision, and then every entry whose bound reaches the least score that they leave: of the lists that a query probes none is missed,
however near each other the vectors are.

Which share of the lists is probed, is measured: the least that holds ``GOAL`` of the nearest others, in the sample, of ``ASKED``
of the queries. Where vectors cluster that is a few lists; directions without any clusters, the worst case, need
about three quarters, and work and shuffles then grow with queries times shards. Further lists are scanned, in the same
order, until ``RERANK`` entries are: a small table is searched whole. Vectors farther from each centroid than any of the
sample are in a list of their own, which all queries probe.

Equal vectors are one entry with the smallest ids that can matter, so hot vectors cost no more than others.

Nulls and edges: vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id, take
no part; vectors of different lengths never meet; rows that repeat an id and vector count once; a query without
candidates gives no rows, as does an empty table; other columns are never read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, written
from fleetlens.llm.kmeans import kmeans
from fleetlens.llm.neardup import over_lengths, usable, vector

SAMPLE, MOST_LISTS, RERANK = 20_000, 1024, 120
GOAL, ASKED = 0.985, 1_000
#: Vectors in a shard and queries in a block.
SHARD, BLOCK = 32_768, 2_048


def search(vectors: DataFrame, is_query: Column, *, k: int = 20, probe: float | None = None, rerank: int = RERANK, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest of each row for which ``is_query`` (over ``id``) holds.

    ``probe``: the share of the lists that is probed; by default it is measured.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vector(vectors, vector_col).alias("v"))
    rows = rows.where(F.col("id").isNotNull() & usable("v")).distinct()
    # of equal vectors, the k + 1 smallest ids can be among some query's k nearest other rows
    least = rows.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("n") <= k + 1)
    classes = written(least.groupBy("v").agg(F.min("id").alias("rep"), F.sort_array(F.collect_list("id")).alias("members")).withColumn("d", F.size("v")), "vectors")
    asking = written(rows.where(is_query).join(classes.select("v", "rep"), "v").select("id", "rep"), "queries")
    best = over_lengths(
        classes, spark.createDataFrame([], "q long, c long, score double"),
        lambda own, d: _candidates(own, own.join(asking.select("rep").distinct(), "rep", "left_semi"), d, k, probe, rerank),
    )
    found = best.join(classes.select(F.col("rep").alias("c"), "members"), "c").select("q", "score", F.explode("members").alias("vec_id"))
    found = found.join(asking.select(F.col("id").alias("query_id"), F.col("rep").alias("q")), "q").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.select("query_id", F.row_number().over(w).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _candidates(own: DataFrame, asked: DataFrame, d: int, k: int, probe: float | None, rerank: int) -> DataFrame:
    """For each distinct query the ``k + 1`` best entries of the lists that it probes, with their scores."""
    spark = own.sparkSession
    sample, reps = _drawn(own, F.xxhash64("v"), SAMPLE, d)
    some = _drawn(asked, F.xxhash64("rep", F.lit(1)), ASKED, d)
    centres = kmeans(sample, int(min(max(own.count() ** 0.5, 1), MOST_LISTS)))
    lists = len(centres)
    width = 2 if d % 2 == 0 else 1
    spaces = d // width
    of = _nearest(sample, centres)
    books = np.zeros((spaces, 256, width), np.float32)
    for m in range(spaces):
        book = kmeans((sample - centres[of])[:, m * width : (m + 1) * width], 256, 6)
        books[m, : len(book)] = book
        books[m, len(book) :] = book[0] if len(book) else 0
    reach = np.sqrt(((sample - centres[of]) ** 2).sum(1).max()) * (1 + 1e-9) if lists else 0.0
    take = min(lists, int(np.ceil((_share(sample, centres, of, k, reps, some) if probe is None else probe) * lists))) + 1
    # the last list is that of vectors far from all centres
    centres = np.concatenate([centres, np.zeros((1, d))])
    held = spark.sparkContext.broadcast((centres, books))  # 1025 x d doubles and 256 x d floats at most
    kind = "f4" if own.schema["v"].dataType.simpleString() == "array<float>" else "f8"

    def file(batches):  # noqa: ANN001, ANN202
        c, b = held.value
        for pdf in batches:
            x = np.stack(pdf["v"].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, d))
            at = _nearest(x, c[:-1])
            at[((x - c[at]) ** 2).sum(1) > reach**2] = lists
            r = x - c[at]
            codes, coded = np.empty((len(x), spaces), np.uint8), np.empty_like(r)
            for m in range(spaces):
                here = slice(m * width, (m + 1) * width)
                codes[:, m] = _nearest(r[:, here], b[m])
                coded[:, here] = b[m][codes[:, m]]
            # how much a sum, in floats, can be off for a query of length one
            norm = lambda y: np.sqrt((y**2).sum(1))
            off = norm(r - coded) + 1e-5 * (norm(c[at]) + spaces**0.5 * norm(coded))
            yield pd.DataFrame({"rep": pdf["rep"], "list": at.astype(np.int32), "code": [row.tobytes() for row in codes], "off": off, "x": [row.tobytes() for row in x.astype(kind)]})

    index = written(own.select("rep", "v").mapInPandas(file, "rep long, list int, code binary, off double, x binary"), "index")
    filled = np.zeros(lists + 1, np.int64)
    for r in index.groupBy("list").count().collect():
        filled[r["list"]] = r["count"]
    enough = max(rerank, k + 1)
    first, parts = _shards(centres, filled)

    def route(batches):  # noqa: ANN001, ANN202
        c, _ = held.value
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                part = pdf.iloc[a : a + 256]
                row, at = np.nonzero(_probed(np.stack(part["v"].to_numpy()).astype(np.float64), c, filled, take, enough)[1])
                row, at, piece = np.repeat(row, parts[at]), np.repeat(at, parts[at]), np.concatenate([np.arange(p) for p in parts[at]])
                row, shard = np.unique(np.stack([row, first[at] + piece]), axis=1)
                yield pd.DataFrame({"q": part["rep"].to_numpy()[row], "v": part["v"].to_numpy()[row], "shard": shard.astype(np.int32)})

    visits = written(asked.select("rep", "v").mapInPandas(route, f"q long, v {asked.schema['v'].dataType.simpleString()}, shard int"), "visits")
    blocks = visits.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    of_list = spark.createDataFrame([(i, int(first[i]), int(parts[i])) for i in range(lists + 1)], "list int, first int, parts int")  # MOST_LISTS rows at most
    stored = index.join(F.broadcast(of_list), "list").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("rep"), "parts").cast("int"))
    stored = stored.join(blocks, "shard").select("rep", "list", "code", "off", "x", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    dealt = visits.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("q", F.lit(1)), "blocks").cast("int")).drop("blocks")

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c, b = held.value
        if not len(left) or not len(right):
            return pd.DataFrame({"q": [], "c": [], "score": []}).astype({"q": "int64", "c": "int64", "score": "float64"})
        left = left.sort_values(["list", "rep"], ignore_index=True)
        codes = np.frombuffer(b"".join(left["code"]), np.uint8).reshape(-1, spaces)
        whole = np.frombuffer(b"".join(left["x"]), kind).reshape(-1, d)
        reps, at, off = left["rep"].to_numpy(), left["list"].to_numpy(), left["off"].to_numpy()
        out = []
        for a in range(0, len(right), 64):
            part = right.iloc[a : a + 64]
            q = np.stack(part["v"].to_numpy()).astype(np.float64)
            near, probed = _probed(q, c, filled, take, enough)
            tables = np.einsum("qmw,mkw->mqk", q.reshape(-1, spaces, width), b).astype(np.float32)
            # the inverted lists that some query of the slice probes, one after another
            on = np.flatnonzero(probed.any(0)[at])
            score = near[:, at[on]].astype(np.float32)
            for m in range(spaces):
                score += tables[m][:, codes[on, m]]
            wanted = probed[:, at[on]]
            score[~wanted] = -np.inf
            top = np.argpartition(-score, enough - 1, axis=1)[:, :enough] if score.shape[1] > enough else np.broadcast_to(np.arange(score.shape[1]), score.shape)
            best = _exact(q, whole, np.repeat(np.arange(len(q)), top.shape[1]), on[top].ravel()).reshape(top.shape)
            best[~np.take_along_axis(wanted, top, 1)] = -np.inf
            least = np.partition(best, -(k + 1), axis=1)[:, -(k + 1)] if best.shape[1] > k else np.full(len(q), -np.inf)
            bound = np.sqrt((q**2).sum(1))[:, None] * off[on]
            bound += score
            row, col = np.nonzero(wanted & ~(bound < least[:, None]))  # what isn't a number stays
            s, c_ = _exact(q, whole, row, on[col]), reps[on[col]]
            order = np.lexsort((c_, -s, row))
            row, s, c_ = row[order], s[order], c_[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) <= k
            out.append(pd.DataFrame({"q": part["q"].to_numpy()[row[keep]], "c": c_[keep], "score": s[keep]}))
        return pd.concat(out, ignore_index=True)

    got = stored.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block")).applyInPandas(scan, "q long, c long, score double")
    # k + 1 classes at least have the k nearest other rows
    w = Window.partitionBy("q").orderBy(F.desc("score"), "c")
    best = written(got.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k + 1).drop("n"), "candidates")
    dropped(index, visits)
    return best


def _drawn(rows: DataFrame, order: Column, most: int, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors and ids of at most so many rows."""
    got = rows.select("rep", "v").orderBy(order, "v").limit(most).toArrow()
    return np.array(got["v"].to_pylist(), np.float64).reshape(-1, d), got["rep"].to_numpy()


def _exact(q: np.ndarray, vectors: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Inner products in double precision, summed one component after another, as SQL does."""
    out = np.empty(len(row))
    for a in range(0, len(row), 16_384):
        here = slice(a, a + 16_384)
        out[here] = np.cumsum(q[row[here]] * vectors[at[here]].astype(np.float64), axis=1)[:, -1]
    return out


def _probed(q: np.ndarray, centres: np.ndarray, filled: np.ndarray, take: int, enough: int) -> tuple[np.ndarray, np.ndarray]:
    """The inner products of queries and centres, and which lists each query probes, the last one first: ``take``, or as many as hold ``enough``."""
    near = q @ centres.T
    first = -near
    first[:, -1] = -np.inf
    order = np.argsort(first, axis=1, kind="stable")
    before = np.cumsum(filled[order], 1) - filled[order]
    probed = np.zeros(near.shape, bool)
    np.put_along_axis(probed, order, (np.arange(len(centres)) < take) | (before < enough), 1)
    return near, probed


def _share(sample: np.ndarray, centres: np.ndarray, of: np.ndarray, k: int, reps: np.ndarray | None = None, asked: tuple[np.ndarray, np.ndarray] | None = None) -> float:
    """The least share of the lists, best first, that holds ``GOAL`` of the ``k`` nearest others, in the sample, of queries.

    ``asked``: vectors and ids of queries, with ``reps`` as ids of the sample; by default its first rows ask.
    """
    ids = np.arange(len(sample)) if reps is None else reps
    queries, own = (sample[:ASKED], ids[:ASKED]) if asked is None else asked
    k, ranks = min(k, len(sample) - 1), []
    for a in range(0, len(queries) if k > 0 else 0, 250):
        q = queries[a : a + 250]
        score = q @ sample.T
        score[own[a : a + 250, None] == ids] = -np.inf
        top = np.argpartition(-score, k - 1, axis=1)[:, :k]
        place = np.argsort(np.argsort(-(q @ centres.T), axis=1), axis=1)
        ranks.append(np.take_along_axis(place, of[top], 1).ravel())
    return (np.quantile(np.concatenate(ranks), GOAL, method="higher") + 1) / len(centres) if ranks else 1.0


def _shards(centres: np.ndarray, filled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first shard of each list and the number of shards that it is dealt to."""
    near = _nearest(centres, kmeans(centres, min(len(centres), max(1, int(filled.sum()) // SHARD))))
    first, parts = np.zeros(len(filled), np.int64), np.maximum(1, -(-filled // SHARD))
    shard, held = 0, 0
    for i in np.argsort(near, kind="stable"):
        if held and held + filled[i] > SHARD:
            shard, held = shard + 1, 0
        first[i], held = shard, held + filled[i]
        if parts[i] > 1:
            shard, held = shard + int(parts[i]), 0
    return first, parts


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres**2).sum(1)
    out = np.empty(len(x), np.int64)
    for a in range(0, len(x), 4096):
        out[a : a + 4096] = (norms - 2 * x[a : a + 4096] @ centres.T).argmin(1)
    return out
