"""Operator 1, quality classifier: a linear-chain conditional random field over the lines of a document.

Each line is good or bad. Its features are shares and counts of its own (letters, marks, repeated words, repeated lines,
...), cut into ranges, and those of the line before and after it. The field is fitted by maximum likelihood, with a
quadratic penalty, to the lines of a bounded sample of labelled documents (``SAMPLE`` of them, chosen by a hash of the id, with
``SAMPLE_LINES`` lines in all: each document of the sample gives an equal share of these at most, and what short ones
leave goes to the long ones, so none is left out and a long one gives its first lines); a line has its document's label. Forward-backward gives each line's marginal; the mean over a document's lines, each
weighted by its length, is the document's quality, mapped to a probability of label 1 by a logistic curve that is
fitted to the same sample. Documents of ``SAMPLE`` are collected as line features, never as texts.

Nulls and edges: a null or empty text, or one of blank lines only, gets the sample's share of label 1; very long texts are
read whole, line by line; documents with a null id are scored and count as not held out; repeated rows give a row
each; labels that are null, or of ids without a document, are not used; without any usable label every score is 0.5;
an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, claim, dropped, rows_kept, with_text, written
from fleetlens.llm.optimise import minimise, sigmoid

SAMPLE, SAMPLE_LINES = 6_000, 300_000
#: Upper ends of the ranges that each measure of a line is cut into.
RANGES: dict[str, list[float]] = {
    "upper": [0.0, 0.06, 0.2, 0.5],
    "symbols": [0.0, 0.01, 0.03, 0.08],
    "bars": [0.0, 0.02, 0.06],
    "bangs": [0.0, 0.01, 0.05],
    "digits": [0.0, 0.05, 0.2],
    "punctuation": [0.0, 0.02, 0.05, 0.12],
    "beyond_ascii": [0.0, 0.05],
    "word_length": [2.5, 4.0, 5.5, 8.0, 12.0],
    "same_as_before": [0.0, 0.05, 0.3],
    "distinct": [0.2, 0.5, 0.8, 0.95],
    "words": [0, 1, 3, 8, 25, 100],
    "marked_words": [0.0, 0.1, 0.4],
    "ends_sentence": [0.5],
    "repeats_line": [0.5],
    "tags": [0.0, 0.02],
}
WIDTH = sum(len(r) + 1 for r in RANGES.values())
#: Own, before, after, at the document's beginning, at its end, always.
FEATURES = 3 * WIDTH + 3
_STARTS = np.cumsum([0] + [len(r) + 1 for r in RANGES.values()][:-1])


def _class_table() -> np.ndarray:
    """For each byte: 1 upper, 2 symbol, 3 bar, 4 bang, 5 digit, 6 punctuation, 7 beyond ASCII (a character's first byte), 8 tag, 9 the rest of a character."""
    out = np.zeros(256, np.uint8)
    for k, chars in ((2, b"#$%&*@^~=+_\\"), (3, b"|"), (4, b"!"), (6, b".,;:?'\"()-/[]{}"), (8, b"<>")):
        out[list(chars)] = k
    out[0x41:0x5B], out[0x30:0x3A], out[0xC0:], out[0x80:0xC0] = 1, 5, 7, 9
    return out


_CLASS = _class_table()


def lines_of(text: bytes | None) -> list[bytes]:
    """The lines that are not blank."""
    return [x for x in (text or b"").split(b"\n") if x and not x.isspace()]


def line_features(lines: list[bytes]) -> np.ndarray:
    """Own features of each line: for each measure, the index of its range."""
    flat = _CLASS[np.frombuffer(b"".join(lines), np.uint8)]
    size = np.array([len(x) for x in lines])
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    count = {k: np.add.reduceat((flat == k).astype(np.int64), at) for k in range(1, 10)}
    n = np.maximum(size - count[9], 1)
    rows, seen = np.zeros((len(lines), 7)), set()
    for i, line in enumerate(lines):
        words = line.split()
        m = len(words)
        same = sum(map(bytes.__eq__, words, words[1:]))
        marked = sum(not (w[-1:].isalnum() or w[-1] >= 0x80 or w[-1:] in b".,;:?'\")") for w in words)
        rows[i] = m, same / m, len(set(words)) / m, marked / m, line.rstrip()[-1:] in b".?", line in seen, (n[i] - m + 1) / m
        seen.add(line)
    measures = {
        "upper": count[1] / n, "symbols": count[2] / n, "bars": count[3] / n, "bangs": count[4] / n, "digits": count[5] / n, "punctuation": count[6] / n,
        "beyond_ascii": count[7] / n, "tags": count[8] / n, "words": rows[:, 0], "same_as_before": rows[:, 1], "distinct": rows[:, 2], "marked_words": rows[:, 3],
        "ends_sentence": rows[:, 4], "repeats_line": rows[:, 5], "word_length": rows[:, 6],
    }
    return np.stack([np.searchsorted(r, measures[name], "left") for name, r in RANGES.items()], 1) + _STARTS


def chain_features(own: np.ndarray) -> np.ndarray:
    """Indices into the weights for each line of one document; -1 for none."""
    n = len(own)
    none = np.full((1, own.shape[1]), -1 - 2 * WIDTH)
    before, after = np.vstack([none, own[:-1]]), np.vstack([own[1:], none])
    edge = np.full((n, 3), -1)
    edge[0, 0], edge[-1, 1], edge[:, 2] = 3 * WIDTH, 3 * WIDTH + 1, 3 * WIDTH + 2
    return np.maximum(np.hstack([own, before + WIDTH, after + 2 * WIDTH, edge]), -1)


def batch_features(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features and lengths of all lines, and the number of lines of each text."""
    parts, sizes, counts = [np.zeros((0, 3 * len(RANGES) + 3), np.int64)], [], []
    for t in texts:
        lines = lines_of(t)
        counts.append(len(lines))
        if lines:
            parts.append(chain_features(line_features(lines)))
            sizes += [len(x) for x in lines]
    return np.concatenate(parts), np.array(sizes, np.float64), np.array(counts, np.int64)


class Field(NamedTuple):
    """weights: what each feature adds to the score of good; moves: scores of (from, to); slope, shift: of the curve."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    shift: float
    prior: float


def forward_backward(score: np.ndarray, moves: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For chains that stand one after another: each line's probability of good, expected moves, each chain's log sum.

    All chains advance together, the longest first, so the loop is as long as the longest chain.
    """
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    length = counts[order]
    n = len(score)
    emit = np.stack([np.zeros(n), score], 1)
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    logsum = lambda a, axis: np.logaddexp(a.take(0, axis), a.take(1, axis))
    if len(order):
        alpha[first] = emit[first]
    longest = int(length[0]) if len(order) else 0
    live = np.searchsorted(-length, -np.arange(1, longest + 1), "right")  # chains with so many lines at least
    for t in range(1, longest):
        i = first[: live[t]] + t
        alpha[i] = emit[i] + logsum(alpha[i - 1][:, :, None] + moves, 1)
    expected = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        i = first[: live[t]] + t
        beta[i - 1] = logsum(moves + (emit[i] + beta[i])[:, None, :], 2)
    log_z = np.zeros(len(counts))
    if len(order):
        log_z[order] = logsum(alpha[first + length - 1], 1)
    per_line = np.repeat(log_z, counts)
    good = np.exp(np.minimum(alpha[:, 1] + beta[:, 1] - per_line, 0))
    inner = np.ones(n, bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]] = False
    i = np.flatnonzero(inner)
    if len(i):
        expected = np.exp(alpha[i - 1][:, :, None] + moves + (emit[i] + beta[i])[:, None, :] - per_line[i][:, None, None]).sum(0)
    return good, expected, log_z


def _scores(weights: np.ndarray, features: np.ndarray) -> np.ndarray:
    return np.append(weights, 0.0)[features].sum(1)


def _means(good: np.ndarray, sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mean marginals weighted by length, as log odds; nan for documents without lines."""
    full = counts > 0
    at = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
    out = np.full(len(counts), np.nan)
    if full.any():
        m = np.add.reduceat(good * sizes, at) / np.add.reduceat(sizes, at)
        m = np.clip(m, 1e-6, 1 - 1e-6)
        out[full] = np.log(m / (1 - m))
    return out


def fit(features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> Field:
    """The field and the curve for documents whose lines' features stand one after another."""
    if not len(labels):
        return Field(np.zeros(FEATURES), np.zeros((2, 2)), 0.0, 0.0, 0.5)
    y = np.repeat(labels, counts).astype(int)
    inner = np.ones(len(y), bool)
    inner[np.concatenate([[0], np.cumsum(counts)[:-1]])[counts > 0]] = False
    seen = np.zeros((2, 2))
    i = np.flatnonzero(inner)
    np.add.at(seen, (y[i - 1], y[i]), 1)
    rows, cols = np.nonzero(features >= 0)
    index = features[rows, cols]

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        w, moves = x[:FEATURES], x[FEATURES:].reshape(2, 2)
        score = _scores(w, features)
        good, expected, log_z = forward_backward(score, moves, counts)
        value = log_z.sum() - (score * y).sum() - (seen * moves).sum() + penalty / 2 * (x @ x)
        g = np.bincount(index, (good - y)[rows], FEATURES)
        return value, np.concatenate([g, (expected - seen).ravel()]) + penalty * x

    x = minimise(loss, np.zeros(FEATURES + 4), 120)
    w, moves = x[:FEATURES], x[FEATURES:].reshape(2, 2)
    m = _means(forward_backward(_scores(w, features), moves, counts)[0], sizes, counts)
    ok = ~np.isnan(m)
    t, u = labels[ok].astype(float), np.stack([m[ok], np.ones(ok.sum())], 1)

    def curve(z: np.ndarray) -> tuple[float, np.ndarray]:
        p = sigmoid(u @ z)
        return -(t * np.log(p + 1e-12) + (1 - t) * np.log(1 - p + 1e-12)).sum() + 0.01 * (z @ z), u.T @ (p - t) + 0.02 * z

    slope, shift = minimise(curve, np.array([1.0, 0.0]), 60) if len(t) else (0.0, 0.0)
    return Field(w, moves, float(slope), float(shift), float(labels.mean()))


def score_texts(field: Field, texts: list[bytes | None]) -> np.ndarray:
    features, sizes, counts = batch_features(texts)
    m = _means(forward_backward(_scores(field.weights, features), field.moves, counts)[0], sizes, counts)
    return np.where(np.isnan(m), field.prior, sigmoid(field.slope * np.nan_to_num(m) + field.shift))


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sampled_labels(labels: DataFrame, label_col: str, out: Column, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``most`` labelled ids outside the held-out fold, by a hash of the id; small enough to be sent to all."""
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    rows = rows.where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~out)
    return rows.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(most)


def share_of(lengths: list[tuple[int, int]], total: int) -> int:
    """The most lines that each document may give so that there are no more than ``total``; of pairs of lines and documents."""
    left, docs = total, sum(n for _, n in lengths)
    for length, n in sorted(lengths):
        if length * docs > left:
            return left // docs
        left, docs = left - length * n, docs - n
    return max((length for length, _ in lengths), default=0)


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 5, fold: int = 0, sample: int = SAMPLE, lines: int = SAMPLE_LINES, id_col: str = "doc_id", text_col: str = "text") -> Field:
    chosen = written(sampled_labels(labels, "quality", held_out("id", folds, fold), sample, id_col), "labels")
    rows = with_text(docs, id_col, text_col).join(chosen, "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            features, sizes, counts = batch_features(as_bytes(batch["text"]))
            ends = np.cumsum(counts)
            data = [(features[e - c : e].astype(np.int16).tobytes(), sizes[e - c : e].astype(np.int32).tobytes()) for e, c in zip(ends, counts, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["label"], pa.array(counts), pa.array([a for a, _ in data], pa.binary()), pa.array([b for _, b in data], pa.binary())], names=["id", "label", "lines", "features", "sizes"])

    measured = written(rows.mapInArrow(measure, "id long, label int, lines long, features binary, sizes binary"), "measured")
    most = share_of([(r["lines"], r["count"]) for r in measured.groupBy("lines").count().collect()], lines)  # no more rows than ``sample``
    width = 2 * (3 * len(RANGES) + 3)
    got = measured.where(F.lit(most > 0)).select("id", "label", F.substring("features", 1, most * width).alias("features"), F.substring("sizes", 1, most * 4).alias("sizes")).toArrow().sort_by("id")
    dropped(measured, chosen)
    sizes = [np.frombuffer(x, np.int32) for x in got["sizes"].to_pylist()]
    features = np.frombuffer(b"".join(got["features"].to_pylist()), np.int16).reshape(-1, 3 * len(RANGES) + 3).astype(np.int64)
    return fit(features, np.concatenate([np.zeros(0), *sizes]), np.array([len(s) for s in sizes], np.int64), got["label"].to_numpy().astype(np.int64))


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, folds: int = 5, fold: int = 0, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    spark = docs.sparkSession
    field = spark.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold, sample=sample, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality")
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                yield pa.RecordBatch.from_arrays([part["id"], pa.array(score_texts(field.value, as_bytes(part["text"])))], names=["id", "score"])

    out = with_text(docs, id_col, text_col).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias("doc_id"), held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.3, text_col: str = "text", **options: object) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be bad."""
    field = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))  # type: ignore[arg-type]
    return rows_kept(docs, text_col, lambda: lambda texts: score_texts(field.value, texts) >= threshold)
