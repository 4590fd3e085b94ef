"""Operator 9, licence scan: diagonal voting.

Each template is a sequence of words. The rolling hashes of all word k-grams of a document are joined with the places of
the same k-grams in the templates. A hit at word ``i`` of the document and word ``j`` of a template votes for the diagonal
``i - j`` of that template in that document; votes are counted by diagonal, diagonals that differ by a few words (a word
more or less in the text) are merged, and the merged spans, however few votes they have, are verified word by word
against the template, as changed words that are spread out break most k-grams. The worker
that makes the hashes leaves out those that no template has, which are the ones the join would drop.

Base phrases are templates that must stand word for word; notices are longer templates with labels of their own that may
miss some words. The score is 1 - product(1 - covered share of each label's best span).

Nulls and edges: a null text is empty; a text without words has 0 words, no labels and score 0; null ids and repeated
rows give a row each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, with_text, written

#: Words of a k-gram: of base phrases, the shortest of which has two, and of notices.
K, NOTICE_K = 2, 3
#: Diagonals this near are one span; so much of a notice must stand in the span.
NEAR, SHARE = 3, 0.8
#: Base phrases, fixed values.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notices with the labels of this method.
NOTICES = {
    "licensed under the apache license version 2 0": "apache-2.0",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache-2.0",
    "this work is licensed under the gnu general public license version 3": "gpl-3.0",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "this work is licensed under the gnu general public license version 2": "gpl-2.0",
    "licensed under cc by 4 0": "cc-by-4.0",
    "licensed under cc by sa 4 0": "cc-by-sa-4.0",
    "licensed under cc by nc 4 0": "cc-by-nc-4.0",
    "licensed under a creative commons attribution 4 0 international license": "cc-by-4.0",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "mozilla public license version 2 0": "mpl-2.0",
    "all rights reserved": "all-rights-reserved",
}
_SPACE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case."""
    return text.translate(_SPACE).split() if text else []


def _templates(base: dict[str, str], notices: dict[str, str]) -> list[tuple[int, list[bytes], str, bool]]:
    both = [(p, label, True) for p, label in base.items()] + [(p, label, False) for p, label in notices.items()]
    return [(t, p.encode().split(), label, exact) for t, (p, label, exact) in enumerate(both)]


def scan(docs: DataFrame, *, base: dict[str, str] = BASE, notices: dict[str, str] = NOTICES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``."""
    spark = docs.sparkSession
    templates = _templates(base, notices)
    vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, t, _, _ in templates for w in t), 1)}
    size = len(vocabulary) + 1

    def gram(ids: np.ndarray, k: int) -> np.ndarray:
        """Exact hashes: k digits to the base ``size``, those of different k apart."""
        if len(ids) < k:
            return np.zeros(0, np.int64)
        return sum((ids[j : len(ids) - k + 1 + j] * size ** (k - 1 - j) for j in range(k)), np.int64(size**NOTICE_K * (k == K)))

    places = []
    for t, ws, label, exact in templates:
        ids = np.array([vocabulary[w] for w in ws], np.int64)
        places += [(int(h), t, j, len(ws), label, exact) for j, h in enumerate(gram(ids, K if exact else NOTICE_K))]
    longest = max(len(ws) for _, ws, _, _ in templates) + NEAR
    known = np.unique(np.array([p[0] for p in places], np.int64))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("grams", pa.list_(pa.struct([("h", pa.int64()), ("i", pa.int64())]))), ("known", pa.list_(pa.int32())), ("at", pa.list_(pa.int64()))])
        get = vocabulary.get
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc, text in zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                ws = words(text)
                ids = np.fromiter((get(w, 0) for w in ws), np.int64, len(ws))
                hits, near = [], np.zeros(0, np.int64)
                for k in (K, NOTICE_K):
                    h = gram(ids, k)
                    full = np.flatnonzero(ids[: len(h)])  # most words are in no template
                    i = full[np.isin(h[full], known)]
                    hits += zip(h[i].tolist(), i.tolist(), strict=True)
                    near = i if k == NOTICE_K else near
                # the words that spans are verified with: those of the templates around a hit, with their places
                mine = np.unique(np.concatenate([np.arange(max(0, i - longest), min(len(ids), i + longest)) for i in near.tolist()])) if len(near) else near
                mine = mine[ids[mine] > 0]
                for col, v in zip(rows, (doc, len(ws), [{"h": h, "i": i} for h, i in hits], ids[mine].tolist(), mine.tolist()), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    ddl = "id long, n_words long, grams array<struct<h:long,i:long>>, known array<int>, at array<long>"
    rows = written(with_text(docs, id_col, text_col).mapInArrow(hashes, ddl).withColumn("row", F.monotonically_increasing_id()), "grams")
    index = spark.createDataFrame(places, "h long, t int, j int, size int, label string, exact boolean")
    votes = rows.select("row", F.explode("grams").alias("g")).select("row", "g.h", "g.i").join(index, "h")
    diagonals = votes.groupBy("row", "t", "size", "label", "exact", (F.col("i") - F.col("j")).alias("d")).agg(F.count("*").alias("n"))
    # exact phrases: every k-gram of the phrase on one diagonal, which is the phrase word for word
    exact = diagonals.where(F.col("exact") & (F.col("n") == F.col("size") - K + 1)).select("row", "label", F.col("d").alias("word"))
    exact = exact.groupBy("row").agg(F.count("*").alias("n_base"), F.min("word").alias("first_word"), F.max("word").alias("last_word"), F.collect_set("label").alias("base"))
    # notices: neighbouring diagonals are one span if none is further than NEAR from the last
    w = Window.partitionBy("row", "t").orderBy("d")
    near = diagonals.where(~F.col("exact")).withColumn("new", F.coalesce((F.col("d") - F.lag("d").over(w) > NEAR).cast("int"), F.lit(1))).withColumn("span", F.sum("new").over(w))
    spans = near.groupBy("row", "t", "size", "label", "span").agg(F.min("d").alias("from"), F.max("d").alias("to"), F.sum("n").alias("n"))
    length = {t: [vocabulary[x] for x in ws] for t, ws, _, e in templates if not e}
    span_rows = spans.groupBy("row").agg(F.collect_list(F.struct("t", "label", "from", "to")).alias("spans"))
    schema = pa.schema([("row", pa.int64()), ("label", pa.list_(pa.string())), ("share", pa.list_(pa.float64()))])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], []]
            for row, spans_, ids, at in zip(*(batch[c].to_pylist() for c in ("row", "spans", "known", "at")), strict=True):
                best: dict[str, float] = {}
                where, found = np.array(at, np.int64), []
                for s in spans_:
                    t = length[s["t"]]
                    a, b = np.searchsorted(where, [s["from"], s["to"] + len(t)])
                    share = _common(t, ids[a:b]) / len(t)
                    if share >= SHARE:
                        found.append((share, s["from"], s["to"] + len(t), s["label"]))
                for share, label in fitting_best(found):
                    best[label] = max(best.get(label, 0), share)
                out[0].append(row)
                out[1].append(list(best))
                out[2].append(list(best.values()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    own = span_rows.join(rows.select("row", "known", "at"), "row").select("row", "spans", "known", "at").mapInArrow(verify, "row long, label array<string>, share array<double>")
    none = F.array().cast("array<string>")
    out = rows.select("row", "id", "n_words").join(exact, "row", "left").join(own, "row", "left")
    base_set = F.coalesce("base", none)
    missed = F.aggregate(F.coalesce("share", F.array().cast("array<double>")), F.lit(1.0), lambda a, x: a * (F.lit(1.0) - x * F.lit(0.9)))
    return out.select(
        F.col("id").alias("doc_id"), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base_set, F.coalesce("label", none)))), ",").alias("labels"),
        (F.lit(1.0) - missed * F.pow(F.lit(0.1), F.size(base_set))).alias("score"),
    )


def fitting_best(found: list[tuple[float, int, int, str]]) -> Iterator[tuple[float, str]]:
    """Of spans (share, from, to, label) over the same words, such as two versions of a licence, those that fit best.

    Spans go by falling share; what better ones cover is kept as sorted intervals that don't touch, so each span is a search.
    """
    starts: list[int] = []
    ends: list[int] = []
    for share, group in groupby(sorted(found, key=lambda s: -s[0]), key=lambda s: s[0]):
        spans = [(a, b, label) for _, a, b, label in group]
        for a, b, label in spans:
            if bisect_right(ends, a) == bisect_left(starts, b):  # no interval ends behind the beginning and begins before the end
                yield share, label
        for a, b, _ in spans:
            i, j = bisect_left(ends, a), bisect_right(starts, b)
            if i < j:
                a, b = min(a, starts[i]), max(b, ends[j - 1])
            starts[i:j], ends[i:j] = [a], [b]


def _common(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence; a is a template, b a span of about its length."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], max(row[j], row[j - 1], diagonal + (x == y))
    return row[-1]
