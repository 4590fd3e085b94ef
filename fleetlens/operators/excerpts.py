"""Source lines around places, by a table of line offsets. A file that is missing or has no text gives nothing; lines count from 1.

``line_starts`` is made once for a set of files; from then on a window of lines is a slice of a file's bytes, whatever its
size. A line beyond the end has what of its window there is, an empty text if there is none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def line_starts(files: DataFrame) -> DataFrame:
    """``slug, path, starts``: the byte at which each line begins, and last the byte after the text and its last line end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cell in batch["text"].cast(pa.binary()):
                data = np.frombuffer(cell.as_buffer(), np.uint8) if len(cell.as_buffer()) else np.zeros(0, np.uint8)
                ends = np.flatnonzero(data == 10) + 1
                last = [] if len(ends) and ends[-1] == len(data) else [len(data) + 1]
                out.append(np.concatenate([[0], ends, last]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch["slug"], batch["path"], pa.array(out, pa.list_(pa.int64()))], names=["slug", "path", "starts"])

    return files.where("text is not null").select("slug", "path", "text").mapInArrow(run, "slug string, path string, starts array<long>")


def windows(places: DataFrame, files: DataFrame, starts: DataFrame, before: int, after: int) -> DataFrame:
    """``places`` (slug, path, line, and more) with the number of the window's ``first`` line and its ``content``."""
    n = F.size("starts") - 1
    rows = places.join(starts, ["slug", "path"]).withColumn("_a", F.least(F.greatest(F.col("line") - 1 - before, F.lit(0)), n)).withColumn("_b", F.greatest(F.least(F.col("line") + after, n), F.col("_a")))
    rows = rows.withColumns({"_from": F.get("starts", F.col("_a")), "_to": F.get("starts", F.col("_b")) - 1, "first": F.col("_a") + 1}).drop("starts", "_a", "_b")
    cut = F.expr("cast(substring(cast(text as binary), cast(_from + 1 as int), cast(greatest(_to - _from, 0) as int)) as string)")
    return rows.join(files.where("text is not null").select("slug", "path", "text"), ["slug", "path"]).withColumn("content", cut).drop("text", "_from", "_to")


def _numbered(content: Column, first: Column | str, line: Column | str) -> Column:
    first, line = (F.col(c) if isinstance(c, str) else c for c in (first, line))
    return F.transform(F.split(content, "\n"), lambda x, i: F.concat(F.when(first + i == line, "→ ").otherwise("  "), F.format_string("%4d", first + i), F.lit("  "), x))


def contexts(places: DataFrame, files: DataFrame, starts: DataFrame, around: int = 3) -> DataFrame:
    """``places`` with their ``context``: numbered lines around each, the place itself marked by an arrow."""
    return windows(places, files, starts, around, around).withColumn("context", _numbered(F.col("content"), "first", "line")).drop("content", "first")


def context(text: Column, line: Column, around: int = 3) -> Column:
    """The same for a single text at hand: what stands before the window's end is cut off, then what stands before it."""
    lines = lambda t, n: F.call_function("substring_index", t, F.lit("\n"), n.cast("int"))
    upto = lines(F.regexp_replace(text, "\n$", ""), line + around)
    size = F.length(upto) - F.length(F.replace(upto, F.lit("\n"), F.lit(""))) + 1
    first = F.greatest(line - around, F.lit(1))
    return _numbered(lines(upto, -F.greatest(size - first + 1, F.lit(0))), first, line)


def excerpts(facts: DataFrame, files: DataFrame, most: int = 5, before: int = 10, after: int = 10, starts: DataFrame | None = None) -> DataFrame:
    """``slug, feature, excerpts`` (array of path, content) of the first pieces of evidence, each file once, in their order."""
    e = facts.select("slug", "feature", F.posexplode(F.slice("evidence", 1, most)).alias("at", "e")).where("coalesce(e.file, '') <> ''")
    first = e.groupBy("slug", "feature", F.col("e.file").alias("path")).agg(F.min(F.struct("at", F.coalesce("e.line", F.lit(1)).alias("line"))).alias("x")).select("slug", "feature", "path", "x.*")
    rows = windows(first, files, line_starts(files) if starts is None else starts, before, after)
    out = rows.groupBy("slug", "feature").agg(F.array_sort(F.collect_list(F.struct("at", "path", "content"))).alias("es"))
    return out.select("slug", "feature", F.transform("es", lambda x: F.struct(x["path"].alias("path"), x["content"].alias("content"))).alias("excerpts"))
