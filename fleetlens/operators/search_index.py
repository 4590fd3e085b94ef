"""The page's search by posting lists: character trigrams of the search blob and of fields.

The index has a row for each field, trigram and row id, sorted by trigram, so that a search reads the files' parts of its own
trigrams alone. A term of three characters or more that isn't negated must have all its trigrams; the lists of the rarest
few are intersected, and the language itself decides on the rows that are left. Without such a term all rows are looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.operators.search import Term, matches
from fleetlens.plans.staging import staged

SIZE, RAREST = 3, 4
#: Texts that a worker gets at once, and trigrams that it gives back at once, but for those of one text.
BATCH_ROWS, BATCH_GRAMS = 1_000, 200_000


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each trigram of a value."""
    for batch in batches:
        at, flat, last = [], [], batch.num_rows - 1
        for k, v in enumerate(batch["v"]):
            v = v.as_py()
            own = {v[i : i + SIZE] for i in range(len(v) - SIZE + 1)}
            at += [k] * len(own)
            flat += own
            if len(flat) >= BATCH_GRAMS or k == last:
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([batch["field"].take(take), batch["id"].take(take), pa.array(flat, pa.string())], names=["field", "id", "gram"])
                at, flat = [], []


def build(rows: DataFrame, id_col: str, fields: tuple[str, ...] = ("search",)) -> tuple[DataFrame, DataFrame]:
    """``field, gram, id`` and the lists' sizes ``field, gram, n``, both written. A null or shorter value has no trigrams."""
    each = reduce(DataFrame.unionByName, [rows.select(F.col(id_col).alias("id"), F.lit(f).alias("field"), F.lower(F.col(f).cast("string")).alias("v")) for f in fields])

    conf = rows.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") or 0) not in range(1, BATCH_ROWS + 1):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kind = rows.schema[id_col].dataType.simpleString()
    made = each.where("v is not null").mapInArrow(_grams, f"field string, id {kind}, gram string")
    lists = staged(made.repartitionByRange("gram", "field", "id").sortWithinPartitions("gram", "field", "id"))
    return lists, staged(lists.groupBy("field", "gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram"))


def asked(terms: list[Term], blob: str = "search") -> set[tuple[str, str]]:
    """Field and trigram of all that a row must have."""
    return {(t.field or blob, t.needle[k : k + SIZE]) for t in terms if not t.negated for k in range(len(t.needle) - SIZE + 1)}


def search(rows: DataFrame, id_col: str, lists: DataFrame, sizes: DataFrame, terms: list[Term], blob: str = "search") -> DataFrame:
    """Equal to ``rows.where(matches(terms, blob))``; ``rows`` may lack none of the fields that the terms name."""
    want = asked(terms, blob)
    if not want:
        return rows.where(matches(terms, blob))
    known = sizes.where(F.col("gram").isin(sorted({g for _, g in want}))).collect()  # a row for each trigram asked, at most
    size = {(r["field"], r["gram"]): r["n"] for r in known}
    if any(w not in size for w in want):
        return rows.limit(0)
    rare = sorted(want, key=lambda w: (size[w], w))[:RAREST]
    hits = lists.where(F.col("gram").isin([g for _, g in rare]) & reduce(lambda a, b: a | b, [(F.col("field") == f) & (F.col("gram") == g) for f, g in rare]))
    both = hits.groupBy("id").agg(F.count_distinct("field", "gram").alias("n")).where(F.col("n") == len(rare))
    return rows.join(both.select(F.col("id").alias(id_col)), id_col, "left_semi").where(matches(terms, blob))
