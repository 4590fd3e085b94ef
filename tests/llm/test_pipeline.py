"""The pipeline's stages and its whole run against brute force, with odd rows, empty tables and columns with clashing names."""

import zlib
from array import array
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import quality, toxicity
from fleetlens.llm.bpe import public_path
from fleetlens.llm.common import table

from .test_llm import DATA, ODD, roots

NAMES = ("id", "n", "h", "t", "v", "rep", "score", "component_id", "ids")


@pytest.fixture(scope="module")
def docs(spark):
    given = table(spark, DATA, "documents")
    copy = " ".join(f"word{k}" for k in range(60))
    extra = [*ODD, (900010, copy), (900011, copy + " end"), (900012, copy + " another end"), (900013, copy), (900014, "é ß " * 20), (900012, copy + " another end")]
    odd = spark.createDataFrame(extra, "doc_id long, text string").select("doc_id", "text", *(F.lit(None).cast(given.schema[c].dataType).alias(c) for c in given.columns if c not in ("doc_id", "text")))
    both = given.unionByName(odd.select(given.columns))
    return both.select("*", *(F.lit(k if k % 2 else None).cast("int").alias(c) for k, c in enumerate(NAMES)))


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def one_of_each(found, width=5, num=80):
    """The distinct rows of (id, text) without those that a smaller id stands for."""
    sets = {}
    for i, t in found:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    part = roots(ids, links)
    return {i for i in ids if part[i] == i}


@pytest.mark.parametrize(("stage", "module", "kept"), [(corpus_pipeline.toxicity_stage, toxicity, 0), (corpus_pipeline.quality_stage, quality, 1)])
def test_classifying_stages(spark, docs, stage, module, kept):
    labels = table(spark, DATA, "labels")
    got = stage(spark, docs, DATA)
    assert got.schema == docs.schema
    predicted = {r.doc_id: r.predicted for r in module.scored(docs, labels).collect()}
    want = Counter({r: n for r, n in rows(docs).items() if predicted[r[0]] == kept})
    assert rows(got) == want and 0 < len(want)
    assert stage(spark, docs.limit(0), DATA).count() == 0


def test_join_stage(spark, docs):
    got = corpus_pipeline.ngram_join_stage(spark, docs, DATA)
    assert got.schema == docs.schema
    keep = one_of_each([(r.doc_id, r.text) for r in docs.collect()])
    assert {900010} == keep & {900010, 900011, 900012, 900013}
    # rows without an id stay as they are; of rows that share id and text one stays
    want = Counter({r: n if r[0] is None else 1 for r, n in rows(docs).items() if r[0] is None or r[0] in keep})
    assert rows(got) == want
    assert corpus_pipeline.ngram_join_stage(spark, docs.limit(0), DATA).count() == 0


def test_packing_stage_of_nothing(spark, docs):
    assert corpus_pipeline.packing_stage(spark, docs.limit(0), DATA).count() == 0
    nulls = docs.where("doc_id is null or text is null")
    assert sorted((r.doc_id or 0, r.piece, r.length > 0) for r in corpus_pipeline.packing_stage(spark, nulls, DATA).collect()) == [(0, 0, True), (900001, 0, True)]


def test_whole_run(spark, docs, tmp_path):
    labels = table(spark, DATA, "labels")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.unionByName(spark.createDataFrame([(None, 1, 1), (900004, None, None)], "doc_id long, quality int, toxic int")).write.parquet(f"{tmp_path}/labels.parquet")
    given, labels = table(spark, tmp_path, "documents"), table(spark, tmp_path, "labels")
    for module, kept in ((toxicity, 0), (quality, 1)):
        ids = [r.doc_id for r in module.scored(given, labels).where(F.col("predicted") == kept).collect()]
        given = given.where(F.col("doc_id").isin([i for i in ids if i is not None]) | (F.col("doc_id").isNull() & F.lit(None in ids)))
    found = [(r.doc_id, r.text) for r in given.collect()]
    keep = one_of_each(found)
    encode, want = Tokenizer.from_file(public_path("word_bpe_49k.json")), Counter()
    for i, t in [f for f in found if f[0] is None] + sorted({f for f in found if f[0] in keep}, key=lambda f: f[0]):
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), 2048)):
            want[i, k, a, len(ids[a : a + 2048]), zlib.crc32(array("I", ids[a : a + 2048]).tobytes())] += 1
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        ends = [0, *(o + n for o, n in sorted(b))]
        assert [o for o, _ in sorted(b)] == ends[:-1] and ends[-1] <= 2048
