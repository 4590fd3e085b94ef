"""A corpus pipeline of four operators: documents in, packed training sequences out.

Nulls and edges, alike in all stages: columns other than ``doc_id`` and ``text`` are handed on as they are, whatever their
names; empty tables give empty tables; without labels that can be learned from, both classifiers keep a document or not by
one score. A null or empty text is scored by both classifiers as an empty one, joins with nothing and is packed as its end
id. A row without an id is scored, never joined, and packed. Rows that share id and text are scored alike, and the join
keeps one of them; of those that share an id but not the text each text counts by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.llm import ngramjoin, packing, quality, toxicity
from fleetlens.llm.bpe import public_path
from fleetlens.llm.common import table, written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.good(docs, table(spark, sf_dir, "labels"))


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that is joined by a Jaccard similarity of 0.8 of five-word shingles, the smallest id stays."""
    return ngramjoin.one_of_each(docs, width=5, num=80, den=100)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in the training sequences."""
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity_stage), ("quality", quality_stage), ("ngram_join", ngram_join_stage), ("packing", packing_stage)]

#: The classifiers and the tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
