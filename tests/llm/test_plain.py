"""License places and segmentations of a whole small table against plain implementations."""

import re
import zlib
from array import array

import pytest

from fleetlens.llm import licenses, sentencepiece, tokens_out
from fleetlens.llm.bpe import public_path
from fleetlens.llm.common import table

from .test_llm import DATA, ODD

PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
MORE = [(900020, "MIT license mit LICENSE, GNU General  Public-License cc by cc_by"), (900021, "mit é license MIT license"), (900022, "apache apache license license " * 3_000), (900023, "mit")]


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, DATA, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(ODD + MORE, "doc_id long, text string"))


def test_base_places_of_all_documents(spark, docs):
    want = []
    for i, t in docs.collect():
        ws = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().lower())
        at = [(k, label) for phrase, label in PHRASES for p in [phrase.encode().split()] for k in range(len(ws)) if ws[k : k + len(p)] == p]
        starts = [k for k, _ in at]
        want.append((i or 0, len(ws), len(at), min(starts, default=-1), max(starts, default=-1), ",".join(sorted({label for _, label in at}))))
    found = licenses.scan(docs).collect()
    none = lambda x: -1 if x is None else x
    assert sorted((r.doc_id or 0, r.n_words, r.n_base, none(r.first_word), none(r.last_word), r.base_labels) for r in found) == sorted(want)
    assert all(0 <= r.score <= 1 and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) for r in found)
    assert all(r.labels == ",".join(sorted(set(r.labels.split(",")))) for r in found)


def test_segmentations_of_all_documents(spark, docs):
    """No segmentation into pieces has fewer characters without a piece, or as few and a greater score."""
    path = public_path("piece_bpe_32k.model")
    codec = sentencepiece.Codec.at(path)
    score = {p: codec.automaton.get(p)[1] for p in codec.automaton.keys()}
    longest = max(map(len, score))
    checked = 0
    for r in sentencepiece.encoded(docs.where("length(text) < 5000 or text is null"), path, keep_ids=True).join(docs.dropDuplicates(["doc_id"]), "doc_id").collect():
        assert r.n_pieces == len(r.ids) and r.ids_crc32 == zlib.crc32(array("I", r.ids).tobytes()) and r.decoded_chars == len(r.text or "")
        text = "▁" + r.text.replace(" ", "▁") if r.text else ""
        best = [(0, 0.0)]
        for e in range(1, len(text) + 1):
            ends = [(best[a][0], best[a][1] - score[text[a:e]]) for a in range(max(0, e - longest), e) if text[a:e] in score]
            best.append(min([*ends, (best[e - 1][0] + 1, best[e - 1][1])]))
        pieces = [codec.pieces[i] for i in r.ids if i not in codec.byte_of]
        assert sum(score[p] for p in pieces) == pytest.approx(-best[-1][1])
        assert len(text) - sum(map(len, pieces)) == best[-1][0]
        checked += 1
    assert checked > 150


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert licenses.scan(none).count() == 0
    assert sentencepiece.encoded(none, public_path("piece_bpe_32k.model")).count() == 0
    assert tokens_out.token_table(none, public_path("byte_bpe_50k.json")).count() == 0
