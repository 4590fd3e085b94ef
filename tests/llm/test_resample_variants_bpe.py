"""Operators 11 to 13 against brute force and the library, with nulls, odd rows, ties and empty tables."""

import hashlib
import math
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fleetlens.llm import queries, resample, speculate, variants
from fleetlens.llm.bpe import public_path
from fleetlens.llm.common import table

DATA = "/root/testdata/sf0.001"
ODD = [
    (None, "no id at all, nothing and nothing"), (900001, None), (900002, ""), (900003, " \n\t "), (900004, "one"), (900005, "Straße straße STRASSE naïveté"), (900006, "abcdefgh " * 30_000), (900006, "abcdefgh " * 30_000),
    (900007, "y" * 20_000), (900008, "y" * 20_000), (900009, "y" * 19_999), (900010, "<|endoftext|> a <|startoftext|><|endoftext|>b <| c 日本語 ½"), (900011, "x" * 70 + " " + "ab" * 50),
]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(i, t, 1, "c") for i, t in ODD], "doc_id long, text string, n long, place string")
    return table(spark, DATA, "documents").select("doc_id", "text", F.lit(0).cast("long").alias("n"), F.lit("k").alias("place")).unionByName(extra)


def edits(word, alphabet):
    """All strings at one insertion, deletion or replacement."""
    cuts = [(word[:k], word[k:]) for k in range(len(word) + 1)]
    return ({a + b[1:] for a, b in cuts if b} | {a + c + b[1:] for a, b in cuts if b for c in alphabet} | {a + c + b for a, b in cuts for c in alphabet}) - {word}


def forms(rows, least=7, times=2, ratio=10):
    count = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least
    vocab = {w: n for w, n in count.items() if n >= times}
    alphabet = sorted({c for w in vocab for c in w})
    out = {}
    for w, n in vocab.items():
        if len(w) > 1000:
            near = [v for v in vocab if v != w and set(v) == {"y"} and abs(len(v) - len(w)) == 1]
        else:
            near = [v for v in edits(w, alphabet) if v in vocab]
        best = min(near, key=lambda v: (-vocab[v], v), default=None)
        out[w] = (best if best and vocab[best] >= ratio * n else None, n, len(near))

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {(w, f, root(w), n, k, vocab.get(f)) for w, (f, n, k) in out.items()}


def test_variants(spark, docs):
    got = variants.variants(docs).collect()
    want = forms([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    assert variants.variants(docs.limit(0)).count() == 0


def test_variants_of_a_chain_with_ties(spark):
    rows = [(f"{w} " * n) for w, n in (("abcdefgz", 2000), ("abcdefgh", 200), ("abcdefgi", 200), ("abcdefg", 20), ("abcefg", 9), ("bbcdefg", 2), ("aabcdefg", 2))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r.word: tuple(r) for r in variants.variants(docs, one_of=1 << 40).collect()}
    assert got["abcdefgh"] == ("abcdefgh", "abcdefgz", "abcdefgz", 200, 3, 2000)
    assert got["abcdefg"] == ("abcdefg", "abcdefgz", "abcdefgz", 20, 5, 2000)
    assert got["bbcdefg"] == ("bbcdefg", "abcdefg", "abcdefgz", 2, 1, 20) and got["aabcdefg"][:3] == ("aabcdefg", "abcdefg", "abcdefgz")


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abà", min_size=1, max_size=6), min_size=1, max_size=8))
def test_keys_meet_where_words_are_near(words):
    of, own, key = variants.keys(words)
    groups = {}
    for w, o, a, b in zip(of.tolist(), own.tolist(), *key.tolist(), strict=True):
        groups.setdefault((a, b), []).append((w, o))
    met = set()
    for g in groups.values():
        for w, o in g:
            met |= {frozenset((w, v)) for v, p in g if v != w and words[v] != words[w] and (p or o or len(words[v]) == len(words[w]))}
    assert {m for m in met if len(m) == 2 and not (len({len(words[k]) for k in m}) == 1 and not near(*[words[k] for k in m]))} == {
        frozenset((i, j)) for i in range(len(words)) for j in range(i) if near(words[i], words[j])
    }


def near(a, b):
    return a != b and b in edits(a, sorted(set(a + b)))


def test_resampling(spark, docs):
    target = table(spark, DATA, "benchmark").unionByName(spark.createDataFrame([(None, "a b"), (900100, None)], table(spark, DATA, "benchmark").schema))
    grams = {}
    for name, rows in (("s", docs.select("doc_id", "text")), ("t", target.select("item_id", "text"))):
        grams[name] = []
        for i, t in rows.collect():
            ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
            grams[name].append((i, len(ws), [zlib.crc32(" ".join(ws[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(ws) - n + 1)]))
    s, t = (Counter(b for _, _, g in grams[k] for b in g) for k in "st")
    big_s, big_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000)))) for b in s}
    want = []
    for i, n, g in grams["s"]:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in g)
        want.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    order = sorted((w for w in want if w[1] >= 20), key=lambda w: (-w[4], w[0] is None, w[0]))
    drawn = order[: 5 * len(order) // 100]
    got = resample.resample(docs, target).collect()
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((w[0], *w[2:]) for w in want)
    ranks = sorted((r.rank, r.doc_id) for r in got if r.rank is not None)
    assert ranks == [(k + 1, w[0]) for k, w in enumerate(drawn)] and len(ranks) > 5


def test_resampling_of_little(spark, docs):
    empty = docs.limit(0)
    assert resample.resample(empty, table(spark, DATA, "benchmark")).count() == 0
    got = resample.resample(docs.where("doc_id > 900000"), empty, target_id="doc_id").collect()
    assert {r.weight for r in got if not r.n_features} == {0} and sum(r.rank is not None for r in got) == 0
    text = ("aé B-b c1 " * 50).encode()
    for piece in (1, 7, 30):
        resample.PIECE, kept = piece, resample.PIECE
        try:
            pieces = resample.features(text)
        finally:
            resample.PIECE = kept
        assert pieces[1] == 200 and sorted(pieces[0]) == sorted(resample.features(text)[0])
    assert len(resample.features(b"a b c d", 1)[0]) == 4


def test_ranks_over_many_ranges(spark):
    rows = spark.range(1000).withColumn("v", F.col("id") % 7).repartition(5)
    got = resample.ranked(rows, [F.col("v").desc(), F.col("id").asc()], "r").collect()
    assert [r.id for r in sorted(got, key=lambda r: r.place)] == sorted(range(1000), key=lambda i: (-(i % 7), i)) and sorted(r.place for r in got) == list(range(1, 1001))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_path("byte_bpe_50k.json"))


def test_bpe(spark, docs, library):
    path = public_path("byte_bpe_50k.json")
    rows = speculate.encoded(docs, path, decode=True)
    want = Counter((i, array("I", library.encode(t or "", add_special_tokens=False).ids).tobytes(), t or "") for i, t in docs.select("doc_id", "text").collect())
    assert Counter((r.id, bytes(r.ids), r.decoded) for r in rows.collect()) == want
    assert Counter((r.id, r.text) for r in speculate.decoded(rows, path).collect()) == Counter((i, t) for i, _, t in want.elements())
    assert speculate.decoded(spark.createDataFrame([(1, None)], "id long, ids binary"), path).first().text == ""
    assert speculate.encoded(docs.limit(0), path).count() == 0


def test_bpe_query(spark, library):
    want = set()
    for r in table(spark, DATA, "documents").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(array("I", ids).tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert {tuple(r) for r in queries.op13_bpe(spark, DATA).collect()} == want


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab ethinzs'éß\n\t1_!.½日 \x85\x1c😀<|>") | st.characters(exclude_categories=["Cs"]), max_size=60))
def test_bpe_of_any_text(text):
    path = public_path("byte_bpe_50k.json")
    codec, own = speculate.Codec.at(path), Tokenizer.from_file(path) if not hasattr(test_bpe_of_any_text, "own") else test_bpe_of_any_text.own
    test_bpe_of_any_text.own = own
    ids = codec.encode([text])
    assert list(array("I", ids[0])) == own.encode(text, add_special_tokens=False).ids
    cut = ids[0][4:-4]
    assert codec.decode([ids[0], cut]) == [text, own.decode(list(array("I", cut)), skip_special_tokens=False)]


def test_proposals_checks_and_merging_agree():
    codec = speculate.Codec.at(public_path("byte_bpe_50k.json"))
    rng = np.random.default_rng(6)
    parts = [b"the", b"ing", b" ", b"a", b"aa", b"qu", b"ion", b"\xc3\xa9", b"0", b"zz"]
    words = [b"".join(parts[k] for k in rng.integers(0, len(parts), int(n))) for n in rng.integers(1, 25, 3000)]
    exact = [array("I", codec.merged(w)).tobytes() for w in words]
    before = codec.proposed, codec.failed
    assert codec.encoded(words) == exact
    assert 0 < codec.failed - before[1] < codec.proposed - before[0] == len(words), "some proposals hold and some fail"
    short = [w for w in words if len(w) <= speculate.SHORT]
    ids, of = codec.merged_together(short)
    assert [ids[of == k].tolist() for k in range(len(short))] == [codec.merged(w) for w in short]


def test_a_file_of_another_kind_is_refused():
    with pytest.raises(ValueError, match="not a plain byte-level BPE"):
        speculate.Codec(public_path("word_bpe_49k.json"))
