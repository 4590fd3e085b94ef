"""The training-data operators against brute force, exact round trips and held-out labels, with nulls and odd rows."""

import hashlib
import zlib
from array import array
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from fleetlens.llm import ann, graph, licenses, neardup, ngramjoin, packing, quality, sentencepiece, tokens_out, toxicity, warc
from fleetlens.llm.bpe import Encoder, public_path
from fleetlens.llm.common import shared_dir, table

DATA = "/root/testdata/sf0.001"
ODD = [(None, "no id at all here"), (900001, None), (900002, ""), (900003, "  \n\t "), (900004, "one"), (900005, "two words"), (900006, "a b c d " * 30_000), (900008, "<|endoftext|> a <|startoftext|><|endoftext|>b <| c"), (900007, "MIT License and Apache License."), (900007, "MIT License and Apache License.")]


@pytest.fixture(scope="module")
def docs(spark):
    extra = spark.createDataFrame([(i, t, "n", "1") for i, t in ODD], "doc_id long, text string, id string, n string")
    return table(spark, DATA, "documents").select("doc_id", "text", F.lit("x").alias("id"), F.lit("y").alias("n")).unionByName(extra)


def roots(ids, links):
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("width", "num"), [(3, 90), (5, 80), (2, 50)])
def test_jaccard_components(spark, docs, width, num):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    ids = [i for i in sets if i is not None]
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = roots(ids, links)
    got = ngramjoin.jaccard_components(docs, width=width, num=num).collect()
    assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == Counter((i, len(sets[i]), want.get(i)) for i, _ in rows)


def test_jaccard_prefixes_of_frequent_tokens(spark, monkeypatch):
    """Many near copies: frequent tokens go by combinations, and no link is lost."""
    rng = np.random.default_rng(1)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(150):
        ws = list(base)
        for k in rng.choice(120, int(rng.integers(0, 4)), replace=False):
            ws[k] = f"x{i}_{k}"
        rows.append((i, " ".join(ws)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: {tuple(t.split()[k : k + 3]) for k in range(118)} for i, t in rows}
    want = roots(list(sets), [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(df).collect()} == want


def test_signatures_meet_whatever_is_frequent():
    rng = np.random.default_rng(2)
    scheme = ngramjoin.Scheme(80, 100)
    for _ in range(300):
        n = int(rng.integers(4, 120))
        x = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        y = np.unique(np.concatenate([rng.permutation(x)[: len(x) - int(rng.integers(0, max(1, len(x) // 8)))], rng.integers(0, 1 << 62, int(rng.integers(0, max(1, len(x) // 12)))).astype(np.uint64)]))
        both = len(np.intersect1d(x, y))
        if 100 * both < 80 * (len(x) + len(y) - both) or len(x) == len(y) == both:
            continue
        kind = lambda s: (1 + (s // np.uint64(7)) % np.uint64(3)).astype(np.int8)
        assert set(scheme.signatures(len(x), x, kind(x)).tolist()) & set(scheme.signatures(len(y), y, kind(y)).tolist())


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 100), (None, 3), (7, 6)], "u long, v long")
    assert {tuple(r) for r in graph.components(links).collect()} == {(k, 0) for k in range(41)}
    assert graph.components(links.limit(0)).count() == 0


def test_packing(spark, docs):
    path = public_path("word_bpe_49k.json")
    got = packing.pack_documents(docs, path, group=60).collect()
    encode = Tokenizer.from_file(path)
    want, total = [], 0
    for i, t in docs.select("doc_id", "text").collect():
        ids = [*encode.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        want += [(i, k, a, len(ids[a : a + 2048]), zlib.crc32(array("I", ids[a : a + 2048]).tobytes())) for k, a in enumerate(range(0, len(ids), 2048))]
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == Counter(want)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) + 2


def test_bounds_never_exceed_what_is_packed():
    rng = np.random.default_rng(3)
    for _ in range(200):
        x = rng.integers(1, 101, int(rng.integers(1, 60)))
        assert packing.lower_bound(x, 100) <= packing.best_fit_decreasing(x, 100)[2]
    assert packing.lower_bound(np.array([51] * 7), 100) == 7 and packing.lower_bound(np.array([34] * 6), 100) == 3


def test_token_files(spark, docs):
    path = public_path("byte_bpe_50k.json")
    got = tokens_out.token_table(docs, path).collect()
    encode = Tokenizer.from_file(path)
    want = {(i, len(ids) + 1, zlib.crc32(array("I", [*ids, 2]).tobytes())) for i, t in docs.select("doc_id", "text").collect() for ids in [encode.encode(t or "", add_special_tokens=False).ids]}
    assert {(r.doc_id, r.n_tokens, r.ids_crc32) for r in got} == want and len(got) == docs.count()
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    folder = f"{shared_dir(spark)}/t"
    for encoding in ("dictionary", "delta"):
        files = tokens_out.write(docs, path, folder, encoding=encoding)
        assert tokens_out.document_ids(spark, files, folder, 900004) == [[*encode.encode("one").ids, 2]]
        assert tokens_out.read(spark, files, folder, ("doc_id", "n_tokens")).columns == ["doc_id", "start", "n_tokens"]


def test_encoders_equal_the_library():
    odd = ["a  b", "  x", "x ", "a \n b", "it's 's  't\t\t x", "foo\n bar\n\n baz", "a_b __ 12 3² ½", " ", "é è  ß", "<|endoftext|> a", "日本語 text", "A'S 'S o'RE", "é"]
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        e, own = Encoder.at(public_path(name)), Tokenizer.from_file(public_path(name))
        for t in odd:
            assert list(array("I", e.ids(t))) == own.encode(t, add_special_tokens=False).ids


def test_sentencepiece_viterbi_and_round_trip(spark, docs):
    path = public_path("piece_bpe_32k.model")
    got = sentencepiece.encoded(docs, path).collect()
    assert len(got) == docs.count() and all(r.round_trip for r in got)
    codec = sentencepiece.Codec.at(path)
    score = {p: s for _, (_, s, i) in ((p, codec.automaton.get(p)) for p in codec.automaton.keys()) for p in [codec.pieces[i]]}
    for word in ("▁the", "▁abracadabra", "▁▁x", "▁Größe"):
        best = [0.0] + [-1e18] * len(word)
        for e in range(1, len(word) + 1):
            for a in range(e):
                best[e] = max(best[e], best[a] + score.get(word[a:e], -1e12 if e - a == 1 else -1e18))
        assert sum(score[codec.pieces[i]] for i in codec.viterbi(word)) == pytest.approx(best[-1])
    for t in ("日本 ½ x", "", " a  b ", "\n"):
        assert codec.decode(codec.encode(t)) == t


def test_license_base_places(spark, docs):
    got = licenses.scan(docs).collect()
    assert len(got) == docs.count()
    by = {r.doc_id: r for r in got}
    assert (by[900007].n_base, by[900007].base_labels, by[900007].first_word, by[900007].last_word) == (2, "apache,mit", 0, 3)
    assert by[900001].n_words == 0 and by[900001].score == 0 and by[900001].labels == ""
    text = "x Licensed under the Apache License, Version 2.0. y CC-BY cc by"
    r = licenses.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_base, r.labels, r.first_word, r.last_word) == (3, "apache,apache-2.0,cc-by", 4, 12)


def test_warc_round_trip_and_look_up(spark):
    rows = [(3, "http://b.Example.com/x", "y" * 100), (1, "http://a.example.com/x?q#f", "y" * 100), (2, None, None), (4, "http://b.example.com/x", "short"), (5, "http://b.example.com/z", "short"), (None, "u", "y" * 100), (6, "h\r\nX: 1", "é" * 50)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, key string")
    got = {tuple(r) for r in warc.archive(pages).collect()}
    kind = {3: ("revisit", 1)}
    want = {(i, len(h := (t or "").encode()), hashlib.sha256(h).hexdigest(), *kind.get(i, ("response", None))) for i, _, t in rows}
    assert got == want
    folder = f"{shared_dir(spark)}/warc"
    directory = warc.build_index(warc.write(pages, folder), folder, block=2)
    assert [p for _, p in warc.look_up(folder, directory, "http://B.example.com/x")] == [b"", b"short"]
    assert warc.look_up(folder, directory, "http://no.where/") == [] and warc.archive(pages.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    x[50:90] = x[10] + 0.05 * rng.normal(size=(40, 16))
    x[100:130] = x[0]
    rows = [(i, v.tolist(), i % 3 if i != 7 else None) for i, v in enumerate(x)] + [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [], 1), (None, [1.0] * 16, 1), (1004, [1.0, 2.0], 1)]
    return spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<float>, label int, rep string")


def usable(vectors):
    rows = [r for r in vectors.collect() if r.vec_id is not None and r.embedding and len(r.embedding) == 16 and np.isfinite(r.embedding).all() and any(r.embedding)]
    return rows, np.array([r.embedding for r in rows], np.float64)


def test_near_duplicates(spark, vectors):
    rows, x = usable(vectors)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = x @ x.T >= 0.93
    links = [(rows[a].vec_id, rows[b].vec_id) for a, b in zip(*np.nonzero(np.triu(close, 1)), strict=True) if rows[a].label is not None and rows[a].label == rows[b].label]
    ids = [r.vec_id for r in vectors.collect() if r.vec_id is not None]
    part, degree = roots(ids, links), Counter(i for p in links for i in p)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in neardup.near_duplicates(vectors).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == {i: (degree[i], part[i], part[i] == i) for i in ids}


def test_nearest_neighbours(spark, vectors):
    rows, x = usable(vectors)
    ids = np.array([r.vec_id for r in rows])
    got = {}
    for r in ann.search(vectors, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    hits = 0
    for k in np.flatnonzero(ids % 20 == 0):
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -s)) if j != k][:20]
        mine = got[ids[k]]
        assert sorted(mine) == list(range(1, 21)) and ids[k] not in {i for i, _ in mine.values()}
        assert [p for p in mine.items()] and all(mine[n][1] >= mine[n + 1][1] for n in range(1, 20))
        hits += len({ids[j] for j in order} & {i for i, _ in mine.values()})
    assert hits >= 0.9 * 20 * len(got)
    assert ann.search(vectors.limit(0), F.col("id") % 20 == 0).count() == 0


@pytest.mark.parametrize("n", [16, 20, 24, 28, 60])
def test_nearest_neighbours_of_few_vectors(spark, n):
    x = np.random.default_rng(n).normal(size=(n, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("id") < 5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    x = x.astype(np.float64)
    assert got == {i: [int(j) for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:20] for i in range(5)}


@pytest.mark.parametrize(("module", "label", "folds", "fold"), [(quality, "quality", 5, 0), (toxicity, "toxic", 3, 1)])
def test_classifiers_on_held_out_labels(spark, module, label, folds, fold):
    data = "/root/testdata/sf0.1"
    got = module.scored(table(spark, data, "documents"), table(spark, data, "labels"))
    rows = got.join(table(spark, data, "labels"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % folds == fold for r in rows)
    right = np.mean([r.predicted == r[label] for r in rows])
    assert right >= (0.99 if label == "quality" else 0.97)


def test_label_model_on_drawn_votes():
    """Voters drawn from known accuracies, two of them the same; labels are few and some wrong."""
    rng = np.random.default_rng(8)
    n, rate = 20_000, 0.2
    toxic = rng.random(n) < rate
    if_toxic, if_clean = rng.uniform(0.1, 0.4, 15), rng.uniform(0.001, 0.01, 15)
    votes = (rng.random((n, 15)) < np.where(toxic[:, None], if_toxic, if_clean)).astype(float)
    votes = np.hstack([votes, votes[:, :1], (votes.sum(1) == 0)[:, None]])
    model = toxicity.fit_label_model(votes.mean(0), votes.T @ votes / n, rate)
    assert model.tied[0, 15] == model.tied[:16, :16].max() > toxicity.CORRELATED
    labels = np.full(n, -1)
    labels[:2000] = toxic[:2000] ^ (rng.random(2000) < 0.03)
    model = model.calibrated(votes, labels)
    assert model.if_toxic[:15] == pytest.approx(if_toxic, abs=0.03) and model.if_clean[:15] == pytest.approx(if_clean, abs=0.005)
    assert model.label_if_toxic == pytest.approx(0.97, abs=0.02) and model.label_if_clean == pytest.approx(0.03, abs=0.02)
    exact = np.log(rate / (1 - rate)) + np.where(votes[:, :15] > 0, np.log(if_toxic / if_clean), np.log((1 - if_toxic) / (1 - if_clean))).sum(1)
    assert np.mean((model.posterior(votes, np.full(n, -1)) > 0.5) == toxic) >= np.mean((exact > 0) == toxic) - 0.002


def test_lines_of_the_sample_are_bounded(spark):
    rows = [(i, "\n".join([f"Good line {i} of a text." if i % 2 else "### $$ |||"] * (200 if i == 3 else 4))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels, lines=60)
    assert quality.score_texts(field, [b"Good line of a text.", b"### $$ |||"])[0] > quality.score_texts(field, [b"### $$ |||"])[0]
    assert quality.train(docs, labels, lines=0).prior == 0.5


def test_classifiers_take_odd_rows(spark, docs):
    labels = table(spark, DATA, "labels").unionByName(spark.createDataFrame([(None, 1, 1), (5, None, None), (900004, 1, 0)], "doc_id long, quality int, toxic int"))
    for module in (quality, toxicity):
        got = module.scored(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        assert module.scored(docs, labels.limit(0)).count() == docs.count()
        assert module.scored(docs.limit(0), labels).count() == 0


def test_marked_words_of_a_long_line_all_count():
    start = list(quality.RANGES).index("marked_words")
    plain, late = quality.line_features([b"word " * 1000, b"word " * 400 + b"wo#rd# " * 600])[:, start]
    assert late - plain == len(quality.RANGES["marked_words"])


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(4)
    score, moves = rng.normal(size=5), rng.normal(size=(2, 2))
    weight = {}
    for y in np.ndindex(2, 2, 2, 2, 2):
        weight[y] = np.exp(sum(score[k] * y[k] for k in range(5)) + sum(moves[a, b] for a, b in zip(y, y[1:], strict=False)))
    z = sum(weight.values())
    good, _, log_z = quality.forward_backward(score, moves, np.array([0, 5, 0]))
    assert log_z[1] == pytest.approx(np.log(z))
    assert good == pytest.approx([sum(w for y, w in weight.items() if y[k]) / z for k in range(5)])


def test_pipeline_keeps_columns_and_drops_what_it_should(spark):
    docs = table(spark, DATA, "documents")
    clean = corpus_pipeline.toxicity_stage(spark, docs, DATA)
    assert clean.columns == docs.columns and 0 < clean.count() <= docs.count()
    one = corpus_pipeline.ngram_join_stage(spark, docs, DATA)
    part = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs, width=5, num=80).collect()}
    assert sorted(r.doc_id for r in one.collect()) == sorted(set(part.values()))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "ngram_join", "packing"]
