"""Strays of a large group of texts that are nearly similar enough: their pairs are ruled out where they meet, no link is lost."""

import numpy as np

from fleetlens.llm import ngramjoin

from .test_ngramjoin import linked, roots, shingles


def near_misses(size, n=48, share=0.02):
    """Versions of one text with words of their own, of which two are about 0.7 similar, and of every sixth a version of its own."""
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(size)]
    out = []
    for i in range(n):
        words = list(base)
        for at in rng.choice(size, round(share * size), replace=False):
            words[at] = f"x{i}_{at}"
        out.append(words)
        if i % 6 == 0:
            out.append([*words[: size // 2], f"y{i}", *words[size // 2 + 1 :]])
    return [(k, " ".join(ws)) for k, ws in enumerate(out)]


def test_near_misses_are_ruled_out_where_they_meet(spark):
    rows = near_misses(420)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scheme = ngramjoin.Scheme(80, 100)
    found = ngramjoin._found(docs, scheme, 5, "doc_id", "text")
    unlinked = spark.createDataFrame([], "id long, component long")
    number = {r.k: r.rep for r in found.classes.collect()}
    met = {frozenset((number[r.a], number[r.b])) for r in ngramjoin._strays(found, unlinked, scheme).collect()}
    sets = {i: shingles(t, 5) for i, t in rows}
    links = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b], 80)]
    assert len(links) == 8 and len(rows) == 56
    # members of the hub's component don't look for partners; here each is a component of its own, so all others do
    hubs = {number[r.a] for r in found.entries.select("a").distinct().collect()}
    assert {frozenset(x) for x in links} <= met | {frozenset((a, h)) for h in hubs for a in sets}
    assert len(met) <= 40, len(met)  # of 1,540 pairs
    got = {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(docs, width=5, num=80, den=100).collect()}
    assert got == roots(list(sets), links)


def test_sketches_of_unlike_lengths(spark):
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in (3, 100, 127, 130, 500, 520, 2000, 2100, 9000, 30000)]
    sketches = [ngramjoin._sketch(ngramjoin._parity(s), len(s)) for s in sets]
    rows = [(i, j, a.tolist(), b.tolist()) for i, a in enumerate(sketches) for j, b in enumerate(sketches)]
    got = spark.createDataFrame(rows, "i int, j int, a array<long>, b array<long>").select("i", "j", ngramjoin.apart("a", "b").alias("d")).collect()
    for i, j, d in got:
        long, short = sorted((sketches[i], sketches[j]), key=len, reverse=True)
        if len(long) <= 2 * len(short):
            assert d == int(np.bitwise_count((ngramjoin._fold(long, len(short)) ^ short).view(np.uint64)).sum())
        else:
            assert d == 0
        assert d <= len(np.setxor1d(sets[i], sets[j]))
