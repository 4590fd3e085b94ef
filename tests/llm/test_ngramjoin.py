"""The n-gram join against brute force where tokens are frequent, ids repeat, sets are tiny or tables empty."""

import duckdb
import numpy as np
import pytest

from fleetlens.llm import ngramjoin, queries

TINY = "/root/testdata/sf0.001"


def shingles(text, width):
    ws = (text or "").encode().lower().split()
    return {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()


def linked(a, b, num):
    return bool(a and b) and 100 * len(a & b) >= num * len(a | b)


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


def families(seed, n=160, size=70):
    """Texts made of few passages with changes, so most tokens are in many texts, and tiny ones of few words."""
    rng = np.random.default_rng(seed)
    passages = [[f"p{p}w{k}" for k in range(size)] for p in range(4)]
    rows = []
    for i in range(n):
        ws = [w for p in sorted(rng.choice(4, int(rng.integers(1, 4)), replace=False)) for w in passages[p]]
        for k in rng.choice(len(ws), int(rng.integers(0, 6)), replace=False):
            ws[k] = f"x{int(rng.integers(0, 30))}"
        rows.append((i, " ".join(ws)))
    return rows + [(n + i, " ".join(f"t{int(x)}" for x in rng.integers(0, 3, int(rng.integers(1, 14))))) for i in range(60)]


@pytest.mark.parametrize(("width", "num"), [(3, 90), (1, 50)])
def test_frequent_tokens_lose_no_link(spark, monkeypatch, width, num):
    monkeypatch.setattr(ngramjoin, "FREQUENT", 2)
    monkeypatch.setattr(ngramjoin, "VERY_FREQUENT", 12)
    rows = families(width)
    sets = {i: shingles(t, width) for i, t in rows}
    links = {(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b], num)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(df, width=width, num=num).collect()} == roots(sets, links)
    pairs, who = ngramjoin.jaccard_pairs(df, width=width, num=num)
    of = {}
    for r in who.collect():
        assert r.n_shingles == len(sets[r.doc_id])
        of.setdefault(r.class_id, []).append(r.doc_id)
    assert None not in of or all(not sets[i] for i in of[None])
    found = {tuple(sorted((a, b))) for r in pairs.collect() for a in of[r.a] for b in of[r.b]}
    found |= {(a, b) for k, x in of.items() if k is not None for a in x for b in x if a < b}
    assert found == links


def test_hub_of_a_star(spark):
    """Copies of one text that are far from each other are one component through it, wherever its id stands."""
    base = [f"w{k}" for k in range(200)]
    rows = [(i, " ".join(base[: 6 * i] + [f"n{i}"] * 5 + base[6 * i + 5 :])) for i in range(30)] + [(77, " ".join(base))]
    sets = {i: shingles(t, 3) for i, t in rows}
    want = roots(sets, [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b], 90)])
    assert set(want.values()) == {0}
    assert {r.doc_id: r.component_id for r in ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_rows_that_share_an_id_are_one_node(spark):
    a, b = [" ".join(f"{x}{k}" for k in range(60)) for x in "ab"]
    rows = [(5, a), (5, b), (6, f"{b} more"), (7, f"{a} more"), (8, ""), (8, a), (9, None), (9, ""), (None, a)]
    got = ngramjoin.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (6, 5), (7, 5), (8, 5), (8, 5), (9, 9), (9, 9)]
    only = ngramjoin.jaccard_components(spark.createDataFrame([(8, ""), (8, a), (3, a)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in only) == [(3, 3), (8, 3), (8, 3)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, sig string, k string")
    assert ngramjoin.jaccard_components(none).count() == 0
    assert ngramjoin.one_of_each(none).count() == 0
    assert [x.count() for x in ngramjoin.jaccard_pairs(none)] == [0, 0]


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_give_what_their_sql_gives(spark, name):
    db = duckdb.connect()
    for t in ("benchmark", "documents", "embeddings", "pages", "labels"):
        db.execute(f"create view {t} as select * from '{TINY}/{t}.parquet'")
    got = queries.QUERIES[name](spark, TINY).toPandas()
    want = db.execute(queries.SQL[name]).df()
    cols = sorted(want.columns)
    assert set(cols) == set(got.columns)
    rows = lambda df: sorted(map(repr, df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)))
    key = lambda df: [r.replace(".0,", ",").replace(".0)", ")") for r in rows(df)]
    assert key(got) == key(want)
