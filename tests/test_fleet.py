"""Fleet queries against their SQL, and small cases by hand."""

import duckdb
import pytest
from pyspark.sql import functions as F

from fleetlens import catalog, scan_queries  # noqa: F401  (registers its queries)
from fleetlens.functions import text as tx
from fleetlens.operators import pairs, refine, search, trend

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = catalog.QUERIES[name](spark, DATA)
    want = db.sql(catalog.SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    pick = lambda names, rows: sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in rows)
    assert pick(got.columns, [tuple(r) for r in got.collect()]) == pick(want.columns, want.fetchall())


def test_rounding_is_half_even_on_the_binary_value(spark):
    xs = [0.05, 0.15, 0.25, 0.35, 1.45, 2.675, 1234.05]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(tx.round1(F.col("x"))).collect()]
    assert got == [round(x, 1) for x in xs]


def test_slug_and_roots(spark):
    df = spark.createDataFrame([("https://h/a/b.git/",), ("https://h/a/b.git",), ("b",)], "u string")
    assert [r[0] for r in df.select(tx.slug(F.col("u"))).collect()] == ["b", "b", "b"]
    df = spark.createDataFrame([("x-k8s-operator",), ("x-k8s",), ("x-operator",), ("-k8s",)], "u string")
    assert [r[0] for r in df.select(tx.k8s_root(F.col("u"))).collect()] == ["x", "x", "x", "-k8s"]


def test_match_lines(spark):
    df = spark.createDataFrame([("a\nbb a\n\na",), ("",), (None,)], "t string")
    got = df.select(tx.match_lines("t", "a")).collect()
    assert [m["line"] for m in got[0][0]] == [1, 2, 4] and got[1][0] == [] and got[2][0] == []


def test_fuzzy_pairs_at_the_threshold(spark):
    rows = [(0, "abcdef-k8s", True), (1, "abcdxx-operator", False), (2, "abcdxy-operator", False), (3, "qrs-k8s", True), (4, "qxxx-operator", False), (5, "zz-k8s", True), (6, "z-operator", False)]
    u = spark.createDataFrame([(o, n, "", c, []) for o, n, c in rows], "ord long, name string, repo_url string, has_containers boolean, library_names array<string>")
    got = {(r.k8s_name, r.machine_name, r.confidence) for r in pairs.find_pairs(u).collect()}
    assert got == {("abcdef-k8s", "abcdxx-operator", "medium"), ("zz-k8s", "z-operator", "medium")}


def test_search_language():
    got = search.parse('foo -bar team:"a b" x:y - ""', {"team"})
    assert got == [search.Term(None, "foo", False), search.Term(None, "bar", True), search.Term("team", "a b", False), search.Term(None, "x:y", False), search.Term(None, "-", False)]
    s = search.from_query_string("charm.q=a&charm.feat=has:f,gap:g,odd:h&charm.sort=5:desc&charm.arch=x,y", "charm", {"f", "g", "h"})
    assert s.features == {"f": "has", "g": "gap", "h": "has"} and s.sort == (5, True) and s.facets == {"arch": ["x", "y"]}


def test_answers_at_the_limits(spark):
    raw = ['{"verdict":"clear-gap","rationale":"%s"}' % ("r" * n) for n in (200, 201)] + ["", None, "[]", '{"verdict":"clear-gap","rationale":"r","evidence_path":"b"}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string").orderBy("i")
    assert [r[0] for r in df.select(refine.outcome(F.col("x"), F.array(F.lit("a")))).collect()] == ["ok", *["parse-error"] * 4, "invalid-path"]


def test_empty_facts_have_no_flips(spark):
    facts = spark.createDataFrame([], "date string, slug string, feature string, present boolean")
    assert trend.flips(facts).count() == 0 and trend.adoption(facts).count() == 0
