"""Lines by offsets, the search by lists, the timeline by runs, and the parallel writer, each against a plain version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import excerpts, search, search_index, trend
from fleetlens.sources import tables

TEXTS = {"a": "", "b": "\n", "c": "one", "d": "one\ntwo\n", "e": "é\n\nzwei\n\n日本", "f": "x" * 50_000 + "\n" + "y\n" * 3000, "g": None}


def test_windows_against_lists_of_lines(spark):
    files = spark.createDataFrame([(k, "p", t) for k, t in TEXTS.items()], "slug string, path string, text string")
    places = spark.createDataFrame([(k, "p", line, "clash") for k in [*TEXTS, "none"] for line in (1, 2, 3, 5, 3001, 9000)], "slug string, path string, line int, text string").drop("text")
    starts = excerpts.line_starts(files)
    for before, after in ((0, 0), (1, 2), (10, 10)):
        got = {(r.slug, r.line): (r.first, r.content) for r in excerpts.windows(places, files, starts, before, after).collect()}
        want = {}
        for k, t in TEXTS.items():
            if t is not None:
                lines = (t[:-1] if t.endswith("\n") else t).split("\n")
                for line in (1, 2, 3, 5, 3001, 9000):
                    a = min(max(line - 1 - before, 0), len(lines))
                    want[k, line] = (a + 1, "\n".join(lines[a : max(line + after, 0)]))
        assert got == want
    assert excerpts.line_starts(files.limit(0)).count() == 0 and excerpts.windows(places.limit(0), files, starts, 1, 1).count() == 0


def test_context_of_a_text_equals_that_by_offsets(spark):
    files = spark.createDataFrame([(k, "p", t) for k, t in TEXTS.items() if k in "cdef"], "slug string, path string, text string")
    places = files.select("slug", "path", F.explode(F.array(F.lit(1), F.lit(2))).alias("line")).where("slug <> 'c' or line = 1")
    one = {(r.slug, r.line): r.context for r in excerpts.contexts(places, files, excerpts.line_starts(files)).collect()}
    other = {(r.slug, r.line): r.c for r in places.join(files, ["slug", "path"]).select("slug", "line", excerpts.context(F.col("text"), F.col("line")).alias("c")).collect()}
    assert one == other and one["d", 2] == ["     1  one", "→    2  two"]


QUERIES = ["the cat", "cat -dog", '"a cat"', "-cat", "ca", "", "team:red", "team:red cat", 'team:"red a"', "-team:red", "zebra", "team:zz", "CAT", "straße", "cat cat at"]


def test_search_by_lists_equals_the_language(spark):
    rng = random.Random(4)
    words = ["the", "cat", "dog", "a", "at", "Straße", "catalogue", "x"]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 5))), rng.choice(["red", "Red Apple", "blue", None])) for k in range(200)] + [(900, None, "red"), (901, "cat", None), (901, "cat", None)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, search string, team string, gram string")
    lists, sizes = search_index.build(df, "id", ("search", "team"))
    for q in QUERIES:
        terms = search.parse(q, {"team"})
        got, want = search_index.search(df, "id", lists, sizes, terms), df.where(search.matches(terms))
        assert sorted(r.id for r in got.collect()) == sorted(r.id for r in want.collect()), q
    assert search_index.asked(search.parse("-zebra ab team:red", {"team"}), "search") == {("team", "red")}
    assert search_index.search(df.limit(0), "id", *search_index.build(df.limit(0), "id"), search.parse("cat", set())).count() == 0


def test_state_of_the_page_in_a_url():
    state = search.State('a "b c" -d', {"team": ["x", "y"]}, {"f": "lacks", "g": "gap", "h": "has"}, (3, True))
    text = search.to_query_string(state, "units")
    assert search.from_query_string(text, "units", {"f", "g", "h"}) == state and search.from_query_string(text, "other", {"f"}) == search.State()
    assert search.from_query_string("?units.feat=odd:f,nope:x,g&units.sort=x", "units", {"f", "g"}) == search.State("", {}, {"f": "has", "g": "has"})


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_timeline_by_runs_equals_the_grid(spark, seed):
    rng = random.Random(seed)
    dates = [f"2024-0{1 + k // 28}-{1 + k % 28:02d}" for k in range(12)]
    there = [(d, s) for d in dates for s in "uvwxyz" if rng.random() < 0.7]
    scanned = [(d, f) for d in dates for f in "fgh" if rng.random() < 0.7] + [(dates[0], "only")]
    facts = [(d, s, f, rng.random() < 0.5, rng.choice(["clear-gap", "worth-considering", None])) for d, s in there for e, f in scanned if e == d and rng.random() < 0.8]
    facts += [(dates[1], "ghost", "f", True, None)]  # a record of a unit that isn't in the corpus
    f = spark.createDataFrame(facts, "date string, slug string, feature string, present boolean, score string")
    u = spark.createDataFrame(there, "date string, slug string")
    for feature, slug in ((None, None), ("f", None), ("g", "v")):
        runs = trend.timeline_runs(f, u, feature, slug)
        grid = trend.timeline(f, u, feature, slug)
        assert sorted(map(tuple, trend.timeline_of(runs, u).collect())) == sorted(map(tuple, grid.select("slug", "feature", "date", "state").collect()))
        by_pair = {}
        for r in runs.orderBy("first").collect():
            by_pair.setdefault((r.slug, r.feature), []).append(r)
        assert all(a.state != b.state and a.last < b.first for rs in by_pair.values() for a, b in zip(rs, rs[1:], strict=False))
    assert trend.timeline_runs(f.limit(0), u).count() == trend.timeline_runs(f, u.limit(0)).count() == 0


def test_a_unit_that_never_changes_is_one_run(spark):
    f = spark.createDataFrame([(f"2024-01-{k:02d}", "u", "f", True) for k in range(1, 31)], "date string, slug string, feature string, present boolean")
    assert [tuple(r) for r in trend.timeline_runs(f, f.select("date", "slug")).collect()] == [("u", "f", "2024-01-01", "2024-01-30", "present")]


@pytest.mark.parametrize("left_out", [None, [], [("z", "why"), ("ä\"", "clone failed")]])
def test_results_written_by_all_tasks(spark, tmp_path, left_out, monkeypatch):
    monkeypatch.setattr(tables, "_TOGETHER", 3)
    n = 20 if left_out != [] else 0
    doc = {f"u{k}": {"name": f"n{k}é\"", "team": "t", "repo_url": "u", "subpath": "", "features": {"f": {"present": k % 2 == 0, "score": "clear-gap"}}} for k in range(n)}
    (tmp_path / "in.json").write_text(json.dumps(doc))
    units, facts = tables.results(spark, str(tmp_path / "in.json"))
    skipped = None if left_out is None else spark.createDataFrame(left_out, "slug string, reason string")
    counts = tables.write_results(units.repartition(5), facts, str(tmp_path / "out.json"), skipped)
    assert counts == {"scanned": n, "skipped": len(left_out or [])}
    got = (tmp_path / "out.json").read_text(encoding="utf-8")
    # one record after another, as a single writer has them
    made = json.loads(got)
    want, comma = "{", ""
    for slug, record in made.items():
        want += f"{comma}\n{json.dumps(slug)}: {json.dumps(record, indent=2)}"
        comma = ","
    assert got == want + "\n}\n"
    assert [k for k in made if k != "__skipped__"] == list(doc) and made.get("__skipped__", {}) == dict(left_out or [])
    assert all(made[k]["name"] == doc[k]["name"] and made[k]["features"]["f"] == doc[k]["features"]["f"] for k in doc)
    assert not list(tmp_path.glob("*.part"))
