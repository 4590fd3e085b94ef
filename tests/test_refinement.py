"""Refinement under limits, with cache and log, and the committed tables that these are."""

import json

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import refine, refinement
from fleetlens.operators.refinement import Limits
from fleetlens.sources import committed

NOW = "2024-05-02T00:00:00Z"
UNITS = "unit_ord long, slug string, repo_url string, repo_sha string, architecture array<string>"
FACTS = "slug string, feature string, present boolean, score string, rationale string"


def fleet(spark, *units, features=("ops.secrets", "pebble.checks")):
    u = spark.createDataFrame([(i, s, url, sha, arch) for i, (s, url, sha, arch) in enumerate(units)], UNITS)
    f = spark.createDataFrame([(s, x, False, "worth-considering", "rule") for s, *_ in units for x in features], FACTS)
    return f, u


def model(*answers, tokens=(None, None)):
    """Answers by the candidate's slug and feature; the last one for all others."""
    given = dict(a for a in answers if isinstance(a, tuple))
    other = next((a for a in answers if not isinstance(a, tuple)), "")

    def call(prompt):
        r = json.loads(prompt)
        raw = given.get(f"{r['charm_slug']}/{r['feature_id']}", other)
        if raw == "fail":
            raise RuntimeError("down")
        return (raw, *tokens)

    return call


GAP, KEEP = '{"verdict": "clear-gap", "rationale": "seen"}', '{"verdict": "worth-considering", "rationale": "fine", "evidence_path": null}'


def sources(out):
    return {(r.slug, r.feature): (r.source, r.outcome) for r in out.results.collect()}


def test_escalates_keeps_and_skips(spark):
    f, u = fleet(spark, ("a", "ua", "s", []), ("b", "ub", "s", ["shim"]), ("c", "uc", None, []))
    f = f.unionByName(spark.createDataFrame([("a", "ops.collect-status", True, None, None), ("a", "ops.relation-app-data", False, "clear-gap", "x"), ("a", "other", False, "worth-considering", "x")], FACTS))
    out = refinement.run(f, u, spark.createDataFrame([], refinement.ENTRIES), model(("a/pebble.checks", KEEP), GAP), now=NOW, model_name="m")
    assert sources(out) == {("a", "ops.secrets"): ("asked", "ok"), ("a", "pebble.checks"): ("asked", "ok"), ("b", "pebble.checks"): ("asked", "ok"), ("c", "ops.secrets"): ("asked", "ok"), ("c", "pebble.checks"): ("asked", "ok")}
    assert out.counts == {"candidates": 5, "calls": 5, "hits": 0, "stopped": 0, "escalated": 4}
    up = {(r.slug, r.feature): (r.score, r.rationale) for r in out.facts.where("ai_escalated").collect()}
    assert up == {k: ("clear-gap", "seen") for k in (("a", "ops.secrets"), ("b", "pebble.checks"), ("c", "ops.secrets"), ("c", "pebble.checks"))}
    assert out.facts.count() == f.count()
    assert {(e.charm_slug, e.verdict) for e in out.entries.collect()} == {("a", "clear-gap"), ("a", "worth-considering"), ("b", "clear-gap")}, "without a commit nothing is kept"
    assert {r.outcome for r in out.log.collect()} == {"escalated"} and out.log.count() == 4


def test_call_cap_stops_hits_too(spark):
    f, u = fleet(spark, ("a", "ua", "s", []), ("b", "ub", "s", []), features=("ops.secrets",))
    key = spark.range(1).select(refine.cache_key(F.lit("ub"), F.lit("s"), F.lit("ops.secrets"), F.lit(""), refine.prompt_version(F.lit(""), F.lit("")))).first()[0]
    kept = spark.createDataFrame([(key, "clear-gap", "kept", "2024-05-01T00:00:00Z"), (key, "worth-considering", "older", "2024-04-30T00:00:00Z")], "key string, verdict string, rationale string, timestamp string")
    one = refinement.run(f, u, kept, model(KEEP), now=NOW, limits=Limits(calls=1))
    assert sources(one) == {("a", "ops.secrets"): ("asked", "ok"), ("b", "ops.secrets"): ("stopped", "budget-stop")}
    assert [(r.charm_slug, r.outcome, r.llm_verdict) for r in one.log.collect()] == [("b", "budget-stop", None)]
    two = refinement.run(f, u, kept, model(KEEP), now=NOW, limits=Limits(calls=2))
    assert sources(two)["b", "ops.secrets"] == ("hit", None) and {r.slug: r.rationale for r in two.facts.collect()}["b"] == "kept"
    none = refinement.run(f, u, kept, model(KEEP), now=NOW, limits=Limits(usd=0.0))
    assert none.counts["stopped"] == 2 and none.counts["calls"] == 0
    old = refinement.run(f, u, kept.withColumn("timestamp", F.lit("2024-03-01T00:00:00Z")), model(KEEP), now=NOW)
    assert old.counts["calls"] == 2, "entries beyond their time don't count"


@pytest.mark.parametrize("most_usd", [0.0011, 0.01])
def test_spend_limit_stops_after_the_call_that_reaches_it(spark, most_usd):
    f, u = fleet(spark, *((f"u{k}", f"r{k}", "s", []) for k in range(9)), features=("ops.secrets",))
    out = refinement.run(f, u, spark.createDataFrame([], refinement.ENTRIES), model(("u1/ops.secrets", "fail"), GAP, tokens=(950, 80)), now=NOW, limits=Limits(usd=0.00324, most_usd=most_usd))
    got = sources(out)  # 0.00108 a call, the second fails and costs nothing
    assert [got[f"u{k}", "ops.secrets"] for k in range(9)] == [("asked", "ok"), ("asked", "parse-error"), ("asked", "ok"), ("asked", "ok"), *[("stopped", "budget-stop")] * 5]


def test_units_of_one_repository_are_asked_once(spark):
    f, u = fleet(spark, *((f"m/{k}", "mono", "s", []) for k in range(6)), features=("ops.secrets",))
    answers = model(("m/0/ops.secrets", "fail"), ("m/1/ops.secrets", "no json"), GAP)
    for block in (1, 2, 100):
        out = refinement.run(f, u, spark.createDataFrame([], refinement.ENTRIES), answers, now=NOW, limits=Limits(block=block))
        got = sources(out)
        assert [got[f"m/{k}", "ops.secrets"] for k in range(6)] == [("asked", "parse-error"), ("asked", "parse-error"), ("asked", "ok"), *[("hit", None)] * 3], block
        assert out.counts["escalated"] == 4 and out.entries.count() == 1


def test_twice_into_the_same_tables(spark, tmp_path):
    f, u = fleet(spark, ("a", "ua", "s", []), ("b", "ub", "s", []))
    cache, log = f"file://{tmp_path}/cache", f"file://{tmp_path}/log"
    wrong = ("b/pebble.checks", '{"verdict": "clear-gap", "rationale": "r", "evidence_path": "made/up.py"}')
    first = refinement.run_into(cache, log, f, u, model(wrong, GAP), now=NOW)
    again = refinement.run_into(cache, log, f, u, model(wrong, GAP), now=NOW)
    assert first.counts["calls"] == 4 and again.counts == {"candidates": 4, "calls": 1, "hits": 3, "stopped": 0, "escalated": 3}
    entries = committed.read(spark, cache, refinement.ENTRIES)
    assert entries.count() == 3 == committed.newest(entries, "key", "timestamp").count() and {r.ttl_days for r in entries.collect()} == {30}
    logged = committed.read(spark, log, refinement.LOG)
    assert {(r.outcome, r["count"]) for r in logged.groupBy("outcome").count().collect()} == {("escalated", 3), ("invalid-path", 2)}
    assert {r.raw_output for r in logged.where("outcome = 'invalid-path'").collect()} == {wrong[1]}
    # a job that wrote the same entries again leaves one of each
    committed.append(first.entries, cache)
    both = committed.newest(committed.read(spark, cache, refinement.ENTRIES), "key", "timestamp")
    assert both.count() == 3
    committed.compact(spark, cache, both)
    assert committed.read(spark, cache, refinement.ENTRIES).count() == 3


def test_empty_tables(spark):
    f, u = fleet(spark, ("a", "ua", "s", []))
    none = spark.createDataFrame([], refinement.ENTRIES)
    for facts, units in ((f.limit(0), u), (f, u.limit(0))):
        out = refinement.run(facts, units, none, model(GAP), now=NOW)
        assert out.counts["candidates"] == 0 and out.results.count() == out.log.count() == out.entries.count() == 0 and out.facts.count() == facts.count()


RAW = [GAP, KEEP, "", "[]", "5", "null", "{", GAP + " more", GAP + "\n", '{"verdict": "maybe", "rationale": "r", "evidence_path": "b"}', '{"verdict": "clear-gap", "rationale": ""}', '{"verdict": "clear-gap", "rationale": "%s"}' % ("x" * 201),
       '{"verdict": "clear-gap", "rationale": 5}', '{"verdict": "clear-gap", "rationale": "r", "evidence_path": "a"}', '{"verdict": "clear-gap", "rationale": "r", "evidence_path": "b"}', '{"verdict": "clear-gap", "rationale": "r", "evidence_path": 3}', '{"verdict": "clear-gap", "rationale": "r", "evidence_path": ""}']


def test_both_readings_of_answers_agree(spark):
    rows = spark.createDataFrame([(r,) for r in RAW], "raw string").select("raw", refine.outcome(F.col("raw"), F.array(F.lit("a"))).alias("o")).collect()
    assert {r.raw: r.o for r in rows} == {r: refinement.judged(r, ["a"])[0] for r in RAW}


def test_commits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = lambda a, b: spark.range(a, b).withColumn("v", F.col("id") % 3)
    ids = lambda: sorted(r.id for r in committed.read(spark, path, "id long, v long").collect())
    assert ids() == []
    assert committed.append(rows(0, 3), path) == 1
    left, right = committed.write_aside(rows(3, 5), path), committed.write_aside(rows(5, 6), path)
    assert ids() == [0, 1, 2], "what isn't committed isn't read"
    assert committed.commit(spark, path, right) == 2 and committed.commit(spark, path, left) == 3 and committed.commit(spark, path, left) == 4
    assert ids() == [0, 1, 2, 3, 4, 5]
    kept = committed.read(spark, path, "id long, v long").where("id > 2")
    committed.append(rows(6, 7), path)
    folders = committed._newest(spark, path)[1]
    committed.compact(spark, path, kept)
    assert ids() == [3, 4, 5] and len(folders) == 4


def test_a_version_taken_by_another_writer_is_not_replaced(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/t"
    committed.append(spark.range(1), path)
    a, b = committed.write_aside(spark.range(1, 2), path), committed.write_aside(spark.range(2, 3), path)
    real, stale = committed._newest, [committed._newest(spark, path)]
    committed.commit(spark, path, a)
    monkeypatch.setattr(committed, "_newest", lambda *x: stale.pop() if stale else real(*x))
    assert committed.commit(spark, path, b) == 3
    assert sorted(r.id for r in committed.read(spark, path, "id long").collect()) == [0, 1, 2]


def test_input_records(spark):
    facts = spark.createDataFrame([("a", "f", "why"), ("b", "f", None)], "slug string, feature string, rationale string")
    units = spark.createDataFrame([("a", "n", "u", True, [("db", "requires", "pg"), ("p", "peers", "x")], ["pw"], ["reconcile", "x"]), ("b", None, None, False, [], [], [])], "slug string, name string, repo_url string, has_containers boolean, relations array<struct<name:string,role:string,interface:string>>, secret_like_config array<string>, architecture array<string>")
    excerpts = spark.createDataFrame([("a", "f", [("x.py", "text")])], "slug string, feature string, excerpts array<struct<path:string,content:string>>")
    got = {r.slug: (json.loads(r.prompt), r.allowed) for r in refinement.input_records(facts, units, excerpts, F.create_map(F.lit("f"), F.lit("what it is"))).collect()}
    assert got["a"] == ({"charm_slug": "a", "charm_name": "n", "repo_url": "u", "feature_id": "f", "feature_summary": "what it is", "rule_rationale": "why", "charm_meta": {"has_containers": True, "relations_count": 1, "secret_like_config": ["pw"], "architecture": "reconcile"}, "source_excerpts": [{"path": "x.py", "content": "text"}]}, ["x.py"])
    assert got["b"][0]["charm_name"] == "b" and got["b"][0]["charm_meta"]["architecture"] == "delta" and got["b"][1] == []
