"""From stored results to views, and the catalogue from a file."""

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.operators import excerpts, extract, metadata, scan, views
from fleetlens.sources import catalogue, tables


def test_stored_results_give_all_views(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"a": {"name": "a", "team": "t", "repo_url": "u", "features": {"__meta__": {"has_containers": true, "bases": ["x@1"], "architecture": ["reconcile"], "min_juju_version": "3.1"}, "f": {"present": false, "score": "clear-gap", "rationale": "r"}}}, "b": {"repo_url": "v", "features": {}}}')
    units, facts = tables.results(spark, str(tmp_path / "r.json"))
    features = catalogue.as_table(spark, [catalogue.Entry("f", "l", "src", [])])
    assert {(r.axis, r.label): r.n for r in views.summary(units).collect()} == {("total", "units"): 2, ("total", "k8s"): 1, ("total", "machine"): 1, ("architecture", "reconcile"): 1, ("base", "x@1"): 1}
    assert [(r.arch, r.total) for r in views.feature_by_architecture(units, facts, features).orderBy("arch").collect()] == [("delta", 1), ("reconcile", 1)]
    assert {r.slug: r.stack for r in views.unit_labels(units).collect()} == {"a": "k8s x@1 juju 3.1", "b": "machine"}
    assert views.unit_gaps(facts).collect()[0].gaps[0].asDict() == {"feature": "f", "rationale": "r", "ai_escalated": False}
    assert views.unit_view(units, facts).count() == 2 and views.team_rollup(units, facts).count() == 2 and views.facets(units, features).count() == 10


def test_metadata_of_several_documents_or_with_an_odd_name(spark):
    files = spark.createDataFrame([("u", "charmcraft.yaml", "name: x\n---\nname: y\n"), ("u", "metadata.yaml", "name: 5"), ("v", "metadata.yaml", "name: v")], "slug string, path string, text string")
    got = {r.slug: r.charm_name for r in metadata.unit_facts(files, extract.yaml_docs(files)).collect()}
    assert got == {"u": None, "v": "v"}


def test_catalogue_from_a_file(spark, tmp_path):
    p = tmp_path / "c.yaml"
    p.write_text("features:\n- {name: f, library: l, scope: src, detect: [{kind: import, module: ops}]}\n- {name: g, detect: [{kind: regex, pattern: 'a+'}]}\n")
    features, patterns = catalogue.load(str(p))
    assert [e.name for e in features] == ["f", "g"] and features[1].scope == "any" and patterns == []
    files = spark.createDataFrame([("u", "src/a.py", "import ops\naa\n"), ("v", "README", None)], "slug string, path string, text string")
    got = scan.scan(files, features, patterns).facts
    assert sorted((r.slug, r.feature, r.present) for r in got.collect()) == [("u", "f", True), ("u", "g", True), ("v", "f", False), ("v", "g", False)]
    assert scan.scan(files.limit(0), features, patterns).facts.count() == 0
    p.write_text("features:\n- {name: f, detect: [{kind: guess}]}\n")
    with pytest.raises(ValueError, match="guess"):
        catalogue.load(str(p))


def test_lines_of_many_matches_and_of_marks(spark):
    text = "a\n" * 16000
    got = spark.createDataFrame([(text,), ("\ue000 a\n\ue000\na",)], "t string").select(tx.match_lines("t", "a")).collect()
    assert [m["line"] for m in got[0][0]] == list(range(1, 16001)) and [tuple(m) for m in got[1][0]] == [("a", 1), ("a", 3)]


def test_units_without_a_name_keep_their_architecture(spark):
    u = spark.createDataFrame([(0, "a", None, ["reconcile"], False, False), (1, "b", "n", [], True, False)], "unit_ord int, slug string, name string, architecture array<string>, is_reactive boolean, is_legacy_classic boolean")
    assert sorted((r.slug, r.arch) for r in views.with_architecture(u).collect()) == [("a", "reconcile"), ("b", "reactive")]


def test_excerpts_and_context(spark):
    text = "".join(f"l{i}\n" for i in range(1, 31))
    files = spark.createDataFrame([("u", "a.py", text), ("u", "b.py", None)], "slug string, path string, text string")
    ddl = "slug string, feature string, evidence array<struct<file:string,line:int,detector_kind:string,snippet:string>>"
    facts = spark.createDataFrame([("u", "f", [("b.py", 1, "k", "s"), ("a.py", 15, "k", "s"), ("a.py", 2, "k", "s"), ("gone", 1, "k", "s")]), ("u", "g", [])], ddl)
    got = excerpts.excerpts(facts, files).collect()
    assert len(got) == 1 and [(e.path, e.content) for e in got[0].excerpts] == [("a.py", "\n".join(f"l{i}" for i in range(5, 26)))]
    lines = files.where("path = 'a.py'").select(excerpts.context(F.col("text"), F.lit(2))).collect()[0][0]
    assert lines == ["     1  l1", "→    2  l2", "     3  l3", "     4  l4", "     5  l5"]


def test_results_round_trip(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"b": {"name": "b", "repo_url": "u", "features": {"__meta__": {"bases": ["x@1"]}, "f": {"present": true, "evidence": []}}}, "a": {"name": "a", "repo_url": "v", "features": {}}}')
    units, facts = tables.results(spark, str(tmp_path / "r.json"))
    tables.write_results(units, facts, str(tmp_path / "w.json"), spark.createDataFrame([("z", "clone failed")], "slug string, reason string"))
    units2, facts2 = tables.results(spark, str(tmp_path / "w.json"))
    assert [(r.slug, r.bases) for r in units2.orderBy("unit_ord").collect()] == [("b", ["x@1"]), ("a", [])]
    assert [(r.slug, r.feature, r.present) for r in facts2.collect()] == [("b", "f", True)] and '"__skipped__"' in (tmp_path / "w.json").read_text()
    (tmp_path / "g.json").write_text('[{"charm_slug": "a", "feature_id": "f", "human_verdict": "clear-gap"}]')
    assert tuple(tables.ground_truth(spark, str(tmp_path / "g.json")).collect()[0]) == ("a", "f", "clear-gap")
    (tmp_path / "p.json").write_text('{"pairs": [{"root": "x", "confidence": "high"}]}')
    assert [r.root for r in tables.pairs(spark, str(tmp_path / "p.json")).collect()] == ["x"]
    (tmp_path / "cache").mkdir()
    (tmp_path / "cache" / "k.json").write_text('{"key": "k", "verdict": "clear-gap"}')
    (tmp_path / "cache" / "odd.json").write_text("{odd")
    assert [r.key for r in tables.verdicts(spark, str(tmp_path / "cache")).collect()] == ["k"]
