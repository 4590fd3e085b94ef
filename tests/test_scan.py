"""Trees, extraction and detectors on small units."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import detect, extract
from fleetlens.sources import tables, tree

CODE = '''import ops
from scenario import Context, State
from . import nothing
from .scenario import State


class A:
    def __init__(self):
        self._boot()
        framework.observe(self.on.one, self._all)
        framework.observe(self.on.two, self._all)
        framework.observe(self.on.three, self._all)
        framework.observe(self.on.db_relation_joined, self._db)
        framework.observe(self.on.db_relation_changed, self._db)
        framework.observe(self.on.db_relation_broken, self._db)
        framework.observe(self.on["collect_status"], self._c)

    def _on_a(self):
        self._same()

    def _on_b(self):
        if 1:
            self._same()

    async def _on_c(self):
        self._same()

    def other(self):
        self.unit.open_port("tcp", 1)
        self._unit._secrets.add()
'''


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("trees")
    for path, text in {
        "u/charmcraft.yaml": "name: u\nrequires:\n  db: {interface: mysql}\n  log: {interface: loki, optional: true}\n",
        "u/src/charm.py": CODE, "u/src/bad.py": "def (:\n  observe(self.on.collect_status, x)", "u/src/empty.py": "", "u/lib/charms/x/v0/y.py": "import ops",
        "u/tests/test_x.py": "import ops.testing", "u/pytest.ini": "[pytest]\nLog_CLI = 1%\n", "u/.venv/a.yaml": "db: 1", "u/_x/b.yaml": "a: [\n",
        "m/one/metadata.yaml": "name: one", "m/one/deep/metadata.yaml": "name: deep", "m/two/charmcraft.yaml": "type: charm", "m/tests/three/metadata.yaml": "name: no", "m/charmcraft.yaml": "type: bundle\n",
    }.items():
        p = top / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    roots = spark.createDataFrame([(s, str(top / s)) for s in ("u", "m", "gone")], "slug string, root string")
    return tree.files(roots).cache()


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_units(files):
    roots = tree.unit_roots(files)
    assert rows(roots, "slug", "subpath") == [("m", "one"), ("m", "two"), ("u", "")]
    got = rows(tree.unit_files(files, roots).where("slug like 'm%'"), "slug", "path")
    assert got == [("m/one", "deep/metadata.yaml"), ("m/one", "metadata.yaml"), ("m/two", "charmcraft.yaml")]


def test_scopes(files):
    of = lambda scope: [r[0] for r in rows(files.where((F.col("slug") == "u") & tree.in_scope(F.col("path"), scope)), "path")]
    assert of("src") == ["src/bad.py", "src/charm.py", "src/empty.py"] and of("tests") == ["tests/test_x.py"] and len(of("any")) == 4
    assert rows(files.where((F.col("slug") == "u") & tree.yaml_in_scope(F.col("path"))), "path") == [("_x/b.yaml",), ("charmcraft.yaml",)]


def test_imports_and_calls(spark, files):
    py = extract.python_facts(files.where(tree.in_scope(F.col("path"), "any")))
    want = spark.createDataFrame([("ops", 0, "ops", None), ("state", 0, "scenario", ["State"]), ("plain", 0, "ops", ["testing"])], "owner string, det_ord int, module string, names array<string>")
    assert rows(detect.imports(py, want), "owner", "file", "line") == [("ops", "src/charm.py", 1), ("ops", "tests/test_x.py", 1), ("state", "src/charm.py", 2), ("state", "src/charm.py", 4)]
    want = spark.createDataFrame([("p", 0, "unit.open_port"), ("s", 0, "secrets.add"), ("never", 0, "_unit.open_port")], "owner string, det_ord int, attr string")
    assert rows(detect.calls(py, want), "owner", "line", "snippet") == [("p", 29, 'self.unit.open_port("tcp", 1)'), ("s", 30, "self._unit._secrets.add()")]


def test_events_and_patterns(files):
    src = files.where(tree.in_scope(F.col("path"), "src"))
    assert rows(detect.observed(src, [("c", 0, ["CollectStatusEvent"])]), "file", "line") == [("src/bad.py", 2), ("src/charm.py", 16)]
    assert rows(detect.matches(src, [("r", 0, r"^class \w+")]), "line", "snippet") == [(7, "class A")]
    assert detect.matches(src, []).count() == 0


def test_structure(files):
    py = extract.python_facts(files.where(tree.in_scope(F.col("path"), "src")))
    assert rows(detect.shared_handlers(py, "reconcile"), "line") == [(10,), (11,), (12,)]
    assert detect.shared_handlers(py, "reconcile", min_events=4).count() == 0
    assert rows(detect.init_calls(py, "i", ["_boot", "_same"]), "line") == [(9,)]
    assert rows(detect.shared_method(py, "s", ["_same"]), "line") == [(19,), (23,)]
    assert detect.shared_method(py, "s", ["_same"], min_callers=3).count() == 0


def test_yaml_settings_and_relations(spark, files):
    meta = files.where("slug = 'u'")
    docs = extract.yaml_docs(meta.where(tree.yaml_in_scope(F.col("path"))))
    want = spark.createDataFrame([("k", 0, ["log", "nope"])], "owner string, det_ord int, keys array<string>")
    assert rows(detect.yaml_keys(docs, meta, want), "file", "line") == [("charmcraft.yaml", 4)]
    want = spark.createDataFrame([("p", 0, ["log_cli"])], "owner string, det_ord int, keys array<string>")
    assert rows(detect.pytest_keys(extract.settings(meta), want), "snippet") == [("log_cli = 1%",)]
    rel = spark.createDataFrame([("u", "m", 0, "db", "requires", "mysql", False), ("u", "m", 1, "log", "requires", "loki", True), ("u", "n", 0, "log", "requires", "loki", False)], "slug string, path string, ord int, name string, role string, interface string, optional boolean")
    units = spark.createDataFrame([("u", "m"), ("v", "m")], "slug string, path string")
    want = spark.createDataFrame([("two", 0, "requires", 2, 2, None), ("one+", 0, "requires", 1, None, True), ("none", 0, "requires", 0, 0, None)], "owner string, det_ord int, role string, min int, max int, optional boolean")
    got = detect.relation_count(rel, units, want)
    assert rows(got, "slug", "owner") == [("u", "one+"), ("u", "two"), ("v", "none")]
    want = spark.createDataFrame([("my", 0, ["mysql"], None), ("no", 0, ["mysql", "pg"], True)], "owner string, det_ord int, interfaces array<string>, invert boolean")
    found = detect.requires_interface(rel, units, want)
    assert rows(found, "slug", "owner") == [("u", "my"), ("v", "no")]
    features = spark.createDataFrame([("my", 0), ("no", 1)], "feature string, feature_ord int")
    facts = detect.facts(found, units, features)
    assert rows(facts, "slug", "feature", "present") == [("u", "my", True), ("u", "no", False), ("v", "my", False), ("v", "no", True)]


def test_corpus_and_results(spark, tmp_path):
    (tmp_path / "c.csv").write_text("Team,Charm Name,Repository,Branch (if not the default)\n A ,,https://h/x.git/,\nB,n,,\nB, n ,https://h/y,dev\n")
    got = tables.corpus(spark, str(tmp_path / "c.csv")).orderBy("ord").collect()
    assert [(r.team, r.name, r.branch, r.key_charm, r.slug) for r in got] == [("A", "x", None, False, "x"), ("B", "n", "dev", False, "y")]
    (tmp_path / "scored-2024-01-01.json").write_text('{"__skipped__": {"z": "r"}, "b": {"name": "b", "repo_url": "u", "features": {"__meta__": {"has_containers": true}, "f": {"present": true, "evidence": []}, "e": {"present": false, "score": "clear-gap"}}}, "a": {"name": "a", "features": {}}}')
    units, facts = tables.results(spark, str(tmp_path / "scored-*.json"), date_from_name=True)
    assert [(r.date, r.slug, r.has_containers) for r in units.orderBy("unit_ord").collect()] == [("2024-01-01", "b", True), ("2024-01-01", "a", False)]
    assert rows(facts, "slug", "feature", "present") == [("b", "e", False), ("b", "f", True)]
    made = tables.documents(units, facts).orderBy("unit_ord").collect()
    assert '"f":{"present":true' in made[0].record and made[1].slug == "a"
    tables.write_facts(facts.drop("date"), str(tmp_path / "store"), "2024-01-01")
    assert spark.read.parquet(str(tmp_path / "store")).count() == 2


def test_overrides(spark, tmp_path):
    (tmp_path / "o.yaml").write_text("exclude:\n- {url: a, reason: r}\n- {reason: x}\nfeature_excludes:\n- {url: a, features: [f, g]}\n")
    got = tables.overrides(spark, str(tmp_path / "o.yaml"))
    assert rows(got["exclude"], "url", "reason") == [("a", "r")] and rows(got["feature"], "sub_path", "feature") == [("", "f"), ("", "g")]
    assert tables.overrides(spark, None)["sub"].count() == 0


def test_own_library_is_no_evidence(spark):
    units = spark.createDataFrame([("u", "my-lib", True), ("v", "other", False), ("w", None, False)], "slug string, charm_name string, provides_own_library boolean")
    code = "from charms.my_lib.v0 import x\nimport charms.other.v0\n"
    py = extract.python_facts(spark.createDataFrame([(s, "src/charm.py", code) for s in "uvw"], "slug string, path string, text string"))
    want = spark.createDataFrame([("a", 0, "charms.my_lib.v0", None), ("b", 0, "charms.other", None)], "owner string, det_ord int, module string, names array<string>")
    assert rows(detect.imports(py, want, detect.own_libraries(units)), "slug", "owner") == [("u", "b"), ("v", "a"), ("v", "b"), ("w", "a"), ("w", "b")]
