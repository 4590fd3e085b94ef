"""Contents are parsed once, patterns meet only texts that they can match, globs choose files."""

import re
from pathlib import PurePosixPath

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fleetlens.functions.literals import required
from fleetlens.functions.text import glob_pattern, match_lines
from fleetlens.operators import detect, extract, scan
from fleetlens.sources.catalogue import Entry, built_in

FILES = "slug string, path string, text string"
CODE = "import ops\nfrom ops import StoredState\nclass A:\n    def __init__(self):\n        framework.observe(self.on.go_action, self._on_go)\n        self.unit.status = 1\n"


def fleet(spark, changed=()):
    rows = [(f"u{k}", "src/charm.py", CODE + ("# changed\n" if k in changed else "")) for k in range(6)] + [("u0", "src/empty.py", ""), ("u1", "src/bad.py", "def ("), ("u2", "a.yaml", "checks: {}\n"), ("u3", "b/a.yaml", "checks: {}\n"), ("u4", "pytest.ini", "[pytest]\nlog_level = INFO\n"), ("u5", "x.py", None)]
    return spark.createDataFrame(rows, FILES)


def facts(found):
    return sorted((r.slug, r.feature, r.present, [(e.file, e.line, e.detector_kind, e.snippet) for e in r.evidence]) for r in found.facts.collect())


def test_known_contents_are_not_parsed_again(spark, tmp_path):
    known = f"file://{tmp_path}/known"
    first = scan.scan(fleet(spark), *built_in(), known=known)
    assert first.parsed == 5, "charm.py of all units once, empty.py, bad.py, one YAML content, settings"
    second = scan.scan(fleet(spark), *built_in(), known=known)
    third = scan.scan(fleet(spark, {3}), *built_in(), known=known)
    assert (second.parsed, third.parsed) == (0, 1)
    assert facts(second) == facts(first) == facts(scan.scan(fleet(spark), *built_in()))
    assert facts(third) == facts(scan.scan(fleet(spark, {3}), *built_in()))
    assert any(p for _, f, p, _ in facts(first) if f == "ops.action-handlers")


def test_contents_of_empty_tables(spark):
    out, n = extract.facts_of(fleet(spark).limit(0), extract.PYTHON_PARSER)
    assert n == 0 and out.count() == 0


def test_a_new_version_parses_again(spark, tmp_path):
    known, files = f"file://{tmp_path}/known", fleet(spark)
    files = files.where("path like '%.py'")
    assert [extract.facts_of(files, p, known)[1] for p in (extract.PYTHON_PARSER, extract.PYTHON_PARSER, extract.PYTHON_PARSER._replace(version=2))] == [3, 0, 3]


PATTERNS = [d["pattern"] for e in [*built_in()[0], *built_in()[1]] for d in e.detectors if d["kind"] == "regex"] + detect.event_patterns("collect_unit_status")
ODD = ["a|bc", "abc|", "ab?cd{0,2}ef+g", "[]ab]cd", "(ab|cd)*ef", "x(?:ab|cd)+", "(?i)abc", r"\Qa.b\E", "(?=ab)cd", "(?<!ab)cd", "ab{2,3}c", r"a\.b\|c", "(a(b|cc)d|ee)+f", "[^\\]x]yz", "ab++c", "ab*?cd"]


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_no_match_without_a_required_string(data):
    pattern = data.draw(st.sampled_from([p for p in PATTERNS + ODD if r"\Q" not in p]))
    text = data.draw(st.from_regex(pattern)) if data.draw(st.booleans()) else data.draw(st.text("abcdefgxyz.|", max_size=12))
    need = required(pattern)
    if need is not None and re.search(pattern, text, re.MULTILINE):
        assert any(x in text for x in need)


def test_required_strings():
    assert {p: required(p) for p in ODD[:10]} == {
        "a|bc": None, "abc|": None, "ab?cd{0,2}ef+g": {"ef"}, "[]ab]cd": {"cd"}, "(ab|cd)*ef": {"ef"}, "x(?:ab|cd)+": {"ab", "cd"}, "(?i)abc": None, r"\Qa.b\E": None, "(?=ab)cd": {"cd"}, "(?<!ab)cd": {"cd"},
    }
    assert all(required(p) for p in PATTERNS)


def test_each_text_meets_only_what_it_can_match(spark):
    wanted = [detect.Pattern("p", k, p) for k, p in enumerate(["alpha\\d", "beta|gamma", "x", "never seen"])]
    texts = spark.createDataFrame([("1", "alpha1 x"), ("2", "gamma"), ("3", "nothing"), ("4", "")], "id string, text string")
    assert sorted((r.id, r.k) for r in detect._can_match(texts, wanted).collect()) == [("1", 0), ("1", 2), ("2", 1), ("2", 2), ("3", 2), ("4", 2)]
    # as many files again with the same content: the same pairs of content and pattern
    files = spark.createDataFrame([(f"s{k}", "src/a.py", t) for k in range(5) for t in ("alpha1 x\nbeta", "nothing x", None)], FILES)
    got = detect.found_by(files, wanted)
    want = [(r.slug, w.det_ord, line) for w in wanted for r in files.where("text is not null").collect() for line, text in enumerate(r.text.split("\n"), 1) for _ in re.findall(w.pattern, text)]
    assert sorted((r.slug, r.det_ord, r.line) for r in got.collect()) == sorted(want) and len(want) == 5 * 4
    assert detect.found_by(files, []).count() == 0


GLOBS = ["**/*.yaml", "*.yaml", "conf/*.conf", "a/**/b.yml", "**/x?.yaml", "[ab]/*.yaml", "[!a]/*.yaml", "**/*.y*ml", "a.b/*"]
PATHS = ["a.yaml", "d/a.yaml", "conf/x.conf", "conf/d/x.conf", "a/b.yml", "a/c/d/b.yml", "d/x1.yaml", "d/x12.yaml", "a/q.yaml", "c/q.yaml", ".hidden.yaml", "d/q.yml", "a.b/z", "axb/z"]


@pytest.mark.parametrize("glob", GLOBS)
def test_globs(spark, glob):
    got = {r.p for r in spark.createDataFrame([(p,) for p in PATHS], "p string").where(F.col("p").rlike(glob_pattern(glob))).collect()}
    assert got == {p for p in PATHS if PurePosixPath(p).full_match(glob)}


def test_yaml_keys_of_chosen_files(spark):
    entries = [Entry("f", "l", "any", [{"kind": "yaml-key", "key": "up", "files": ["conf/*.conf"]}]), Entry("g", "l", "any", [{"kind": "yaml-key", "key": "up"}])]
    files = spark.createDataFrame([("u", "conf/a.conf", "up: 1\n"), ("v", "conf/a.yaml", "up: 1\n"), ("w", ".x/a.yaml", "up: 1\n")], FILES)
    got = {(r.slug, r.feature) for r in scan.scan(files, entries, []).facts.where("present").collect()}
    assert got == {("u", "f"), ("v", "g")}
