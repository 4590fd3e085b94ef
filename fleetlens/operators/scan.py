"""A scan: files of units in, facts with labels out.

Files are written once, and their contents parsed once (by any scan, with a table of known contents) and read by all
detectors; entries of one kind go together, so the work follows the number of contents, not files times entries. Rejected rows of the corpus go to ``skipped`` with a reason.
Null or empty texts show nothing; a unit without any file gives no row; empty tables give empty tables.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import glob_pattern
from fleetlens.operators import detect, extract, filters, metadata, scoring
from fleetlens.plans.staging import staged
from fleetlens.sources import tree
from fleetlens.sources.catalogue import SCOPES, YAML_GLOBS, Entry, as_table

NO_CLONE, NO_UNIT = "clone failed", "no charmcraft.yaml or metadata.yaml found"
_EVIDENCE = "slug string, owner string, det_ord int, file string, line int, detector_kind string, snippet string, ev_ord long"


class Scan(NamedTuple):
    """``units``: a row of facts with architecture; ``facts``: slug, feature, feature_ord, present, score, rationale, evidence;
    ``parsed``: how many contents no scan had met before.
    """

    units: DataFrame
    facts: DataFrame
    parsed: int


def evidence(files: DataFrame, py: DataFrame, docs: DataFrame, conf: DataFrame, own: DataFrame, entries: list[Entry], described: DataFrame | None = None, relations: DataFrame | None = None) -> DataFrame:
    """What all detectors of the entries find; ``py``, ``docs`` and ``conf`` are the tables of ``extract`` over the same files,
    ``described`` and ``relations`` those of ``metadata`` over ``docs``.
    """
    spark = files.sparkSession
    found: list[DataFrame] = []
    searches: list[detect.Pattern] = []
    path = F.col("path")

    def asked(kind: str, scope: str | None = None) -> list[tuple[str, int, dict]]:
        return [(e.name, i, d) for e in entries if scope in (None, e.scope) for i, d in enumerate(e.detectors) if d["kind"] == kind]

    for scope in SCOPES:
        mine = py.where(tree.in_scope(path, scope))
        if some := asked("import", scope):
            want = spark.createDataFrame([(o, i, d["module"], d.get("names")) for o, i, d in some], "owner string, det_ord int, module string, names array<string>")
            found.append(detect.imports(mine, want, own))
        if some := asked("call", scope):
            found.append(detect.calls(mine, spark.createDataFrame([(o, i, d["attr"]) for o, i, d in some], "owner string, det_ord int, attr string")))
        searches += detect.event_searches(spark, [(o, i, d["events"]) for o, i, d in asked("observe-event", scope)], scope)
        searches += [detect.Pattern(o, i, d["pattern"], "regex", scope) for o, i, d in asked("regex", scope)]
        for o, i, d in asked("ast-init-call", scope):
            found.append(detect.init_calls(mine, o, d["attrs"], i))
        for o, i, d in asked("ast-shared-method", scope):
            found.append(detect.shared_method(mine, o, d["attrs"], i, d.get("min_callers", 2), d.get("handler_re", "^_on_")))
        for o, i, d in asked("ast-observe-shared-handler", scope):
            found.append(detect.shared_handlers(mine, o, i, d.get("min_events", 3), tuple(d.get("exclude_suffixes", ["_error"]))))
    if searches:
        found.append(detect.found_by(files, searches))
    if some := asked("yaml-key"):
        want = spark.createDataFrame([(o, i, d.get("keys") or [d["key"]], [glob_pattern(g) for g in d.get("files") or YAML_GLOBS]) for o, i, d in some if d.get("keys") or d.get("key")], "owner string, det_ord int, keys array<string>, paths array<string>")
        found.append(detect.yaml_keys(docs.where(tree.own_path(path)), files, want))
    described = metadata.described(docs) if described is None else described
    relations = metadata.relations(described) if relations is None else relations
    if some := asked("requires-interface"):
        want = spark.createDataFrame([(o, i, d["interfaces"], d.get("invert", False)) for o, i, d in some], "owner string, det_ord int, interfaces array<string>, invert boolean")
        found.append(detect.requires_interface(relations, described.select("slug", "path"), want))
    if some := asked("relation-count"):
        want = spark.createDataFrame([(o, i, d["role"], d.get("min", 0), d.get("max"), d.get("optional", False)) for o, i, d in some], "owner string, det_ord int, role string, min int, max int, optional boolean")
        found.append(detect.relation_count(relations, files.where(tree.is_metadata(path)).select("slug", "path"), want))
    if some := asked("pytest-config-key"):
        found.append(detect.pytest_keys(conf, spark.createDataFrame([(o, i, d["keys"]) for o, i, d in some], "owner string, det_ord int, keys array<string>")))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _EVIDENCE)


def scan(files: DataFrame, features: list[Entry], patterns: list[Entry], known: str | None = None) -> Scan:
    """``files``: slug, path, text of units (of ``tree.unit_files`` or any table of that shape).

    ``known``: a folder in which contents that were parsed are kept from scan to scan (see ``extract.facts_of``).
    """
    spark = files.sparkSession
    files = staged(files.select("slug", "path", "text"))
    globs = [g for e in [*features, *patterns] for d in e.detectors if d["kind"] == "yaml-key" for g in d.get("files") or ()]
    py, new_py = extract.facts_of(files.where(tree.in_scope(F.col("path"), "any")), extract.PYTHON_PARSER, known)
    docs, new_docs = extract.facts_of(files, extract.yaml_parser(globs), known)
    conf, new_conf = extract.facts_of(files, extract.SETTINGS_PARSER, known)
    py, docs = staged(py), staged(docs)
    # JSON is read once, for all that asks the metadata
    described = staged(metadata.described(docs))
    relations = staged(metadata.relations(described))
    units = staged(metadata.facts_from(files, described, relations))
    shown = staged(evidence(files, py, docs, conf, detect.own_libraries(units), [*features, *patterns], described, relations))
    named = spark.createDataFrame([(e.name, i) for i, e in enumerate(patterns)], "pattern string, pattern_ord int")
    arch = detect.architectures(shown.where(F.col("owner").isin([e.name for e in patterns])), named)
    units = units.join(arch, "slug", "left").withColumn("architecture", F.coalesce("architecture", F.array().cast("array<string>")))
    facts = detect.facts(shown.where(F.col("owner").isin([e.name for e in features])), units, as_table(spark, features))
    return Scan(units, scoring.scored(facts, units), new_py + new_docs + new_conf)


def route(refs: DataFrame, overrides: dict[str, DataFrame], cloned: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units to scan (ord, slug, name, team, repo_url, subpath) and ``skipped`` (slug, reason), by the first reason that holds.

    ``refs``: of ``tables.corpus``; a repository counts once, at its first row. ``cloned``: slugs that have a tree.
    """
    first = filters.first_of(refs, "repo_url", "ord")
    rows = filters.with_overrides(first, overrides["exclude"], overrides["branch"])
    rows = rows.join(cloned.select("slug", F.lit(True).alias("there")).distinct(), "slug", "left")
    roots = tree.unit_roots(files)
    some = roots.select("slug", F.lit(True).alias("some")).distinct()
    rows = rows.join(some, "slug", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("there").isNull(), NO_CLONE), F.when(F.col("some").isNull(), NO_UNIT)))
    good = rows.where("reason is null").drop("reason", "there", "some").join(roots, "slug")
    stay, left_out = filters.without_sub_units(good.withColumn("slug", _below("slug")).withColumn("name", _below("name")), overrides["sub"])
    return stay.select("ord", "slug", "name", "team", "repo_url", "subpath"), rows.where("reason is not null").select("slug", "reason").unionByName(left_out)


def _below(c: str) -> Column:
    return F.when(F.col("subpath") == "", F.col(c)).otherwise(F.concat_ws("/", c, "subpath"))
