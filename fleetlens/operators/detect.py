"""Detectors: which places show that a unit uses a feature.

Every detector is a query on the tables of ``extract`` and gives ``slug, owner, det_ord, file, line, detector_kind,
snippet, ev_ord``; ``owner`` is a feature or a pattern. A feature is present where it has any evidence. Detectors of one
kind go together: their table is configuration, joined by key, so no source row meets every detector.
Null texts and files that don't parse show nothing; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions.literals import required
from fleetlens.functions.text import event_attribute, match_lines
from fleetlens.sources.tree import in_scope

#: Endings of events of relations and of resources, and events that every unit has.
RELATION = ("relation_created", "relation_joined", "relation_changed", "relation_departed", "relation_broken")
RESOURCE = ("storage_attached", "storage_detaching", "pebble_ready", "pebble_custom_notice", "pebble_check_failed", "pebble_check_recovered")
BASELINE = ("install", "config_changed", "upgrade_charm", "update_status", "start", "stop")
KEYS = ("owner", "det_ord", "slug", "path")


def _evidence(rows: DataFrame, kind: str | Column, order: str | Column = "ord", line: str | Column = "line", snippet: str | Column = "snippet") -> DataFrame:
    col = lambda c: F.col(c) if isinstance(c, str) else c
    return rows.select("slug", "owner", "det_ord", F.col("path").alias("file"), col(line).cast("int").alias("line"), (F.lit(kind) if isinstance(kind, str) else kind).alias("detector_kind"), F.substring(col(snippet), 1, 120).alias("snippet"), col(order).cast("long").alias("ev_ord"))


def _runs(c: str, from_end: bool) -> Column:
    """All beginnings, or endings, of an array, joined by dots."""
    n = F.size(c)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(c, (n - i + 1) if from_end else F.lit(1), i), "."))


def own_libraries(units: DataFrame) -> DataFrame:
    """``slug, pkg``: the library packages that a unit provides itself, told by its name and its folder lib/charms/pkg. ``units``: as of ``metadata.unit_facts``."""
    return units.where("provides_own_library").select("slug", F.replace("charm_name", F.lit("-"), F.lit("_")).alias("pkg"))


def imports(py: DataFrame, wanted: DataFrame, own: DataFrame | None = None) -> DataFrame:
    """``wanted``: owner, det_ord, module, names. With names only ``from`` imports of one of them count; a statement counts once.

    ``own``: slug, pkg, of ``own_libraries``. For modules charms.pkg of these a unit shows nothing: it is their provider.
    """
    rows = py.where("kind in ('import', 'from')").withColumn("dotted", F.split("module", r"\.")).drop("module")
    rows = rows.withColumn("module", F.explode(_runs("dotted", False))).join(wanted.withColumnRenamed("names", "only"), "module")
    rows = rows.where(F.col("only").isNull() | ((F.col("kind") == "from") & F.arrays_overlap("names", "only")))
    if own is not None:
        pkg = F.when(F.col("module").startswith("charms."), F.split("module", r"\.")[1])
        rows = rows.withColumn("pkg", pkg).join(own.select("slug", "pkg"), ["slug", "pkg"], "left_anti")
    return _evidence(rows.groupBy(*KEYS, "ord").agg(F.min("line").alias("line"), F.min("snippet").alias("snippet")), "import")


def calls(py: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: owner, det_ord, attr. The dotted name of the call ends with attr."""
    rows = py.where("kind = 'call'").withColumn("attr", F.explode(_runs("chain", True))).join(wanted, "attr")
    return _evidence(rows, "call")


class Pattern(NamedTuple):
    """A pattern that matches no empty text; ``scope`` as of ``tree.in_scope``, None for all files given."""

    owner: str
    det_ord: int
    pattern: str
    kind: str = "regex"
    scope: str | None = None


def _can_match(contents: DataFrame, wanted: list[Pattern]) -> DataFrame:
    """``id, text, k``: contents (id, text) with each pattern that may match them.

    One automaton of the strings without which the patterns can't match goes over each text once; patterns of which no such
    string is known go with every text.
    """
    strings: dict[str, set[int]] = {}
    always = {k for k, w in enumerate(wanted) if not required(w.pattern)}
    for k, w in enumerate(wanted):
        for x in required(w.pattern) or ():
            strings.setdefault(x, set()).add(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for x, ks in strings.items():
            automaton.add_word(x, ks)
        automaton.make_automaton()
        for batch in batches:
            can = [sorted(always.union(*{id(ks): ks for _, ks in automaton.iter(text)}.values()) if strings else always) for text in batch["text"]]
            some = [bool(c) for c in can]
            if any(some):  # a frame without lists has no kind of list
                yield pd.DataFrame({"id": batch["id"][some], "text": batch["text"][some], "can": [c for c in can if c]})

    return contents.mapInPandas(run, "id string, text string, can array<int>").select("id", "text", F.explode("can").alias("k"))


def found_by(files: DataFrame, wanted: list[Pattern]) -> DataFrame:
    """Evidence of patterns: a content is searched once, however many files have it, and only for patterns that it can match."""
    spark = files.sparkSession
    rows = [(k, *w) for k, w in enumerate(wanted)]
    table = F.broadcast(spark.createDataFrame(rows, "k int, owner string, det_ord int, pattern string, kind string, scope string"))  # the catalogue's patterns
    scopes = sorted({w.scope for w in wanted if w.scope})
    inside = F.array_compact(F.array(*(F.when(in_scope(F.col("path"), s), F.lit(s)) for s in scopes))) if scopes else F.array().cast("array<string>")
    own = files.where("text is not null").select("slug", "path", "text", inside.alias("scopes"), F.sha2("text", 256).alias("id"))
    if all(w.scope for w in wanted):
        own = own.where(F.size("scopes") > 0)
    pattern = F.element_at(F.array(*(F.lit(f"(?m)(?U)(?d){w.pattern}") for w in wanted)), F.col("k") + 1) if wanted else F.lit("(?!)x")
    found = _can_match(own.select("id", "text").dropDuplicates(["id"]), wanted).select("id", "k", F.posexplode(match_lines("text", pattern)).alias("i", "m"))
    out = own.select("slug", "path", "id", "scopes").join(found, "id").join(table, "k").where(F.col("scope").isNull() | F.array_contains("scopes", F.col("scope")))
    # matches of a detector are in order of its patterns, then of the text
    return _evidence(out, F.col("kind"), order=F.col("k").cast("long") * (1 << 32) + F.col("i"), line="m.line", snippet=F.trim("m.match"))


def matches(files: DataFrame, wanted: list[tuple[str, int, str]], kind: str = "regex") -> DataFrame:
    """``wanted``: (owner, det_ord, pattern)."""
    return found_by(files, [Pattern(*w, kind) for w in wanted])


def event_patterns(attribute: str) -> list[str]:
    """How an event is named where it is observed; fixed values."""
    return [rf"observe\s*\([^)]*\bon\.{attribute}\b", rf"observe\s*\([^)]*\bon\[\s*['\"]{attribute}['\"]\s*\]"]


def event_searches(spark: SparkSession, wanted: list[tuple[str, int, list[str]]], scope: str | None = None) -> list[Pattern]:
    """``wanted``: (owner, det_ord, event classes)."""
    names = sorted({e for _, _, events in wanted for e in events})
    attribute = {r.e: r.a for r in spark.createDataFrame([(n,) for n in names], "e string").select("e", event_attribute(F.col("e")).alias("a")).collect()} if names else {}
    return [Pattern(o, d, p, "observe-event", scope) for o, d, events in wanted for e in events for p in event_patterns(attribute[e])]


def observed(files: DataFrame, wanted: list[tuple[str, int, list[str]]]) -> DataFrame:
    """By text, so also in files that don't parse."""
    return found_by(files, event_searches(files.sparkSession, wanted))


def _scoped_to_relations(events: str) -> Column:
    form = f"^(?:(.+)_)?(?:{'|'.join(RELATION)})$"
    return F.forall(events, lambda e: e.rlike(form)) & (F.size(F.array_distinct(F.transform(events, lambda e: F.regexp_extract(e, form, 1)))) <= 2)


def _named(ending: str, event: Column) -> Column:
    return event.endswith(f"_{ending}") & (F.length(event) > len(ending) + 1)


def _fans_out(events: str) -> Column:
    """All events have one ending of a resource, each with another name before it."""
    out = F.lit(False)
    for s in RESOURCE:
        out |= F.forall(events, partial(_named, s))
    return out


def shared_handlers(py: DataFrame, owner: str, det_ord: int = 0, min_events: int = 3, exclude_suffixes: tuple[str, ...] = ("_error",)) -> DataFrame:
    """All bindings of handlers that so many events of a file share, but for those of relations, of resources and of baseline events."""
    bound = py.where("kind = 'observe'")
    counted = bound
    for s in exclude_suffixes:
        counted = counted.where(~F.col("event").endswith(s))
    shared = counted.groupBy("slug", "path", "handler").agg(F.collect_set("event").alias("events")).where(F.size("events") >= min_events)
    baseline = F.size(F.array_except("events", F.array(*map(F.lit, BASELINE)))) == 0
    shared = shared.where(~(_scoped_to_relations("events") | _fans_out("events") | baseline))
    rows = bound.join(shared.select("slug", "path", "handler"), ["slug", "path", "handler"], "left_semi")
    return _evidence(rows.withColumns({"owner": F.lit(owner), "det_ord": F.lit(det_ord)}), "ast-observe-shared-handler")


def init_calls(py: DataFrame, owner: str, attrs: list[str], det_ord: int = 0) -> DataFrame:
    """Calls of ``self.X`` in a plain ``__init__``."""
    rows = py.where((F.col("kind") == "self_call") & (F.col("method") == "__init__") & ~F.col("is_async") & F.col("chain")[0].isin(attrs))
    return _evidence(rows.withColumns({"owner": F.lit(owner), "det_ord": F.lit(det_ord)}), "ast-init-call")


def shared_method(py: DataFrame, owner: str, attrs: list[str], det_ord: int = 0, min_callers: int = 2, handler_re: str = "^_on_") -> DataFrame:
    """The first such call of each handler, where so many handlers of a class make one."""
    rows = py.where((F.col("kind") == "self_call") & ~F.col("is_async") & F.col("chain")[0].isin(attrs) & F.col("method").rlike(f"^(?:{handler_re})"))
    first = rows.groupBy("slug", "path", "cls", "method").agg(F.min(F.struct("ord", "line", "snippet")).alias("x")).select("slug", "path", "cls", "method", "x.*")
    enough = first.groupBy("slug", "path", "cls").agg(F.count("*").alias("n")).where(F.col("n") >= min_callers)
    out = first.join(enough.drop("n"), ["slug", "path", "cls"], "left_semi").withColumns({"owner": F.lit(owner), "det_ord": F.lit(det_ord)})
    return _evidence(out, "ast-shared-method", order="line")


def yaml_keys(docs: DataFrame, files: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: owner, det_ord, keys, and patterns of paths (null: all of ``docs``). One place a file, that of the first key found; line 0 if the text doesn't tell."""
    flat = docs.select("slug", "path", "doc", F.posexplode("keys").alias("at", "key"))
    paths = F.col("paths") if "paths" in wanted.columns else F.lit(None).cast("array<string>")
    asked = wanted.select("owner", "det_ord", paths.alias("paths"), F.explode("keys").alias("key"))
    inside = F.col("paths").isNull() | F.exists("paths", lambda p: F.rlike(F.col("path"), p))
    first = flat.join(asked, "key").where(inside).groupBy(*KEYS).agg(F.min_by("key", F.struct("doc", "at")).alias("key")).join(files.select("slug", "path", "text"), ["slug", "path"])
    quoted = F.concat(F.lit(r"(?m)^\s*[\"']?\Q"), F.col("key"), F.lit(r"\E[\"']?\s*:"))
    before = F.get(F.split("text", quoted, 2), F.lit(0))
    found = F.regexp_extract_all("text", quoted, F.lit(0))
    lead = F.length(F.regexp_extract(F.get(found, F.lit(0)), r"^\s*", 0)) - F.length(F.replace(F.regexp_extract(F.get(found, F.lit(0)), r"^\s*", 0), F.lit("\n"), F.lit("")))
    line = F.when(F.size(found) > 0, F.size(F.split(before, "\n")) + lead).otherwise(0)
    return _evidence(first, "yaml-key", order=F.lit(0), line=line, snippet="key")


def requires_interface(relations: DataFrame, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: owner, det_ord, interfaces, invert. Inverted: one place for each described unit that requires none of them.

    ``relations``: slug, path, ord, name, role, interface, optional. ``described``: slug, path of metadata that parses.
    """
    one = wanted.select("owner", "det_ord", F.coalesce("invert", F.lit(False)).alias("invert"), F.explode("interfaces").alias("interface"))
    hits = relations.where("role = 'requires'").join(one, "interface")
    plain = _evidence(hits.where("not invert"), "requires-interface", line=F.lit(0), snippet=F.concat_ws(": ", "name", "interface"))
    units = described.groupBy("slug").agg(F.min("path").alias("path"))
    none = units.crossJoin(wanted.where("coalesce(invert, false)").select("owner", "det_ord")).join(hits.select("slug", "owner", "det_ord"), ["slug", "owner", "det_ord"], "left_anti")
    return plain.unionByName(_evidence(none, "requires-interface", order=F.lit(0), line=F.lit(0), snippet=F.lit("none of the interfaces")))


def relation_count(relations: DataFrame, metadata: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: owner, det_ord, role, min, max (null: no end), optional (only such relations count).

    Relations are told apart by name; optional anywhere is optional. Units with metadata but no relation count 0.
    """
    named = relations.groupBy("slug", "role", "name").agg(F.bool_or("optional").alias("optional"))
    n = named.groupBy("slug", "role").agg(F.count("*").alias("every"), F.count_if("optional").alias("some"))
    units = metadata.groupBy("slug").agg(F.min("path").alias("path"))
    rows = units.crossJoin(wanted).join(n, ["slug", "role"], "left")
    count = F.coalesce(F.when(F.coalesce("optional", F.lit(False)), F.col("some")).otherwise(F.col("every")), F.lit(0))
    rows = rows.withColumn("n", count).where((F.col("n") >= F.col("min")) & (F.col("max").isNull() | (F.col("n") <= F.col("max"))))
    return _evidence(rows, "relation-count", order=F.lit(0), line=F.lit(0), snippet=F.concat(F.col("n").cast("string"), F.lit(" "), F.col("role")))


def pytest_keys(settings: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted``: owner, det_ord, keys."""
    rows = settings.join(wanted.select("owner", "det_ord", F.explode("keys").alias("key")), "key")
    return _evidence(rows, "pytest-config-key", order=F.lit(0), line=F.lit(0), snippet=F.concat_ws(" = ", "key", "value"))


def facts(evidence: DataFrame, units: DataFrame, features: DataFrame) -> DataFrame:
    """``slug, feature, feature_ord, present, evidence`` of every unit and feature. Evidence of metadata and settings comes first."""
    by_file = ~F.col("detector_kind").isin("pytest-config-key", "requires-interface", "relation-count", "yaml-key")
    # all of a unit meets at its slug, so the grid of units and features is neither shuffled nor sorted
    shown = evidence.repartition("slug").groupBy("slug", F.col("owner").alias("feature")).agg(F.array_sort(F.collect_list(F.struct(by_file.alias("p"), F.when(by_file, 0).otherwise(F.col("det_ord")).alias("d"), "file", "det_ord", "ev_ord", "line", "detector_kind", "snippet"))).alias("e"))
    shown = shown.groupBy("slug").agg(F.map_from_entries(F.collect_list(F.struct("feature", "e"))).alias("of"))
    every = units.select("slug").join(shown, "slug", "left").crossJoin(F.broadcast(features.select("feature", "feature_ord"))).withColumn("e", F.col("of")[F.col("feature")])
    own = F.transform("e", lambda x: F.struct(x["file"].alias("file"), x["line"].alias("line"), x["detector_kind"].alias("detector_kind"), x["snippet"].alias("snippet")))
    return every.select("slug", "feature", "feature_ord", F.col("e").isNotNull().alias("present"), F.coalesce(own, F.array().cast("array<struct<file:string,line:int,detector_kind:string,snippet:string>>")).alias("evidence"))


def architectures(evidence: DataFrame, patterns: DataFrame) -> DataFrame:
    """``slug, architecture``: patterns with evidence, in the order of the catalogue (pattern_ord, pattern)."""
    rows = evidence.select("slug", F.col("owner").alias("pattern")).distinct().join(patterns, "pattern")
    return rows.groupBy("slug").agg(F.transform(F.array_sort(F.collect_list(F.struct("pattern_ord", "pattern"))), lambda x: x["pattern"]).alias("architecture"))
