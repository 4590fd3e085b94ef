"""The catalogue: features and architecture patterns, each with the detectors that show it.

``built_in`` is the standard one; ``load`` reads one of the same shape from a YAML file, with the lists ``features`` and
``architecture`` of entries (name, library, summary, scope, expected_rare, detect); a detector is its kind and its settings.
"""

from __future__ import annotations

from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

KINDS = ("import", "call", "observe-event", "regex", "yaml-key", "requires-interface", "pytest-config-key", "relation-count", "ast-init-call", "ast-observe-shared-handler", "ast-shared-method")
SCOPES = ("src", "tests", "any")
YAML_GLOBS = ("**/*.yaml", "**/*.yml")


class Entry(NamedTuple):
    name: str
    library: str
    scope: str
    detectors: list[dict[str, Any]]
    summary: str = ""
    expected_rare: bool = False


def _imports(module: str, *names: str) -> dict[str, Any]:
    return {"kind": "import", "module": module} | ({"names": list(names)} if names else {})


def _calls(*attrs: str) -> list[dict[str, Any]]:
    return [{"kind": "call", "attr": a} for a in attrs]


def _regex(*patterns: str) -> list[dict[str, Any]]:
    return [{"kind": "regex", "pattern": p} for p in patterns]


def _events(*names: str) -> dict[str, Any]:
    return {"kind": "observe-event", "events": list(names)}


#: Fixed values from here to the end of ``built_in``: names, modules, patterns, interfaces, methods and ranges that detectors look for.
def _event_forms(suffix: str) -> list[dict[str, Any]]:
    """Three ways to name an event of a container or an action: attribute, subscript and getattr."""
    return _regex(rf"\bon\.[a-zA-Z_][a-zA-Z0-9_]*_{suffix}\b", rf"\bon\[\s*[^\]]+\s*\]\.{suffix}\b", rf"getattr\s*\(\s*[^,)]+\.on\s*,\s*['\"][a-zA-Z_][a-zA-Z0-9_]*_{suffix}['\"]")


CHISME, SUNBEAM, WORKERS, MONGO = "charmed_kubeflow_chisme.components", "ops_sunbeam", "coordinated_workers", "single_kernel_mongo"
INTERFACES = {
    "postgresql": ["postgresql_client", "pgsql", "postgresql_async", "postgresql_watcher"],
    "mysql": ["mysql_client", "mysql-shared", "mysql", "mysql_async", "mysql-async-replication", "mysql-router", "mysql_datastore", "mysql-monitor", "mysql-root"],
    "mongodb": ["mongodb_client", "mongodb", "mongos_client"],
    "redis": ["redis"],
    "opensearch": ["opensearch_client"],
    "elasticsearch": ["elasticsearch", "elasticsearch-datastore", "elastic-beats"],
    "kafka": ["kafka_client", "kafka"],
    "cassandra": ["cassandra", "cassandra_client"],
    "etcd": ["etcd", "etcd_client", "etcd-proxy"],
    "memcached": ["memcache"],
    "influxdb": ["influxdb-api"],
    "zookeeper": ["zookeeper"],
    "arangodb": ["arangodb"],
    "db2": ["db2"],
}
RARE_DATABASES = ("cassandra", "memcached", "influxdb", "zookeeper", "arangodb", "db2")
RECONCILERS = ["_reconcile", "reconcile", "_update_charm", "_reconcile_charm", "_do_reconcile"]


def _code_features() -> list[Entry]:
    ops = lambda name, detectors, summary: Entry(name, "ops", "src", detectors, summary)
    tests = lambda name, library, detectors, summary: Entry(name, library, "tests", detectors, summary)
    lib = lambda name, module, summary, *names: Entry(name, name.split(".")[0], "src", [_imports(module, *names)], summary)
    return [
        ops("ops.collect-status", [_events("CollectAppStatusEvent", "CollectUnitStatusEvent", "CollectStatusEvent"), *map(_imports, (CHISME, SUNBEAM, WORKERS, MONGO))], "Status is collected by an event."),
        ops("ops.status-set-directly", _regex(r"\.(unit|app)\.status\s*="), "Status is assigned directly."),
        ops("ops.secrets", [*_calls("model.get_secret", "app.add_secret", "unit.add_secret"), _imports("ops", "Secret")], "Secrets of the platform are used."),
        ops("ops.stored-state", [*_calls("StoredState"), _imports("ops", "StoredState")], "State is kept in the framework's store."),
        ops("ops.relation-app-data", _regex(r"relation\.data\[\s*(self\.app|event\.app|self\.model\.app|relation\.app|event\.relation\.app)\s*\]"), "Relation data of the application is read or written."),
        ops("ops.pebble-ready", [_events("PebbleReadyEvent"), *_event_forms("pebble_ready"), *_regex(r"self\.on\.events\(\)"), *map(_imports, (CHISME, SUNBEAM, WORKERS))], "A container's readiness is observed."),
        ops("ops.pebble-custom-notice", [_events("PebbleCustomNoticeEvent"), *_event_forms("pebble_custom_notice")], "Notices of the workload are observed."),
        ops("ops.leader-events", [_events("LeaderElectedEvent", "LeaderSettingsChangedEvent")], "Changes of the leader are observed."),
        ops("ops.open-ports", _calls("unit.open_port", "unit.set_ports", "_unit.open_port", "_unit.set_ports"), "Ports are opened in code."),
        ops("ops.action-handlers", [_events("ActionEvent"), *_event_forms("action")], "An action is observed."),
        Entry("pebble.checks", "pebble", "src", [_imports("ops.pebble", "CheckDict", "Check"), {"kind": "yaml-key", "files": list(YAML_GLOBS), "key": "checks"}, *_regex(r"(?<![a-zA-Z_])[\"']?checks[\"']?\s*:\s*(?:[{\[]|$)")], "A layer has checks."),
        Entry("pebble.log-forwarding", "pebble", "src", [_imports("ops.pebble", "LogTarget", "LogTargetDict"), _imports("charms.loki_k8s", "LogForwarder"), *_regex(r"\blog[-_]targets[\"']?\s*[:\]]"), {"kind": "yaml-key", "key": "log-targets"}], "Logs are forwarded to targets."),
        Entry("pebble.restart-delay", "pebble", "src", [*_regex(r"\b(restart[-_]delay|backoff[-_](delay|factor|limit))[\"']?\s*[:\]]"), {"kind": "yaml-key", "keys": ["backoff-delay", "backoff-factor", "backoff-limit"]}], "Restarts of a service are timed."),
        tests("ops-scenario.unit-tests", "ops-scenario", [_imports("scenario"), _imports("ops.testing", "Harness", "Context", "State"), _imports("ops", "testing")], "Unit tests use the testing module in either form."),
        tests("ops-scenario.unit-tests.harness", "ops-scenario", [_imports("ops.testing", "Harness")], "Unit tests use the older form."),
        tests("ops-scenario.unit-tests.scenario", "ops-scenario", [_imports("scenario"), _imports("ops.testing", "Context", "State"), _imports("ops", "testing")], "Unit tests use the newer form."),
        tests("jubilant.integration-tests", "jubilant", [_imports("jubilant")], "Integration tests use jubilant."),
        tests("testing.pytest-log-config", "python", [{"kind": "pytest-config-key", "keys": ["log_level", "log_cli_level", "log_file_level"]}], "Test settings name a level of logging."),
        tests("testing.caplog", "python", _regex(r"def\s+test_\w*\s*\([^)]*\bcaplog\b"), "Tests take the fixture caplog."),
        lib("charmlibs.data-platform", "charms.data_platform_libs", "The data platform's library is imported."),
        lib("charmlibs.observability", "charms.observability_libs", "The observability libraries are imported."),
        lib("charmlibs.cos-agent", "charms.grafana_agent", "The agent's provider is imported.", "COSAgentProvider"),
        lib("charmlibs.rolling-ops", "charms.rolling_ops", "The library of rolling restarts is imported."),
        lib("python.lightkube", "lightkube", "Kubernetes is called by lightkube."),
        lib("python.pydantic", "pydantic", "Models of pydantic are used."),
        ops("ops.typed-relation", _regex(r"\b\w*[Rr]elation\w*\.load\s*\(\s*[A-Z]\w+", r"\b\w*[Rr]elation\w*\.save\s*\("), "Relation data is loaded and saved as typed objects."),
    ]


def _metadata_features() -> list[Entry]:
    of = lambda name, detector, rare=False: Entry(name, "metadata", "any", [detector], "By the unit's metadata.", rare)
    out = [of(f"db.{db}", {"kind": "requires-interface", "interfaces": some}, db in RARE_DATABASES) for db, some in INTERFACES.items()]
    out.append(of("db.none", {"kind": "requires-interface", "invert": True, "interfaces": [i for some in INTERFACES.values() for i in some]}))

    def counts(prefix: str, role: str, singles: int, ranges: list[tuple[int, int | None]], rare: int | None = None, **more: bool) -> list[Entry]:
        every = [(n, n) for n in range(singles)] + ranges
        label = lambda lo, hi: f"{lo}-plus" if hi is None else str(lo) if lo == hi else f"{lo}-{hi}"
        return [of(f"{prefix}-{label(lo, hi)}", {"kind": "relation-count", "role": role, **more, "min": lo} | ({} if hi is None else {"max": hi}), lo == rare) for lo, hi in every]

    out += counts("requires", "requires", 6, [(6, 10), (11, None)], rare=11)
    out += counts("provides", "provides", 6, [(6, None)])
    return out + counts("requires-optional", "requires", 4, [(4, 5), (6, None)], rare=6, optional=True)


def built_in() -> tuple[list[Entry], list[Entry]]:
    """Features and patterns, in their order."""
    pattern = lambda name, detectors, summary: Entry(name, "", "src", detectors, summary)
    patterns = [
        pattern("reconcile-all", _regex(r"self\.on\.events\(\)"), "All events go to one handler."),
        pattern("reconcile", [{"kind": "ast-observe-shared-handler", "min_events": 3, "exclude_suffixes": ["_error"]}], "A set of events goes to one handler."),
        pattern("part-reconcile", [{"kind": "ast-shared-method", "attrs": RECONCILERS, "min_callers": 2}], "Handlers share a method."),
        pattern("unconditional-init", [{"kind": "ast-init-call", "attrs": RECONCILERS}], "The constructor does the work."),
        pattern("component-graph", [*map(_imports, (CHISME, SUNBEAM, WORKERS))], "A framework of components does the wiring."),
    ]
    return _code_features() + _metadata_features(), patterns


def _entry(doc: dict[str, Any]) -> Entry:
    detectors = [dict(d) for d in doc.get("detect") or []]
    for d in detectors:
        if d.get("kind") not in KINDS:
            raise ValueError(f"{doc['name']}: unknown kind of detector {d.get('kind')!r}")
    if (scope := doc.get("scope") or "any") not in SCOPES:
        raise ValueError(f"{doc['name']}: unknown scope {scope!r}")
    return Entry(str(doc["name"]), str(doc.get("library") or ""), scope, detectors, str(doc.get("summary") or ""), bool(doc.get("expected_rare")))


def load(path: str) -> tuple[list[Entry], list[Entry]]:
    """Features and patterns of a file; without ``architecture`` there are no patterns."""
    import yaml

    with open(path, encoding="utf-8") as f:
        doc = yaml.safe_load(f) or {}
    return [_entry(e) for e in doc.get("features") or []], [_entry(e) for e in doc.get("architecture") or []]


def as_table(spark: SparkSession, entries: list[Entry]) -> DataFrame:
    """``feature, feature_ord, library, summary, scope, expected_rare``."""
    rows = [(e.name, i, e.library, e.summary, e.scope, e.expected_rare) for i, e in enumerate(entries)]
    return spark.createDataFrame(rows, "feature string, feature_ord int, library string, summary string, scope string, expected_rare boolean")
