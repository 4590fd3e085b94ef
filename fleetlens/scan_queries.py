"""Registered queries of the scan half: trees made from the rows of ``customer``, scanned with the built-in catalogue.

The tree of a customer's key ``k`` says by remainders of ``k`` what the unit holds, so the SQL can tell what a scan must find.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.catalog import FLEET, facts, features, query, table, units
from fleetlens.operators import extract, metadata, refine, scan, scoring, search, views
from fleetlens.plans.staging import shared_folder, staged
from fleetlens.sources import tree
from fleetlens.sources.catalogue import INTERFACES, built_in


def _lines(*items: str | tuple[str, str]) -> Column:
    """Lines of a file; a pair is a condition in SQL and the line it allows."""
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else F.when(F.expr(x[0]), F.lit(x[1])) for x in items), F.lit(""))


def _relations(role: str, n: str, each: str) -> Column:
    return F.when(F.expr(f"{n} > 0"), F.concat(F.lit(f"{role}:\n"), F.array_join(F.expr(f"transform(sequence(0, {n} - 1), i -> {each})"), "\n"), F.lit("\n"))).otherwise("")


#: The second relation of a tree asks for one of these, by k % 17.
SECOND = {db: some[0] for db, some in INTERFACES.items() if db not in ("mysql", "redis")} | {f"no{n}": "other" for n in range(5)}


def trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``slug, path, text``."""
    t = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"))
    interface = f"case when i = 1 then coalesce(element_at(array({', '.join(map(repr, SECOND.values()))}), cast(k % 17 + 1 as int)), 'other') when i > 0 then 'other' when k % 3 = 0 then 'mysql' when k % 3 = 1 then 'redis' else 'ingress' end"
    name = F.expr("case when k % 48 = 1 then 'data-platform-libs' else concat('app-', k) end")
    meta = F.concat(
        F.lit("name: "), name, F.lit("\n"), _lines(("k % 2 = 0", "containers: {web: {}}")),
        _relations("requires", "(k % 13)", f"concat('  r', i, ': {{interface: ', {interface}, ', optional: ', i < k % 9, '}}')"), _relations("provides", "(k % 8)", "concat('  p', i, ': {interface: http}')"),
        _lines(("k % 5 = 1", "config: {options: {admin-password: {type: string}}}"), ("k % 5 = 2", "config: {options: {admin-password: {type: secret}}}"), ("k % 5 = 3", "config: {options: {admin-password: {type: secret}, api-key: {type: string}}}"), ("k % 5 = 4", "config: {options: {port: {type: int}}}")),
        _lines(("k % 23 = 3", "subordinate: true"), ("k % 23 = 5", "subordinate: ' TRUE '"), ("k % 27 = 4", "assumes:\n  - juju >= 3.10\n  - any-of: [juju >= 3.9, k8s-api]"), ("k % 29 = 2", "parts: {a: {plugin: charm}, b: {plugin: uv}, c: {plugin: charm}}"),
               ("k % 31 = 5", "base: ubuntu@24.04\nbuild-base: ubuntu@22.04"), ("k % 31 = 9", "bases: [{name: ubuntu, channel: '20.04'}, {run-on: [{name: ubuntu, channel: '22.04'}]}]")),
    )
    code = _lines(
        "import ops", ("k % 3 = 1", "from charms.data_platform_libs.v0 import data_interfaces"), ("k % 6 = 0", "import lightkube.core.client"), ("k % 7 = 1", "from ops import StoredState"),
        ("k % 11 = 0", "import ops_sunbeam.charm"), ("k % 5 = 3", "import pydantic"), ("k % 20 = 11", "from charms.loki_k8s.v1.log import LogForwarder"), ("k % 21 = 5", "from charms.observability_libs.v1 import x"), ("k % 23 = 6", "from charms.grafana_agent.v0.cos_agent import COSAgentProvider"), ("k % 23 = 8", "from charms.grafana_agent.v0.cos_agent import Other"), ("k % 25 = 4", "import charms.rolling_ops.v0.rollingops"), "class Charm:", "    def __init__(self):", "        framework.observe(self.on.install, self._on_install)",
        ("k % 5 = 0", "        framework.observe(self.on.collect_unit_status, self._on_status)"), ("k % 4 = 1", "        framework.observe(self.on.secret_changed, self._all)"), ("k % 4 = 1", "        framework.observe(self.on.upgrade_charm, self._all)"),
        ("k % 4 = 1", "        framework.observe(self.on.leader_elected, self._all)"), ("k % 14 = 3", "        framework.observe(self.on.web_pebble_ready, self._on_web)"), ("k % 15 = 2", "        framework.observe(self.on.go_action, self._on_go)"), ("k % 7 = 0", "        self._reconcile()"),
        ("k % 4 = 2", "        framework.observe(self.on.db_relation_created, self._rel)"), ("k % 4 = 2", "        framework.observe(self.on.db_relation_changed, self._rel)"), ("k % 4 = 2", "        framework.observe(self.on.db_relation_broken, self._rel)"), 
        ("k % 8 = 3", "        framework.observe(self.on.a_pebble_ready, self._ready)"), ("k % 8 = 3", "        framework.observe(self.on.b_pebble_ready, self._ready)"), ("k % 8 = 3", "        framework.observe(self.on.c_pebble_ready, self._ready)"), 
        ("k % 8 = 7", "        framework.observe(self.on.install, self._base)"), ("k % 8 = 7", "        framework.observe(self.on.start, self._base)"), ("k % 8 = 7", "        framework.observe(self.on.stop, self._base)"), ("k % 12 = 0", "        framework.observe(self.on.a_error, self._err)"), ("k % 12 = 0", "        framework.observe(self.on.b_error, self._err)"), ("k % 12 = 0", "        framework.observe(self.on.install, self._err)"), ("k % 12 = 0", "        framework.observe(self.on.start, self._err)"), 
        ("k % 28 = 6", "        framework.observe(self.on.a_relation_created, self._many)"), ("k % 28 = 6", "        framework.observe(self.on.b_relation_changed, self._many)"), ("k % 28 = 6", "        framework.observe(self.on.c_relation_broken, self._many)"), ("k % 18 = 7", '        framework.observe(self.on["web"].pebble_custom_notice, self._on_note)'),
        "    def _on_install(self, event):", ("k % 9 = 0", "        self.unit.status = 1"), ("k % 10 = 0", "        self._reconcile()"), "        pass",
        "    def _on_status(self, event):", ("k % 10 = 0", "        self._reconcile()"), ("k % 6 = 4", '        self.unit.open_port("tcp", 80)'), ("k % 9 = 4", "        relation.data[self.app]"),
        ("k % 12 = 5", "        self.model.get_secret(id=1)"), ("k % 10 = 6", "        event.relation.load(Model, self.app)"), "        pass",
    )
    own = F.expr("case when k % 48 = 1 then 'lib/charms/data_platform_libs/v0/data_interfaces.py' when k % 16 = 0 then concat('lib/charms/app_', k, '/v0/own.py') end")
    entry = lambda test, path, text: F.when(F.expr(test), F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), (F.lit(text).cast("string") if text is None or isinstance(text, str) else text).alias("text")))
    files = F.array_compact(F.array(
        entry("true", "charmcraft.yaml", meta), entry("true", "src/charm.py", code), entry("k % 48 = 1 or k % 16 = 0", own, "import ops\n"),
        entry("true", "tests/unit/test_charm.py", _lines("import pytest", ("k % 3 = 0", "from ops.testing import Harness"), ("k % 3 = 1", "from ops import testing"), ("k % 8 = 2", "def test_log(caplog):\n    pass"))),
        entry("k % 2 = 1", "tests/integration/test_it.py", _lines(("k % 4 = 3", "import jubilant"))), entry("k % 5 = 2", "pytest.ini", "[pytest]\nlog_cli_level = INFO\n"), entry("k % 2 = 0", "tox.ini", "[tox]\nenvlist = x\n"),
        entry("k % 6 = 1", "checks.yaml", "services:\n  checks:\n    up: 1\n"), entry("k % 19 = 0", "layer.yaml", "includes: []\n"), entry("k % 19 = 0", "reactive/x.py", "import os\n"),
        entry("k % 20 = 9", "log.yaml", "services: {}\nlog-targets: {a: {}}\n"), entry("k % 22 = 13", "restart.yaml", "services:\n  x:\n    backoff-delay: 1s\n"), entry("k % 35 = 6", "main.tf", None),
    ))
    return t.select(F.concat(F.lit("c"), F.col("k")).alias("slug"), F.explode(files).alias("f")).select("slug", "f.path", "f.text")


def _scan(spark: SparkSession, sf_dir: str) -> scan.Scan:
    return scan.scan(trees(spark, sf_dir), *built_in())


#: What is in a tree, as a condition on k.
SHOWN = {
    "ops.collect-status": "k % 5 = 0 or k % 11 = 0", "ops.status-set-directly": "k % 9 = 0", "ops.secrets": "k % 12 = 5", "ops.stored-state": "k % 7 = 1", "ops.relation-app-data": "k % 9 = 4",
    "ops.pebble-ready": "k % 14 = 3 or k % 11 = 0 or k % 8 = 3", "ops.pebble-custom-notice": "k % 18 = 7", "ops.leader-events": "k % 4 = 1", "ops.open-ports": "k % 6 = 4", "ops.action-handlers": "k % 15 = 2", "pebble.checks": "k % 6 = 1",
    "ops-scenario.unit-tests": "k % 3 < 2", "ops-scenario.unit-tests.harness": "k % 3 = 0", "ops-scenario.unit-tests.scenario": "k % 3 = 1", "jubilant.integration-tests": "k % 4 = 3",
    "testing.pytest-log-config": "k % 5 = 2", "testing.caplog": "k % 8 = 2", "charmlibs.data-platform": "k % 3 = 1 and k % 48 <> 1", "python.lightkube": "k % 6 = 0", "python.pydantic": "k % 5 = 3",
    "ops.typed-relation": "k % 10 = 6", "db.mysql": "k % 13 > 0 and k % 3 = 0", "db.redis": "k % 13 > 0 and k % 3 = 1", "db.none": "not (k % 13 > 0 and k % 3 < 2) and not (k % 13 > 1 and k % 17 < 12)",
    "pebble.log-forwarding": "k % 20 in (9, 11)", "pebble.restart-delay": "k % 22 = 13", "charmlibs.observability": "k % 21 = 5", "charmlibs.cos-agent": "k % 23 = 6", "charmlibs.rolling-ops": "k % 25 = 4",
    **{f"db.{db}": f"k % 13 > 1 and k % 17 = {n}" for n, db in enumerate(SECOND) if n < 12},
    **{f"requires-{n}": f"k % 13 = {n}" for n in range(6)}, "requires-6-10": "k % 13 between 6 and 10", "requires-11-plus": "k % 13 >= 11",
    **{f"provides-{n}": f"k % 8 = {n}" for n in range(6)}, "provides-6-plus": "k % 8 >= 6", **{f"requires-optional-{n}": f"least(k % 13, k % 9) = {n}" for n in range(4)}, "requires-optional-4-5": "least(k % 13, k % 9) between 4 and 5", "requires-optional-6-plus": "least(k % 13, k % 9) >= 6",
}
SECOND_SQL = " ".join(f"when {n} then '{i}'" for n, i in enumerate(SECOND.values()))
NAMES = ", ".join(f"('{e.name}')" for e in built_in()[0])
TREES = f"""
    t as (select c_custkey as k, 'c' || c_custkey as slug from customer),
    g as (select t.k, t.slug, n.feature, case n.feature {' '.join(f"when '{f}' then {c}" for f, c in SHOWN.items())} else false end as present from t cross join (values {NAMES}) n(feature))
"""
GAP, WORTH, NA = "'clear-gap'", "'worth-considering'", "'not-applicable'"
ABSENT = f"""case when k % 19 = 0 then {NA} when feature in ('ops.pebble-ready', 'ops.collect-status') and (k % 4 = 1 or k % 28 = 6 or k % 7 = 0) then {NA}
    when feature in ('pebble.checks', 'ops.pebble-custom-notice') then case when k % 2 = 0 then {WORTH} else {NA} end
    when feature = 'ops.pebble-ready' then case when k % 2 = 0 then {GAP} else {NA} end
    when feature = 'ops.relation-app-data' then case when k % 13 + k % 8 > 0 then {WORTH} else {NA} end
    when feature = 'ops.collect-status' then case when k % 9 = 0 or k % 13 + k % 8 > 0 then {GAP} else {WORTH} end
    when feature = 'ops.secrets' then case k % 5 when 1 then {GAP} when 3 then {WORTH} else {NA} end
    when feature = 'jubilant.integration-tests' then case when k % 2 = 1 then {WORTH} else {NA} end else {NA} end"""


@query(f"with {TREES} select slug, feature, present, case when present then case when feature = 'ops.stored-state' then {WORTH} end else {ABSENT} end as score from g")
def scan_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scan(spark, sf_dir).facts.select("slug", "feature", "present", "score")


@query(f"""
    with {TREES} select slug, feature, file, detector_kind, snippet from g, (values
        ('ops.open-ports', 'src/charm.py', 'call', 'self.unit.open_port("tcp", 80)'), ('ops.status-set-directly', 'src/charm.py', 'regex', '.unit.status ='), ('python.lightkube', 'src/charm.py', 'import', 'import lightkube.core.client'),
        ('db.mysql', 'charmcraft.yaml', 'requires-interface', 'r0: mysql'), ('testing.pytest-log-config', 'pytest.ini', 'pytest-config-key', 'log_cli_level = INFO'), ('pebble.checks', 'checks.yaml', 'yaml-key', 'checks'),
        ('ops.action-handlers', 'src/charm.py', 'regex', 'on.go_action'), ('ops.secrets', 'src/charm.py', 'call', 'self.model.get_secret(id=1)')
    ) e(owner, file, detector_kind, snippet) where present and feature = owner
""")
def scan_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = ["ops.open-ports", "ops.status-set-directly", "python.lightkube", "db.mysql", "testing.pytest-log-config", "pebble.checks", "ops.action-handlers", "ops.secrets"]
    rows = _scan(spark, sf_dir).facts.where(F.col("feature").isin(some)).select("slug", "feature", F.explode("evidence").alias("e"))
    return rows.select("slug", "feature", "e.file", "e.detector_kind", "e.snippet")


@query("""
    with t as (select c_custkey as k from customer)
    select 'c' || k as slug, case when k % 48 = 1 then 'data-platform-libs' else 'app-' || k end as charm_name, k % 2 = 0 as has_containers, cast(k % 13 + k % 8 as int) as relations,
        case k % 5 when 0 then '' when 4 then 'port' when 3 then 'admin-password api-key' else 'admin-password' end as config_keys,
        case k % 5 when 0 then '' when 4 then '' when 3 then 'admin-password api-key' else 'admin-password' end as secret_like_config,
        case when k % 5 in (2, 3) then 'admin-password' else '' end as secret_typed_config, k % 2 = 1 as has_integration_tests, k % 19 = 0 as is_reactive,
        case when k % 48 = 1 then 'data_platform_libs' when k % 16 = 0 then 'app_' || k else '' end as library_names, k % 48 = 1 or k % 16 = 0 as provides_own_library,
        k % 2 = 1 and k % 19 <> 0 as is_workload_less, case when k % 2 = 0 then 'tox' else '' end as tooling, k % 23 in (3, 5) as is_subordinate, case when k % 27 = 4 then '3.9' end as min_juju_version, case when k % 29 = 2 then 'charm uv' else '' end as charmcraft_plugins,
        case k % 31 when 5 then 'ubuntu@24.04 ubuntu@22.04' when 9 then 'ubuntu@20.04 ubuntu@22.04' else '' end as bases, k % 35 = 6 as has_terraform_module,
        concat_ws(' ', case when k % 4 = 1 or k % 28 = 6 then 'reconcile' end, case when k % 10 = 0 then 'part-reconcile' end, case when k % 7 = 0 then 'unconditional-init' end, case when k % 11 = 0 then 'component-graph' end) as architecture
    from t
""")
def scan_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _scan(spark, sf_dir).units
    joined = lambda c: F.array_join(c, " ").alias(c)
    return u.select(
        "slug", "charm_name", "has_containers", F.size("relations").alias("relations"), joined("config_keys"), joined("secret_like_config"), joined("secret_typed_config"), "has_integration_tests",
        "is_reactive", joined("library_names"), "provides_own_library", "is_workload_less", joined("tooling"), "is_subordinate", "min_juju_version", joined("charmcraft_plugins"), joined("bases"), "has_terraform_module", joined("architecture"),
    )


@query("""
    with r as (select distinct c_custkey // 2 as j from customer),
    w as (select j, 'r' || j as slug, case when j % 7 = 0 then 'archived' when j % 5 = 0 then 'clone failed' when j % 5 = 1 then 'no charmcraft.yaml or metadata.yaml found' end as reason from r),
    s as (select j, slug || s.sub as slug, s.sub = '/b' and j % 4 = 0 as gone from w, (values (3, '/a'), (3, '/b'), (2, ''), (4, '/x/y')) s(kind, sub) where reason is null and j % 5 = s.kind)
    select slug, reason from w where reason is not null union all select slug, case when gone then 'not a unit' end from s
""")
def scan_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("ord"), F.expr("c_custkey div 2").alias("j"))
    refs = k.select("ord", F.lit("t").alias("team"), F.concat(F.lit("r"), "j").alias("name"), F.concat(F.lit("r"), "j").alias("slug"), F.concat(F.lit("https://h/r"), "j").alias("repo_url"), F.lit(None).cast("string").alias("branch"))
    paths = F.expr("case j % 5 when 1 then array('src/charm.py') when 2 then array('metadata.yaml', 'a/metadata.yaml') when 3 then array('a/charmcraft.yaml', 'b/metadata.yaml', 'tests/c/metadata.yaml', 'b/d/metadata.yaml') when 4 then array('x/y/metadata.yaml', '.z/metadata.yaml') else array() end")
    files = k.select("j").distinct().select(F.concat(F.lit("r"), "j").alias("slug"), F.explode(paths.cast("array<string>")).alias("path"), F.lit("name: x").alias("text"))
    url = F.concat(F.lit("https://h/r"), F.col("j")).alias("url")
    over = {
        "exclude": k.where("j % 7 = 0").select(url, F.lit("archived").alias("reason")).distinct(), "branch": spark.createDataFrame([], "url string, branch string"),
        "sub": k.where("j % 4 = 0").select(url, F.lit("b").alias("sub_path"), F.lit("not a unit").alias("reason")).distinct(),
    }
    stay, skipped = scan.route(refs, over, files.select("slug"), files)
    return stay.select("slug", F.lit(None).cast("string").alias("reason")).unionByName(skipped)


@query(f"""
    with t as (select c_custkey as k from customer), x as (select 'c' || k as slug, unnest(range(k % 13)) as i, 'requires' as role, k from t union all select 'c' || k, unnest(range(k % 8)), 'provides', k from t)
    select slug, role, case role when 'requires' then 'r' else 'p' end || i as name, case when role = 'provides' then 'http' when i = 1 then case k % 17 {SECOND_SQL} else 'other' end when i > 0 then 'other' when k % 3 = 0 then 'mysql' when k % 3 = 1 then 'redis' else 'ingress' end as interface, role = 'requires' and i < k % 9 as optional from x
""")
def unit_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = extract.yaml_docs(staged(trees(spark, sf_dir).where(tree.is_metadata(F.col("path")))))
    return metadata.relations(metadata.described(docs)).select("slug", "role", "name", "interface", "optional")


@query("select 'second' as scan, 0 as parsed union all select 'third', count(*) from customer where c_custkey % 50 = 0")
def scan_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many contents are parsed by a second scan of the same trees, and by a third after one file of some has changed."""
    files, known = staged(trees(spark, sf_dir)), shared_folder(spark, "known")
    changed = (F.col("path") == "src/charm.py") & (F.substring("slug", 2, 20).cast("long") % 50 == 0)
    after = files.withColumn("text", F.when(changed, F.concat("text", F.lit("# "), "slug")).otherwise(F.col("text")))
    parsed = [sum(extract.facts_of(f, p, known)[1] for p in (extract.PYTHON_PARSER._replace(wanted=lambda: tree.in_scope(F.col("path"), "any")), extract.yaml_parser(), extract.SETTINGS_PARSER)) for f in (files, files, after)]
    return spark.createDataFrame([("second", parsed[1]), ("third", parsed[2])], "scan string, parsed long")


# The page: labels, facets and chips of units.


@query(f"""
    with {FLEET} select slug, concat_ws(' ', case when unit_ord % 9 = 0 then 'terraform' end) as flags,
        case when is_reactive then 'reactive' when is_legacy_classic then 'legacy-classic' when reconcile and part_reconcile then 'reconcile part-reconcile' when reconcile then 'reconcile' when part_reconcile then 'part-reconcile' else 'delta' end as arch_labels,
        trim(case when has_containers then 'k8s' else 'machine' end || ' ubuntu@22.04' || case when tox then ' tox' else '' end || case when make then ' make' else '' end || ' ' || case when unit_ord % 9 = 0 then ' terraform' else '' end) as stack
    from u
""")
def unit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir).withColumns({"is_subordinate": F.lit(False), "is_workload_less": F.lit(False), "min_juju_version": F.lit(None).cast("string")})
    return views.unit_labels(u).select("slug", F.array_join("flags", " ").alias("flags"), F.array_join("arch_labels", " ").alias("arch_labels"), "stack")


@query(f"""
    with {FLEET}, v as (
        select 'team' as facet, team as value, count(*) as n, lower(team) as key from u group by team union all select 'library', substr(feature, 1, 1), count(*), substr(feature, 1, 1) from feats group by all
        union all select 'tooling', 'tox', count(*), 'tox' from u where tox union all select 'tooling', 'make', count(*), 'make' from u where make
        union all select 'architecture', a.v, count(arch.slug), a.o from (values ('reactive', '0'), ('legacy-classic', '1'), ('component-graph', '2'), ('reconcile-all', '3'), ('reconcile', '4'), ('unconditional-init', '5'), ('part-reconcile', '6'), ('delta', '7')) a(v, o) left join arch on arch.arch = a.v group by a.v, a.o
    ) select facet, value, n, cast(row_number() over (partition by facet order by key, value) as int) as place from v where facet <> 'tooling' or n > 0
""")
def page_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facets(units(spark, sf_dir), features(spark, sf_dir))


@query(f"with {FLEET}, a as (select slug, bool_or(f.feature = 'STANDARD' and f.present) as has, bool_or(f.feature = 'ECONOMY' and f.present) as lacks from u join f using (slug) group by slug) select slug from a join u using (slug) where not has and not lacks and (tox or make)")
def page_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = units(spark, sf_dir)
    rows = views.unit_view(u, facts(spark, sf_dir)).join(u.select("slug", "tooling"), "slug").join(facts(spark, sf_dir).select("slug").distinct(), "slug", "left_semi")
    return rows.where(search.chips({"STANDARD": "lacks", "ECONOMY": "lacks"}) & search.facet("tooling", ["tox", "make"])).select("slug")


# Refinement: candidates, keys of the cache, cost, expiry, counts, escalation.


@query(f"with {FLEET} select feature, count(f.slug) as n from (values ('STANDARD'), ('ECONOMY'), ('none')) e(feature) left join (select * from f where not present and score = 'worth-considering') f using (feature) group by feature")
def eligible_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return refine.eligible_counts(facts(spark, sf_dir), ("STANDARD", "ECONOMY", "none"))


@query(f"""
    with {FLEET}, c as (select slug, feature, unit_ord, case when unit_ord % 3 = 0 then '' else 'sha' || unit_ord end as sha, repo_url from f join u using (slug) where not present and score = 'worth-considering' and feature in ('STANDARD', 'ECONOMY'))
    select slug, feature, case when sha <> '' then sha256(repo_url || '@' || sha || ':' || feature || ':1:p') end as key, sha <> '' and unit_ord % 2 = 0 as hit from c
""")
def refinement_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("unit_ord")
    u = units(spark, sf_dir).withColumn("repo_sha", F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("sha"), k.cast("string"))))
    rows = refine.eligible(facts(spark, sf_dir), u, ("STANDARD", "ECONOMY")).withColumn("key", refine.cache_key(F.col("repo_url"), F.col("repo_sha"), F.col("feature"), F.lit("1"), F.lit("p")))
    kept = rows.where("unit_ord % 2 = 0 and key is not null").select("key", F.lit("clear-gap").alias("verdict"), F.lit("r").alias("rationale"))
    return refine.with_cache(rows, kept).select("slug", "feature", "key", "hit")


@query(f"with {FLEET} select slug, feature, case when up then 'clear-gap' else score end as score, case when up then 'asked' else 'why' end as rationale, up as ai_escalated from (select f.*, coalesce(not present and score = 'worth-considering' and unit_ord % 2 = 0, false) as up from f join u using (slug))")
def refined_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = facts(spark, sf_dir)
    asked = f.where("not present and score = 'worth-considering'").join(units(spark, sf_dir).select("slug", "unit_ord"), "slug")
    verdicts = asked.select("slug", "feature", F.when(F.col("unit_ord") % 2 == 0, "clear-gap").otherwise("worth-considering").alias("verdict"), F.lit("asked").alias("rationale"))
    return refine.refined(f, verdicts).select("slug", "feature", "score", "rationale", "ai_escalated")


@query("select event_id, case when event_id % 7 = 0 then 'odd' else strftime(ts, '%Y-%m-%dT%H:%M:%SZ') end as timestamp from events where event_id % 7 = 0 or ts >= timestamp '2024-01-16 00:00:00'")
def cache_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    at = F.when(F.col("event_id") % 7 == 0, "odd").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return refine.pruned(e.select("event_id", at.alias("timestamp")), F.lit("2024-02-15").cast("timestamp"))


@query("select conv_id, turn, case turn % 4 when 0 then 'parse-error' when 1 then 'parse-error' when 2 then 'ok' else 'invalid-path' end as outcome from conversations")
def strict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(F.lit('{"verdict":"clear-gap","rationale":5}'), F.lit('{"verdict":"clear-gap","rationale":"r"} more'), F.lit('{"verdict":"worth-considering","rationale":"r","evidence_path":null}'), F.lit('{"verdict":"maybe","evidence_path":"b.py"}')), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", refine.outcome(raw, F.array(F.lit("a.py"))).alias("outcome"))


# Labels of secrets with their reasons, and kinds of units, each in all its branches.


@query(f"""
    with {FLEET} select slug, case when is_reactive or is_legacy_classic then 'not-applicable' when k in (0, 2) then 'not-applicable' when k in (1, 5) then 'clear-gap' else 'worth-considering' end as score,
        case when is_reactive then 'the unit is reactive' when is_legacy_classic then 'the unit is a classic one of hooks' when k = 0 then 'no option looks like a secret' when k = 1 then 'options look like secrets: db-password, token'
            when k = 2 then 'all such options are secrets already' when k = 3 then 'some options are not secrets yet: token' when k = 4 then 'some options are not secrets yet: db-password'
            when k = 5 then 'options look like secrets: a-token, b-token, c-token, …' else 'some options are not secrets yet: a-token, b-token, c-token, …' end as rationale
    from (select *, unit_ord % 7 as k from u)
""")
def secret_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("unit_ord") % 7
    words = lambda *xs: F.array(*map(F.lit, xs)).cast("array<string>")
    many = words("d-token", "c-token", "b-token", "a-token")
    like = F.when(k.isin(1, 3), words("db-password", "token")).when(k.isin(2, 4), words("db-password")).when(k >= 5, many).otherwise(words())
    typed = F.when(k.isin(2, 3), words("db-password")).when(k.isin(4, 6), words("cert")).otherwise(words())
    no_relations = F.array().cast("array<struct<name:string,role:string,interface:string>>")
    u = units(spark, sf_dir).withColumns({"secret_like_config": like, "secret_typed_config": typed, "relations": no_relations, "has_integration_tests": F.lit(False)})
    own = u.select("slug", F.lit("ops.secrets").alias("feature"), F.lit(False).alias("present"), F.lit(None).cast("string").alias("score"), F.lit(None).cast("string").alias("rationale"))
    return scoring.scored(own, u).select("slug", "score", "rationale")


@query("select 'h' || c_custkey as slug, c_custkey % 6 = 2 as is_reactive, c_custkey % 6 in (0, 4, 5) as is_legacy_classic, c_custkey % 6 in (0, 1, 5) as is_workload_less from customer")
def unit_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = {0: ["hooks/install"], 1: ["hooks/install", "src/charm.py"], 2: ["hooks/install", "layer.yaml", "reactive/x.py"], 3: ["src/charm.py", "deep/my-layer-1.yaml"], 4: ["hooks/start", "layer.yaml"], 5: ["hooks/start", "reactive/x.py"]}
    k = F.col("c_custkey")
    some = F.coalesce(*(F.when(k % 6 == n, F.array(*map(F.lit, ["metadata.yaml", *ps]))) for n, ps in paths.items()))
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("h"), k.cast("string")).alias("slug"), F.explode(some).alias("path")).withColumn("text", F.when(F.col("path") == "metadata.yaml", "name: h\n"))
    return metadata.unit_facts(files, extract.yaml_docs(files)).select("slug", "is_reactive", "is_legacy_classic", "is_workload_less")
