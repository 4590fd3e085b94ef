"""Facts of units from metadata files and trees."""

from fleetlens.operators import extract, metadata

MAIN = """
name: my-app
subordinate: "True"
containers: {web: {}}
requires: {db: {interface: mysql, optional: true}, odd: text}
peers: {p: {interface: own}}
config: {options: {a-password: {type: secret}, api-key: {type: string}, port: {type: int}}}
parts: {x: {plugin: uv}, y: {plugin: uv}}
bases: [{name: ubuntu, channel: "22.04"}]
assumes: [juju >= 3.10, {any-of: [juju >= 3.9]}]
"""


def test_facts(spark):
    tree = {"charmcraft.yaml": MAIN, "metadata.yaml": "name: other\nrequires: {db: {interface: pg}}", "lib/charms/my_app/v0/l.py": "", "tests/integration/t.py": "", "tox.ini": "", "Makefile": None, "main.tf": None, "hooks/start": None}
    rows = [("u", p, t) for p, t in tree.items()] + [("v", "src/charm.py", "pebble.Layer({})"), ("w", "metadata.yaml", "[broken")]
    files = spark.createDataFrame(rows, "slug string, path string, text string")
    got = {r.slug: r for r in metadata.unit_facts(files, extract.yaml_docs(files)).collect()}
    u, v, w = got["u"], got["v"], got["w"]
    assert (u.charm_name, u.has_containers, u.is_subordinate, u.min_juju_version, u.provides_own_library) == ("my-app", True, True, "3.9", True)
    assert [tuple(r) for r in u.relations] == [("db", "requires", "mysql"), ("odd", "requires", ""), ("p", "peers", "own")]
    assert u.config_keys == ["a-password", "api-key", "port"] and u.secret_typed_config == ["a-password"] and u.secret_like_config == ["a-password", "api-key"]
    assert u.charmcraft_plugins == ["uv"] and u.bases == ["ubuntu@22.04"] and u.tooling == ["tox", "make"] and u.has_terraform_module and u.has_integration_tests and u.is_legacy_classic
    assert not v.is_workload_less and v.charm_name is None and w.is_workload_less and w.relations == []
    assert metadata.unit_facts(files.limit(0), extract.yaml_docs(files.limit(0))).count() == 0
