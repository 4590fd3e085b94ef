"""Facts of each unit from its metadata files and its tree, by aggregates over ``files`` and ``yaml_docs`` of ``extract``.

All files named charmcraft.yaml come before those named metadata.yaml, by path within; "first" is by that order. Documents
that aren't mappings don't count. A unit without metadata has empty lists, false flags and no name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import version_key
from fleetlens.sources.tree import METADATA, folders, in_scope, is_metadata, parts

#: Values of maps stay JSON text: one that isn't a mapping must not spoil its neighbours.
_RELATIONS = "map<string,string>"
DOC = f"name string, subordinate string, containers map<string,string>, provides {_RELATIONS}, requires {_RELATIONS}, peers {_RELATIONS}, config struct<options:map<string,string>>, parts map<string,string>, base string, `build-base` string, bases array<string>, assumes string"
ROLES = ("provides", "requires", "peers")
#: An option that looks like a secret, a version that is asked for, a layer that is made in code.
SECRET = "(?i)(password|token|secret|api[-_]?key)$"
JUJU = r"(?i)juju\s*[>=]*\s*(\d+(?:\.\d+)*)"
LAYER = r"\bpebble\.Layer(Dict)?\s*\("
TOOLS = {"tox": ("tox.ini",), "make": ("Makefile", "makefile"), "just": ("justfile", "Justfile")}
_NONE = "array<string>"


def described(docs: DataFrame) -> DataFrame:
    """``slug, path, rank, d, declared``: metadata files that hold one document, a mapping; ``declared`` is its name, if that is text."""
    rows = docs.where(is_metadata(F.col("path")) & (F.col("docs") == 1) & F.col("json").startswith("{"))
    named = F.try_variant_get(F.try_parse_json("json"), "$.name", "variant")
    rank = F.struct(F.array_position(F.array(*map(F.lit, METADATA)), F.element_at(parts(F.col("path")), -1)).alias("of"), F.col("path").alias("at"))
    return rows.select("slug", "path", rank.alias("rank"), F.from_json("json", DOC).alias("d"), F.when(F.schema_of_variant(named) == "STRING", named.cast("string")).alias("declared"))


def relations(own: DataFrame) -> DataFrame:
    """``slug, path, rank, ord, name, role, interface, optional``; a relation without a mapping has the interface ''."""
    of = lambda k, role: F.transform(F.map_entries(F.coalesce(F.col(f"d.{role}"), F.create_map().cast(_RELATIONS))), lambda e, i: F.struct((i + 1000000 * k).alias("ord"), e["key"].alias("name"), F.lit(role).alias("role"), F.coalesce(F.get_json_object(e["value"], "$.interface"), F.lit("")).alias("interface"), (F.lower(F.coalesce(F.get_json_object(e["value"], "$.optional"), F.lit(""))) == "true").alias("optional")))
    return own.select("slug", "path", "rank", F.explode(F.concat(*(of(k, r) for k, r in enumerate(ROLES)))).alias("r")).select("slug", "path", "rank", "r.*")


def _in_order(values: Column) -> Column:
    """Distinct values of lists of all files, in the files' order."""
    lists = F.array_sort(F.collect_list(F.struct(F.col("rank"), F.coalesce(values, F.array().cast(_NONE)).alias("v"))))
    return F.array_distinct(F.flatten(F.transform(lists, lambda x: x["v"])))


def _base(b: Column) -> Column:
    """A base as text, or a mapping as name@channel; of run-on bases the first."""
    name, channel = F.coalesce(F.get_json_object(b, "$.name"), F.get_json_object(b, "$['run-on'][0].name")), F.coalesce(F.get_json_object(b, "$.channel"), F.get_json_object(b, "$['run-on'][0].channel"))
    return F.when(b.startswith("{"), F.concat_ws("@", name, channel)).otherwise(b)


def from_documents(own: DataFrame) -> DataFrame:
    """Of ``described`` documents."""
    options = F.coalesce(F.col("d.config.options"), F.create_map().cast(_RELATIONS))
    of_type = F.transform(F.filter(F.map_entries(options), lambda e: F.get_json_object(e["value"], "$.type") == "secret"), lambda e: e["key"])
    plugins = F.filter(F.transform(F.map_values(F.coalesce("d.parts", F.create_map().cast(_RELATIONS))), lambda p: F.get_json_object(p, "$.plugin")), lambda p: p.isNotNull())
    bases = F.filter(F.concat(F.array("d.base", "d.`build-base`"), F.transform(F.coalesce("d.bases", F.array().cast(_NONE)), _base)), lambda b: F.coalesce(b, F.lit("")) != "")
    versions = F.regexp_extract_all(F.coalesce("d.assumes", F.lit("")), F.lit(JUJU), F.lit(1))
    least = F.array_min(F.transform(versions, lambda v: F.struct(version_key(v).alias("k"), v.alias("v"))))["v"]
    return own.groupBy("slug").agg(
        F.bool_or(F.size(F.coalesce("d.containers", F.create_map().cast("map<string,string>"))) > 0).alias("has_containers"),
        F.bool_or(F.coalesce(F.lower(F.trim("d.subordinate")) == "true", F.lit(False))).alias("is_subordinate"),
        _in_order(F.map_keys(options)).alias("config_keys"), _in_order(of_type).alias("secret_typed_config"),
        F.min_by("declared", F.when(F.col("declared").isNotNull(), F.col("rank"))).alias("charm_name"),
        _in_order(plugins).alias("charmcraft_plugins"), _in_order(bases).alias("bases"), F.min_by(least, F.when(least.isNotNull(), F.col("rank"))).alias("min_juju_version"),
    ).withColumn("secret_like_config", F.filter("config_keys", lambda k: k.rlike(SECRET)))


def from_tree(files: DataFrame) -> DataFrame:
    """Flags and lists that follow from paths, and from the text of source files."""
    path, p = F.col("path"), parts(F.col("path"))
    at = lambda *names: F.bool_or(path.isin(*names))
    layer = (in_scope(path, "any") & path.startswith("src/") & F.coalesce(F.col("text").rlike(LAYER), F.lit(False))) | (F.lower(F.element_at(p, -1)).rlike(r"layer.*\.yaml$") & ~F.exists(folders(path), lambda d: d.isin("tests", "test", "lib", ".git")))
    library = F.when(path.startswith("lib/charms/") & (F.size(p) > 3), p[2])
    out = files.groupBy("slug").agg(
        F.bool_or(path.rlike(r"^tests/integration/.*\.py$")).alias("has_integration_tests"), at("layer.yaml", "osci.yaml").alias("layered"), F.bool_or(path.rlike(r"^(src/)?reactive/.*\.py$")).alias("reactive"),
        F.bool_or(path.startswith("hooks/")).alias("hooked"), at("src/charm.py").alias("modern"), F.array_sort(F.collect_set(library)).alias("library_names"), F.bool_or(layer).alias("has_layer"),
        F.bool_or(path.startswith("terraform/") | path.rlike(r"^[^/]*\.tf$")).alias("has_terraform_module"), *(at(*names).alias(f"tool_{t}") for t, names in TOOLS.items()),
    )
    is_reactive = F.col("layered") & F.col("reactive")
    tooling = F.array_compact(F.array(*(F.when(F.col(f"tool_{t}"), t) for t in TOOLS)))
    return out.select("slug", "has_integration_tests", is_reactive.alias("is_reactive"), (F.col("hooked") & ~F.col("modern") & ~is_reactive).alias("is_legacy_classic"), "library_names", F.size("library_names").alias("library_count"), "has_layer", "has_terraform_module", tooling.alias("tooling"))


def unit_facts(files: DataFrame, docs: DataFrame) -> DataFrame:
    """One row for each unit of ``files``: both of the above, its relations, and what follows from all of these."""
    own = described(docs)
    return facts_from(files, own, relations(own))


def facts_from(files: DataFrame, own: DataFrame, rel: DataFrame) -> DataFrame:
    """``unit_facts``, given ``described`` documents and their ``relations``, which others may read too."""
    rel = rel.groupBy("slug", "name", "role").agg(F.min(F.struct("rank", "ord", "interface")).alias("x"))
    rel = rel.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("x.rank", "x.ord", "name", "role", "x.interface"))).alias("rs"))
    rel = rel.select("slug", F.transform("rs", lambda r: F.struct(r["name"].alias("name"), r["role"].alias("role"), r["interface"].alias("interface"))).alias("relations"))
    out = from_tree(files).join(from_documents(own), "slug", "left").join(rel, "slug", "left")
    flags, lists = ("has_containers", "is_subordinate"), ("config_keys", "secret_typed_config", "secret_like_config", "charmcraft_plugins", "bases")
    out = out.withColumns({c: F.coalesce(c, F.lit(False)) for c in flags} | {c: F.coalesce(c, F.array().cast(_NONE)) for c in lists})
    out = out.withColumn("relations", F.coalesce("relations", F.array().cast("array<struct<name:string,role:string,interface:string>>")))
    machine = F.exists("relations", lambda r: (r["role"] == "requires") & (r["interface"] == "juju-info"))
    own = F.coalesce(F.array_contains("library_names", F.replace("charm_name", F.lit("-"), F.lit("_"))), F.lit(False))
    return out.withColumns({"provides_own_library": own, "is_workload_less": ~F.col("has_containers") & ~F.col("has_layer") & ~machine}).drop("has_layer")
