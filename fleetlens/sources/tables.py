"""Corpus, override and result files as tables, and results written back."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import name_from_url, slug, strip_all
from fleetlens.operators.filters import not_reserved
from fleetlens.plans.staging import numbered, staged

#: Column of the corpus file by field; fixed values.
CORPUS = {"team": "Team", "name": "Charm Name", "repo_url": "Repository", "branch": "Branch (if not the default)", "key_charm": "Key Charm for this Team", "notes": "Notes"}
#: Reason of an override that gives none; fixed value.
DEFAULT_REASON = "excluded by corpus-overrides.yaml"
#: All facts of a unit, by type; those that a record lacks are false, empty, 0 or null.
FLAGS = ("has_containers", "has_integration_tests", "is_reactive", "is_legacy_classic", "is_subordinate", "is_workload_less", "provides_own_library", "has_terraform_module")
LISTS = ("architecture", "config_keys", "secret_like_config", "secret_typed_config", "charmcraft_plugins", "bases", "library_names", "tooling")
META = ", ".join([*(f"{c} boolean" for c in FLAGS), *(f"{c} array<string>" for c in LISTS), "relations array<struct<name:string,role:string,interface:string>>", "charm_name string", "min_juju_version string", "repo_sha string", "library_count int"])
RECORD = "present boolean, score string, rationale string, ai_escalated boolean, evidence array<struct<file:string,line:int,detector_kind:string,snippet:string>>"


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """``ord, team, name, repo_url, branch, key_charm, notes, slug``; rows without a repository go, missing columns are null.

    The order of rows is the file's: it is one file, read as a whole by one task.
    """
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    cell = lambda f: strip_all(F.coalesce(F.col(f"`{CORPUS[f]}`"), F.lit(""))) if CORPUS[f] in raw.columns else F.lit("")
    rows = raw.select(F.monotonically_increasing_id().alias("ord"), *(cell(f).alias(f) for f in CORPUS)).where("repo_url <> ''")
    rows = rows.withColumn("name", F.when(F.col("name") == "", name_from_url(F.col("repo_url"))).otherwise(F.col("name")))
    return rows.withColumns({"branch": F.nullif("branch", F.lit("")), "key_charm": F.upper("key_charm") == "TRUE", "slug": slug(F.col("repo_url"))})


def overrides(spark: SparkSession, path: str | None) -> dict[str, DataFrame]:
    """``exclude, branch, sub, feature`` of a YAML file of configuration; no file, no rows. Entries without their keys go.

    Of a repeated key the last wins.
    """
    import os

    import yaml

    doc: dict = {}
    if path and os.path.exists(path):
        with open(path, encoding="utf-8") as f:
            doc = yaml.safe_load(f) or {}
    entries = lambda key: [e for e in doc.get(key) or [] if isinstance(e, dict) and e.get("url")]
    why = lambda e: str(e.get("reason", DEFAULT_REASON))
    exclude = {e["url"]: why(e) for e in entries("exclude")}
    branch = {e["url"]: str(e["branch"]) for e in entries("branch_overrides") if e.get("branch")}
    sub = {(e["url"], str(s)): why(e) for e in entries("sub_charm_excludes") for s in e.get("sub_paths") or []}
    feature = {(e["url"], str(e.get("sub_path") or ""), str(f)): why(e) for e in entries("feature_excludes") for f in e.get("features") or []}
    return {
        "exclude": spark.createDataFrame(list(exclude.items()), "url string, reason string"),
        "branch": spark.createDataFrame(list(branch.items()), "url string, branch string"),
        "sub": spark.createDataFrame([(*k, v) for k, v in sub.items()], "url string, sub_path string, reason string"),
        "feature": spark.createDataFrame([(*k, v) for k, v in feature.items()], "url string, sub_path string, feature string, reason string"),
    }


def _entries(text: Column, value: str = "string") -> Column:
    return F.map_entries(F.from_json(text, f"map<string,{value}>"))


def results(spark: SparkSession, path: str, date_from_name: bool = False) -> tuple[DataFrame, DataFrame]:
    """``units`` and ``facts`` of result files; with dated names (scored-2024-01-01.json) both have ``date``.

    Key order is that of the file; keys that begin with two underscores are no units or features.
    """
    date = F.regexp_extract(F.input_file_name(), r"scored-(\d{4}-\d{2}-\d{2})\.json", 1)
    raw = spark.read.text(path, wholetext=True).select("value", *[date.alias("date")] * date_from_name)
    if date_from_name:
        raw = raw.where("date <> ''")
    keys = ["date"] * date_from_name
    unit = raw.select(*keys, F.posexplode(_entries("value")).alias("unit_ord", "u")).where(not_reserved(F.col("u.key")))
    of = F.from_json("u.value", "name string, team string, repo_url string, subpath string, features map<string,string>")
    unit = unit.select(*keys, "unit_ord", F.col("u.key").alias("slug"), of.alias("r"))
    meta = F.from_json(F.try_element_at("r.features", F.lit("__meta__")), META)
    units = unit.select(*keys, "unit_ord", "slug", "r.name", "r.team", "r.repo_url", "r.subpath", meta.alias("meta")).select(*keys, "unit_ord", "slug", "name", "team", "repo_url", "subpath", *(_fact(c) for c in (*FLAGS, *LISTS, "relations", "charm_name", "min_juju_version", "repo_sha", "library_count")))
    facts = unit.select(*keys, "slug", F.posexplode(F.map_entries("r.features")).alias("feature_ord", "f")).where(not_reserved(F.col("f.key")))
    facts = facts.select(*keys, "slug", F.col("f.key").alias("feature"), "feature_ord", F.from_json("f.value", RECORD).alias("x")).select(*keys, "slug", "feature", "feature_ord", "x.*")
    return units, facts.withColumn("present", F.coalesce("present", F.lit(False)))


def _fact(name: str) -> Column:
    c = F.col(f"meta.{name}")
    if name in FLAGS:
        return F.coalesce(c, F.lit(False)).alias(name)
    if name in LISTS:
        return F.coalesce(c, F.array().cast("array<string>")).alias(name)
    if name == "relations":
        return F.coalesce(c, F.array().cast("array<struct<name:string,role:string,interface:string>>")).alias(name)
    return (F.coalesce(c, F.lit(0)) if name == "library_count" else c).alias(name)


def documents(units: DataFrame, facts: DataFrame) -> DataFrame:
    """``slug, record``: a JSON record for each unit, features in their order; nulls are left out."""
    record = F.struct(*(c for c in ("present", "score", "rationale", "ai_escalated", "evidence") if c in facts.columns))
    made = facts.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("feature_ord", "feature", record.alias("r")))).alias("fs"))
    of = F.map_from_entries(F.transform(F.coalesce("fs", F.array().cast(made.schema["fs"].dataType)), lambda x: F.struct(x["feature"], x["r"])))
    return units.join(made, "slug", "left").select("unit_ord", "slug", F.to_json(F.struct("name", "team", "repo_url", "subpath", of.alias("features"))).alias("record"))


def write_facts(facts: DataFrame, path: str, date: str) -> None:
    """The store: Parquet, a partition for each snapshot; writing a date again replaces it alone."""
    facts.withColumn("date", F.lit(date)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


#: Rows whose offsets are added up together.
_TOGETHER = 10_000


def write_results(units: DataFrame, facts: DataFrame, path: str, skipped: DataFrame | None = None) -> dict[str, int]:
    """One JSON file: a record for each unit in order, its facts as ``__meta__``, and ``__skipped__`` if anything was.

    Returns how many were ``scanned`` and ``skipped``, counted by the action that makes the records.

    All tasks write the one document at once: records are made and numbered in order, their sizes are added up to offsets, and
    each task writes its records at their place, so a task that runs again writes the same bytes. ``path`` lies in a folder
    that all workers see; the file has its name when it is whole. ``write_facts`` is the store for large fleets.
    """
    import json
    import os

    meta = F.to_json(F.struct(*(c for c in units.columns if c not in ("unit_ord", "slug", "name", "team", "repo_url", "subpath")))).alias("meta")
    rows = documents(units, facts).join(units.select("slug", meta), "slug").select(F.lit(0).alias("kind"), F.col("unit_ord").cast("long").alias("unit_ord"), "slug", "record", "meta")
    if skipped is not None:
        left = skipped.groupBy("slug").agg(F.max("reason").alias("record"))
        rows = rows.unionByName(left.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("unit_ord"), "slug", "record", F.lit(None).cast("string").alias("meta")))
    placed, total = numbered(rows, "kind", "unit_ord", "slug")
    n_units = units.count()

    def bodies(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for place, kind, slug_, record, own in zip(batch["place"], batch["kind"], batch["slug"], batch["record"], batch["meta"], strict=True):
                comma = "," if place else ""
                if kind:
                    head = f'{comma}\n"__skipped__": {{' if place == n_units else ","
                    out.append(f"{head}\n  {json.dumps(slug_)}: {json.dumps(record)}")
                else:
                    doc = json.loads(record)
                    doc["features"] = {**doc.get("features", {}), "__meta__": json.loads(own)}
                    out.append(f"{comma}\n{json.dumps(slug_)}: {json.dumps(doc, indent=2)}")
            yield pd.DataFrame({"place": batch["place"], "body": [t.encode() for t in out]})

    seen = Observation()
    placed = placed.observe(seen, F.count_if(F.col("kind") == 0).alias("scanned"), F.count_if(F.col("kind") == 1).alias("skipped"))
    made = staged(placed.mapInPandas(bodies, "place long, body binary").withColumn("part", F.floor(F.col("place") / _TOGETHER)))
    base, at = [], 1  # behind the opening bracket
    for r in made.groupBy("part").agg(F.sum(F.octet_length("body")).alias("size")).orderBy("part").collect():
        base.append((r["part"], at))
        at += r["size"]
    w = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    offsets = made.join(F.broadcast(made.sparkSession.createDataFrame(base, "part long, base long")), "part").select("body", (F.col("base") + F.coalesce(F.sum(F.octet_length("body")).over(w), F.lit(0))).alias("offset"))
    aside = f"{path}.part"
    with open(aside, "wb") as f:
        f.write(b"{")
        f.seek(at)
        f.write(b"\n}\n}\n" if total > n_units else b"\n}\n")

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with open(aside, "r+b") as f:
            for batch in batches:
                for body, offset in zip(batch["body"], batch["offset"], strict=True):
                    f.seek(offset)
                    f.write(body)
                yield pd.DataFrame({"n": [len(batch)]})

    wrote = offsets.mapInPandas(put, "n long").agg(F.sum("n")).first()[0] or 0
    if wrote != total:
        raise RuntimeError(f"{path}: {wrote} of {total} records were written")
    os.replace(aside, path)
    return dict(seen.get)


def pairs(spark: SparkSession, path: str) -> DataFrame:
    """The pairs of a pairs file."""
    of = "array<struct<root:string,k8s_name:string,machine_name:string,k8s_url:string,machine_url:string,confidence:string,same_repo:boolean,shares_charmlib:boolean>>"
    return spark.read.schema(f"pairs {of}").json(path, multiLine=True).select(F.inline("pairs"))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """``slug, feature, human_verdict`` of a file of human verdicts."""
    rows = spark.read.schema("charm_slug string, feature_id string, human_verdict string").json(path, multiLine=True)
    return rows.select(F.col("charm_slug").alias("slug"), F.col("feature_id").alias("feature"), "human_verdict")


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The cache: a JSON file for each key, or lines of JSON; entries that can't be read are left out."""
    ddl = "key string, charm_slug string, feature_id string, verdict string, rationale string, evidence_path string, model string, charm_sha string, timestamp string"
    return spark.read.schema(ddl).json(path, multiLine=True, mode="DROPMALFORMED").where("key is not null")
