"""Analytic views of one scan: features, units, teams, summary, facets, evidence.

``units``: unit_ord, slug, name, team, repo_url, subpath, repo_sha, architecture array, has_containers, is_reactive,
is_legacy_classic, provides_own_library, has_terraform_module, tooling / charmcraft_plugins / bases arrays.
``facts``: slug, feature, feature_ord, present, score, rationale, ai_escalated, evidence array.
``features``: feature_ord, feature, library, summary, expected_rare.
Ties are broken by the order columns, which stand for the order of the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import ARCH_ORDER, floor_percent, permalink, primary_architecture, round1

LOW_COUNT = 5
GAP, WORTH, NA = "clear-gap", "worth-considering", "not-applicable"
NO_TEAM = "(no team)"


def with_architecture(units: DataFrame) -> DataFrame:
    """``arch``, by name; where names repeat the last unit wins."""
    own = units.select("name", F.struct("unit_ord", primary_architecture(F.col("architecture"), F.col("is_reactive"), F.col("is_legacy_classic")).alias("arch")).alias("x"))
    by_name = own.groupBy("name").agg(F.max("x").alias("x")).select("name", F.col("x.arch").alias("arch"))
    by_name = by_name.withColumnRenamed("name", "of_name")
    return units.join(by_name, F.col("name").eqNullSafe(F.col("of_name"))).drop("of_name")


def grid(units: DataFrame, facts: DataFrame, features: DataFrame) -> DataFrame:
    """Every unit with every feature; a missing record is absent and not applicable."""
    every = units.select("unit_ord", "slug", "name").crossJoin(features.select("feature", "feature_ord"))
    rows = every.join(facts.select("slug", "feature", "present", "score", *[c for c in ("rationale", "ai_escalated", "evidence") if c in facts.columns]), ["slug", "feature"], "left")
    return rows.withColumn("present", F.coalesce("present", F.lit(False))).withColumn("score", F.when(~F.col("present"), F.coalesce("score", F.lit(NA))))


def feature_view(units: DataFrame, facts: DataFrame, features: DataFrame) -> DataFrame:
    ai = F.coalesce(F.col("ai_escalated"), F.lit(False)) if "ai_escalated" in facts.columns else F.lit(False)
    is_gap = F.col("score") == GAP
    out = grid(units, facts, features).groupBy("feature", "feature_ord").agg(
        F.count_if("present").alias("present"), F.count_if(is_gap).alias("clear_gap"), F.count_if(is_gap & ai).alias("clear_gap_ai"),
        F.count_if(F.col("score") == WORTH).alias("worth"), F.count_if(F.col("score") == NA).alias("na"),
    )
    out = out.join(features.select("feature", "expected_rare"), "feature")
    return out.withColumn("low_count", (F.col("present") < LOW_COUNT) & ~F.col("expected_rare"))


def feature_by_architecture(units: DataFrame, facts: DataFrame, features: DataFrame) -> DataFrame:
    """Share of units with a feature in each architecture; none for units that the scanner can't read."""
    of = with_architecture(units).select("slug", "arch")
    out = grid(units, facts, features).join(of, "slug").groupBy("feature", "arch").agg(F.count_if("present").alias("present"), F.count("*").alias("total"))
    pct = F.when(~F.col("arch").isin("reactive", "legacy-classic"), floor_percent(F.col("present"), F.col("total")))
    return out.withColumn("pct", pct).withColumn("arch_ord", F.array_position(F.array(*map(F.lit, ARCH_ORDER)), F.col("arch")).cast("int"))


def exemplars(units: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """The first units with a feature, each with a link to its first evidence."""
    w = Window.partitionBy("feature").orderBy("unit_ord")
    rows = facts.where("present").join(units, "slug").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    if "evidence" not in facts.columns:
        return rows.select("feature", "n", "slug", F.col("repo_url").alias("link"))
    first = F.get("evidence", F.lit(0))
    return rows.select("feature", "n", "slug", permalink(F.col("repo_url"), F.col("repo_sha"), F.col("subpath"), first["file"], first["line"]).alias("link"))


def unit_view(units: DataFrame, facts: DataFrame) -> DataFrame:
    """Counts and ordered lists for each unit."""
    ai = F.coalesce(F.col("ai_escalated"), F.lit(False)) if "ai_escalated" in facts.columns else F.lit(False)
    absent = ~F.col("present")
    ordered = lambda test: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("feature_ord", "feature")))), lambda x: x["feature"])
    gap = absent & (F.col("score") == GAP)
    counts = facts.groupBy("slug").agg(
        F.count_if("present").alias("present"), F.count_if(gap).alias("clear_gap"), F.count_if(gap & ai).alias("clear_gap_ai"), F.count_if(absent & (F.col("score") == WORTH)).alias("worth"),
        ordered(F.col("present")).alias("present_features"), ordered(gap).alias("gap_features"),
    )
    none = F.array().cast("array<string>")
    out = units.join(counts, "slug", "left")
    return out.select("unit_ord", "slug", "name", "team", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("present", "clear_gap", "clear_gap_ai", "worth")), *(F.coalesce(c, none).alias(c) for c in ("present_features", "gap_features")))


def unit_labels(units: DataFrame) -> DataFrame:
    """``slug, flags, arch_labels, stack, search``: what the page shows and searches. ``units`` may lack some of the facts."""
    there = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in units.columns else F.lit(False)
    some = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in units.columns else F.array().cast("array<string>")
    flags = F.array_compact(F.array(*(F.when(there(c), name) for c, name in (("provides_own_library", "lib-provider"), ("is_subordinate", "subordinate"), ("is_workload_less", "workload-less"), ("has_terraform_module", "terraform")))))
    labels = F.when(there("is_reactive"), F.array(F.lit("reactive"))).when(there("is_legacy_classic"), F.array(F.lit("legacy-classic"))).when(F.size(some("architecture")) > 0, some("architecture")).otherwise(F.array(F.lit(ARCH_ORDER[-1])))
    version = F.coalesce(F.col("min_juju_version"), F.lit("")) if "min_juju_version" in units.columns else F.lit("")
    ends = F.array(F.when(version != "", F.concat(F.lit("juju "), version)).otherwise(""), F.when(there("has_terraform_module"), "terraform").otherwise(""))
    stack = F.trim(F.array_join(F.concat(F.array(F.when(there("has_containers"), "k8s").otherwise("machine")), some("charmcraft_plugins"), some("bases"), some("tooling"), ends), " "))
    blob = F.lower(F.concat_ws(" ", "name", "team", F.array_join(labels, " "), stack, F.array_join(flags, " ")))
    return units.select("slug", flags.alias("flags"), labels.alias("arch_labels"), stack.alias("stack"), blob.alias("search"))


def unit_gaps(facts: DataFrame) -> DataFrame:
    """``slug, gaps``: the gaps of each unit in the order of the catalogue, with rationale and whether a model escalated them."""
    ai = F.coalesce(F.col("ai_escalated"), F.lit(False)) if "ai_escalated" in facts.columns else F.lit(False)
    rows = facts.where(~F.col("present") & (F.col("score") == GAP)).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("feature_ord", "feature", F.coalesce("rationale", F.lit("")).alias("rationale"), ai.alias("ai_escalated")))).alias("gs"))
    return rows.select("slug", F.transform("gs", lambda g: F.struct(g["feature"].alias("feature"), g["rationale"].alias("rationale"), g["ai_escalated"].alias("ai_escalated"))).alias("gaps"))


def _team(c: Column) -> Column:
    return F.when(F.coalesce(c, F.lit("")) == "", NO_TEAM).otherwise(c)


def team_rollup(units: DataFrame, facts: DataFrame) -> DataFrame:
    per_unit = unit_view(units, facts)
    out = per_unit.withColumn("team", _team(F.col("team"))).groupBy("team").agg(
        F.count("*").alias("units"), F.sum("present").alias("present"), F.sum("clear_gap").alias("clear_gap"), F.sum("worth").alias("worth"), F.min("unit_ord").alias("first_ord")
    )
    return out.withColumn("avg_gap", round1(F.col("clear_gap") / F.col("units")))


def team_top_gaps(units: DataFrame, facts: DataFrame, most: int = 5) -> DataFrame:
    """The features that most units of a team lack; ties in the order of the catalogue."""
    gaps = facts.where(~F.col("present") & (F.col("score") == GAP)).join(units.select("slug", _team(F.col("team")).alias("team")), "slug")
    n = gaps.groupBy("team", "feature", "feature_ord").agg(F.count("*").alias("n"))
    w = Window.partitionBy("team").orderBy(F.desc("n"), "feature_ord")
    return n.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).drop("feature_ord")


def team_architectures(units: DataFrame) -> DataFrame:
    """How many units of each team have which first label (of the catalogue's order, unlike the priority elsewhere)."""
    first = F.when(F.col("is_reactive"), "reactive").when(F.col("is_legacy_classic"), "legacy-classic").otherwise(F.coalesce(F.get("architecture", F.lit(0)), F.lit(ARCH_ORDER[-1])))
    return units.select(_team(F.col("team")).alias("team"), first.alias("arch")).groupBy("team", "arch").agg(F.count("*").alias("n"))


def summary(units: DataFrame) -> DataFrame:
    """``axis, label, n``: totals, and for each array a unit once for each distinct label, in one pass."""
    flag = lambda c, label: F.when(c, F.struct(F.lit("total").alias("axis"), F.lit(label).alias("label")))
    labels = lambda col, axis: F.transform(F.array_distinct(F.coalesce(F.col(col), F.array().cast("array<string>"))), lambda x: F.struct(F.lit(axis).alias("axis"), x.alias("label")))
    flags = F.array(flag(F.lit(True), "units"), *(flag(F.coalesce(F.col(c), F.lit(False)), n) for c, n in (("has_containers", "k8s"), ("is_reactive", "reactive"), ("is_legacy_classic", "legacy"), ("provides_own_library", "own-library"), ("has_terraform_module", "terraform"))), flag(~F.coalesce(F.col("has_containers"), F.lit(False)), "machine"))
    every = F.concat(F.array_compact(flags), labels("architecture", "architecture"), labels("tooling", "tooling"), labels("charmcraft_plugins", "plugin"), labels("bases", "base"))
    return units.select(F.explode(every).alias("x")).groupBy("x.axis", "x.label").agg(F.count("*").alias("n"))


def facets(units: DataFrame, features: DataFrame) -> DataFrame:
    """``facet, value, n, place``: what the page offers to filter by; architectures also where none has them."""
    teams = units.where(F.coalesce("team", F.lit("")) != "").groupBy(F.col("team").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("team")).withColumn("key", F.lower("value"))
    libs = features.groupBy(F.col("library").alias("value")).agg(F.count("*").alias("n")).withColumn("facet", F.lit("library")).withColumn("key", F.col("value"))
    tools = units.select(F.explode("tooling").alias("value")).groupBy("value").agg(F.count("*").alias("n")).withColumn("facet", F.lit("tooling")).withColumn("key", F.col("value"))
    spark = units.sparkSession
    taxonomy = spark.createDataFrame([(a, f"{i:02d}") for i, a in enumerate(ARCH_ORDER)], "value string, key string")
    arch = taxonomy.join(with_architecture(units).groupBy(F.col("arch").alias("value")).agg(F.count("*").alias("n")), "value", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("facet", F.lit("architecture"))
    out = teams.unionByName(libs).unionByName(tools).unionByName(arch)
    return out.withColumn("place", F.row_number().over(Window.partitionBy("facet").orderBy("key", "value"))).drop("key")


def evidence_log(facts: DataFrame) -> DataFrame:
    """Every scored record other than not applicable, whether present or not."""
    return facts.where(F.col("score").isin(GAP, WORTH)).select("slug", "feature", "score", "rationale")
