"""Labels of absent features by ordered rules, the note on a discouraged present one, and overrides.

One ``when`` chain: the first rule that holds decides. ``facts`` joined with ``units`` has: feature, present, architecture,
is_reactive, is_legacy_classic, has_containers, relations (array of name, role, interface), secret_like_config,
secret_typed_config, has_integration_tests; ``status_set`` tells whether the unit sets its status directly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GAP, WORTH, NA = "clear-gap", "worth-considering", "not-applicable"
#: Architectures that leave no event handlers to look at, in this order; fixed values.
SUPPRESSING = ("component-graph", "reconcile-all", "reconcile", "unconditional-init")
#: Features whose evidence is an event handler; fixed values.
BY_EVENT = ("ops.pebble-ready", "ops.collect-status")


def _label(score: str, why: str | Column) -> Column:
    return F.struct(F.lit(score).alias("score"), (F.lit(why) if isinstance(why, str) else why).alias("rationale"))


def _few(names: Column) -> Column:
    """The first three in order, and dots if there are more."""
    some = F.array_join(F.slice(F.array_sort(F.array_distinct(names)), 1, 3), ", ")
    return F.concat(some, F.when(F.size(F.array_distinct(names)) > 3, ", …").otherwise(""))


def absent_label() -> Column:
    """struct<score, rationale> of an absent feature."""
    feature = F.col("feature")
    arch = F.coalesce(F.col("architecture"), F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    like, typed = F.coalesce(F.col("secret_like_config"), none), F.coalesce(F.col("secret_typed_config"), none)
    total = F.coalesce(F.size("relations"), F.lit(0))
    own = F.coalesce(F.size(F.filter("relations", lambda r: r["role"] != "peers")), F.lit(0))
    out = F.when(F.col("is_reactive"), _label(NA, "the unit is reactive")).when(F.col("is_legacy_classic"), _label(NA, "the unit is a classic one of hooks"))
    for a in SUPPRESSING:
        out = out.when(feature.isin(*BY_EVENT) & F.array_contains(arch, a), _label(NA, f"handlers are shared: {a}"))
    containers = F.coalesce(F.col("has_containers"), F.lit(False))
    for name, score in (("pebble.checks", WORTH), ("ops.pebble-custom-notice", WORTH), ("ops.pebble-ready", GAP)):
        out = out.when((feature == name) & containers, _label(score, "it has workload containers")).when(feature == name, _label(NA, "no workload containers"))
    shared = feature == "ops.relation-app-data"
    out = out.when(shared & (own > 0), _label(WORTH, F.concat(own.cast("string"), F.lit(" relations could share application data")))).when(shared, _label(NA, "no relations but peers"))
    status = feature == "ops.collect-status"
    out = out.when(status & F.coalesce(F.col("status_set"), F.lit(False)), _label(GAP, "it sets its status directly")).when(status & (total > 0), _label(GAP, "its status depends on relations")).when(status, _label(WORTH, "it has no relations"))
    secrets = feature == "ops.secrets"
    rest = F.array_except(like, typed)
    out = out.when(secrets & (F.size(like) > 0) & (F.size(rest) == 0), _label(NA, "all such options are secrets already"))
    out = out.when(secrets & (F.size(like) > 0) & (F.size(typed) > 0), _label(WORTH, F.concat(F.lit("some options are not secrets yet: "), _few(rest))))
    out = out.when(secrets & (F.size(like) > 0), _label(GAP, F.concat(F.lit("options look like secrets: "), _few(like)))).when(secrets, _label(NA, "no option looks like a secret"))
    tests = feature == "jubilant.integration-tests"
    out = out.when(tests & F.coalesce(F.col("has_integration_tests"), F.lit(False)), _label(WORTH, "it has integration tests")).when(tests, _label(NA, "no integration tests"))
    out = out.when(feature == "ops.stored-state", _label(NA, "its absence is desirable"))
    return out.otherwise(_label(NA, "no rule for this feature"))


def scored(facts: DataFrame, units: DataFrame) -> DataFrame:
    """Facts with new labels; those of present ones go, but for the discouraged one."""
    status = facts.where((F.col("feature") == "ops.status-set-directly") & F.col("present")).select("slug", F.lit(True).alias("status_set")).distinct()
    meta = [c for c in units.columns if c == "slug" or c not in facts.columns]
    rows = facts.drop("score", "rationale").join(units.select(*meta), "slug").join(status, "slug", "left")
    note = F.when(F.col("feature") == "ops.stored-state", _label(WORTH, "stored state is discouraged"))
    label = F.when(F.col("present"), note).otherwise(absent_label())
    keep = [c for c in facts.columns if c not in ("score", "rationale")]
    return rows.withColumn("label", label).select(*keep, F.col("label.score").alias("score"), F.col("label.rationale").alias("rationale"))


def exclude_features(facts: DataFrame, units: DataFrame, overrides: DataFrame) -> DataFrame:
    """``overrides``: url, sub_path, feature, reason. Sets the label whether the feature is present or not; an empty reason does nothing."""
    where = units.select("slug", F.col("repo_url").alias("url"), F.coalesce("subpath", F.lit("")).alias("sub_path"))
    rows = facts.join(where, "slug", "left").join(overrides, ["url", "sub_path", "feature"], "left")
    hit = F.coalesce(F.col("reason"), F.lit("")) != ""
    return rows.withColumn("score", F.when(hit, NA).otherwise(F.col("score"))).withColumn("rationale", F.when(hit, F.col("reason")).otherwise(F.col("rationale"))).select(*facts.columns)
