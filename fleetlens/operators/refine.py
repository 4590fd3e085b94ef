"""Refinement by an external model: candidates, cache, cap and budget, validation of answers, calibration.

Columns and queries; ``refinement`` puts them together and calls the model.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
ELIGIBLE = ("ops.secrets", "ops.collect-status", "ops.pebble-custom-notice", "ops.relation-app-data", "pebble.checks")
VERDICTS = ("clear-gap", "worth-considering")
LONGEST, TTL_DAYS, MOST_CALLS, MOST_USD = 200, 30, 200, 5.0
TOKENS_IN, TOKENS_OUT = 950, 80


def eligible(facts: DataFrame, units: DataFrame, features: tuple[str, ...] = ELIGIBLE) -> DataFrame:
    rows = facts.where(F.col("feature").isin(*features) & ~F.col("present") & (F.col("score") == "worth-considering"))
    rows = rows.join(units.select("slug", "unit_ord", "architecture", "repo_url", "repo_sha"), "slug")
    return rows.where(~((F.col("feature") == "ops.secrets") & F.array_contains("architecture", "shim")))


def prompt_version(prompt: Column, model: Column) -> Column:
    return F.substring(F.sha2(F.concat(prompt, F.lit("\0"), model), 256), 1, 12)


def cache_key(url: Column, sha: Column, feature: Column, scanner: Column, prompt: Column) -> Column:
    """Null without a commit, so that such rows neither hit nor fill the cache."""
    return F.when(F.coalesce(sha, F.lit("")) != "", F.sha2(F.concat(url, F.lit("@"), sha, F.lit(":"), feature, F.lit(":"), scanner, F.lit(":"), prompt), 256))


def with_cache(candidates: DataFrame, cache: DataFrame) -> DataFrame:
    """``hit`` and the kept verdict by key."""
    kept = cache.select("key", F.col("verdict").alias("cached_verdict"), F.col("rationale").alias("cached_rationale"))
    return candidates.join(kept, "key", "left").withColumn("hit", F.col("cached_verdict").isNotNull())


def capped(rows: DataFrame, order: list[str], calls: Column, most: int) -> DataFrame:
    """Rows before the cap stops: fewer than ``most`` calls were made before them. Hits after the stop are left out too.

    A running count over all rows would be one task's; counts of ranges and then within ranges are many.
    """
    spread = rows.withColumn("call", calls.cast("int")).repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    from fleetlens.plans.staging import staged

    spread = staged(spread)
    totals = spread.groupBy("part").agg(F.sum("call").alias("n"))
    before = totals.alias("a").join(totals.alias("b"), F.col("b.part") < F.col("a.part"), "left").groupBy(F.col("a.part").alias("part")).agg(F.coalesce(F.sum("b.n"), F.lit(0)).alias("earlier"))
    w = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = spread.join(F.broadcast(before), "part").withColumn("made", F.col("earlier") + F.coalesce(F.sum("call").over(w), F.lit(0)))
    return out.where(F.col("made") < most).drop("call", "part", "earlier", "made")


def outcome(raw: Column, allowed: Column) -> Column:
    """ok, parse-error or invalid-path, for the answer as a whole: nothing may follow the JSON, and fields are text.

    A path that is text but isn't allowed makes any JSON object an invalid-path, whatever else is wrong with it.
    """
    # the parser stops after the first value; as the only element of a list and the only member of an object nothing can follow it
    listed, member = F.try_parse_json(F.concat(F.lit("["), raw, F.lit("]"))), F.try_parse_json(F.concat(F.lit('{"a":'), raw, F.lit("}")))
    alone = member.isNotNull() & F.try_variant_get(listed, "$[1]", "variant").isNull()
    whole = F.when(alone, F.try_variant_get(listed, "$[0]", "variant"))
    field = lambda name: F.try_variant_get(whole, f"$.{name}", "variant")
    text = lambda name: F.when(F.schema_of_variant(field(name)) == "STRING", F.try_variant_get(whole, f"$.{name}", "string"))
    path, kind = text("evidence_path"), F.schema_of_variant(field("evidence_path"))
    fits = F.coalesce(F.array_contains(allowed, path), F.lit(False))
    sound = whole.isNotNull() & text("verdict").isin(*VERDICTS) & F.length(text("rationale")).between(1, LONGEST) & (fits | F.coalesce(kind == "VOID", F.lit(True)))
    elsewhere = (path != "") & ~fits
    return F.when(F.coalesce(sound, F.lit(False)), "ok").when(F.coalesce(elsewhere, F.lit(False)), "invalid-path").otherwise("parse-error")


def pruned(cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Without entries older than the limit; those without a readable time stay."""
    at = F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return cache.where(at.isNull() | (at >= now - F.make_dt_interval(days=F.lit(days))))


def refined(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Facts with gaps that verdicts (slug, feature, verdict, rationale) escalate."""
    v = verdicts.where("verdict = 'clear-gap'").select("slug", "feature", F.col("rationale").alias("why"), F.lit(True).alias("up"))
    rows = facts.join(v, ["slug", "feature"], "left")
    up = F.coalesce("up", F.lit(False))
    old = F.col("ai_escalated") if "ai_escalated" in facts.columns else F.lit(False)
    return rows.withColumns({"score": F.when(up, "clear-gap").otherwise(F.col("score")), "rationale": F.when(up, F.col("why")).otherwise(F.col("rationale")), "ai_escalated": up | F.coalesce(old, F.lit(False))}).drop("why", "up")


def eligible_counts(facts: DataFrame, features: tuple[str, ...] = ELIGIBLE) -> DataFrame:
    """How many rows each eligible feature has, zeros too."""
    names = reduce(lambda a, b: a.unionByName(b), [facts.sparkSession.range(1).select(F.lit(f).alias("feature")) for f in features])
    n = facts.where(~F.col("present") & (F.col("score") == "worth-considering")).groupBy("feature").agg(F.count("*").alias("n"))
    return names.join(n, "feature", "left").select("feature", F.coalesce("n", F.lit(0)).alias("n"))


def calibrated(truth: DataFrame, facts: DataFrame, default: str = "worth-considering", bar: float = 0.9) -> DataFrame:
    """Share of human verdicts that the labels agree with; 1 if there are none."""
    rows = truth.join(facts.select("slug", "feature", "score"), ["slug", "feature"], "left")
    agree = F.col("human_verdict") == F.coalesce("score", F.lit(default))
    out = rows.agg(F.count("*").alias("total"), F.count_if(agree).alias("agreed"))
    return out.withColumn("agreement", F.when(F.col("total") > 0, F.col("agreed") / F.col("total")).otherwise(1.0)).withColumn("passed", F.col("agreement") >= bar)
