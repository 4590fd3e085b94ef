"""Refinement as one call: cache, calls of a model under a call and a spend limit, escalated facts, cache entries, log.

Candidates have an order. Calls are made by executors, block by block in that order, and a block is written before the
next one is planned: it has no more calls than the call limit leaves, nor than the spend limit leaves at the highest price
of a call, so no block holds a call that a run of one call after another wouldn't make. After a block the spend that it
really had is added up, in whole units of 1e-7 USD. Where a limit is reached, everything behind the last call is left as
it is and logged as ``budget-stop``, also what the cache could have answered.

Candidates with the same cache key (units of one repository at one commit) go to the same task of a block, in order, where
the first valid answer serves those after it; in later blocks they find it among the answers. Those without a key are asked
each. A failing call counts as a call, costs nothing and is a parse error. If an executor is lost during a block, that block's
calls are made again: answers and spend count once, what the provider charged for the lost attempt isn't known here.

Nulls and edges: facts or units that are empty give empty tables; a unit without a commit neither hits nor fills the
cache; missing counts of tokens are the defaults; texts of any length pass.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from fleetlens.operators import refine
from fleetlens.plans.staging import numbered, shared_folder, staged
from fleetlens.sources import committed

#: Prompt to answer, tokens in and tokens out (null: not told); a RuntimeError is a failed call. It runs on executors.
Model = Callable[[str], tuple[str, int | None, int | None]]
#: Price of a token in units of 1e-7 USD, and units in a dollar; fixed values.
UNIT_IN, UNIT_OUT, UNITS = 8, 40, 10_000_000
ANSWERS = "place long, key string, raw string, outcome string, verdict string, rationale string, evidence_path string, units long"
ENTRIES = "key string, charm_slug string, feature_id string, verdict string, rationale string, evidence_path string, model string, charm_sha string, prompt_version string, scanner_version string, timestamp string, ttl_days int"
LOG = "charm_slug string, feature_id string, scanner_verdict string, llm_verdict string, outcome string, raw_output string, llm_rationale string, evidence_path string, timestamp string"


class Limits(NamedTuple):
    """``most_usd``: what one call can cost at most; ``block``: calls between two looks at the limits, at most."""

    calls: int = refine.MOST_CALLS
    usd: float = refine.MOST_USD
    most_usd: float = 0.01
    block: int = 10_000


class Refined(NamedTuple):
    """``facts`` with escalations; ``results``: a row for each candidate; ``entries`` for the cache; ``log``; ``counts``."""

    facts: DataFrame
    results: DataFrame
    entries: DataFrame
    log: DataFrame
    counts: dict[str, int]


def judged(raw: str, allowed: list[str] | None) -> tuple[str, str | None, str | None, str | None]:
    """Outcome (as ``refine.outcome`` has it), verdict, rationale and path of an answer; all but the outcome are null unless it is ok."""
    try:
        data = json.loads(raw)
    except (ValueError, RecursionError):
        return "parse-error", None, None, None
    if not isinstance(data, dict):
        return "parse-error", None, None, None
    verdict, why, path = data.get("verdict"), data.get("rationale"), data.get("evidence_path")
    known = path is None or (isinstance(path, str) and path in (allowed or ()))
    if isinstance(path, str) and path and not known:
        return "invalid-path", None, None, None
    if verdict not in refine.VERDICTS or not isinstance(why, str) or not 1 <= len(why) <= refine.LONGEST or not known:
        return "parse-error", None, None, None
    return "ok", verdict, why, path


def _asking(model: Model) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        served: set[str] = set()  # keys with a valid answer; all rows of a key are in this task
        for batch in batches:
            out = []
            for place, key, prompt, allowed in zip(batch["place"], batch["key"], batch["prompt"], batch["allowed"], strict=True):
                if key in served:
                    continue
                try:
                    raw, tokens_in, tokens_out = model(prompt)
                    units = UNIT_IN * (refine.TOKENS_IN if tokens_in is None else tokens_in) + UNIT_OUT * (refine.TOKENS_OUT if tokens_out is None else tokens_out)
                except RuntimeError:
                    raw, units = "", 0
                found = judged(raw, None if allowed is None else list(allowed))
                if found[0] == "ok" and isinstance(key, str):
                    served.add(key)
                out.append((place, key, raw, *found, units))
            yield pd.DataFrame(out, columns=["place", "key", "raw", "outcome", "verdict", "rationale", "evidence_path", "units"])

    return run


def _answers(asks: DataFrame, model: Model, limits: Limits, tasks: int) -> tuple[DataFrame, int | None]:
    """Answers of the calls that the limits allow, and the place of the last one if a limit was reached (-1: before the first)."""
    spark = asks.sparkSession
    queue, total = numbered(asks, "place", name="ask")
    queue = staged(queue)  # in order of ask, so a block reads its part of the files
    base, spent, calls, last, at, blocks = shared_folder(spark, "answers"), 0, 0, -1, 0, 0
    most = round(limits.usd * UNITS)
    schema = spark.createDataFrame([], ANSWERS).schema
    so_far = lambda: spark.read.schema(schema).parquet(*(f"{base}/{b}" for b in range(blocks))) if blocks else spark.createDataFrame([], schema)
    while at < total and calls < limits.calls and spent < most:
        size = min(limits.calls - calls, limits.block, max(1, (most - spent) // max(1, round(limits.most_usd * UNITS))))
        block = queue.where((F.col("ask") >= at) & (F.col("ask") < at + size))
        if blocks:
            block = block.join(so_far().where("outcome = 'ok' and key is not null").select("key"), "key", "left_anti")
        together = block.select("place", "key", "prompt", "allowed").repartition(min(tasks, size), F.coalesce("key", F.col("place").cast("string"))).sortWithinPartitions("place")
        together.mapInPandas(_asking(model), ANSWERS).write.parquet(f"{base}/{blocks}")
        got = spark.read.schema(schema).parquet(f"{base}/{blocks}").agg(F.count("*").alias("n"), F.sum("units").alias("units"), F.max("place").alias("last")).first()
        calls, spent, last = calls + got["n"], spent + (got["units"] or 0), last if got["last"] is None else got["last"]
        at, blocks = at + size, blocks + 1
    return so_far(), last if calls >= limits.calls or spent >= most else None


def run(
    facts: DataFrame, units: DataFrame, cache: DataFrame, model: Model, *, now: str, inputs: DataFrame | None = None, features: tuple[str, ...] = refine.ELIGIBLE, limits: Limits | None = None, system: str = "", model_name: str = "",
    scanner: str = "", tasks: int = 32,
) -> Refined:
    """``cache``: at least key, verdict, rationale, timestamp. ``inputs``: slug, feature, prompt, allowed (paths an answer may cite)."""
    limits = limits or Limits()
    version = F.lit(facts.sparkSession.range(1).select(refine.prompt_version(F.lit(system), F.lit(model_name))).first()[0])
    kept = committed.newest(refine.pruned(cache, F.to_timestamp(F.lit(now))), "key", "timestamp").withColumn("verdict", F.coalesce("verdict", F.lit("worth-considering")))
    rows = refine.eligible(facts, units, features).withColumn("key", refine.cache_key(F.col("repo_url"), F.col("repo_sha"), F.col("feature"), F.lit(scanner), version))
    rows = refine.with_cache(rows.select("slug", "feature", "key", "unit_ord", "repo_sha"), kept).withColumn("at", F.array_position(F.array(*map(F.lit, features)), F.col("feature")))
    if inputs is None:
        rows = rows.withColumns({"prompt": F.to_json(F.struct(F.col("slug").alias("charm_slug"), F.col("feature").alias("feature_id"))), "allowed": F.array().cast("array<string>")})
    else:
        rows = rows.join(inputs.select("slug", "feature", "prompt", "allowed"), ["slug", "feature"], "left")
    rows, _ = numbered(rows, "unit_ord", "at", "slug")
    answers, last = _answers(rows.where("not hit").select("place", "key", F.coalesce("prompt", F.lit("")).alias("prompt"), "allowed"), model, limits, tasks)
    own = answers.select("place", F.lit(True).alias("asked"), "raw", "outcome", "verdict", "rationale", "evidence_path")
    valid = answers.where("outcome = 'ok' and key is not null").select("key", F.col("verdict").alias("run_verdict"), F.col("rationale").alias("run_rationale"))
    out = rows.drop("prompt", "allowed").join(own, "place", "left").join(valid, "key", "left")
    stopped = F.lit(False) if last is None else F.col("place") > last
    source = F.when(stopped, "stopped").when(F.coalesce("asked", F.lit(False)), "asked").otherwise("hit")
    out = out.withColumn("source", source).withColumns({
        "verdict": F.when(F.col("source") == "asked", F.col("verdict")).when(F.col("source") == "hit", F.coalesce("cached_verdict", "run_verdict")),
        "rationale": F.when(F.col("source") == "asked", F.col("rationale")).when(F.col("source") == "hit", F.when(F.col("hit"), F.col("cached_rationale")).otherwise(F.col("run_rationale"))),
        "outcome": F.when(stopped, "budget-stop").otherwise(F.col("outcome")),
    })
    seen = Observation()
    count = lambda test, name: F.count_if(test).alias(name)
    # counted by the action that writes the results, so a task that runs twice counts once
    results = staged(out.select("place", "slug", "feature", "key", "repo_sha", "source", "outcome", "verdict", "rationale", "evidence_path", "raw").observe(
        seen, F.count("*").alias("candidates"), count(F.col("source") == "asked", "calls"), count(F.col("source") == "hit", "hits"), count(F.col("source") == "stopped", "stopped"), count(F.coalesce(F.col("verdict") == "clear-gap", F.lit(False)), "escalated")
    ))
    at = F.lit(now)
    entries = results.where("source = 'asked' and outcome = 'ok' and key is not null").select(
        "key", F.col("slug").alias("charm_slug"), F.col("feature").alias("feature_id"), "verdict", "rationale", "evidence_path", F.lit(model_name).alias("model"), F.col("repo_sha").alias("charm_sha"), version.alias("prompt_version"),
        F.lit(scanner).alias("scanner_version"), at.alias("timestamp"), F.lit(refine.TTL_DAYS).alias("ttl_days"),
    )
    escalated = (F.col("source") == "asked") & (F.col("verdict") == "clear-gap")
    wrong = F.col("outcome").isin("parse-error", "invalid-path")
    log = results.where(escalated | wrong | (F.col("source") == "stopped")).select(
        F.col("slug").alias("charm_slug"), F.col("feature").alias("feature_id"), F.lit("worth-considering").alias("scanner_verdict"), F.when(escalated, F.col("verdict")).alias("llm_verdict"),
        F.when(escalated, "escalated").otherwise(F.col("outcome")).alias("outcome"), F.when(wrong, F.substring("raw", 1, 500)).alias("raw_output"), F.when(escalated, F.col("rationale")).alias("llm_rationale"),
        F.when(escalated, F.col("evidence_path")).alias("evidence_path"), at.alias("timestamp"),
    )
    verdicts = results.where("verdict = 'clear-gap'").select("slug", "feature", "verdict", "rationale")
    return Refined(refine.refined(facts, verdicts), results, entries, log, dict(seen.get))


def run_into(cache_path: str, log_path: str, facts: DataFrame, units: DataFrame, model: Model, **options: object) -> Refined:
    """``run`` with the cache and the log as committed tables: reads the one, appends to both."""
    spark = facts.sparkSession
    out = run(facts, units, committed.read(spark, cache_path, ENTRIES), model, **options)  # type: ignore[arg-type]
    committed.append(out.entries, cache_path)
    committed.append(out.log, log_path)
    return out


def input_records(facts: DataFrame, units: DataFrame, excerpts: DataFrame, summaries: Column) -> DataFrame:
    """``slug, feature, prompt, allowed``: what a model is told of each fact, as JSON, and the paths that it may cite.

    ``units``: with name, repo_url, has_containers, relations, secret_like_config, architecture. ``excerpts``: of the module
    of that name. ``summaries``: a map of features to what they are.
    """
    u = units.select(
        "slug", "name", "repo_url",
        F.struct(
            "has_containers", F.size(F.filter("relations", lambda r: r["role"] != "peers")).alias("relations_count"), "secret_like_config",
            F.when(F.size("architecture") > 0, F.get("architecture", F.lit(0))).otherwise("delta").alias("architecture"),
        ).alias("charm_meta"),
    )
    none = F.array().cast("array<struct<path:string,content:string>>")
    rows = facts.select("slug", "feature", "rationale").join(u, "slug").join(excerpts, ["slug", "feature"], "left").withColumn("source_excerpts", F.coalesce("excerpts", none))
    record = F.struct(
        F.col("slug").alias("charm_slug"), F.coalesce("name", "slug").alias("charm_name"), F.coalesce("repo_url", F.lit("")).alias("repo_url"), F.col("feature").alias("feature_id"), F.coalesce(F.try_element_at(summaries, F.col("feature")), F.lit("")).alias("feature_summary"),
        F.coalesce("rationale", F.lit("")).alias("rule_rationale"), "charm_meta", "source_excerpts",
    )
    return rows.select("slug", "feature", F.to_json(record).alias("prompt"), F.transform("source_excerpts", lambda e: e["path"]).alias("allowed"))
