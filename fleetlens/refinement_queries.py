"""Registered queries of the refinement run and of committed tables, on the fleet made of suppliers.

The model is a stub that decides by the unit's number and the feature, so SQL can tell what a run must give: its limits are
running sums over the candidates in order, and a candidate is served by the first valid answer of its key.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.catalog import FLEET, facts, query, table, units
from fleetlens.operators import refine, refinement
from fleetlens.plans.staging import shared_folder
from fleetlens.sources import committed

FEATURES = ("STANDARD", "ECONOMY", "PROMO", "SMALL", "MEDIUM", "LARGE")


def stub(prompt: str) -> tuple[str, int | None, int | None]:
    record = json.loads(prompt)
    n = int("".join(c for c in record["charm_slug"] if c.isdigit()))
    kind = (n + len(record["feature_id"])) % 7
    if kind == 0:
        raise RuntimeError("no connection")
    verdict = "clear-gap" if kind in (3, 4) else "worth-considering"
    raw = "not json" if kind == 1 else json.dumps({"verdict": verdict, "rationale": f"r{n}", "evidence_path": "z.py" if kind == 2 else None})
    return raw, 500 + 10 * (n % 50), None if kind == 3 else 60


def _refined(spark: SparkSession, sf_dir: str, limits: refinement.Limits) -> refinement.Refined:
    k = F.col("unit_ord")
    u = units(spark, sf_dir).withColumns({"repo_url": F.concat(F.lit("https://host/"), (k % 40).cast("string")), "repo_sha": F.when(k % 9 > 0, "s")})
    f = facts(spark, sf_dir)
    version = spark.range(1).select(refine.prompt_version(F.lit("sys"), F.lit("m")).alias("v"))
    kept = u.where((k % 40 % 6 == 0) & (k < 41)).crossJoin(F.broadcast(version)).select(
        F.explode(F.array(*(F.struct(refine.cache_key(F.col("repo_url"), F.lit("s"), F.lit(x), F.lit("1"), F.col("v")).alias("key")) for x in FEATURES[:2]))).alias("e"), F.when(k % 4 == 0, "clear-gap").otherwise("worth-considering").alias("verdict"),
    ).select("e.key", "verdict", F.lit("kept").alias("rationale"), F.lit("2024-05-01T00:00:00Z").alias("timestamp"))
    return refinement.run(f, u, kept, stub, now="2024-05-02T00:00:00Z", features=FEATURES, limits=limits, system="sys", model_name="m", scanner="1")


def _sql(limit: str) -> str:
    return f"""
    with {FLEET}, c as (
        select slug, feature, score, unit_ord, a.nth, unit_ord % 40 as repo, unit_ord % 9 > 0 as keyed, unit_ord % 40 % 6 = 0 and unit_ord % 9 > 0 and a.nth <= 2 and unit_ord % 40 in (select unit_ord % 40 from u where unit_ord < 41) as hit,
            (unit_ord + length(feature)) % 7 as kind
        from f join u using (slug) join (values {', '.join(f"('{f}', {i + 1})" for i, f in enumerate(FEATURES))} ) a(feature, nth) using (feature) where not present and score = 'worth-considering'
    ),
    k as (select *, case when keyed then repo || '' else 'own' || unit_ord end as grp, kind >= 3 and keyed as fills, unit_ord * 10 + nth as place from c),
    s as (select *, min(case when fills and not hit then place end) over (partition by grp, feature order by place rows between unbounded preceding and 1 preceding) as by_place from k),
    q as (select *, not hit and by_place is null as asks, case kind when 0 then 0 when 3 then 8 * (500 + 10 * (unit_ord % 50)) + 3200 else 8 * (500 + 10 * (unit_ord % 50)) + 2400 end as cost from s),
    w as (select *, coalesce(sum(case when asks then 1 else 0 end) over o, 0) as calls, coalesce(sum(case when asks then cost else 0 end) over o, 0) as spent from q window o as (order by place rows between unbounded preceding and 1 preceding)),
    y as (select w.*, case when {limit} then 'stopped' when asks then 'asked' else 'hit' end as source, l.kind as lead_kind, l.unit_ord as lead from w left join (select place, kind, unit_ord from k) l on l.place = w.by_place),
    r as (
        select slug, feature, source, case source when 'stopped' then 'budget-stop' when 'asked' then case when kind = 2 then 'invalid-path' when kind < 2 then 'parse-error' else 'ok' end end as outcome,
            case source when 'asked' then kind in (3, 4) when 'hit' then case when hit then (unit_ord % 40 + case when unit_ord % 40 = 0 then 40 else 0 end) % 4 = 0 else lead_kind in (3, 4) end else false end as up,
            case source when 'asked' then 'r' || unit_ord when 'hit' then case when hit then 'kept' else 'r' || lead end end as why from y
    )"""


@query(f"{_sql('calls >= 25')} select slug, feature, source, outcome from r")
def refinement_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir, refinement.Limits(calls=25, block=10)).results.select("slug", "feature", "source", "outcome")


@query(f"{_sql('spent >= 200000')} select f.slug, f.feature, case when up then 'clear-gap' else score end as score, case when up then why else 'why' end as rationale, coalesce(up, false) as ai_escalated from f left join r using (slug, feature)")
def refinement_spend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir, refinement.Limits(calls=1 << 30, usd=0.02, most_usd=0.002)).facts.select("slug", "feature", "score", "rationale", "ai_escalated")


@query(f"{_sql('calls >= 25')} select outcome, count(*) as n from (select case when source = 'asked' and up then 'escalated' else outcome end as outcome from r) where outcome <> 'ok' group by outcome")
def refinement_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refined(spark, sf_dir, refinement.Limits(calls=25)).log.groupBy("outcome").agg(F.count("*").alias("n"))


@query(f"{_sql('false')} select count(*) as candidates, count(*) filter (source = 'asked') as calls, count(*) filter (source = 'hit') as hits, count(*) filter (source = 'stopped') as stopped, count(*) filter (up) as escalated from r")
def refinement_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _refined(spark, sf_dir, refinement.Limits(calls=1 << 30, usd=1e6)).counts
    return spark.createDataFrame([counts], "candidates long, calls long, hits long, stopped long, escalated long")


@query("select user_id || event_type as key, arg_max(event_id, struct_pack(ts := ts, event_id := event_id)) as event_id from events where event_id % 4 <> 3 group by 1")
def cache_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest entry by key of a table with three appends, one of them committed twice, and a writer that never committed."""
    e = table(spark, sf_dir, "events").select(F.concat(F.col("user_id").cast("string"), "event_type").alias("key"), "ts", "event_id")
    path = shared_folder(spark, "cache")
    for k in range(3):
        name = committed.write_aside(e.where(F.col("event_id") % 4 == k), path)
        for _ in range(1 + (k == 1)):
            committed.commit(spark, path, name)
    committed.write_aside(e.where(F.col("event_id") % 4 == 3), path)
    return committed.newest(committed.read(spark, path, e.schema), "key", "ts", "event_id").select("key", "event_id")
