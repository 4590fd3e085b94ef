"""All registered queries on the driver's tables, with the SQL that they are held against.

The operators work on fleet tables (units, facts, features, ...). Here such tables are made from the driver's: weekly
events stand for dated snapshots, suppliers for units, nations for teams, part types for features, part names for unit
names, pages for repository URLs. Both sides, Spark and SQL, start from the same definitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import text as tx
from fleetlens.operators import audit, filters, pairs, refine, search, trend, views

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Weekly facts of events.

WEEKLY = "f as (select cast(cast(date_trunc('week', ts) as date) as varchar) as date, cast(user_id as varchar) as slug, event_type as feature, max(value) >= 60 as present from events group by all)"
LAST = "ends as (select min(date) as base, max(date) as latest from f)"


def weekly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    date = F.date_format(F.date_trunc("week", F.col("ts").cast("timestamp")), "yyyy-MM-dd")
    return e.groupBy(date.alias("date"), F.col("user_id").cast("string").alias("slug"), F.col("event_type").alias("feature")).agg((F.max("value") >= 60).alias("present"))


@query(f"with {WEEKLY} select feature, date, count(*) filter (present) as present, count(*) as total, cast(printf('%.1f', 100.0 * count(*) filter (present) / count(*)) as double) as percent from f group by feature, date")
def adoption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.adoption(weekly(spark, sf_dir))


@query(f"with {WEEKLY} select feature, date, count(*) filter (present) as present, count(*) as total, cast(printf('%.1f', 100.0 * count(*) filter (present) / count(*)) as double) as percent from f where feature = 'click' and date >= '2024-01-15' group by feature, date")
def adoption_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.adoption(trend.in_range(weekly(spark, sf_dir), "2024-01-15"), "click")


@query(f"with {WEEKLY}, {LAST}, b as (select f.* from f, ends where date = base), l as (select f.* from f, ends where date = latest) select slug, feature, b.present as was, l.present as now, case when b.present then 'regression' else 'adoption' end as kind from b join l using (slug, feature) where b.present <> l.present")
def flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.flips(weekly(spark, sf_dir))


@query(f"with {WEEKLY}, {LAST}, b as (select f.* from f, ends where date = base), l as (select f.* from f, ends where date = latest) select case when b.present then 'regression' else 'adoption' end as kind, count(*) as n from b join l using (slug, feature) where b.present <> l.present group by 1")
def flip_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trend.flip_counts(trend.flips(weekly(spark, sf_dir)))


@query(f"""
    with {WEEKLY}, dates as (select distinct date from f), feats as (select distinct feature from f),
    u as (select distinct date, slug from f), slugs as (select distinct slug from u), s as (select distinct date, feature from f),
    g as (
        select slugs.slug, feats.feature, dates.date,
               case when u.slug is null then 'not-in-corpus' when s.date is null then 'not-scanned' when f.present then 'present' else 'not-applicable' end as state
        from slugs cross join feats cross join dates
        left join u on u.slug = slugs.slug and u.date = dates.date
        left join s on s.feature = feats.feature and s.date = dates.date
        left join f on f.slug = slugs.slug and f.feature = feats.feature and f.date = dates.date
    )
    select * from g where (slug, feature) in (select (slug, feature) from g where state not in ('not-in-corpus', 'not-scanned'))
""")
def timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = weekly(spark, sf_dir)
    return trend.timeline(facts, facts.select("date", "slug").distinct())


@query(f"""
    with {WEEKLY}, u as (select distinct date, slug, cast(cast(slug as bigint) % 97 as varchar) as url from f where feature = 'purchase' and present), ends as (select min(date) as base, max(date) as latest from u),
    b as (select u.* from u, ends where date = base), l as (select u.* from u, ends where date = latest),
    gone as (select url, any_value(slug) as old_slug from b where slug not in (select slug from l) group by url having count(*) = 1),
    came as (select url, any_value(slug) as new_slug from l where slug not in (select slug from b) group by url having count(*) = 1)
    select old_slug, new_slug, url as repo_url from gone join came using (url)
""")
def renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = weekly(spark, sf_dir).where("feature = 'purchase' and present").select("date", "slug", (F.col("slug").cast("long") % 97).cast("string").alias("repo_url")).distinct()
    return trend.renames(units)


@query(f"with {WEEKLY}, l as (select slug, feature, present from f where date = '2024-01-22') select date, slug, feature, present from f where date < '2024-01-22' union all select '2024-02-05', slug, feature, present from l")
def live_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = weekly(spark, sf_dir)
    past = facts.where("date < '2024-01-22'")
    return trend.with_live(past, facts.where("date = '2024-01-22'").drop("date"), "2024-02-05").select("date", "slug", "feature", "present")


# A fleet of suppliers.

FLEET = """
    u as (
        select s_suppkey as unit_ord, s_name as slug, s_name as name, n_name as team, 'https://host/' || s_name as repo_url, s_suppkey % 3 = 0 as has_containers, s_suppkey % 11 = 0 as is_reactive,
               s_suppkey % 13 = 0 as is_legacy_classic, s_suppkey % 5 = 0 as reconcile, s_suppkey % 7 = 0 as part_reconcile, s_suppkey % 2 = 0 as tox, s_suppkey % 4 = 0 as make
        from supplier join nation on s_nationkey = n_nationkey
    ),
    feats as (select p_type as feature, row_number() over (order by p_type) as feature_ord from (select distinct p_type from part)),
    x as (
        select l_suppkey, p_type, count(*) filter (l_returnflag = 'R' and l_quantity >= 45) >= 8 as present, sum(l_quantity) as q
        from lineitem join part on l_partkey = p_partkey group by all
    ),
    f as (
        select s_name as slug, p_type as feature, feature_ord, present,
               case when not present then case when s_acctbal > 5000 then 'clear-gap' when q > 2000 then 'worth-considering' else 'not-applicable' end end as score
        from x join supplier on l_suppkey = s_suppkey join feats on p_type = feature
    ),
    arch as (select *, case when is_reactive then 'reactive' when is_legacy_classic then 'legacy-classic' when reconcile then 'reconcile' when part_reconcile then 'part-reconcile' else 'delta' end as arch from u)
"""
GRID = "g as (select u.slug, feats.feature, coalesce(f.present, false) as present, case when coalesce(f.present, false) then null else coalesce(f.score, 'not-applicable') end as score from u cross join feats left join f on f.slug = u.slug and f.feature = feats.feature)"


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    k = F.col("s_suppkey")
    some = lambda *xs: F.array_compact(F.array(*(F.when(t, v) for t, v in xs)))
    return s.join(n, s["s_nationkey"] == n["n_nationkey"]).select(
        k.alias("unit_ord"), F.col("s_name").alias("slug"), F.col("s_name").alias("name"), F.col("n_name").alias("team"), F.concat(F.lit("https://host/"), "s_name").alias("repo_url"), F.lit("").alias("subpath"), F.lit(None).cast("string").alias("repo_sha"),
        some((k % 5 == 0, "reconcile"), (k % 7 == 0, "part-reconcile")).alias("architecture"), (k % 3 == 0).alias("has_containers"), (k % 11 == 0).alias("is_reactive"), (k % 13 == 0).alias("is_legacy_classic"),
        F.lit(False).alias("provides_own_library"), (k % 9 == 0).alias("has_terraform_module"), some((k % 2 == 0, "tox"), (k % 4 == 0, "make")).alias("tooling"), F.array().cast("array<string>").alias("charmcraft_plugins"), F.array(F.lit("ubuntu@22.04")).alias("bases"),
    )


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("feature")).distinct()
    return p.withColumn("feature_ord", F.row_number().over(Window.orderBy("feature"))).withColumn("library", F.substring("feature", 1, 1)).withColumn("expected_rare", F.lit(False))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity", "l_returnflag")
    x = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", F.col("p_type").alias("feature"))
    x = x.agg((F.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") >= 45)) >= 8).alias("present"), F.sum("l_quantity").alias("q"))
    x = x.join(table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("slug"), "s_acctbal"), F.col("l_suppkey") == F.col("s_suppkey"))
    score = F.when(F.col("s_acctbal") > 5000, "clear-gap").when(F.col("q") > 2000, "worth-considering").otherwise("not-applicable")
    return x.join(features(spark, sf_dir).select("feature", "feature_ord"), "feature").select("slug", "feature", "feature_ord", "present", F.when(~F.col("present"), score).alias("score"), F.lit("why").alias("rationale"))


@query(f"with {FLEET}, {GRID} select feature, count(*) filter (present) as present, count(*) filter (score = 'clear-gap') as clear_gap, count(*) filter (score = 'worth-considering') as worth, count(*) filter (score = 'not-applicable') as na, count(*) filter (present) < 5 as low_count from g group by feature")
def feature_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.feature_view(units(spark, sf_dir), facts(spark, sf_dir), features(spark, sf_dir))
    return out.select("feature", "present", "clear_gap", "worth", "na", "low_count")


@query(f"with {FLEET}, {GRID} select feature, arch, count(*) filter (present) as present, count(*) as total, case when arch not in ('reactive', 'legacy-classic') then cast(100 * count(*) filter (present) // count(*) as bigint) end as pct from g join arch using (slug) group by feature, arch")
def feature_by_architecture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.feature_by_architecture(units(spark, sf_dir), facts(spark, sf_dir), features(spark, sf_dir)).select("feature", "arch", "present", "total", "pct")


@query(f"with {FLEET} select slug, team, count(*) filter (f.present) as present, count(*) filter (not f.present and score = 'clear-gap') as clear_gap, count(*) filter (not f.present and score = 'worth-considering') as worth, coalesce(string_agg(feature, ' ' order by feature_ord) filter (f.present), '') as present_features, coalesce(string_agg(feature, ' ' order by feature_ord) filter (not f.present and score = 'clear-gap'), '') as gap_features from u left join f using (slug) group by slug, team")
def unit_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = views.unit_view(units(spark, sf_dir), facts(spark, sf_dir))
    return out.select("slug", "team", "present", "clear_gap", "worth", F.array_join("present_features", " ").alias("present_features"), F.array_join("gap_features", " ").alias("gap_features"))


@query(f"with {FLEET}, c as (select team, u.slug, count(*) filter (f.present) as p, count(*) filter (score = 'clear-gap') as g, count(*) filter (score = 'worth-considering') as w from u left join f on f.slug = u.slug group by all) select team, count(*) as units, cast(sum(p) as bigint) as present, cast(sum(g) as bigint) as clear_gap, cast(sum(w) as bigint) as worth, cast(printf('%.1f', sum(g) / count(*)) as double) as avg_gap from c group by team")
def team_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.team_rollup(units(spark, sf_dir), facts(spark, sf_dir)).drop("first_ord")


@query(f"with {FLEET}, n as (select team, feature, feature_ord, count(*) as n from f join u using (slug) where not present and score = 'clear-gap' group by all) select team, feature, n, cast(row_number() over (partition by team order by n desc, feature_ord) as int) as place from n qualify place <= 5")
def team_top_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.team_top_gaps(units(spark, sf_dir), facts(spark, sf_dir))


@query(f"with {FLEET} select team, case when is_reactive then 'reactive' when is_legacy_classic then 'legacy-classic' when reconcile then 'reconcile' when part_reconcile then 'part-reconcile' else 'delta' end as arch, count(*) as n from u group by all")
def team_architectures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.team_architectures(units(spark, sf_dir))


@query(f"""
    with {FLEET}, a as (
        select 'total' as axis, unnest(list_filter([ 'units', case when has_containers then 'k8s' else 'machine' end, case when is_reactive then 'reactive' end, case when is_legacy_classic then 'legacy' end, case when unit_ord % 9 = 0 then 'terraform' end], lambda x: x is not null)) as label from u
        union all select 'architecture', unnest(list_filter([case when reconcile then 'reconcile' end, case when part_reconcile then 'part-reconcile' end], lambda x: x is not null)) from u
        union all select 'tooling', unnest(list_filter([case when tox then 'tox' end, case when make then 'make' end], lambda x: x is not null)) from u
        union all select 'base', 'ubuntu@22.04' from u
    ) select axis, label, count(*) as n from a group by all
""")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.summary(units(spark, sf_dir))


@query(f"with {FLEET} select feature, cast(row_number() over (partition by feature order by unit_ord) as int) as n, slug, repo_url as link from f join u using (slug) where present qualify n <= 5")
def exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.exemplars(units(spark, sf_dir), facts(spark, sf_dir))


@query(f"with {FLEET} select slug, feature, score, 'why' as rationale from f where score in ('clear-gap', 'worth-considering')")
def evidence_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.evidence_log(facts(spark, sf_dir))


@query(f"with {FLEET} select slug, feature, present, case when unit_ord % 17 = 0 and feature like 'S%' then 'not-applicable' else score end as score, case when unit_ord % 17 = 0 and feature like 'S%' then 'declared' else 'why' end as rationale from f join u using (slug)")
def feature_excludes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators import scoring

    u = units(spark, sf_dir)
    own = u.where("unit_ord % 17 = 0").select(F.col("repo_url").alias("url"), F.lit("").alias("sub_path"), F.lit("declared").alias("reason")).crossJoin(features(spark, sf_dir).where("feature like 'S%'").select("feature"))
    return scoring.exclude_features(facts(spark, sf_dir), u, own).select("slug", "feature", "present", "score", "rationale")


# Corpus rows and their overrides.


@query("select cast(s_suppkey as bigint) as ord, s_name as name, case when s_suppkey % 4 = 0 then 'pinned' else 'main' end as branch, case when s_suppkey % 17 = 0 then 'archived' end as reason from supplier where s_nationkey in (1, 2, 3) or s_suppkey % 10 = 0")
def corpus_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    refs = s.select(F.col("s_suppkey").alias("ord"), F.col("s_nationkey").cast("string").alias("team"), F.col("s_name").alias("name"), F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("repo_url"), (F.col("s_suppkey") % 10 == 0).alias("key_charm"), F.lit("main").alias("branch"))
    kept = filters.chosen(refs, teams=["1", "2", "3"], key_only=True)
    out_of = refs.where("ord % 17 = 0").select(F.col("repo_url").alias("url"), F.lit("archived").alias("reason"))
    pinned = refs.where("ord % 4 = 0").select(F.col("repo_url").alias("url"), F.lit("pinned").alias("branch"))
    return filters.with_overrides(kept, out_of, pinned).select("ord", "name", "branch", "reason")


# Names and URLs.

NAMES = "u as (select p_partkey as ord, replace(p_name, ' ', '-') || '-' || lower(substr(p_brand, 7)) || case p_size % 3 when 0 then '-k8s' when 1 then '-operator' else '' end as name, p_size % 3 = 0 as k8s from part)"


@query(f"""
    with {NAMES}, r as (select *, case when k8s then regexp_replace(regexp_replace(name, '(.)-k8s(-operator)?$', '\\1'), '(.)-operator$', '\\1') else regexp_replace(name, '(.)-operator$', '\\1') end as root from u),
    k as (select * from r where k8s), m as (select * from r where not k8s),
    high as (select k.root, k.name as k8s_name, m.name as machine_name, 'high' as confidence from k join m using (root)),
    near as (select k.root, k.name as k8s_name, m.name as machine_name, 'medium' as confidence from k join m on levenshtein(k.root, m.root) <= 2 where k.root not in (select root from m) qualify row_number() over (partition by k.ord order by levenshtein(k.root, m.root), m.ord) = 1)
    select * from high union all select * from near
""")
def unit_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    name = F.concat(F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.lower(F.substring("p_brand", 7, 99)), F.when(size == 0, "-k8s").when(size == 1, "-operator").otherwise(""))
    u = p.select(F.col("p_partkey").alias("ord"), name.alias("name"), F.lit("").alias("repo_url"), (size == 0).alias("has_containers"), F.array().cast("array<string>").alias("library_names"))
    return pairs.find_pairs(u).select("root", "k8s_name", "machine_name", "confidence")


@query("select page_id, regexp_replace(list_last(string_split(regexp_replace(url, '/+$', ''), '/')), '\\.git$', '') as slug from pages")
def url_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("select repo as slug, min(page_id) as ord from (select page_id, split_part(split_part(url, '://', 2), '/', 1) as repo from pages) group by repo")
def first_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1)).alias("slug"))
    return filters.first_of(p, "slug", "ord").select("slug", "ord")


@query("select page_id from pages where contains(lower(url), 'example.com') and not contains(lower(url), 'page=') and contains(lower(url), '/fr/')")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").withColumn("search", F.lower("url"))
    return p.where(search.matches(search.parse('example.com -url:page= url:"/fr/"', {"url"}))).select("page_id")


@query("select d.doc_id, cast(i as int) as line, m as match from (select doc_id, generate_subscripts(ls, 1) as i, unnest(ls) as l from (select doc_id, string_split(text, chr(10)) as ls from documents)) d, unnest(regexp_extract_all(l, '[A-Z][a-z]+\\.$')) as t(m)")
def regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.select("doc_id", F.explode(tx.match_lines("text", "(?m)(?d)[A-Z][a-z]+\\.$")).alias("m")).select("doc_id", "m.line", "m.match")


# Answers of a model, cache, budget, calibration and audit.


@query("select conv_id, turn, case when turn % 5 = 0 then 'parse-error' when turn % 7 = 0 then 'invalid-path' else 'ok' end as outcome from conversations where role = 'assistant'")
def verdict_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("role = 'assistant'")
    path = F.when(F.col("turn") % 7 == 0, F.lit('"other.py"')).otherwise(F.lit("null"))
    raw = F.when(F.col("turn") % 5 == 0, F.lit("no json")).otherwise(F.concat(F.lit('{"verdict": "clear-gap", "rationale": "r", "evidence_path": '), path, F.lit("}")))
    return c.select("conv_id", "turn", refine.outcome(raw, F.array(F.lit("src/a.py"))).alias("outcome"))


@query("select count(*) as total, count(*) filter (q.quality = coalesce(l.toxic, 0)) as agreed, coalesce(count(*) filter (q.quality = coalesce(l.toxic, 0)) / count(*), 1.0) as agreement, coalesce(count(*) filter (q.quality = coalesce(l.toxic, 0)) / count(*), 1.0) >= 0.9 as passed from labels q left join (select * from labels where toxic = 1) l using (doc_id)")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "labels")
    truth = t.select(F.col("doc_id").cast("string").alias("slug"), F.lit("f").alias("feature"), F.col("quality").cast("string").alias("human_verdict"))
    got = t.where("toxic = 1").select(F.col("doc_id").cast("string").alias("slug"), F.lit("f").alias("feature"), F.col("toxic").cast("string").alias("score"))
    return refine.calibrated(truth, got, default="0")


@query(f"with {FLEET}, p as (select slug, row_number() over (order by sha256('clear-gap::STANDARD2' || slug), slug) as n from f where feature = 'STANDARD' and score = 'clear-gap') select slug from p where n <= 30")
def audit_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sample(audit.pool(facts(spark, sf_dir), "STANDARD", "clear-gap"), "clear-gap::STANDARD2", 30).select("slug")


@query(f"with {FLEET}, c as (select f.*, unit_ord, unit_ord % 3 = 0 as hit, row_number() over () as r from f join u using (slug) where score = 'worth-considering'), w as (select *, coalesce(sum(case when hit then 0 else 1 end) over (order by unit_ord, feature_ord rows between unbounded preceding and 1 preceding), 0) as before from c) select slug, feature, hit from w where before < 40")
def call_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = facts(spark, sf_dir).where("score = 'worth-considering'").join(units(spark, sf_dir).select("slug", "unit_ord"), "slug").withColumn("hit", F.col("unit_ord") % 3 == 0)
    return refine.capped(c, ["unit_ord", "feature_ord"], ~F.col("hit"), 40).select("slug", "feature", "hit")


# Labels by the rules; features by number, units by flags.

RULES = """
    r as (
        select slug, unit_ord, is_reactive, is_legacy_classic, reconcile, has_containers, f, unit_ord % 4 = 0 and f = 'ops.status-set-directly' as present
        from u, (select unnest(['ops.status-set-directly', 'ops.collect-status', 'ops.pebble-ready', 'pebble.checks', 'ops.relation-app-data', 'ops.stored-state', 'jubilant.integration-tests', 'other']) as f)
    )
"""


@query(f"""
    with {FLEET}, {RULES}
    select slug, f as feature, case
        when present then null when is_reactive or is_legacy_classic then 'not-applicable'
        when f in ('ops.pebble-ready', 'ops.collect-status') and reconcile then 'not-applicable'
        when f = 'pebble.checks' and has_containers then 'worth-considering' when f = 'ops.pebble-ready' and has_containers then 'clear-gap'
        when f = 'ops.relation-app-data' and unit_ord % 6 = 0 then 'worth-considering'
        when f = 'ops.collect-status' then case when unit_ord % 4 = 0 or unit_ord % 6 = 0 then 'clear-gap' else 'worth-considering' end
        when f = 'jubilant.integration-tests' and unit_ord % 8 = 0 then 'worth-considering' else 'not-applicable' end as score
    from r
""")
def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators import scoring

    names = ["ops.status-set-directly", "ops.collect-status", "ops.pebble-ready", "pebble.checks", "ops.relation-app-data", "ops.stored-state", "jubilant.integration-tests", "other"]
    relation = F.struct(F.lit("db").alias("name"), F.lit("requires").alias("role"), F.lit("pg").alias("interface"))
    none, k = F.array().cast("array<string>"), F.col("unit_ord")
    u = units(spark, sf_dir).withColumns({"relations": F.when(k % 6 == 0, F.array(relation)).otherwise(F.array().cast("array<struct<name:string,role:string,interface:string>>")), "has_integration_tests": k % 8 == 0, "secret_like_config": none, "secret_typed_config": none})
    own = u.select("slug", F.explode(F.array(*map(F.lit, names))).alias("feature"), "unit_ord")
    own = own.select("slug", "feature", ((k % 4 == 0) & (F.col("feature") == names[0])).alias("present"), F.lit(None).cast("string").alias("score"), F.lit(None).cast("string").alias("rationale"))
    return scoring.scored(own, u).select("slug", "feature", "score")
