"""Dated snapshots of facts: adoption series, timeline grid, differences and renames.

``facts``: date, slug, feature, present, and optionally score. ``units``: date, slug, repo_url (all units of a snapshot,
with facts or without). A feature that a snapshot lacks was not scanned; a unit that it lacks is not in the corpus.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions.text import round1


def with_live(past: DataFrame, live: DataFrame, today: str) -> DataFrame:
    """Appends the live snapshot as ``today`` unless that date is there already."""
    seen = past.select("date").distinct()
    return past.unionByName(live.withColumn("date", F.lit(today)).join(seen, "date", "left_anti"), allowMissingColumns=True)


def in_range(facts: DataFrame, since: str | None = None) -> DataFrame:
    """ISO dates compare as text; on a table partitioned by date this prunes partitions."""
    return facts if since is None else facts.where(F.col("date") >= since)


def adoption(facts: DataFrame, feature: str | None = None) -> DataFrame:
    """Of the units that have a record of a feature on a date, how many have the feature."""
    rows = facts if feature is None else facts.where(F.col("feature") == feature)
    out = rows.groupBy("feature", "date").agg(F.count_if("present").alias("present"), F.count("*").alias("total"))
    return out.withColumn("percent", round1(F.lit(100.0) * F.col("present") / F.col("total")))


def adoption_table(facts: DataFrame, dates: list[str]) -> DataFrame:
    """A column of percentages for each date."""
    return adoption(facts).groupBy("feature").pivot("date", dates).agg(F.first("percent"))


def ends(facts: DataFrame, since: str | None = None) -> DataFrame:
    """One row: the first date of the range and the last of all."""
    return facts.agg(F.min(F.when(F.lit(since is None) | (F.col("date") >= F.lit(since or "")), F.col("date"))).alias("base"), F.max("date").alias("latest"))


def flips(facts: DataFrame, since: str | None = None, feature: str | None = None) -> DataFrame:
    """Units in both snapshots whose state of a feature, scanned in both, has changed."""
    at = F.broadcast(ends(facts, since))
    base = facts.join(at, facts["date"] == F.col("base")).select("slug", "feature", F.col("present").alias("was"))
    last = facts.join(at, facts["date"] == F.col("latest")).select("slug", "feature", F.col("present").alias("now"))
    out = base.join(last, ["slug", "feature"]).where("was <> now")
    out = out.select("slug", "feature", "was", "now", F.when(F.col("was"), "regression").otherwise("adoption").alias("kind"))
    return out if feature is None else out.where(F.col("feature") == feature)


def flip_counts(flipped: DataFrame) -> DataFrame:
    return flipped.groupBy("kind").agg(F.count("*").alias("n"))


def renames(units: DataFrame, since: str | None = None) -> DataFrame:
    """A unit that went and one that came with the same repository, if each is the only one."""
    at = F.broadcast(ends(units, since))
    base = units.join(at, units["date"] == F.col("base")).select("slug", "repo_url").distinct()
    last = units.join(at, units["date"] == F.col("latest")).select("slug", "repo_url").distinct()

    def only(side: DataFrame, name: str) -> DataFrame:
        return side.groupBy("repo_url").agg(F.count("*").alias("n"), F.first("slug").alias(name)).where("n = 1").drop("n")

    gone, came = base.join(last.select("slug"), "slug", "left_anti"), last.join(base.select("slug"), "slug", "left_anti")
    return only(gone, "old_slug").join(only(came, "new_slug"), "repo_url").select("old_slug", "new_slug", "repo_url")


def timeline(facts: DataFrame, units: DataFrame, feature: str | None = None, slug: str | None = None) -> DataFrame:
    """``slug, feature, date, state`` for each unit, feature and date; pairs that are never more than a placeholder go."""
    rows = facts if "score" in facts.columns else facts.withColumn("score", F.lit(None).cast("string"))
    if feature is not None:
        rows = rows.where(F.col("feature") == feature)
    names = units.select("slug").distinct()
    grid = (names if slug is None else names.where(F.col("slug") == slug)).crossJoin(rows.select("feature").distinct()).crossJoin(units.select("date").distinct())
    there = units.select("date", "slug").distinct().withColumn("in_corpus", F.lit(True))
    scanned = facts.select("date", "feature").distinct().withColumn("scanned", F.lit(True))
    out = grid.join(there, ["date", "slug"], "left").join(scanned, ["date", "feature"], "left").join(rows.select("date", "slug", "feature", "present", "score"), ["date", "slug", "feature"], "left")
    out = out.withColumn("state", cell_state(F.col("in_corpus"), F.col("scanned"), F.col("present"), F.col("score")))
    rows = cells(out.select("slug", "feature", "date", "state")).where(F.exists("cells", lambda c: ~c["state"].isin("not-in-corpus", "not-scanned")))
    return rows.select("slug", "feature", F.inline("cells"))


def _runs(rows: DataFrame, keys: list[str], *states: str) -> DataFrame:
    """``first, last`` of runs of neighbouring dates (``d``, their numbers) with the same state, for each key."""
    w = Window.partitionBy(*keys, *states).orderBy("d")
    return rows.withColumn("_island", F.col("d") - F.row_number().over(w)).groupBy(*keys, *states, "_island").agg(F.min("d").alias("first"), F.max("d").alias("last")).drop("_island")


def timeline_runs(facts: DataFrame, units: DataFrame, feature: str | None = None, slug: str | None = None) -> DataFrame:
    """``slug, feature, first, last, state``: the timeline as runs of dates with the same state, which change when a state does.

    A unit's runs in the corpus, a feature's runs among the scanned ones and a pair's runs of records are made each from its own
    table; a pair's runs are cut where one of the three changes. So a pair costs its changes, not the number of dates.
    """
    rows = facts if "score" in facts.columns else facts.withColumn("score", F.lit(None).cast("string"))
    if feature is not None:
        rows = rows.where(F.col("feature") == feature)
    if slug is not None:
        rows, units_of = rows.where(F.col("slug") == slug), units.where(F.col("slug") == slug)
    else:
        units_of = units
    names = [r["date"] for r in units.select("date").distinct().orderBy("date").collect()]  # a row for each snapshot
    dates = F.broadcast(units.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), "date string, d int"))
    pack = lambda df, keys, *more: df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last", *more))).alias("r"))
    there = pack(_runs(units_of.select("date", "slug").distinct().join(dates, "date"), ["slug"]), ["slug"]).withColumnRenamed("r", "there")
    every = facts if feature is None else facts.where(F.col("feature") == feature)
    scanned = pack(_runs(every.select("date", "feature").distinct().join(dates, "date"), ["feature"]), ["feature"]).withColumnRenamed("r", "scanned")
    own = rows.withColumn("state", F.when(F.col("present"), "present").otherwise(F.coalesce("score", F.lit("not-applicable")))).join(dates, "date")
    own = pack(_runs(own.select("slug", "feature", "d", "state"), ["slug", "feature"], "state"), ["slug", "feature"], "state").withColumnRenamed("r", "own")
    pairs = there.crossJoin(scanned).join(own, ["slug", "feature"], "left").withColumn("own", F.coalesce("own", F.array().cast(own.schema["own"].dataType)))
    some = lambda c: F.exists("there", lambda t: F.exists(c, lambda s: (t["first"] <= s["last"]) & (s["first"] <= t["last"])))
    pairs = pairs.where(some("scanned"))  # others are never more than a placeholder
    ends = F.flatten(F.array(*(F.flatten(F.transform(c, lambda r: F.array(r["first"], r["last"] + 1))) for c in ("there", "scanned", "own"))))
    cuts = F.array_sort(F.array_distinct(F.filter(F.concat(F.array(F.lit(0)), ends), lambda x: x < len(names))))
    pairs = pairs.withColumn("cuts", cuts)
    inside = lambda c, x: F.exists(c, lambda r: (r["first"] <= x) & (x <= r["last"]))
    record = lambda x: F.get(F.filter("own", lambda r: (r["first"] <= x) & (x <= r["last"])), F.lit(0))["state"]
    state = lambda x: F.when(~inside("there", x), "not-in-corpus").when(~inside("scanned", x), "not-scanned").otherwise(F.coalesce(record(x), F.lit("not-applicable")))
    steps = F.transform("cuts", lambda x: F.struct(x.alias("first"), state(x).alias("state")))
    pairs = pairs.select("slug", "feature", steps.alias("steps"))
    # of neighbouring steps with the same state only the first begins a run
    begins = F.filter("steps", lambda s, i: (i == 0) | (F.get("steps", i - 1)["state"] != s["state"]))
    pairs = pairs.select("slug", "feature", begins.alias("steps"))
    last = F.transform("steps", lambda s, i: F.struct(s["first"].alias("a"), (F.coalesce(F.get("steps", i + 1)["first"], F.lit(len(names))) - 1).alias("b"), s["state"].alias("state")))
    at = F.array(*map(F.lit, names)) if names else F.array().cast("array<string>")
    return pairs.select("slug", "feature", F.inline(last)).select("slug", "feature", F.get(at, F.col("a")).alias("first"), F.get(at, F.col("b")).alias("last"), "state")


def timeline_of(runs: DataFrame, units: DataFrame) -> DataFrame:
    """The grid of runs, equal to ``timeline``: each date within a run."""
    dates = units.select("date").distinct()
    return runs.join(F.broadcast(dates), (F.col("first") <= F.col("date")) & (F.col("date") <= F.col("last"))).select("slug", "feature", "date", "state")  # dates are snapshots, few and one a row


def cell_state(in_corpus: Column, scanned: Column, present: Column, score: Column) -> Column:
    return F.when(in_corpus.isNull(), "not-in-corpus").when(scanned.isNull(), "not-scanned").when(present, "present").otherwise(F.coalesce(score, F.lit("not-applicable")))


def cells(grid: DataFrame) -> DataFrame:
    """The grid with one row for a pair and its states in order of dates."""
    row = F.array_sort(F.collect_list(F.struct("date", "state")))
    return grid.groupBy("slug", "feature").agg(row.alias("cells"))


def moving(grid_or_facts: DataFrame, flipped: DataFrame) -> DataFrame:
    """Only units that occur among the flips (the static page's default)."""
    return grid_or_facts.join(flipped.select("slug").distinct(), "slug", "left_semi")
