"""Filters over corpus rows, overrides, first and last of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def only(rows: DataFrame, col: str, names: list[str]) -> DataFrame:
    """Rows with a listed name; none listed means all."""
    return rows.where(F.col(col).isin(names)) if names else rows


def chosen(refs: DataFrame, teams: list[str] | None = None, *, key_only: bool = False) -> DataFrame:
    """Rows of the teams (in any case) or, if asked for, key rows; without any condition all."""
    if not teams and not key_only:
        return refs
    of_team = F.lower("team").isin([t.lower() for t in teams]) if teams else F.lit(False)
    return refs.where(of_team | (F.lit(key_only) & F.col("key_charm")))


def first_rows(refs: DataFrame, limit: int = 5, *, key_only: bool = False) -> DataFrame:
    rows = refs.where("key_charm") if key_only else refs
    return rows.orderBy("ord").limit(limit) if limit else rows


def not_reserved(c: Column) -> Column:
    """Keys that begin with two underscores are no units or features."""
    return ~c.startswith("__")


def with_overrides(refs: DataFrame, exclude: DataFrame, branches: DataFrame) -> DataFrame:
    """``reason`` is set for excluded rows, which beats the branch override; else the branch may be replaced.

    Both override tables are configuration; small ones are broadcast by the planner, which checks their size.
    """
    out = refs.join(exclude.select(F.col("url").alias("repo_url"), "reason"), "repo_url", "left").join(branches.select(F.col("url").alias("repo_url"), F.col("branch").alias("pinned")), "repo_url", "left")
    return out.withColumn("branch", F.coalesce("pinned", "branch")).drop("pinned")


def without_sub_units(units: DataFrame, excludes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units that stay, and the skipped ones with their reasons, by (url, sub_path)."""
    rows = units.join(excludes.select(F.col("url").alias("repo_url"), F.col("sub_path").alias("subpath"), "reason"), ["repo_url", "subpath"], "left")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select("slug", "reason")


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key: an aggregate with partial sums, no sort of a hot key's rows."""
    cols = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.min(F.struct(order, *cols)).alias("x")) if not cols else rows.groupBy(key).agg(F.min_by(F.struct(order, *cols), order).alias("x"))
    return best.select(key, "x.*")


def last_in_first_place(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key at the place of its first."""
    cols = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x"), F.min(order).alias(order))
    return best.select(key, order, "x.*")
