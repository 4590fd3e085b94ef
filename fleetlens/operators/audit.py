"""Audit pools and deterministic samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pool(facts: DataFrame, feature: str, bucket: str, units: DataFrame | None = None, team: str | None = None) -> DataFrame:
    rows = facts.where((F.col("feature") == feature) & (F.col("score") == bucket))
    return rows if team is None or units is None else rows.join(units.where(F.lower("team") == team.lower()).select("slug"), "slug", "left_semi")


def sample(rows: DataFrame, seed: str, n: int) -> DataFrame:
    """The ``n`` rows whose hash with the seed is smallest: another suffix in the seed gives another sample."""
    return rows.withColumn("draw", F.sha2(F.concat(F.lit(seed), "slug"), 256)).orderBy("draw", "slug").limit(n).drop("draw")
