"""Connected components by repeated hooking to the smallest neighbour and contraction.

Every round halves the components at least that are still joined by links, so rounds are logarithmic; each is a few
shuffles of the remaining links and is written to the shared folder. A hub's links are aggregated before the shuffle
(min) and are joined by plain joins, which adaptive execution splits when they are skewed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import dropped, written


def components(links: DataFrame) -> DataFrame:
    """``links``: ``u``, ``v`` (longs, either direction, repeats and loops allowed; null ends are no links).

    Returns ``id``, ``component`` for each end of a link: the smallest id that can be reached. No links: no rows.
    """
    edges = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    label = None
    while True:
        ends = edges.select(F.col("u").alias("id"), F.col("v").alias("near")).unionByName(edges.select(F.col("v").alias("id"), F.col("u").alias("near")))
        parent = written(ends.groupBy("id").agg(F.min("near").alias("near")).select("id", F.least("id", "near").alias("p")), "parent")
        up = parent.select(F.col("id").alias("p"), F.col("p").alias("pp"))
        parent, once = written(parent.join(up, "p").select("id", F.col("pp").alias("p")), "parent2"), parent
        dropped(once)
        old = label
        label = parent.select("id", F.col("p").alias("component")) if label is None else label.join(parent.withColumnRenamed("id", "component"), "component", "left").select("id", F.coalesce("p", "component").alias("component"))
        label = written(label, "label")
        rest = (
            edges.join(parent.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u")
            .join(parent.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v")
            .where("pu <> pv").select(F.greatest("pu", "pv").alias("u"), F.least("pu", "pv").alias("v")).distinct()
        )
        rest = written(rest, "links")
        dropped(edges, parent)
        if old is not None:
            dropped(old)
        edges = rest
        if edges.isEmpty():
            return label
