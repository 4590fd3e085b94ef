"""Cuts lineage by a table in the shared folder of ``spark.checkpoint.dir``; only a local session may do without that setting."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = os.path.join(tempfile.gettempdir(), "checkpoints")
    if "://" not in base and base.startswith("/"):
        base = "file://" + base
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    path = shared_folder(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(rows: DataFrame, *order: Column | str, name: str = "place") -> tuple[DataFrame, int]:
    """The rows, written, with their place from 0 in this order, and how many they are.

    They are sorted by ranges, and a row's place is that in its range after the sizes of the ranges before; of these, one
    number a range comes to the driver.
    """
    # monotonically_increasing_id has the range above bit 33 and the place in it below
    table = staged(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    before, total = [], 0
    for r in sorted(table.groupBy(F.shiftright("_at", 33).alias("part")).count().collect()):
        before.append((r["part"], total))
        total += r["count"]
    first = table.sparkSession.createDataFrame(before, "_part long, _before long")
    placed = table.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(first), "_part")  # a row for each range
    return placed.withColumn(name, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1)).drop("_part", "_before", "_at"), total
