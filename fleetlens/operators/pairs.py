"""Pairs of a unit for containers and one for machines: equal roots, else the nearest by edit distance.

The fuzzy side never crosses all with all: two roots within ``d`` edits have lengths that differ by ``d`` at most, and of
``d + 1`` pieces of one, one stands unchanged in the other, moved by ``d`` places at most (pigeonhole). So both sides meet
on (length, piece, place), which is an equality join, and the distance is checked there. Roots are compared, not units.

Pairs of equal roots are as many as the product of both sides. A root's pairs are dealt to as many cells as it takes for some
``CELL`` rows in each; equal machine units are one row with a count until the end. ``pair_counts`` gets by without the pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.text import k8s_root, library_root, machine_root
from fleetlens.plans.staging import staged

DISTANCE = 2
#: Pairs in a cell, about, and cells in a task.
CELL, CELLS = 1_000_000, 4


def _pieces(d: int) -> str:
    """d + 1 pieces of a root, with the place at which each begins."""
    cut = lambda i: f"(length(root) * {i} div {d + 1})"
    return "array(" + ", ".join(f"struct({i} as p, substring(root, {cut(i)} + 1, {cut(i + 1)} - {cut(i)}) as piece)" for i in range(d + 1)) + ")"


def _sides(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Units for containers and others, with roots."""
    k8s = units.where("has_containers").select(F.col("ord").alias("k"), F.col("name").alias("k8s_name"), F.col("repo_url").alias("k8s_url"), F.col("library_names").alias("k8s_libs"), k8s_root(F.col("name")).alias("root"))
    machine = units.where(~F.coalesce(F.col("has_containers"), F.lit(False))).select(F.col("ord").alias("m"), F.col("name").alias("machine_name"), F.col("repo_url").alias("machine_url"), F.col("library_names").alias("machine_libs"), machine_root(F.col("name")).alias("root"))
    return k8s, machine


def _bare(url: str) -> Column:
    return F.regexp_replace(F.regexp_replace(url, r"\.git$", ""), "/+$", "")


def _same_repo() -> Column:
    return F.coalesce((F.coalesce("k8s_url", F.lit("")) != "") & (_bare("k8s_url") == _bare("machine_url")), F.lit(False))


def _shares(libs: str) -> Column:
    return F.exists(F.coalesce(libs, F.array().cast("array<string>")), lambda x: F.coalesce(library_root(x) == F.col("root"), F.lit(False)))


def _described() -> list[Column | str]:
    return ["root", "k8s_name", "machine_name", "k8s_url", "machine_url", "confidence", _same_repo().alias("same_repo"), (_shares("k8s_libs") | _shares("machine_libs")).alias("shares_charmlib")]


def _medium(k8s: DataFrame, machine: DataFrame, distance: int) -> DataFrame:
    """Units for containers without a machine unit of their root, each with the nearest one."""
    left = k8s.join(machine.select("root").distinct(), "root", "left_anti")
    roots = machine.groupBy("root").agg(F.min("m").alias("m"))  # nearest and first: of equal roots only the first can win
    asking = left.select(F.col("root").alias("ask")).distinct()
    ask = asking.select("ask", F.col("ask").alias("root")).select("ask", F.explode(F.sequence(F.length("root") - distance, F.length("root") + distance)).alias("size"), F.explode(F.expr(_pieces(distance))).alias("x")).where("size >= 0")
    # a piece of the asking root at place q may stand in the other from q - d to q + d
    begin = F.expr(f"length(ask) * x.p div {distance + 1}")
    ask = ask.select("ask", "size", "x.piece", F.explode(F.sequence(begin - distance, begin + distance)).alias("at"))
    sizes = asking.select(F.col("ask").alias("root")).select(F.explode(F.expr(_pieces(distance))).alias("x")).select(F.length("x.piece").alias("n")).distinct()
    have = roots.join(F.broadcast(sizes), F.col("n") <= F.length("root")).select("m", "root", F.length("root").alias("size"), F.explode(F.sequence(F.lit(0), F.length("root") - F.col("n"))).alias("at"), "n")
    have = have.withColumn("piece", F.expr("substring(root, at + 1, n)")).drop("n")
    near = ask.join(have, ["size", "piece", "at"]).select("ask", "m", F.levenshtein("ask", "root", distance).alias("d")).where("d >= 0")
    best = near.groupBy(F.col("ask").alias("root")).agg(F.min(F.struct("d", "m")).alias("b")).select("root", "b.m")
    return left.join(best, "root").join(machine.drop("root"), "m").withColumn("confidence", F.lit("medium"))


def find_pairs(units: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``units``: ord, name, repo_url, has_containers, library_names. Ordered by confidence, root and name by the caller."""
    k8s, machine = _sides(units)
    medium = _medium(k8s, machine, distance)
    medium = medium.select(*_described())
    classes = staged(machine.groupBy("root", "machine_name", "machine_url", "machine_libs").agg(F.count("*").alias("n")))
    cells = k8s.groupBy("root").agg(F.count("*").alias("asking")).join(classes.groupBy("root").agg(F.sum("n").alias("n")), "root")
    cells = staged(cells.select("root", F.ceil(F.col("asking") * F.col("n") / CELL).cast("int").alias("cells")))
    total = cells.agg(F.sum("cells")).first()[0] or 0
    tasks = max(1, min(total, max(-(-total // CELLS), units.sparkSession.sparkContext.defaultParallelism)))
    own = k8s.join(cells, "root").withColumn("cell", F.pmod(F.xxhash64("k"), "cells").cast("int")).drop("cells").repartition(tasks, "root", "cell")
    others = classes.join(cells, "root").withColumn("cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1))).drop("cells").repartition(tasks, "root", "cell")
    high = own.join(others, ["root", "cell"]).withColumn("confidence", F.lit("high"))
    high = high.select(*_described(), "n").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    return high.unionByName(medium)


def pair_counts(units: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``root, k8s_name, confidence, n, same_repo, shares_charmlib``: how many pairs, and how many of these are such, without making them."""
    k8s, machine = _sides(units)
    medium = _medium(k8s, machine, distance)
    medium = medium.select(*_described()).groupBy("root", "k8s_name", "confidence")
    medium = medium.agg(F.count("*").alias("n"), F.count_if("same_repo").alias("same_repo"), F.count_if("shares_charmlib").alias("shares_charmlib"))
    # pairs that share no library are of two units that have none
    left = k8s.groupBy("root", "k8s_name").agg(F.count("*").alias("n"), F.count_if(~_shares("k8s_libs")).alias("bare"))
    right = machine.groupBy("root").agg(F.count("*").alias("m"), F.count_if(~_shares("machine_libs")).alias("m_bare"))
    here = k8s.where(F.coalesce("k8s_url", F.lit("")) != "").groupBy("root", "k8s_name", _bare("k8s_url").alias("at")).agg(F.count("*").alias("here"))
    there = machine.where(F.col("machine_url").isNotNull()).groupBy("root", _bare("machine_url").alias("at")).agg(F.count("*").alias("there"))
    same = here.join(there, ["root", "at"]).groupBy("root", "k8s_name").agg(F.sum(F.col("here") * F.col("there")).alias("same_repo"))
    high = left.join(right, "root").join(same, ["root", "k8s_name"], "left")
    high = high.select("root", "k8s_name", F.lit("high").alias("confidence"), (F.col("n") * F.col("m")).alias("n"), F.coalesce("same_repo", F.lit(0)).alias("same_repo"), (F.col("n") * F.col("m") - F.col("bare") * F.col("m_bare")).alias("shares_charmlib"))
    return high.unionByName(medium)


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.orderBy(F.col("confidence") != "high", "root", "k8s_name")
