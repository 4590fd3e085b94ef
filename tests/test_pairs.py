"""Pairs of units with many of one root: counted without being made, and dealt to many tasks if made."""

from pyspark.sql import functions as F

from fleetlens.operators import pairs

UNITS = "ord long, name string, repo_url string, has_containers boolean, library_names array<string>"


def test_counts_equal_the_pairs(spark):
    urls, libs = ["https://h/a.git", "https://h/a/", "https://h/b", "", None, ".git"], [["app_1"], [], None, ["x", "app-2-k8s"]]
    rows = [(i, f"app-{i % 3}" + ("-k8s" if i % 2 else "-operator"), urls[i % 6 if i % 5 else 0], bool(i % 2) or None, libs[i // 7 % 4]) for i in range(120)]
    rows += [(200, "other-k8s", "u", True, []), (201, "othex", "u/", False, ["other"]), (202, None, "u", True, []), (203, None, "u", False, [])]
    u = spark.createDataFrame(rows, UNITS)
    made = pairs.find_pairs(u).groupBy("root", "k8s_name", "confidence").agg(F.count("*").alias("n"), F.count_if("same_repo").alias("same_repo"), F.count_if("shares_charmlib").alias("shares_charmlib"))
    got = sorted(map(tuple, pairs.pair_counts(u).collect()))
    assert got == sorted(map(tuple, made.collect())) and len(got) == 4
    assert any(r[4] for r in got) and any(0 < r[5] < r[3] for r in got)


def test_a_root_of_many_units_is_counted_without_its_pairs(spark):
    half = 200_000
    u = spark.range(2 * half).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "app-k8s").otherwise("app").alias("name"), F.lit("u").alias("repo_url"), (F.col("id") % 2 == 0).alias("has_containers"), F.array(F.lit("app")).alias("library_names"))
    assert [tuple(r) for r in pairs.pair_counts(u).collect()] == [("app", "app-k8s", "high", half**2, half**2, half**2)]


def test_the_pairs_of_a_root_are_dealt_to_tasks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "CELL", 5_000)
    u = spark.range(1_000).select(F.col("id").alias("ord"), F.when(F.col("id") % 2 == 0, "app-k8s").otherwise("app").alias("name"), F.lit("").alias("repo_url"), (F.col("id") % 2 == 0).alias("has_containers"), F.array().cast("array<string>").alias("library_names"))
    sizes = [r["count"] for r in pairs.find_pairs(u).groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 250_000 and max(sizes) < 80_000
