"""Short vectors and many lengths: no pair is missed for want of tables, no length is left out."""

import numpy as np
from pyspark.sql import functions as F

from fleetlens.llm import neardup


def test_links_of_short_vectors(spark):
    rng = np.random.default_rng(6)
    rows = []
    for d in (3, 16):
        x = rng.normal(size=(400, d))
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        y = rng.normal(size=(400, d))
        y -= (x * y).sum(1, keepdims=True) * x
        y = 0.935 * x + (1 - 0.935**2) ** 0.5 * y / np.linalg.norm(y, axis=1, keepdims=True)
        # a label a pair, so links are those planted
        rows += [(len(rows) + k, v.tolist(), d * 1000 + k % 400) for k, v in enumerate(np.vstack([x, y]).astype(np.float32))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).where("n_links = 1").count()
    assert got >= 0.999 * len(rows)


def test_all_lengths_count(spark):
    classes = spark.range(1, 1102, 1, 1).select(F.col("id").cast("int").alias("d"))
    got = neardup.over_lengths(classes, classes.limit(0), lambda own, d: own)
    assert got.count() == 1101
