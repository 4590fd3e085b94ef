"""The search finds the nearest vectors also where codes can't tell them apart and where queries lie elsewhere than the rest."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import ann


def _tight(rng, n, d):
    return rng.normal(size=(6, d))[rng.integers(0, 6, n)] + rng.normal(size=(n, d)) * 0.002


def _elsewhere(rng, n, d):
    x = rng.normal(size=(1, d)) + rng.normal(size=(n, d)) * 0.3
    x[::20] = rng.normal(size=(len(x[::20]), d))
    return x


@pytest.mark.parametrize("make", [_tight, _elsewhere])
def test_recall_on_other_rows(spark, make):
    n, d = 3_000, 32
    x = make(np.random.default_rng(4), n, d)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = 0
    for i in range(0, n, 20):
        score = np.cumsum(x * x[i], axis=1)[:, -1]
        assert all(score[j] == s for j, s in got[i].items()) and len(got[i]) == 20
        hits += len(set(got[i]) & set([j for j in np.lexsort((np.arange(n), -score)) if j != i][:20]))
    assert hits >= 0.95 * n
