"""Lists of the index go to shards, and queries only to the shards that they probe."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import ann, neardup


def clustered(n, groups, d=16, seed=3):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, d)) * 3
    return (middle[rng.integers(0, groups, n)] + rng.normal(size=(n, d)) * 0.3).astype(np.float32)


@pytest.mark.parametrize("shard, block", [(32_768, 1_024), (90, 16)])
def test_clustered_vectors_need_few_lists(spark, monkeypatch, shard, block):
    monkeypatch.setattr(ann, "SHARD", shard)
    monkeypatch.setattr(ann, "BLOCK", block)
    x = clustered(4_000, 40)
    x[:1_000] = x[0] + np.random.default_rng(1).normal(size=(1_000, 16)) * 0.01  # a hot list, longer than a small shard
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df, F.col("id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    x = x.astype(np.float64)
    nearest = lambda i: [int(j) for j in np.argsort(-(x @ x[i]), kind="stable") if j != i][:20]
    hits = sum(len(got[i] & set(nearest(i))) for i in range(0, 4_000, 20))
    assert len(got) == 200 and all(len(v) == 20 for v in got.values())
    assert hits >= 0.9 * 20 * 200
    sample = x[np.random.default_rng(0).permutation(len(x))]
    centres = ann.kmeans(sample, 63)
    assert ann._share(sample, centres, ann._nearest(sample, centres), 20) < 0.2


def test_directions_without_clusters_need_most_lists():
    x = np.random.default_rng(5).normal(size=(3_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    centres = ann.kmeans(x, 54)
    assert 0.5 < ann._share(x, centres, ann._nearest(x, centres), 20) <= 1
    assert ann._share(x[:1], centres[:1], np.zeros(1, int), 20) == 1


def test_shards_hold_whole_lists_or_parts_of_long_ones(monkeypatch):
    monkeypatch.setattr(ann, "SHARD", 100)
    filled = np.array([30, 250, 60, 100, 0, 1, 99, 40])
    first, parts = ann._shards(np.random.default_rng(2).normal(size=(8, 4)), filled)
    assert parts.tolist() == [1, 3, 1, 1, 1, 1, 1, 1]
    held = np.zeros(first.max() + 3)
    for i in range(8):
        held[first[i] : first[i] + parts[i]] += filled[i] / parts[i]
    assert held.max() <= 100
    own = set(range(first[1], first[1] + 3))
    assert not own & {int(s) for i, s in enumerate(first) if i != 1 and filled[i]}


@pytest.mark.parametrize("widths", [(8, 32), (30, 32), (32, 32)])
def test_links_whatever_the_width_of_a_chunk(spark, monkeypatch, widths):
    """Chunks share a long of the code, or fill one; ids of two labels, copies and close pairs."""
    monkeypatch.setattr(neardup, "WIDTHS", widths)
    x = clustered(300, 30, d=24, seed=8).astype(np.float64)
    x[280:] = x[:20]
    rows = [(i, v.tolist(), i % 2 or None if i == 7 else i % 2) for i, v in enumerate(x)]
    got = {r.vec_id: r.n_links for r in neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    label = np.array([-1 - i if r[2] is None else r[2] for i, r in enumerate(rows)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    close = (x @ x.T >= 0.93) & (label[:, None] == label)
    want = close.sum(1) - 1
    assert sum(got.values()) >= 0.999 * want.sum() and all(got[i] <= n for i, n in enumerate(want))
