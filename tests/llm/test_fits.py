"""What the two classifiers are fitted to: the label model over all documents, the sample of lines without gaps."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import quality, toxicity
from fleetlens.llm.common import written


def drawn(seed, n=20_000, rate=0.2):
    rng = np.random.default_rng(seed)
    toxic = rng.random(n) < rate
    if_toxic, if_clean = rng.uniform(0.1, 0.4, 15), rng.uniform(0.001, 0.01, 15)
    votes = (rng.random((n, 15)) < np.where(toxic[:, None], if_toxic, if_clean)).astype(float)
    votes = np.hstack([votes, votes[:, :1], (votes.sum(1) == 0)[:, None]])
    labels = np.full(n, -1)
    labels[:2000] = toxic[:2000] ^ (rng.random(2000) < 0.03)
    return if_toxic, if_clean, votes, labels, toxicity.fit_label_model(votes.mean(0), votes.T @ votes / n, rate)


@pytest.mark.parametrize("seed", [1, 2, 3, 4, 8])
def test_calibration_brings_the_moments_nearer(seed):
    if_toxic, if_clean, votes, labels, model = drawn(seed)
    after = model.calibrated(votes, labels)
    error = lambda m: max(np.abs(m.if_toxic[:15] - if_toxic).max(), np.abs(m.if_clean[:15] - if_clean).max())
    assert error(after) < 0.03 and error(after) <= error(model)
    assert np.abs(after.if_toxic - model.calibrated(votes[:2000], labels[:2000]).if_toxic).max() > 1e-4, "unlabelled documents count"


def test_patterns_on_spark_give_the_same_model(spark):
    *_, votes, labels, model = drawn(5, 3000)
    bits = (votes.astype(np.int64) << np.arange(votes.shape[1])).sum(1)
    rows = spark.createDataFrame([(int(b), int(x)) for b, x in zip(bits, labels, strict=True)], "pattern long, label int")
    got = model.calibrated_on(written(rows.groupBy("pattern", "label").agg(F.count("*").alias("n")), "patterns"), 4)
    want = model.calibrated(votes, labels, 4)
    for a, b in zip(got, want, strict=True):
        assert a == pytest.approx(b)


@pytest.mark.parametrize("rank", [0, 3, 17, 39])
def test_one_long_document_leaves_no_other_out(spark, rank):
    ids = [r.id for r in spark.range(40).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, "\n".join([f"Good line {i} of a text." if i % 2 else "### $$ |||"] * (2000 if i == ids[rank] else 4))) for i in ids]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in ids], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels, lines=170)
    good, bad = quality.score_texts(field, [b"Good line of a text.", b"### $$ |||"])
    assert good > 0.8 and bad < 0.2


def test_shares_of_lines():
    assert quality.share_of([(4, 35), (200, 1)], 170) == 30  # 35 * 4 and 30 of the long one
    assert quality.share_of([(4, 35), (200, 1)], 340) == 200 and quality.share_of([(4, 36)], 72) == 2 and quality.share_of([], 9) == 0
