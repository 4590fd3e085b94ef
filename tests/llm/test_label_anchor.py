"""The label model of toxic texts in several languages, whose words never stand together."""

import numpy as np
import pytest

from fleetlens.llm import toxicity


def drawn(seed, langs, n=12_000, english=10):
    """Votes of ten words of one language, which has most toxic texts, of a word of each other language, and of several, dense and no hits."""
    rng = np.random.default_rng(seed)
    toxic = rng.random(n) < 0.1
    lang = np.where(toxic, np.where(rng.random(n) < 0.4, rng.integers(1, langs + 1, n), 0), -1)
    words = np.zeros((n, english + langs))
    words[lang == 0, :english] = rng.random(((lang == 0).sum(), english)) < 0.5
    for k in range(1, langs + 1):
        words[lang == k, english + k - 1] = rng.random((lang == k).sum()) < 0.9
    own = words.sum(1)
    votes = np.hstack([words, np.stack([own >= 2, own >= 3, (own > 0) & (rng.random(n) < 0.6), own == 0], 1)])
    return lang, votes, np.where(rng.random(n) < 0.12, toxic, -1).astype(int)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("langs", [2, 4, 6])
def test_labels_hold_the_languages_in_one_class(seed, langs):
    lang, votes, labels = drawn(seed, langs)
    hit = votes[:, -1] == 0
    means, seconds = votes.mean(0), votes.T @ votes / len(votes)
    toxic = labels == 1
    more = votes[toxic].mean(0) - votes[labels == 0].mean(0)
    rate = toxic.sum() / (labels >= 0).sum()
    model = toxicity.fit_label_model(means, seconds, rate, more, int(toxic.sum())).calibrated(votes, labels)
    soft = model.posterior(votes, labels)
    assert (soft[toxic & hit] > 0.7).all() and (soft[labels == 0] < 0.3).all()
    # without the labels' part the toxic texts of all languages but one are taken for clean, whatever their label says
    alone = toxicity.fit_label_model(means, seconds, rate).calibrated(votes, labels).posterior(votes, labels)
    assert (alone[toxic & hit & (lang > 0)] < 0.5).all()


def test_training_hands_the_labels_to_the_label_model(spark, monkeypatch):
    """Of the texts with labels, toxic ones hold each word of a language in turn."""
    got = {}

    def fit(means, seconds, prior, known=None, toxic=0, *, plain=toxicity.fit_label_model):
        got["known"], got["toxic"] = known, toxic
        return plain(means, seconds, prior, known, toxic)

    monkeypatch.setattr(toxicity, "fit_label_model", fit)
    rows = [(i, "some plain words here " + ("" if i % 5 else "idiot" if i % 10 else "zwerq")) for i in range(600)]
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in toxicity.clean(docs, labels).select("doc_id").collect()}
    assert kept == {i for i in range(600) if i % 5}
    assert 0 < got["toxic"] < 120 and got["known"][0] == pytest.approx(0.5, abs=0.1) and got["known"][-1] == -1
