"""Notices with changed words that are spread out: few 3-grams stand, but enough words."""

import pytest

from fleetlens.llm import licenses


def test_notices_with_spread_changes(spark):
    short = "this work is xx under the gnu xx public license version 3"
    long = "this program is xx software you can xx it and or xx it under the terms xx the gnu general public license"
    less = "this work is xx under the gnu xx public license version xx"
    docs = spark.createDataFrame([(1, short), (2, long), (3, less)], "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].labels, got[1].n_base) == ("gpl-3.0", 0) and got[1].score == pytest.approx(0.9 * 10 / 12)
    assert got[2].labels == "gpl" and got[2].score == pytest.approx(1 - (1 - 0.9 * 18 / 22) * 0.1)
    assert got[3].labels == "" and got[3].score == 0
