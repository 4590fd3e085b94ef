"""Rows that share an id but not the text: only texts that another stands for go."""

from fleetlens.llm import ngramjoin


def text(name, changed=0):
    return " ".join([f"{name}{k}" for k in range(60 - changed)] + [f"new{k}" for k in range(changed)])


def test_unlike_texts_of_an_id_stay(spark):
    rows = [
        (1, text("a")), (2, text("a")), (2, text("b")), (3, text("b", 1)),  # 2's second text stands for 3
        (4, text("c")), (4, text("d")), (4, text("d")), (5, text("e")), (5, text("e", 1)), (6, ""), (6, " "), (6, None), (7, text("f")), (7, text("f")), (None, text("a")), (None, text("a")),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, more string")
    got = ngramjoin.one_of_each(docs)
    assert got.columns == docs.columns
    kept = sorted(((r.doc_id or 0, (r.text or " ").split()[:1]) for r in got.collect()))
    assert kept == [(0, ["a0"]), (0, ["a0"]), (1, ["a0"]), (2, ["b0"]), (4, ["c0"]), (4, ["d0"]), (5, ["e0"]), (6, []), (7, ["f0"])]
