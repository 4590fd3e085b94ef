"""Ids of batches of texts: equal to the library's, with words and memory of a worker bounded."""

import random
from array import array

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from fleetlens.llm import bpe
from fleetlens.llm.bpe import Encoder, Known, public_path

ODD = [None, "", " ", "x", " x", "x ", "a  b", "a \n b", "foo, bar. foo,", "it's 's\t\tx", "a_b 12 3² ½", "É é à Öß ÿ × ÷ x×y", "Ae\x0bb", "\n\n", "a\r\nb", "<|endoftext|> a", "日本語 text", "a\x85b \xa0 c", "\x1c a", "é x", "A'S o'RE don't"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_batches_equal_the_library(name, monkeypatch):
    monkeypatch.setattr(bpe, "TOGETHER", 300)
    encoder, own = Encoder(public_path(name)), Tokenizer.from_file(public_path(name))
    encoder.words.most = 40
    draw = random.Random(5)
    signs = ["a", "B", "th", "é", "ß", "7", "_", ",", ".", "'s", " ", " ", "  ", "\n", "\t", "×", "日", "<|"]
    texts = [*ODD, *("".join(draw.choices(signs, k=draw.randrange(60))) for _ in range(400)), "long " * 500]
    want = [own.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [list(array("I", x)) for x in encoder.all_ids(pa.array(texts))] == want
    assert [list(array("I", x)) for x in encoder.all_ids(pa.array(texts).slice(3, 50))] == want[3:53]
    assert [list(array("I", encoder.ids(t or ""))) for t in texts[:30]] == want[:30]
    assert encoder.all_ids(pa.array([], pa.string())) == []


def test_known_words_are_bounded_and_made_once():
    made = []

    def make(keys):
        made.extend(keys)
        return pa.array([k.encode() for k in keys], pa.large_binary())

    known = Known(make, 100)
    for k in range(50):
        keys = ["the", "of", *(f"w{k}-{j}" for j in range(20))]
        values, at = known.of(pa.array(keys))
        assert values.take(pa.array(at)).to_pylist() == [x.encode() for x in keys]
        assert len(known.keys) <= 100 + len(keys)
    assert made.count("the") == made.count("of") == 1


def test_a_recurring_word_is_looked_up_once_a_batch(monkeypatch):
    encoder = Encoder(public_path("byte_bpe_50k.json"))
    asked = []
    of = encoder.words.of
    monkeypatch.setattr(encoder.words, "of", lambda keys: (asked.append(len(keys)), of(keys))[1])
    encoder.all_ids(pa.array(["one two, three two. " * 50 + "end"] * 40))
    assert sum(asked) < 20
