"""Ids of the public tokenizers, made word by word.

A BPE never merges over the borders that its pre-tokenizer draws, so the ids of a text are those of its pre-tokens, and
these recur: texts are split some MB at a time by Arrow, each distinct word of these is looked up once, and Arrow puts the ids in
their places. Each worker keeps the ids of the words it has met lately in Arrow arrays; new ones are made by the library.
Texts of plain ASCII and Latin-1 letters are split by ``re``; any other text, or one with ``<|``, with which strings of
special tokens begin, goes through the tokenizers library as a whole. There such a string becomes the special token's id.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from fleetlens.llm.common import claim

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

KEPT = 350_000
#: Words of which an encoder keeps the ids.
WORDS = 250_000
#: Bytes of text that are split together.
TOGETHER = 4 << 20


class Lately(dict):
    """What ``make`` gives for a key, kept for two generations of ``KEPT`` keys."""

    def __init__(self, make: Callable[[str], bytes], most: int = KEPT) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        out = self.old.get(key)
        if out is None:
            out = self.make(key)
        self[key] = out
        return out


class Known:
    """What ``make`` gives for keys, for whole arrays of distinct ones; when more than ``most`` are kept, the half that was
    met last stays.
    """

    def __init__(self, make: Callable[[list[str]], pa.Array], most: int) -> None:
        self.make, self.most = make, most
        self.keys, self.values = pa.array([], pa.string()), pa.array([], pa.large_binary())
        self.met, self.turn = np.zeros(0, np.int32), 0

    def of(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """All values, and where that of each key is among them; they hold until the next call."""
        if len(self.keys) > self.most:
            stay = pa.array(np.sort(np.argpartition(self.met, -(self.most // 2))[-(self.most // 2) :]))
            self.keys, self.values, self.met = self.keys.take(stay), self.values.take(stay), self.met[stay.to_numpy()]
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        new = np.flatnonzero(at < 0)
        at[new] = np.arange(len(self.keys), len(self.keys) + len(new))
        strange = keys.take(pa.array(new))
        self.keys, self.values = pa.concat_arrays([self.keys, strange]), pa.concat_arrays([self.values, self.make(strange.to_pylist())])
        self.turn += 1
        self.met = np.append(self.met, np.zeros(len(new), np.int32))
        self.met[at] = self.turn
        return self.values, at


#: Characters for which the fast way is known to be right: there, NFC changes nothing, lower case is one to one, and
#: re's classes equal Unicode's.
_OTHER = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]|<\\|")
#: A space before other white space or at the end.
_GAP = re.compile(r" (?:\s|\Z)")
#: Both, as Arrow's engine writes them.
_OTHER_RE2 = "[^\t-\r -~À-ÖØ-öø-ÿ]|<\\|"
_GAP_RE2 = r" [\t-\r ]| \z"
#: How each vocabulary file splits a text of those characters; a file that isn't named here always goes the slow way.
_SPLITS = {
    "byte_bpe_50k.json": (False, re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:_|[^\s\w])+|\s+(?!\S)|\s+")),
    "word_bpe_49k.json": (True, re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:_|[^\s\w])+")),
}


def _byte_chars() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Encoder:
    """Ids of whole texts by a file of the tokenizers library."""

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.lower, self.split = _SPLITS.get(os.path.basename(path), (False, None))
        self.chars = dict(enumerate(_byte_chars()))
        self.words = Known(self._made_words, WORDS)
        self.slow = _OTHER_RE2 if self.lower else f"{_OTHER_RE2}|{_GAP_RE2}"

    @classmethod
    def at(cls, path: str) -> Encoder:
        """One a worker process: it lives as long as the worker."""
        claim("bpe", cls._made.clear)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _made_words(self, words: list[str]) -> pa.Array:
        """Ids of words, by the library's model."""
        tokenize, ids, ends = self.model.tokenize, array("I"), array("q", [0])
        for word in words:
            if not word.isascii() or not word.removeprefix(" ").isalpha():
                word = word.encode().decode("latin-1").translate(self.chars)
            elif word[0] == " ":
                word = "Ġ" + word[1:]
            ids.extend([t.id for t in tokenize(word)])
            ends.append(4 * len(ids))
        return pa.Array.from_buffers(pa.large_binary(), len(words), [None, pa.py_buffer(ends), pa.py_buffer(ids)])

    def ids(self, text: str) -> bytes:
        """Unsigned 32-bit ids, in the machine's order of bytes; an empty text has none."""
        return self.all_ids(pa.array([text]))[0]

    def _slowly(self, text: str) -> bytes:
        if self.split is None or _OTHER.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return self._joined(pa.array([], pa.string()), [self.split.findall(text)])[0].as_py()

    def _joined(self, alone: pa.Array, lists: list[list[str]]) -> pa.Array:
        """Ids of words, then of lists of words."""
        words = pa.concat_arrays([alone, pa.array([w for x in lists for w in x], pa.string())]).dictionary_encode()
        values, at = self.words.of(words.dictionary)
        flat = values.take(pa.array(at[words.indices.to_numpy()]))
        ends = np.cumsum([len(alone), *map(len, lists)])
        places = np.frombuffer(flat.buffers()[1], np.int64)
        ends = np.concatenate([places[: len(alone)], places[ends]])
        return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(ends), flat.buffers()[2]])

    def all_ids(self, texts: pa.Array) -> list[bytes]:
        """``ids`` of each text, a null one being empty.

        No pre-token goes over a space that stands alone, so what lies between spaces is looked up as a whole.
        """
        texts = pc.fill_null(texts, "")
        if self.split is None:
            return list(map(self._slowly, texts.to_pylist()))
        slow = pc.match_substring_regex(texts, self.slow).to_numpy(zero_copy_only=False)
        out = [b""] * len(texts)
        for k in np.flatnonzero(slow).tolist():
            out[k] = self._slowly(texts[k].as_py())
        fast = np.flatnonzero(~slow)
        for k, got in zip(fast.tolist(), self._together(texts.take(pa.array(fast))), strict=True):
            out[k] = got
        return out

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of texts that go the fast way."""
        ends = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
        at = 0
        while at < len(texts):
            n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")) - at)
            some = texts.slice(at, n)
            lists = pc.ascii_split_whitespace(pc.utf8_lower(some)) if self.lower else pc.split_pattern(some, " ")
            chunks, starts = lists.flatten(), lists.offsets.to_numpy()
            coded = chunks.dictionary_encode()
            codes = coded.indices.to_numpy()
            alone = pc.utf8_is_alpha(coded.dictionary).to_numpy(zero_copy_only=False)
            order = np.argsort(~alone, kind="stable")  # chunks that are one word come first
            words, mixed = (coded.dictionary.take(pa.array(x)) for x in (order[: alone.sum()], order[alone.sum() :]))
            codes = np.argsort(order)[coded.indices.to_numpy()]
            if self.lower:
                values = self._joined(words, list(map(self.split.findall, mixed.to_pylist())))
            else:  # byte-level words take the space before them along; before the first one of a text there is none
                codes[starts[:-1]] = np.arange(len(order), len(order) + n)
                firsts = chunks.take(pa.array(starts[:-1])).to_pylist()
                values = self._joined(pc.binary_join_element_wise(" ", words, ""), [self.split.findall(x) for x in chain((f" {c}" for c in mixed.to_pylist()), firsts)])
            flat = values.take(pa.array(codes))
            _, places, data = flat.buffers()
            cuts = np.frombuffer(places, np.int64)[starts].tolist()
            view = memoryview(data) if data else memoryview(b"")
            yield from (bytes(view[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True))
            at += n


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
