"""Operator 13, BPE encoding and decoding: speculate and verify.

A text falls into pre-tokens (words), over whose borders no merge goes. For words that a worker hasn't met lately the longest
matches, taken greedily from the left, are proposed (one run of an automaton over all new words of a batch). A sequence of tokens is what BPE gives exactly if each two neighbours
are compatible: if merging their bytes alone gives these two tokens. Merges go by rising rank, so that is read off
the derivations of both: from the whole tokens back to their bytes, the last merge is undone step by step, on the right side
of the left token or on the left side of the right one; at no step may a merge over the border have a rank that
comes before the merge undone last. All neighbours of all new words of a batch walk at once, in numpy. Only words in which
a pair fails are merged exactly: short ones all at once, a merge of each a step, long ones by a heap of ranks in O(n log n). Merges that don't rise from parts to wholes, or that make a
token twice, would break the argument; then every word is merged exactly.

Decoding joins the tokens' bytes and reads them as UTF-8, with the replacement character for what isn't.

Nulls and edges: a null text is an empty text, of no ids; null ids decode to an empty text; very long texts and words
are taken whole; strings of special tokens become their id; ids that the vocabulary doesn't have decode to nothing; repeated
rows give a row each; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.bpe import _GAP, _SPLITS, KEPT, Lately, _byte_chars
from fleetlens.llm.common import claim, small_batches, with_text

#: Texts whose new words are proposed and checked together, bytes of a short word, and verdicts on pairs that a worker keeps.
TOGETHER, SHORT, VERDICTS = 256, 64, 1 << 20
_NEVER = 1 << 40
#: Stands between words; no byte is read as this character.
_BORDER = "\u0100"
#: Where a text has one of these, the library's own pre-tokenizer splits it.
_ODD = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")


class Codec:
    """A byte-level BPE of a file of the tokenizers library."""

    _made: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        model, split = made["model"], made["pre_tokenizer"] or {}
        if model["type"] != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or made["normalizer"] or any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in made["added_tokens"]):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.pre_tokenizer = Tokenizer.from_file(path).pre_tokenizer
        self.split = _SPLITS.get(os.path.basename(path), (False, None))[1]
        self.special = {a["content"]: a["id"] for a in made["added_tokens"]}
        self.borders = re.compile(f"({'|'.join(map(re.escape, sorted(self.special, key=len, reverse=True)))})") if self.special else None
        of = {c: b for b, c in enumerate(_byte_chars())}
        raw = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.id_of = {b: i for i, b in raw.items()}
        self.byte_ids = np.array([self.id_of.get(bytes([b]), -1) for b in range(256)])
        n = max([*raw, *self.special.values()], default=-1) + 1
        whole = raw | {i: s.encode() for s, i in self.special.items()}
        self.bytes_of = [whole.get(i, b"") for i in range(n)]
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.array([*map(len, self.bytes_of), 0], np.int64)  # an id that isn't in the file has no bytes
        self.first = np.cumsum(self.size) - self.size
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        vocab = model["vocab"]
        self._derive([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], n)
        self.words = Lately(self._word, KEPT // 3)
        self.chunks = Lately(self._chunk)
        self.ready: dict[str, bytes] = {}
        self.found: dict[str, list[str]] = {}
        self.seen, self.verdict = np.full(VERDICTS, -1), np.zeros(VERDICTS, bool)
        self.proposed = self.failed = 0

    @classmethod
    def at(cls, path: str) -> Codec:
        """One a worker process."""
        claim("speculate", cls._made.clear)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def _derive(self, merges: list[tuple[int, int, int]], n: int) -> None:
        """Which two tokens each one was merged from and at what rank; the pairs' ranks as a sorted table."""
        self.rank, self.left, self.right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
        self.merges = {(a, b): (r, c) for r, (a, b, c) in enumerate(merges)}
        a, b, c = self.product_of = np.array(merges, np.int64).reshape(-1, 3).T
        self.left[c], self.right[c], self.rank[c] = a, b, np.arange(len(c))
        key = a << 32 | b
        order = np.argsort(key, kind="stable")
        self.pairs, self.pair_ranks = np.append(key[order], np.iinfo(np.int64).max), np.append(order, _NEVER)
        rises = len(np.unique(c)) == len(np.unique(key)) == len(c) and bool((np.maximum(self.rank[a], self.rank[b]) < np.arange(len(c))).all())
        # a token may be proposed if its own bytes are merged into it; by rising rank, so what is said of its parts is known
        sound = np.zeros(n, bool)
        sound[self.byte_ids[self.byte_ids >= 0]] = True
        for x, y, z, ok in zip(a.tolist(), b.tolist(), c.tolist(), self.apart(a, b, np.arange(len(c))).tolist(), strict=True):
            sound[z] = rises and ok and sound[x] and sound[y]
        self.automaton = ahocorasick.Automaton()
        self.automaton.add_word(_BORDER, -1)
        for w, i in self.id_of.items():
            if w and sound[i]:
                self.automaton.add_word(w.decode("latin-1"), i)
        self.automaton.make_automaton()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], _NEVER)

    def apart(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | int = _NEVER) -> np.ndarray:
        """Whether these neighbours stay apart when their bytes are merged, by merges of a rank under ``below`` only."""
        out, live = np.ones(len(a), bool), np.arange(len(a))
        a, b = a.copy(), b.copy()
        by_a = by_b = np.broadcast_to(np.asarray(below, np.int64), a.shape)
        by_a, by_b = by_a.copy(), by_b.copy() - 1  # what takes a comes first among equals, what takes b last
        while len(live):
            across = self.ranks(a, b)
            crossed = (across < by_a) & (across <= by_b)
            out[live[crossed]] = False
            ra, rb = self.rank[a], self.rank[b]
            go = ~crossed & (np.maximum(ra, rb) >= 0)
            live, a, b, by_a, by_b, ra, rb = (x[go] for x in (live, a, b, by_a, by_b, ra, rb))
            undo = ra > rb
            by_a, by_b = np.where(undo, ra, by_a), np.where(undo, by_b, rb)
            a, b = np.where(undo, self.right[a], a), np.where(undo, b, self.left[b])
        return out

    def fit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether these tokens can be neighbours; the verdicts met last are kept, one for each value of a hash."""
        key = a << 32 | b
        slot = (a * 0x9E3779B1 + b * 0x85EBCA77) % VERDICTS
        new = np.flatnonzero(self.seen[slot] != key)
        out = self.verdict[slot]
        if len(new):
            fresh, back = np.unique(key[new], return_inverse=True)
            out[new] = self.apart(fresh >> 32, fresh & 0xFFFFFFFF)[back]
            self.seen[slot[new]] = -1
            self.verdict[slot[new]], self.seen[slot[new]] = out[new], key[new]  # of two with the same slot the last one's, both times
        return out

    def merged(self, word: bytes) -> list[int]:
        """Exact merging: always the pair of the lowest rank, of equal ones the first."""
        ids = [i for i in self.byte_ids[np.frombuffer(word, np.uint8)].tolist() if i >= 0]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        merges = self.merges
        heap = [(*m, k, ids[k], ids[k + 1]) for k in range(len(ids) - 1) if (m := merges.get((ids[k], ids[k + 1])))]
        heapify(heap)
        while heap:
            _, new, k, a, b = heappop(heap)
            other = after[k]
            if ids[k] != a or other >= len(ids) or ids[other] != b:
                continue  # one of them is gone
            ids[k], ids[other] = new, -1
            after[k] = after[other]
            if after[k] < len(ids):
                before[after[k]] = k
                if m := merges.get((new, ids[after[k]])):
                    heappush(heap, (*m, k, new, ids[after[k]]))
            if before[k] >= 0 and (m := merges.get((ids[before[k]], new))):
                heappush(heap, (*m, before[k], ids[before[k]], new))
        return [i for i in ids if i >= 0]

    def merged_together(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging of many words: at each step the pair of the lowest rank of each word. Ids, and the word of each."""
        ids = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        of = np.repeat(np.arange(len(words)), [len(w) for w in words])[ids >= 0]
        ids = ids[ids >= 0]
        rank = np.full(len(ids), _NEVER)
        same = np.flatnonzero(of[1:] == of[:-1])
        rank[same] = self.ranks(ids[same], ids[same + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.append(first, len(ids))))
            keep = low < _NEVER
            done.append((ids[~keep], of[~keep]))
            hit = np.flatnonzero(keep & (rank == low))
            hit = hit[np.concatenate([[True], of[hit[1:]] != of[hit[:-1]]])[: len(hit)]]
            ids[hit] = self.product_of[2][rank[hit]]
            keep[hit + 1] = False
            at = (np.cumsum(keep) - 1)[hit]
            ids, of, rank = ids[keep], of[keep], rank[keep]
            rank[at] = _NEVER
            at = np.concatenate([at, at[at > 0] - 1])
            at = at[at + 1 < len(ids)]
            at = at[of[at] == of[at + 1]]
            rank[at] = self.ranks(ids[at], ids[at + 1])
        ids, of = (np.concatenate(x) if done else np.zeros(0, np.int64) for x in (zip(*done, strict=True) if done else ((), ())))
        order = np.argsort(of, kind="stable")
        return ids[order], of[order]

    def encoded(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word: proposed, all pairs of neighbours checked at once, merged exactly where one fails."""
        joined = "".join([w.decode("latin-1") + _BORDER for w in words])
        got = np.fromiter(map(itemgetter(1), self.automaton.iter_long(joined)), np.int64)
        border = got < 0
        of = (np.cumsum(border) - border)[~border]
        ids = got[~border]
        size = np.array([len(w) for w in words], np.int64)
        failed = np.bincount(of, self.size[ids], len(words)) != size  # a byte that begins no match
        inner = np.flatnonzero(of[1:] == of[:-1])
        failed[of[inner[~self.fit(ids[inner], ids[inner + 1])]]] = True
        self.proposed, self.failed = self.proposed + len(words), self.failed + int(failed.sum())
        out: list[bytes] = [b""] * len(words)

        def put(which: np.ndarray, ids: np.ndarray, of: np.ndarray) -> None:
            data, ends = ids.astype("<u4").tobytes(), 4 * np.searchsorted(of, which, "right")
            for k, a, b in zip(which.tolist(), (4 * np.searchsorted(of, which)).tolist(), ends.tolist(), strict=True):
                out[k] = data[a:b]

        put(np.flatnonzero(~failed), ids, of)
        short = np.flatnonzero(failed & (size <= SHORT))
        ids, of = self.merged_together([words[k] for k in short])
        put(short, ids, short[of])
        for k in np.flatnonzero(failed & (size > SHORT)).tolist():
            out[k] = array("I", self.merged(words[k])).tobytes()
        return out

    def _word(self, word: str) -> bytes:
        out = self.ready.get(word)
        return self.encoded([word.encode()])[0] if out is None else out

    def _chunk(self, chunk: str) -> bytes:
        """Ids of what stands between two spaces, with the space before it."""
        words = self.found.get(chunk) or self.split.findall(f" {chunk}")
        alone = self.ready.get(words[0]) if len(words) == 1 else None  # a lone word is kept once, as a chunk
        return b"".join(map(self.words.__getitem__, words)) if alone is None else alone

    def _parts(self, text: str) -> Iterator[tuple[str, list[str]]]:
        """A part's kind and what it consists of: the id of a special string, words, or chunks after the first words."""
        for part in filter(None, self.borders.split(text) if self.borders else [text]):
            if part in self.special:
                yield "special", [part]
            elif self.split is None or _ODD.search(part):
                yield "words", [part[a:b] for _, (a, b) in self.pre_tokenizer.pre_tokenize_str(part)]
            elif _GAP.search(part):
                yield "words", self.split.findall(part)
            else:
                first, *rest = part.split(" ")
                yield "words", self.split.findall(first)
                yield "chunks", rest

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as unsigned 32-bit integers."""
        parts = [list(self._parts(t or "")) for t in texts]
        new: set[str] = set()
        for kind, what in (p for text in parts for p in text):
            if kind == "words":
                new.update(w for w in what if w not in self.words)
            elif kind == "chunks":
                for c in set(what):
                    if c not in self.chunks:
                        self.found[c] = words = self.split.findall(f" {c}")
                        new.update(w for w in words if w not in self.words)
        order = list(new)
        self.ready = dict(zip(order, self.encoded([w.encode() for w in order]), strict=True))
        look = {"words": self.words.__getitem__, "chunks": self.chunks.__getitem__, "special": lambda s: array("I", [self.special[s]]).tobytes()}
        out = [b"".join([x for kind, what in text for x in map(look[kind], what)]) for text in parts]
        self.ready, self.found = {}, {}
        return out

    def decode(self, ids: list[bytes | None]) -> list[str]:
        """The texts of packed ids."""
        flat = np.minimum(np.frombuffer(b"".join([x or b"" for x in ids]), "<u4"), len(self.bytes_of)).astype(np.int64)
        size = self.size[flat]
        ends = np.cumsum(size)
        data = self.flat[np.arange(int(size.sum())) + np.repeat(self.first[flat] - (ends - size), size)].tobytes()
        upto = np.append(0, ends)[np.cumsum([0] + [len(x or b"") // 4 for x in ids])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(upto, upto[1:], strict=False)]


_IDS, _ALL = [("id", pa.int64()), ("ids", pa.binary())], [("id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())]


def encoded(docs: DataFrame, path: str, *, decode: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, ids`` (little-endian unsigned 32-bit integers, packed) of each document, and with ``decode`` their text again as ``decoded``."""
    schema = pa.schema(_ALL if decode else _IDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                ids = codec.encode(part["text"].to_pylist())
                columns = [part["id"], pa.array(ids, pa.binary())] + ([pa.array(codec.decode(ids), pa.string())] if decode else [])
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return with_text(docs, id_col, text_col).mapInArrow(run, "id long, ids binary" + (", decoded string" if decode else ""))


def decoded(rows: DataFrame, path: str, *, id_col: str = "id", ids_col: str = "ids") -> DataFrame:
    """``id, text`` of packed ids."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(codec.decode(batch["ids"].to_pylist()), pa.string())], names=["id", "text"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string")
