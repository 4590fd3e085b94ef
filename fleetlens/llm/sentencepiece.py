"""Operator 8, SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds all pieces of the vocabulary. Going through a text once, it reports at every position, by following
output links, each piece that ends there; the best score at that position is relaxed with the best score at the piece's
start plus the piece's score. Where no piece covers a character its bytes are the pieces of byte fallback. Ties go to the
longer last piece. That is the segmentation of greatest score, the library's for a unigram model; the library's BPE mode
merges by rank instead and can differ from it (see README).

In a vocabulary whose pieces carry the space mark only in front no piece crosses from a word to the next space, so the
best path of a text is those of its words, joined; each worker keeps the paths of words it has met.

Nulls and edges: a null or empty text has no ids and decodes to the empty text; repeated rows give a row each; a null id
stays null; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.bpe import Lately
from fleetlens.llm.common import claim, with_text

MARK = "▁"
#: What a character without a piece costs, below any piece's score.
_UNKNOWN = -1e12


class Codec:
    _made: dict[str, Codec] = {}

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.pieces = [model.id_to_piece(i) for i in range(n)]
        self.unknown = model.unk_id()
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.control = {i for i in range(n) if model.is_control(i)}
        self.automaton = ahocorasick.Automaton()
        whole = True
        for i, p in enumerate(self.pieces):
            if p and not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.automaton.add_word(p, (len(p), model.get_score(i), i))
                whole &= MARK not in p.lstrip(MARK)
        self.automaton.make_automaton()
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+") if whole else re.compile("(?s).+")
        self.words = Lately(lambda w: array("I", self.viterbi(w)).tobytes())

    @classmethod
    def at(cls, path: str) -> Codec:
        claim("sentencepiece", cls._made.clear)
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def viterbi(self, word: str) -> tuple[int, ...]:
        """One pass over a word: at each end position all pieces that end there, longest first."""
        n = len(word)
        best, back = [0.0] + [float("-inf")] * n, [(0, -1)] * (n + 1)
        at = 0

        def fill(end: int) -> None:
            # positions up to end that no piece reached are single characters without a piece
            nonlocal at
            while at < end:
                at += 1
                if best[at] == float("-inf"):
                    best[at], back[at] = best[at - 1] + _UNKNOWN, (at - 1, -1)

        for last, (size, score, i) in self.automaton.iter(word):
            end = last + 1
            fill(end - 1)
            if (s := best[end - size] + score) > best[end]:
                best[end], back[end] = s, (end - size, i)
        fill(n)
        out, end = [], n
        while end:
            start, i = back[end]
            if i >= 0:
                out.append(i)
            else:
                out += [self.bytes.get(b, self.unknown) for b in reversed(word[start:end].encode())] if self.bytes else [self.unknown]
            end = start
        return tuple(reversed(out))

    def encode(self, text: str) -> array:
        out = array("I")
        if text:
            out.frombytes(b"".join(map(self.words.__getitem__, self.split.findall(MARK + text.replace(" ", MARK)))))
        return out

    def decode(self, ids: array) -> str:
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                held.append(self.byte_of[i])
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            if i not in self.control:
                out.append(self.pieces[i] if i != self.unknown else " ⁇ ")
        out.append(held.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text[1:] if text.startswith(" ") else text


def encoded(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_pieces, ids_crc32, decoded_chars, round_trip``, and the ids themselves if asked for.

    Each text is encoded, its ids are decoded and the outcome is held against the text; a mark in the text itself reads
    as a space, as in the library.
    """
    fields = [("doc_id", pa.int64()), ("n_pieces", pa.int64()), ("ids_crc32", pa.int64()), ("decoded_chars", pa.int64()), ("round_trip", pa.bool_())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32()))] * keep_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.at(path)
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                text = text.as_py() or ""
                ids = codec.encode(text)
                back = codec.decode(ids)
                rows.append((doc, len(ids), zlib.crc32(memoryview(ids).cast("B")) if ids else 0, len(back), back == text.replace(MARK, " "), ids.tolist() if keep_ids else None)[: len(schema)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)

    return with_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_chars long, round_trip boolean" + ", ids array<int>" * keep_ids)
