"""Operator 11, spelling variant grouping: pairless wildcard groups.

The vocabulary is counted with a Counter in each task, merged by Spark, and numbered by falling frequency and rising word,
so that of several words the one with the smallest number (``place``) is the one to prefer. From there on words are
numbers. Each word gives

- for each position one key of (position, prefix, suffix): the words of such a group differ by one replacement there;
- for each position one key of the word without that letter (once for equal neighbours), and a key of the word itself:
  these meet where a vocabulary word is another one's deletion, so one table of keys is grouped and joined at a time.

A group keeps its size and its two smallest places, and from these each member has its count and its best other
word: the smaller, or the second if it is the smaller itself. No pairs are made. A wildcard group has no more members than
the alphabet has letters (90), and a word no more neighbours by insertion than 90 times its length, so no group grows with
the input. Prefix and suffix go into the keys as polynomial hashes over three primes, 93 bits together, of which a
long word has all in linear time; two unlike keys are the same with a probability of 1e-28.

Forms have ten times the word's occurrences, so a chain of them has no more steps than digits in the largest count, and
the number of doublings to its root is known beforehand.

Nulls and edges: a null or empty text has no words; a null id counts as an empty string in the hash that picks the
letters to delete; very long texts are read whole, and so are very long words; repeated rows count each; an empty table
gives no rows; other columns are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, claim, dropped, with_text, written

LEAST_LENGTH, LEAST_TIMES, RATIO, ONE_OF = 7, 2, 10, 31
#: Distinct words that a task counts before it hands them on.
HELD = 300_000
#: Primes below 2 ** 31 and bases for the hashes, fixed values.
FIELDS = ((2147483647, 1103515245), (2147483629, 1812433253), (2147483587, 1566083941))


def words_of(doc: int | None, text: bytes | None, pattern: re.Pattern, least: int = LEAST_LENGTH, one_of: int = ONE_OF) -> Iterator[tuple[str, int]]:
    """Words of a document with their occurrences; of some runs a letter goes, by a hash of document and run."""
    head = crc32(f"{'' if doc is None else doc}:".encode())
    for run, n in Counter(pattern.findall((text or b"").lower().decode())).items():
        h = crc32(run.encode(), head)
        if h % one_of == 0:
            run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) < least:
                continue
        yield run, n


def vocabulary(docs: DataFrame, *, least: int = LEAST_LENGTH, times: int = LEAST_TIMES, one_of: int = ONE_OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table of ``place, word, n``: the smaller the place, the larger n, and of equal n the smaller word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("variants")
        pattern = re.compile(f"[a-zÀ-ÿ]{{{least},}}")
        held: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for batch in batches:
            for doc, text in zip(batch["id"].to_pylist(), as_bytes(batch["text"]), strict=True):
                for word, n in words_of(doc, text, pattern, least, one_of):
                    held[word] += n
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    counted = with_text(docs, id_col, text_col).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)
    order = [F.col("n").desc(), F.col("word").asc()]
    return written(counted.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("place"), "word", "n"), "vocabulary")


def _powers(base: int, prime: int, n: int) -> np.ndarray:
    out = np.ones(1, np.int64)
    while len(out) < n:
        out = np.concatenate([out, out * pow(base, len(out), prime) % prime])
    return out[:n]


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all keys of these words: the word's index, whether it is the word itself, and two columns of the key.

    With c for the letters and B for the base, a word's hash is the sum of c[k] * B ** k. Without one term it is the hash
    of (position, prefix, suffix); the suffix moved down by a place gives that of the deletion.
    """
    size = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    word = np.repeat(np.arange(len(words)), size)
    first = np.cumsum(size) - size
    position = np.arange(len(flat)) - first[word]
    distinct = np.ones(len(flat), bool)  # the deletion isn't that of the letter before
    distinct[1:] = (flat[1:] != flat[:-1]) | (position[1:] == 0)
    hashes = []
    for prime, base in FIELDS:
        term = flat * _powers(base, prime, int(size.max(initial=1)))[position] % prime
        upto = np.cumsum(term)
        start = (upto - term)[first]
        whole = np.add.reduceat(term, first) if len(flat) else np.zeros(0, np.int64)
        before = upto - term - start[word]
        after = (whole[word] - before - term) % prime * pow(base, -1, prime)
        hashes.append(np.concatenate([(whole[word] - term) % prime, ((before + after) % prime)[distinct], whole % prime]))
    at = np.concatenate([position + 1, np.zeros(int(distinct.sum()) + len(words), np.int64)])
    own = np.arange(len(at)) >= len(at) - len(words)
    return np.concatenate([word, word[distinct], np.arange(len(words))]), own, np.stack([hashes[0] << 31 | hashes[1], hashes[2] << 31 | at])


def near(vocab: DataFrame) -> DataFrame:
    """``place, n_near, best``: how many words differ by one letter, and the smallest place of those; without those that have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            word, own, key = keys(batch["word"].to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(key[0]), pa.array(key[1]), pa.array(batch["place"].to_numpy()[word]), pa.array(own)], names=["a", "b", "place", "own"])

    rows = vocab.select("place", "word").mapInArrow(run, "a long, b long, place long, own boolean")
    w = Window.partitionBy("a", "b").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = rows.withColumns({
        "size": F.count("place").over(w), "one": F.first("place").over(w), "two": F.nth_value("place", 2).over(w), "target": F.max(F.when(F.col("own"), F.col("place"))).over(w),
    })
    wild = F.col("b") % (1 << 31) > 0
    other = F.when(F.col("one") == F.col("place"), F.col("two")).otherwise(F.col("one"))
    member = ~wild & ~F.col("own")
    found = groups.where((F.col("size") > 1) & (wild | F.col("target").isNotNull()))
    return found.select("place", F.when(member, 1).otherwise(F.col("size") - 1).alias("n"), F.when(member, F.col("target")).otherwise(other).alias("best")).groupBy("place").agg(F.sum("n").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, steps: int) -> DataFrame:
    """``place, form, root``: a written table of the ends of chains of ``place, form`` that have no more than ``steps``."""
    now, doubled = written(links.select("place", "form", F.col("form").alias("root")), "roots"), 1
    while doubled < steps:
        up = now.select(F.col("place").alias("root"), F.col("root").alias("next"))
        after = written(now.join(up, "root", "left").select("place", "form", F.coalesce("next", "root").alias("root")), "roots")
        dropped(now)
        now, doubled = after, 2 * doubled
    return now


def variants(docs: DataFrame, *, least: int = LEAST_LENGTH, times: int = LEAST_TIMES, ratio: int = RATIO, one_of: int = ONE_OF, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of the vocabulary."""
    vocab = vocabulary(docs, least=least, times=times, one_of=one_of, id_col=id_col, text_col=text_col)
    close = written(near(vocab), "near")
    head = vocab.agg(F.max("n").alias("n"), F.min("n").alias("least")).first()
    steps = 0
    while head["n"] and head["least"] * ratio ** (steps + 1) <= head["n"]:
        steps += 1
    best = vocab.select(F.col("place").alias("best"), F.col("n").alias("best_n"))
    links = vocab.select("place", "n").join(close, "place").join(best, "best").where(F.col("best_n") >= ratio * F.col("n")).select("place", F.col("best").alias("form"))
    chains = roots(links, steps)
    named = chains.join(vocab.select(F.col("place").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n")), "form").join(vocab.select(F.col("place").alias("root"), F.col("word").alias("root_word")), "root")
    out = vocab.join(close.select("place", "n_near"), "place", "left").join(named.drop("form", "root"), "place", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
