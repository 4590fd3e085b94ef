"""Operator 7, n-gram Jaccard join: token-combination prefixes, then verification.

The tokens of a document are the 64-bit hashes of its distinct word shingles. All sets share one order of tokens: rare
ones first, then two classes of frequent ones, by hash within. A prefix is extended until it *covers* one token more
than a partner may lack (size - ceil(threshold * size) + 1), where a rare token covers 1 and ``n`` frequent tokens of one
class and group cover ``n - k + 1``. Two sets over the threshold then share, within both prefixes, a rare token or ``k``
tokens of one class and group: fewer would mean that the set whose prefix ends first lacks as many tokens as its prefix
covers. So single rare tokens and k-token combinations of frequent ones are indexed, nothing else. The group of a
frequent token is its hash modulo a number that follows the size class of the sets, so that combinations stay about as
many as prefix tokens. Which token is frequent is read off a filter of a fixed size; whatever it says, the order is
the same for all sets, so no link depends on it, only the lengths of the index lists do.

Equal sets are one class with a number of its own. Lists with the same members are one list. For components, lists are
never expanded into all pairs: each member is verified against hubs of its lists (members that share the most of their
tokens); components are built; and only members whose components still differ meet the others of their lists, a pair in
the first of the lists that both name, and only pairs that sketches and parities of the sets can't rule out are
verified. Pairs within a component need no check then; ``jaccard_pairs`` verifies and returns all pairs instead.

Nulls and edges: a null or empty text, or one without words, has size 0 and its own id as component. A null id gives a
row with a null component and links with nothing. Rows that share an id count as one node with the links of all their
texts; repeated rows give a row each. An empty table gives no rows. Columns other than the two named are never read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain, combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import FILTER_BITS, as_bytes, as_long, claim, dropped, filter_bits, mix64, with_text, written
from fleetlens.llm.graph import components

#: Lists of a token as long as this make it frequent, as the second, very frequent.
FREQUENT, VERY_FREQUENT = 6, 64
#: With more frequent tokens than this a filter would say so of most; then the bounds are raised. That costs time only.
MOST_FREQUENT = FILTER_BITS // 8
#: So many lists of a member tell in which list a pair meets.
FIRST_LISTS = 8
#: Words of which a worker keeps the hash.
KEPT = 200_000
#: Bits of the parity of a set, by which most pairs are ruled out without their tokens.
PARITY = 1024
#: Least and most bits of the folded parity that goes along with list entries.
SKETCH = 256, 4096


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word, 7)
        return h


_words = _Words()


def word_list(text: bytes | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case: of bytes, lower() and split() do just that."""
    return text.lower().split() if text else []


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer words than ``width``: all of them as one shingle."""
    if len(_words) > KEPT:
        _words.clear()
    lists = [word_list(t) for t in texts]
    sizes = [len(x) for x in lists]
    flat = np.fromiter(map(_words.__getitem__, chain.from_iterable(lists)), np.uint64, sum(sizes))
    h = np.zeros(max(0, len(flat) - width + 1), np.uint64)
    for k in range(width):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + flat[k : len(flat) - width + 1 + k]) if len(h) else h
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(h[at : at + n - width + 1]))
        elif n:
            one = np.full(1, n, np.uint64)
            for w in flat[at : at + n]:
                one = mix64(one * np.uint64(0x9E3779B97F4A7C15) + w)
            out.append(mix64(one + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


class Scheme:
    """Sizes, prefixes and signatures for a threshold of ``num`` / ``den``."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den = num, den
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(bounds[-1] * den // num + 1)
        self.bounds = np.array(bounds)

    def needed(self, n: int) -> int:
        """What a prefix must cover."""
        return n - -(-self.num * n // self.den) + 1

    def head(self, n: int) -> int:
        """First tokens by hash that are kept and counted: half as many again as a prefix of rare ones."""
        return self.needed(n) + self.needed(n) // 2

    def alone(self, n: int) -> bool:
        """Only an equal set can be similar enough to one of this size."""
        return self.den * n < self.num * (n + 1)

    def size_class(self, n: int) -> int:
        """Sets over the threshold are of the same or of neighbouring classes."""
        return int(np.searchsorted(self.bounds, n, "right")) - 1

    def groups(self, b: int) -> int:
        """Groups of each frequent class for sets of size classes b - 1 and b; so few that every set can be covered, or 0."""
        n = max(int(self.bounds[max(b - 1, 0)]), 1)
        return min(max(1, self.needed(n) // 2), (n - self.needed(n)) // 3)

    def signatures(self, n: int, tokens: np.ndarray, kinds: np.ndarray | None) -> np.ndarray:
        """Of a set of size ``n`` by its first tokens (sorted, unsigned) or all. kinds: 1, 2 or 3 for each; None: all 1.

        The few tokens of the smallest sets go one by one, whatever their kind, in the prefix by hash alone.
        """
        need = self.needed(n)
        if kinds is None:
            return tokens[:need]
        rare = tokens[kinds == 1]
        b0 = self.size_class(n)
        sizes = [b for b in (b0, b0 + 1) if self.groups(b)]
        out = [rare[:need]] + [tokens[:need]] * (len(sizes) < 2)
        for b in sizes if len(rare) < need else ():
            g, left = self.groups(b), need - len(rare)
            members: dict[tuple[int, int], list[int]] = {}
            for k in (2, 3):
                mine = tokens[kinds == k]
                for t, at in zip(mine.tolist(), (mix64(mine) % np.uint64(g)).tolist(), strict=True):
                    if left <= 0:
                        break
                    x = members.setdefault((k, at), [])
                    x.append(t)
                    left -= len(x) >= k
            if left > 0:
                raise AssertionError(f"{n} tokens can't be covered")
            made = [(b, *c) for (k, _), x in members.items() if len(x) >= k for c in combinations(x, k)]
            for k in (2, 3):
                if some := [c for c in made if len(c) == k + 1]:
                    a = np.array(some, dtype=np.uint64)
                    h = a[:, 0] + np.uint64(0x5851F42D4C957F2D)
                    for j in range(1, k + 1):
                        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + a[:, j])
                    out.append(h)
        return np.unique(np.concatenate(out))


def _kinds(tokens: np.ndarray, filters: list[np.ndarray]) -> np.ndarray | None:
    """The class of each token by the filters of the frequent and the very frequent ones."""
    kinds = np.ones(len(tokens), np.int8)
    at = (tokens >> np.uint64(7)) % np.uint64(FILTER_BITS)
    for k, bits in enumerate(filters, 2):
        hit = (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)).astype(np.int64)) & 1
        kinds[hit.astype(bool)] = k
    return kinds if (kinds > 1).any() else None


def _over(rows: DataFrame, width: int, emit: Callable[[list, list[np.ndarray]], Iterator[list]], schema: pa.Schema, ddl: str) -> DataFrame:
    """Each batch's ids and sets through ``emit``; at most some MB of text at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngramjoin", _words.clear)
        for batch in batches:
            ids, texts = batch["id"].to_pylist(), as_bytes(batch["text"])
            at = 0
            while at < len(ids):
                end, held = at, 0
                while end < len(ids) and (held < 2_000_000 or end == at):
                    held += len(texts[end] or b"")
                    end += 1
                cols = emit(ids[at:end], shingle_sets(texts[at:end], width))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                at = end

    return rows.mapInArrow(run, ddl)


def _keys(sets: list[np.ndarray]) -> tuple[list[int], list[int]]:
    d = [xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0 for s in sets]
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    return [sign(x & (1 << 64) - 1) for x in d], [sign(x >> 64) for x in d]


def frequent(entries: DataFrame) -> DataFrame:
    """Tokens (sig) of several classes (c) with their counts, as a written table."""
    part = F.col("c").bitwiseAND(0x7FFFFFFF).cast("int")  # enough to tell whether there are several, and short
    counts = entries.select("sig", part.alias("c")).groupBy("sig").agg(F.count("*").alias("count"), F.min("c").alias("lo"), F.max("c").alias("hi"))
    return written(counts.where((F.col("count") >= FREQUENT) & (F.col("lo") != F.col("hi"))).select("sig", "count"), "frequent")


def filters(tokens: DataFrame) -> list[np.ndarray]:
    """Of the frequent and the very frequent ones, 4 MB each, made by the executors and merged word by word."""
    sizes = {r["b"]: r["n"] for r in tokens.groupBy(F.floor(F.log2("count")).alias("b")).agg(F.count("*").alias("n")).collect()}  # 64 rows at most
    if not sizes:
        return []
    least = FREQUENT
    while sum(n for b, n in sizes.items() if 2 ** (b + 1) > least) > MOST_FREQUENT:
        least *= 2
    at = F.shiftrightunsigned("sig", 7) % FILTER_BITS
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = tokens.where(F.col("count") >= least).withColumn("at", at).groupBy(F.expr("cast(at div 64 as int)").alias("w"))
    words = words.agg(F.bit_or(bit).alias("some"), F.bit_or(F.when(F.col("count") >= VERY_FREQUENT * least // FREQUENT, bit).otherwise(0)).alias("very")).toArrow()
    out = [np.zeros(FILTER_BITS // 64, np.int64) for _ in range(2)]
    for bits, col in zip(out, ("some", "very"), strict=True):
        bits[words["w"].to_numpy()] = words[col].to_numpy()
    return out


def _needed_sql(num: int, den: int) -> str:
    return f"(n - ({num} * n + {den - 1}) div {den} + 1)"


def _unlike(heads: DataFrame) -> DataFrame:
    """The first tokens of the sets, of equal sets in a task only once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out, cs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for c, n, s in zip(batch["c"].to_pylist(), batch["n"].to_pylist(), _lists(batch, "head"), strict=True):
                if (c, n) not in seen:
                    seen.add((c, n))
                    out.append(s)
                    cs.append(np.full(len(s), c))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(np.concatenate(out))), pa.array(np.concatenate(cs))], names=["sig", "c"])

    return heads.select("c", "n", "head").mapInArrow(run, "sig long, c long")


def _as_batch(cols: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _parity(s: np.ndarray) -> np.ndarray:
    """For each of so many bits whether an odd number of tokens fall on it: two sets differ in as many tokens at least as bits.

    There are twice as many bits as tokens about, PARITY at least; a longer parity folds into a shorter one.
    """
    bits = max(PARITY, 1 << int(2 * len(s)).bit_length()) if len(s) else PARITY
    odd = np.bincount((s >> np.uint64(32)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(bool), bitorder="little").view(np.int64)


def _fold(parity: np.ndarray, longs: int) -> np.ndarray:
    return np.bitwise_xor.reduce(parity.reshape(-1, longs), axis=0)


def _sketch(parity: np.ndarray, n: int) -> np.ndarray:
    """The parity of a set of size ``n`` in twice as many bits as tokens about, within bounds.

    With fewer bits than tokens sets that are nearly similar enough differ in no more bits than similar ones.
    """
    return _fold(parity, min(max(SKETCH[0], 1 << (2 * n).bit_length()), SKETCH[1]) // 64)


_INDEX = pa.schema([("sig", pa.int64()), ("c", pa.int64()), ("n", pa.int64())])


def _lists(batch: pa.RecordBatch, col: str) -> list[np.ndarray]:
    flat, at = batch[col].flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.concatenate([[0], np.cumsum(batch[col].value_lengths().to_numpy(zero_copy_only=False))])
    return [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def _index(heads: DataFrame, whole: DataFrame | None, scheme: Scheme, filters: list[np.ndarray]) -> DataFrame:
    """The signatures of sets whose prefix lies in their first tokens, and of those with all their tokens given."""
    held = heads.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch], *, complete: bool) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            sig, cs, ns = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c, n, s in zip(batch["c"].to_pylist(), batch["n"].to_pylist(), _lists(batch, "tokens"), strict=True):
                if (c, n) in seen:
                    continue
                kinds = _kinds(s, held.value)
                if complete or _covers(scheme, n, kinds, len(s)):
                    seen.add((c, n))
                    got = scheme.signatures(n, s, kinds)
                    sig.append(got)
                    cs.append(np.full(len(got), c))
                    ns.append(np.full(len(got), n))
            yield _as_batch([as_long(np.concatenate(sig)), np.concatenate(cs), np.concatenate(ns)], _INDEX)

    out = heads.select("c", "n", F.col("head").alias("tokens")).mapInArrow(partial(run, complete=False), "sig long, c long, n long")
    return out if whole is None else out.unionByName(whole.select("c", "n", "tokens").mapInArrow(partial(run, complete=True), "sig long, c long, n long"))


def _covers(scheme: Scheme, n: int, kinds: np.ndarray | None, given: int) -> bool:
    """Whether the prefix is made of rare ones of the first tokens."""
    return (given if kinds is None else int((kinds == 1).sum())) >= scheme.needed(n)


def _flagged(heads: DataFrame, scheme: Scheme, filters: list[np.ndarray]) -> DataFrame:
    """Ids of one document of each class, task by task, whose prefix goes beyond its first tokens."""
    held = heads.sparkSession.sparkContext.broadcast(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            out = []
            for i, c, n, s in zip(batch["id"].to_pylist(), batch["c"].to_pylist(), batch["n"].to_pylist(), _lists(batch, "head"), strict=True):
                if (c, n) not in seen and not _covers(scheme, n, _kinds(s, held.value), len(s)):
                    seen.add((c, n))
                    out.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["id"])

    return heads.select("id", "c", "n", "head").mapInArrow(run, "id long")


def _sets(rows: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, c, c2, n, tokens`` of the rows with these ids: workers make the sets of those in a filter of the ids, a join does the rest."""
    spark = rows.sparkSession
    wanted = spark.sparkContext.broadcast(filter_bits(ids, "id"))
    schema = pa.schema([("id", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngramjoin", _words.clear)
        bits = wanted.value
        for batch in batches:
            at = batch["bit"].to_numpy(zero_copy_only=False)
            keep = np.flatnonzero(((bits[at >> 6] >> (at & 63)) & 1).astype(bool))
            for k in range(0, len(keep), 256):
                some = batch.take(pa.array(keep[k : k + 256]))
                sets = shingle_sets(as_bytes(some["text"]), width)
                yield _as_batch([some["id"], *_keys(sets), [len(s) for s in sets], [as_long(s) for s in sets]], schema)

    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    made = rows.where("id is not null").withColumn("bit", bit).mapInArrow(run, "id long, c long, c2 long, n long, tokens array<long>").where("n > 0")
    return made.join(ids, "id", "left_semi")


class _Found(NamedTuple):
    """sized: a row for each document; classes: of equal sets, numbered ``k``; entries: members ``k`` of lists ``sig``."""

    rows: DataFrame
    sized: DataFrame
    classes: DataFrame
    entries: DataFrame


def _found(docs: DataFrame, scheme: Scheme, width: int, id_col: str, text_col: str) -> _Found:
    """The classes of equal sets, and the lists in which all pairs of classes over the threshold meet."""
    num, den = scheme.num, scheme.den
    rows = with_text(docs, id_col, text_col)

    def sizes(ids: list, sets: list[np.ndarray]) -> list:
        heads = [s[: scheme.head(len(s))] if len(s) and not scheme.alone(len(s)) else s[:0] for s in sets]
        parities = [_parity(s) for s in sets]
        return [ids, [len(s) for s in sets], *_keys(sets), parities, [_sketch(x, len(s)) for x, s in zip(parities, sets, strict=True)], [as_long(h) for h in heads]]

    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("c", pa.int64()), ("c2", pa.int64()), ("parity", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())), ("head", pa.list_(pa.int64()))])
    sized = written(_over(rows, width, sizes, schema, "id long, n long, c long, c2 long, parity array<long>, sketch array<long>, head array<long>"), "sized")
    classes = sized.where("n > 0 and id is not null").groupBy("n", "c", "c2").agg(F.min("id").alias("rep"), F.any_value("parity").alias("parity"), F.any_value("sketch").alias("sketch"))
    classes = written(classes.withColumn("k", F.monotonically_increasing_id()), "classes")
    heads = sized.where("size(head) > 0 and id is not null").select("id", "n", "c", "head")

    # Which tokens are frequent is counted over the first tokens by hash of all sets, half as many again as a prefix of rare ones. Sets of
    # which so many are frequent that the prefix goes beyond these are taken whole, and their other tokens are counted too.
    tokens = counted = frequent(_unlike(heads))
    kinds = filters(tokens)
    whole: DataFrame | None = None
    for again in (False, True):
        if not kinds:
            break
        beyond = _flagged(heads, scheme, kinds)
        beyond = written(beyond if whole is None else beyond.join(whole.select("id"), "id", "left_anti"), "beyond")
        if beyond.isEmpty():
            break
        more = written(_sets(rows, beyond, width), "whole")
        if not again:
            other = more.select("c", F.explode(F.expr(f"slice(tokens, 1 + cast({_needed_sql(num, den)} + {_needed_sql(num, den)} div 2 as int), 2147483647)")).alias("sig"))
            counted = frequent(other)
            tokens = tokens.unionByName(counted)
            kinds = filters(tokens)
        whole = more if whole is None else whole.unionByName(more)
        dropped(beyond)
    dropped(tokens)
    index = written(_index(heads, whole, scheme, kinds), "index")
    if whole is not None:
        dropped(whole)
    lists = written(index.groupBy("sig").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("sig"), "lists")
    # entries of lists with two classes or more
    entries = written(_maybe(index, lists).join(lists, "sig").join(classes.select("c", "n", "k"), ["c", "n"]).select("sig", "k", "n").distinct(), "members")
    dropped(index, lists)
    # lists with the same members, by two hashes over them, are one
    lists = entries.groupBy("sig").agg(F.bit_xor(F.xxhash64("k")).alias("x"), F.sum(F.xxhash64("k", F.lit(5)).bitwiseAND((1 << 40) - 1)).alias("y"), F.count("*").alias("members"))
    lists = written(lists.where("members > 1").groupBy("x", "y", "members").agg(F.min("sig").alias("sig"), F.count("*").alias("times")).select("sig", "times"), "lists")
    few = written(entries.join(lists, "sig"), "few")
    dropped(entries, lists)
    # a list's hub has the largest share of its tokens in lists: a text that others were made of rather than one of those
    shares = few.groupBy("k").agg((F.sum("times") / F.first("n")).alias("share"))
    hubs = few.join(shares, "k").groupBy("sig").agg(F.max(F.struct("share", (-F.col("k")).alias("a"), "n")).alias("hub"))
    out = written(few.join(hubs.select("sig", (-F.col("hub.a")).alias("a"), F.col("hub.n").alias("an")), "sig"), "entries")
    dropped(few)
    return _Found(rows, sized, classes, out)


def _fits(m: str, n: str, scheme: Scheme) -> Column:
    """Sets of these sizes can be over the threshold."""
    return F.lit(scheme.den) * F.least(m, n) >= F.lit(scheme.num) * F.greatest(m, n)


def jaccard_pairs(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """All pairs of unlike sets that link, and who is in them: ``a, b`` (numbers of classes) and ``doc_id, n_shingles, class_id``.

    Documents of one class link with each other and with all documents of the classes that theirs links with; so no link is
    left out, and copies are not expanded into pairs. Documents without words have no class.
    """
    scheme = Scheme(num, den)
    found = _found(docs, scheme, width, id_col, text_col)
    one, other = found.entries.select("sig", F.col("k").alias("a"), "n"), found.entries.select("sig", F.col("k").alias("b"), F.col("n").alias("m"))
    pairs = one.join(other, "sig").where((F.col("a") < F.col("b")) & _fits("n", "m", scheme)).select("a", "b").distinct()
    links = verified(found, written(near(pairs, found.classes, num, den), "pairs"), width, num, den)
    who = found.sized.where("id is not null").join(found.classes.select("n", "c", "c2", "k"), ["n", "c", "c2"], "left")
    return links, who.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("k").alias("class_id"))


def jaccard_components(docs: DataFrame, *, width: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id``; two documents link when den * intersection >= num * union."""
    scheme = Scheme(num, den)
    found = _found(docs, scheme, width, id_col, text_col)
    classes, entries = found.classes, found.entries
    # each member is verified against two hubs of its lists: the one it shares most lists with, and the smallest
    shared = entries.where((F.col("k") != F.col("a")) & _fits("an", "n", scheme)).groupBy("k", "a").agg(F.sum("times").alias("lists"))
    hubs = shared.groupBy("k").agg(F.max_by("a", F.struct("lists", -F.col("a"))).alias("most"), F.min("a").alias("least"))
    pairs = written(near(hubs.select(F.explode(F.array_distinct(F.array("most", "least"))).alias("a"), F.col("k").alias("b")), classes, num, den), "pairs")
    links = verified(found, pairs, width, num, den)
    ends = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    part = components(ends)
    rest = written(near(_strays(found, part, scheme), classes, num, den), "rest")
    dropped(pairs, entries)
    # texts that share an id are one node; of such ids there are none as a rule
    known = found.sized.where("id is not null").select("id", "n", "c", "c2")
    unlike = known.groupBy("id").agg(F.min(F.struct("n", "c", "c2")).alias("lo"), F.max(F.struct("n", "c", "c2")).alias("hi")).where("lo <> hi").select("id")
    unlike = written(known.join(unlike, "id", "left_semi").join(classes.select("n", "c", "c2", "k"), ["n", "c", "c2"]).select("id", "k").distinct(), "unlike")
    several = not unlike.isEmpty()
    if several or not rest.isEmpty():
        dropped(part)
        one = unlike.groupBy("id").agg(F.min("k").alias("u"))
        part = components(ends.unionByName(verified(found, rest, width, num, den).toDF("u", "v")).unionByName(unlike.join(one, "id").where("k <> u").select("u", F.col("k").alias("v"))))
    dropped(rest)
    of = classes.select("n", "c", "c2", "rep", "k").join(part.withColumnRenamed("id", "k"), "k", "left").withColumn("component", F.coalesce("component", "k"))
    least = of.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = found.sized.select("id", "n", "c", "c2").join(of.join(least, "component").select("n", "c", "c2", "component_id"), ["n", "c", "c2"], "left")
    component = F.coalesce("component_id", "id")
    if several:  # a row without words has the component of those with words that share its id
        node = out.where("n > 0 and id is not null").groupBy("id").agg(F.min("component_id").alias("of_id"))
        out, component = out.join(node, "id", "left"), F.coalesce("of_id", "id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


def _strays(found: _Found, part: DataFrame, scheme: Scheme) -> DataFrame:
    """Pairs ``a, b`` of members of a list whose components differ, but for those that sketches rule out.

    Only members whose component isn't that of the list's hub look for partners. A pair meets in the first of the lists
    that both members name (each names its first few), or in all that it shares where they name none together.
    """
    of = part.withColumnRenamed("id", "k")
    far = found.entries.join(of, "k", "left").withColumn("component", F.coalesce("component", "k"))
    far = far.join(of.toDF("a", "of_hub"), "a", "left").withColumn("stray", F.col("component") != F.coalesce("of_hub", "a")).select("sig", "k", "n", "component", "stray")
    mixed = far.groupBy("sig").agg(F.max("stray").alias("mixed")).where("mixed").select("sig")
    far = written(far.join(mixed, "sig"), "far")
    first = far.groupBy("k").agg(F.slice(F.sort_array(F.collect_list("sig")), 1, FIRST_LISTS).alias("first"))
    far = written(far.join(first, "k").join(found.classes.select("k", "sketch"), "k"), "far")
    one = far.where("stray").drop("stray")
    other = far.toDF(*(f"{c}2" if c != "sig" else c for c in far.columns))
    alike = apart("sketch", "sketch2") * (scheme.den + scheme.num) <= F.lit(scheme.den - scheme.num) * (F.col("n") + F.col("n2"))
    here = F.coalesce(F.array_min(F.array_intersect("first", "first2")), F.col("sig")) >= F.col("sig")
    apart_ = (F.col("component") != F.col("component2")) & (~F.col("stray2") | (F.col("k") < F.col("k2")))
    met = one.join(other, "sig").where(apart_ & _fits("n", "n2", scheme) & here & alike)
    return met.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()


def apart(a: str, b: str) -> Column:
    """In how many bits two parities differ; one that is twice as long as the other is folded, and of a longer one nothing is told: 0."""

    def halved(x: str, other: str) -> Column:
        half = (F.size(x) / 2).cast("int")
        return F.when(F.size(x) > F.size(other), F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda v, w: v.bitwiseXOR(w))).otherwise(F.col(x))

    differ = F.aggregate(F.zip_with(halved(a, b), halved(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return F.coalesce(differ, F.lit(0)).cast("long")


def near(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs of classes without those whose parities differ in more bits than similar sets can differ in tokens."""
    own = classes.select("k", "n", "parity")
    both = pairs.join(own.toDF("a", "m", "x"), "a").join(own.toDF("b", "n", "y"), "b").select("a", "b", "m", "n", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(batch["m"].to_pylist(), batch["n"].to_pylist(), _lists(batch, "x"), _lists(batch, "y"), strict=True):
                k = min(len(x), len(y))
                differ = int(np.bitwise_count(_fold(x, k) ^ _fold(y, k)).sum())
                keep.append(differ * (den + num) <= (den - num) * (m + n))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _maybe(index: DataFrame, lists: DataFrame) -> DataFrame:
    """The entries without most of those that are alone in their list: a filter of the lists that stay, before the join."""
    held = index.sparkSession.sparkContext.broadcast(filter_bits(lists, "sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch["bit"].to_numpy(zero_copy_only=False)
            yield batch.select(["sig", "c", "n"]).filter(pa.array(((held.value[at >> 6] >> (at & 63)) & 1).astype(bool)))

    return index.withColumn("bit", F.pmod(F.xxhash64("sig"), F.lit(FILTER_BITS))).mapInArrow(run, "sig long, c long, n long")


def verified(found: _Found, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs of classes ``a``, ``b`` whose sets are similar enough; the sets of the ends are made again from a text of each."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("k")).distinct()
    ends = written(found.classes.join(ends, "k", "left_semi").select("k", "rep", "n", "c", "c2"), "ends")
    made = _sets(found.rows, ends.select(F.col("rep").alias("id")).distinct(), width)
    sets = written(made.join(ends.select("k", "n", "c", "c2"), ["n", "c", "c2"]).dropDuplicates(["k"]).select("k", "tokens"), "sets")
    both = F.size(F.array_intersect("x", "y"))
    out = (
        pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
        .where(_similar(both, F.size("x"), F.size("y"), num, den)).select("a", "b")
    )
    out = written(out, "links")
    dropped(sets, ends)
    return out


def _similar(both: Column, m: Column, n: Column, num: int, den: int) -> Column:
    return F.lit(den).cast("long") * both >= F.lit(num).cast("long") * (m + n - both)


def one_of_each(docs: DataFrame, *, width: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, without those that a smaller id stands for; of rows that share id and text, one.

    Rows with a null id stay. Where rows share an id but not the text, each text is a node of its own, by a 64-bit hash of
    both, and only the texts that another stands for go.
    """
    rows = with_text(docs, id_col, text_col).where("id is not null")
    twice = written(rows.groupBy("id").count().where("count > 1").select("id"), "twice")
    repeated = not twice.isEmpty()
    if repeated:
        of_text = rows.join(twice, "id").select("id", _text_hash("id", "text").alias("h"))
        unlike = written(of_text.groupBy("id").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("id"), "unlike")
        if not unlike.isEmpty():
            return _one_of_each_text(docs, unlike, width, num, den, id_col, text_col)
    part = written(jaccard_components(docs, width=width, num=num, den=den, id_col=id_col, text_col=text_col).where("doc_id is not null"), "components")
    # a table of known size: the planner broadcasts it while it is small, and no text is shuffled
    gone = written(part.where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct(), "gone")
    out = docs.join(gone, id_col, "left_anti")
    if not repeated:
        return out
    return out.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]).unionByName(out.where(F.col(id_col).isNull()))


def _text_hash(id_col: str, text_col: str) -> Column:
    """Of id and text; all texts without words are one."""
    text = F.col(text_col).cast("string")
    return F.xxhash64(F.col(id_col).cast("long"), F.when(text.rlike(r"[^\x20\x09-\x0D]"), text).otherwise(""))


def _one_of_each_text(docs: DataFrame, unlike: DataFrame, width: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """``one_of_each`` where the rows of the ids ``unlike`` are nodes by their texts."""
    own = F.col(id_col).cast("long")
    nodes = docs.join(unlike.select(F.col("id").alias("_unlike")), own == F.col("_unlike"), "left")
    nodes = nodes.withColumn("_node", F.when(F.col("_unlike").isNotNull(), _text_hash(id_col, text_col)).otherwise(own)).drop("_unlike")
    part = written(jaccard_components(nodes, width=width, num=num, den=den, id_col="_node", text_col=text_col).where("doc_id is not null"), "components")
    ids = nodes.where("_node is not null").select("_node", own.alias("id")).distinct()
    of = part.select(F.col("doc_id").alias("_node"), "component_id").distinct().join(ids, "_node")
    stay = of.groupBy("component_id").agg(F.min(F.struct("id", "_node"))["_node"].alias("_node")).select("_node")
    out = nodes.where("_node is not null").join(stay, "_node", "left_semi").dropDuplicates(["_node"]).unionByName(nodes.where("_node is null"))
    return out.select(*docs.columns)
