"""Operator 4, toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are lexicon words (a seed list, and words found in the labelled sample) and patterns (word beginnings found there,
several hits, dense hits); one more tells that none of them fires. A word or beginning is a candidate if its
documents are toxic more often than chance allows among all the terms tried (likelihood ratio against the number of
terms).

The label model is generative: a document is toxic with probability ``p``, and voter ``j`` fires with one probability if
it is and another if not. The off-diagonal covariances of the votes, counted over all documents, are then the product of
two voters' strengths; these are fitted, pairs with a residue beyond ``CORRELATED`` are taken as correlated voters and
left out of the next fit, and correlated voters that fire together share their weight. Known labels tell the strengths as
well, and count for the more the more of them are toxic (as many as ``WORTH`` count as the covariances do): words of two
languages hardly fire together, so by covariances alone the toxic class can shrink to the language with most voters.
From there expectation maximisation
over all documents of the training fold fits both probabilities of every voter; they are held as patterns of votes with
counts, and each round is a Spark job over these. The covariances' estimate counts as much as the documents it was
counted over, which keeps voters that seldom fire together, as those of two languages, in one class. A known label is the vote
of one more voter, whose probabilities are fitted too. The posteriors are the soft labels on which the linear classifier is
fitted (logistic, quadratic penalty ``PENALTY``, chosen on the training folds; features are counts of the terms and their density).

Bounds: at most ``SAMPLE`` labelled documents outside the held-out fold give terms and fit the classifier; unlabelled ones are
all in the label model and in none of the classifier's fit. At most ``TERMS`` terms are features, at most ``VOTERS`` of them vote, the
best first: these bound the models' size. Every document is scored by the classifier alone.

Nulls and edges: a null or empty text has the score of a text without hits; very long texts are read whole; documents with a
null id are scored and count as not held out; repeated rows give a row each; labels that are null, or of ids without a
document, are not used; without labels the seed lexicon alone votes; an empty table gives no rows; other columns are
never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import as_bytes, claim, dropped, rows_kept, with_text, written
from fleetlens.llm.optimise import minimise, sigmoid
from fleetlens.llm.quality import held_out, sampled_labels

SAMPLE, TERMS, VOTERS, CORRELATED, ROUNDS, PENALTY, WORTH = 20_000, 2_000, 60, 0.1, 12, 0.3, 50
#: Lengths of word beginnings, in characters.
LENGTHS = range(3, 9)
KEPT = 200_000
#: The seed lexicon, fixed values.
SEEDS = ("idiot", "moron", "stupid", "dumb", "loser", "scum", "trash", "garbage", "pathetic", "worthless", "disgusting", "clown", "fool", "imbecile", "vermin", "filth", "freak", "creep", "jerk", "hate")
_SPACE = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """Runs of letters in lower case; beyond ASCII, all characters count as letters."""
    return text.decode().lower().encode().translate(_SPACE).split() if text else []


def terms_of(word: bytes) -> list[str]:
    """The word itself and its beginnings, which end in a star."""
    w = word.decode()
    return [w, *(f"{w[:k]}*" for k in LENGTHS if k <= len(w))]


class Model(NamedTuple):
    terms: dict[str, int]
    weights: np.ndarray  # of terms, of the features that tell how many and how dense
    shift: float


class _Hits(dict):
    """For each word, the numbers of the terms that it holds."""

    def __init__(self, terms: dict[str, int]) -> None:
        super().__init__()
        self.terms = terms

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= KEPT:
            self.clear()
        self[word] = out = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return out


def hits(ws: list[bytes], find: _Hits) -> tuple[Counter, int, int]:
    """How often each term occurs, words with a term, and words."""
    count: Counter = Counter()
    n = 0
    for got in map(find.__getitem__, ws):
        if got:
            n += 1
            count.update(got)
    return count, n, len(ws)


def _bulk(n: int, total: int) -> list[float]:
    return [float(np.log1p(n)), 100 * min(n / max(total, 1), 0.1), float(n >= 2), float(n >= 3)]


BULK = 4


def mine(rows: DataFrame, most: int = TERMS) -> tuple[list[tuple[str, int, int]], int, int]:
    """Terms of the labelled sample with their clean and toxic documents, the best first; clean and toxic documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            keys = list(both[0].keys() | both[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([both[0][k] for k in keys], pa.int64()), pa.array([both[1][k] for k in keys], pa.int64())], names=["term", "clean", "toxic"])
            both[0].clear()
            both[1].clear()
            return out

        for batch in batches:
            for text, label in zip(as_bytes(batch["text"]), batch["label"].to_pylist(), strict=True):
                both[label].update({t for w in set(words(text)) for t in terms_of(w)})
                both[label][""] += 1
                if len(both[0]) + len(both[1]) > 500_000:
                    yield flush()
        yield flush()

    counts = rows.mapInArrow(count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    often = written(counts.where("toxic >= 3"), "terms")
    size = often.where("term = ''").first()
    if size is None or not size["clean"]:
        return [], 0, 0
    n0, n1 = size["clean"], size["toxic"]
    p = n1 / (n0 + n1)
    n = F.col("clean") + F.col("toxic")
    rate = F.col("toxic") / n
    ratio = F.col("toxic") * F.log(rate / p) + F.when(F.col("clean") > 0, F.col("clean") * F.log((1 - rate) / (1 - p))).otherwise(0.0)
    tried = often.count() + 1000
    best = often.where((F.col("term") != "") & (rate > 2 * p) & (ratio > float(np.log(tried)) + 2)).orderBy(ratio.desc(), F.length("term"), "term").limit(most)
    out = [(r["term"], r["clean"], r["toxic"]) for r in best.collect()]
    dropped(often)
    return out, n0, n1


def choose_voters(terms: list[tuple[str, int, int]], most: int = VOTERS) -> list[str]:
    """Of terms that say the same (one begins the other) the best; seed words always."""
    out = list(SEEDS)
    for term, clean, toxic in terms:
        bare = term.rstrip("*")
        if len(out) >= most:
            break
        if toxic > 4 * clean and not any(bare.startswith(o.rstrip("*")) or (o.startswith(bare) and o in SEEDS) or o.startswith(bare) for o in out):
            out.append(term)
    return out


class LabelModel(NamedTuple):
    prior: float
    if_toxic: np.ndarray
    if_clean: np.ndarray
    tied: np.ndarray  # positive residual correlations of voters

    label_if_toxic: float = 0.95  # how often a known label says toxic
    label_if_clean: float = 0.05

    def odds(self, votes: np.ndarray) -> np.ndarray:
        """Log odds of toxic; votes: a row a document, whether each voter fires. That one keeps quiet counts too.

        The last voter says only that all others keep quiet, so it adds nothing.
        """
        votes = votes * (np.arange(votes.shape[1]) < votes.shape[1] - 1)
        quiet = (1 - votes) * (np.arange(votes.shape[1]) < votes.shape[1] - 1)
        fired, quiet = votes / (1 + votes @ self.tied), quiet / (1 + quiet @ self.tied)
        return np.log(self.prior / (1 - self.prior)) + fired @ np.log(self.if_toxic / self.if_clean) + quiet @ np.log((1 - self.if_toxic) / (1 - self.if_clean))

    def posterior(self, votes: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """labels: 1, 0 or, where there is none, -1."""
        says = np.log([(1 - self.label_if_toxic) / (1 - self.label_if_clean), self.label_if_toxic / self.label_if_clean, 1.0])
        return sigmoid(self.odds(votes) + says[labels])

    def expected(self, votes: np.ndarray, labels: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sums over documents: of both classes' weights, and of these where each voter fires, is a label, and says toxic."""
        p = self.posterior(votes, labels)
        weight = np.stack([p, 1 - p]) * times
        more = np.stack([np.ones(len(p)), labels >= 0, labels == 1], 1)
        return weight @ np.hstack([votes, more])

    def maximised(self, start: LabelModel, sums: np.ndarray) -> LabelModel:
        """From sums over n documents; ``start``, which was counted over as many, counts as n documents more."""
        voters, (n, known, says) = sums[:, :-3], sums[:, -3:].T
        held = np.array([start.prior, 1 - start.prior]) * n.sum()
        fires = (voters + held[:, None] * np.stack([start.if_toxic, start.if_clean])) / np.maximum(n + held, 1e-9)[:, None]
        label = (says + 10 * np.array([0.95, 0.05])) / (known + 10)
        return self._replace(if_toxic=np.clip(fires[0], 1e-3, 1 - 1e-3), if_clean=np.clip(fires[1], 1e-4, 1 - 1e-3), label_if_toxic=float(label[0]), label_if_clean=float(label[1]))

    def calibrated(self, votes: np.ndarray, labels: np.ndarray, rounds: int = ROUNDS) -> LabelModel:
        """After rounds of expectation maximisation over these documents, of which some have labels."""
        out, once = self, np.ones(len(votes))
        for _ in range(rounds):
            out = out.maximised(self, out.expected(votes, labels, once))
        return out

    def calibrated_on(self, patterns: DataFrame, rounds: int = ROUNDS) -> LabelModel:
        """The same over a written table of ``pattern`` (a bit for each voter), ``label`` (or -1) and how many ``n`` have them."""
        voters, out = len(self.if_toxic), self

        def step(model: LabelModel) -> np.ndarray:
            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros((2, voters + 3))
                for batch in batches:
                    votes = batch["pattern"].to_numpy().view(np.uint64)[:, None] >> np.arange(voters, dtype=np.uint64) & np.uint64(1)
                    total += model.expected(votes.astype(float), batch["label"].to_numpy(), batch["n"].to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["k", "s"])

            got = patterns.mapInArrow(run, "k long, s double").groupBy("k").agg(F.sum("s").alias("s")).toArrow()
            sums = np.zeros(2 * (voters + 3))
            sums[got["k"].to_numpy()] = got["s"].to_numpy()
            return sums.reshape(2, -1)

        for _ in range(rounds):
            out = out.maximised(self, step(out))
        return out


def fit_label_model(means: np.ndarray, seconds: np.ndarray, prior: float, known: np.ndarray | None = None, toxic: int = 0) -> LabelModel:
    """From the share of documents in which each voter, and each pair of voters, fires.

    known: by how much oftener each voter fires on documents labelled toxic, of which there are ``toxic``, than on clean ones.
    """
    cov = seconds - np.outer(means, means)
    scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    use = ~np.eye(len(means), dtype=bool)
    sign = np.ones(len(means))
    sign[-1] = -1  # the last fires on clean documents
    z = sign * scale * np.sqrt(prior)
    told = z if known is None else sign * np.clip(sign * known * np.sqrt(prior * (1 - prior)), 1e-6, scale)
    share = 0.0 if known is None else toxic / (toxic + WORTH)
    for _ in range(3):
        for _ in range(50):
            top, low = (use * cov) @ z, use @ z**2
            z = 0.5 * z + 0.5 * (share * told + (1 - share) * np.where(low > 1e-12, top / np.maximum(low, 1e-12), z))
            z = sign * np.clip(sign * z, 1e-6, scale)
        residue = (cov - np.outer(z, z)) / np.outer(scale, scale)
        use = ~np.eye(len(means), dtype=bool) & (np.abs(residue) < CORRELATED)
    strength = z / np.sqrt(prior * (1 - prior))
    if_toxic, if_clean = means + (1 - prior) * strength, means - prior * strength
    tied = np.where(residue >= CORRELATED, residue, 0.0)
    np.fill_diagonal(tied, 0.0)
    return LabelModel(prior, np.clip(if_toxic, 1e-3, 1 - 1e-3), np.clip(if_clean, 1e-4, 1 - 1e-3), np.clip(tied, 0, 1))


def vote(count: Counter, n: int, total: int, voters: int) -> np.ndarray:
    """Voters' own terms come first among the terms; then several hits, dense hits, none."""
    out = np.zeros(voters + 4)
    out[[k for k in count if k < voters]] = 1
    own = int(out.sum())
    out[voters], out[voters + 1], out[voters + 2] = own >= 2, own >= 3, total > 0 and own > 0 and n / total > 0.01
    out[-1] = own == 0
    return out


_MEASURED = "kind int, i int, j int, pattern long, n long, id long, label int, terms array<int>, counts array<int>, hits int, words long"
#: Patterns that a task counts before it hands them on.
PATTERNS = 100_000


def _measured(rows: DataFrame, terms: dict[str, int], voters: int) -> DataFrame:
    """In one pass: how often two voters fire in the same document (kind 0), how many documents of the training fold have
    each pattern of votes, with their label (2), and what is found in the labelled ones (1).
    """
    held = rows.sparkSession.sparkContext.broadcast(terms)
    schema = pa.schema([("kind", pa.int32()), ("i", pa.int32()), ("j", pa.int32()), ("pattern", pa.int64()), ("n", pa.int64()), ("id", pa.int64()), ("label", pa.int32()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("hits", pa.int32()), ("words", pa.int64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        find = _Hits(held.value)
        total = np.zeros((voters + 5, voters + 5), np.int64)
        bits = 1 << np.arange(voters + 4, dtype=np.uint64)
        patterns: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = [{"kind": 2, "pattern": p, "label": label, "n": n} for (p, label), n in patterns.items()]
            patterns.clear()
            return pa.RecordBatch.from_pylist(out, schema=schema)

        for batch in batches:
            out = []
            for text, i, label, fit in zip(as_bytes(batch["text"]), *(batch[c].to_pylist() for c in ("id", "label", "fit")), strict=True):
                count, n, size = hits(words(text), find)
                votes = vote(count, n, size, voters)
                at = np.flatnonzero(np.append(votes, 1))
                total[np.ix_(at, at)] += 1
                if fit:
                    patterns[int(bits[at[:-1]].sum().view(np.int64)), -1 if label is None else label] += 1
                if label is not None:
                    out.append({"kind": 1, "id": i, "label": label, "terms": list(count), "counts": list(count.values()), "hits": n, "words": size})
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            if len(patterns) > PATTERNS:
                yield flush()
        yield flush()
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_pylist([{"kind": 0, "i": a, "j": b, "n": n} for a, b, n in zip(i.tolist(), j.tolist(), total[i, j].tolist(), strict=True)], schema=schema)

    return written(rows.select("id", "text", "label", "fit").mapInArrow(measure, _MEASURED), "measured")


def train(docs: DataFrame, labels: DataFrame, *, folds: int = 3, fold: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Model:
    out = held_out("id", folds, fold)
    chosen = written(sampled_labels(labels, "toxic", out, sample, id_col), "labels")
    rows = with_text(docs, id_col, text_col)
    found, n0, n1 = mine(rows.join(chosen, "id"))
    names = choose_voters(found)
    voters = len(names)
    terms = {t: k for k, t in enumerate(dict.fromkeys([*names, *(t for t, _, _ in found)]))}
    measured = _measured(rows.join(chosen, "id", "left").withColumn("fit", ~out), terms, voters)
    sums = np.zeros((voters + 5, voters + 5))
    for r in measured.where("kind = 0").groupBy("i", "j").agg(F.sum("n").alias("n")).collect():
        sums[r["i"], r["j"]] = r["n"]
    everything = max(sums[-1, -1], 1)
    prior = min(max(n1 / max(n0 + n1, 1), 0.01), 0.5) if n0 + n1 else 0.05
    some = measured.where("kind = 1")
    docs_ = some.select("id", "label", "terms", "counts", "hits", "words").toArrow().sort_by([("id", "ascending"), ("words", "ascending")]).to_pylist()
    votes = np.array([vote(Counter(dict(zip(d["terms"], d["counts"], strict=True))), d["hits"], d["words"], voters) for d in docs_])
    is_toxic = np.array([d["label"] == 1 for d in docs_], bool)
    both = 0 < is_toxic.sum() < len(docs_)
    known = votes[is_toxic].mean(0) - votes[~is_toxic].mean(0) if both else None
    label_model = fit_label_model(sums[-1, :-1] / everything, sums[:-1, :-1] / everything, prior, known, int(is_toxic.sum()))
    if docs_ and found:
        patterns = written(measured.where("kind = 2").groupBy("pattern", "label").agg(F.sum("n").alias("n")), "patterns")
        label_model = label_model.calibrated_on(patterns)
        dropped(patterns)
    dropped(measured, chosen)
    if not docs_ or not len(found):
        # nothing to learn from: the label model's own odds
        odds = np.log(label_model.if_toxic / label_model.if_clean)
        return Model(terms, np.concatenate([np.maximum(odds[:voters], 1.0) / np.log(2), np.zeros(BULK)]), float(np.log(prior / (1 - prior))))
    soft = label_model.posterior(votes, np.array([d["label"] for d in docs_]))
    row = np.repeat(np.arange(len(docs_)), [len(d["terms"]) for d in docs_])
    col = np.array([t for d in docs_ for t in d["terms"]], np.int64)
    val = np.log1p([c for d in docs_ for c in d["counts"]])
    bulk = np.array([_bulk(d["hits"], d["words"]) for d in docs_])
    n = len(terms)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        s = np.bincount(row, val * x[col], len(docs_)) + bulk @ x[n : n + BULK] + x[-1]
        p = sigmoid(s)
        g = p - soft
        value = (np.logaddexp(0, s) - soft * s).sum() + PENALTY / 2 * (x[:-1] @ x[:-1])
        return value, np.concatenate([np.bincount(col, val * g[row], n), bulk.T @ g, [g.sum()]]) + PENALTY * np.append(x[:-1], 0.0)

    x = minimise(loss, np.zeros(n + BULK + 1), 150)
    return Model(terms, x[:-1], float(x[-1]))


def score_texts(model: Model, texts: list[bytes | None], find: _Hits) -> np.ndarray:
    out = np.full(len(texts), model.shift)
    n = len(model.terms)
    for k, text in enumerate(texts):
        count, got, total = hits(words(text), find)
        if got:
            i = np.fromiter(count, np.int64, len(count))
            out[k] += np.log1p(np.fromiter(count.values(), np.float64, len(count))) @ model.weights[i] + model.weights[n:] @ np.array(_bulk(got, total))
    return sigmoid(out)


def scored(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, folds: int = 3, fold: int = 1, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, folds=folds, fold=fold, sample=sample, id_col=id_col, text_col=text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity")
        find = _Hits(model.value.terms)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(score_texts(model.value, as_bytes(batch["text"]), find))], names=["id", "score"])

    out = with_text(docs, id_col, text_col).mapInArrow(run, "id long, score double")
    return out.select(F.col("id").alias("doc_id"), held_out("id", folds, fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def clean(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.7, text_col: str = "text", **options: object) -> DataFrame:
    """The documents, with all their columns, that are not predicted to be toxic."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, text_col=text_col, **options))  # type: ignore[arg-type]

    def keep() -> Callable[[list[bytes | None]], np.ndarray]:
        find = _Hits(model.value.terms)
        return lambda texts: score_texts(model.value, texts, find) < threshold

    return rows_kept(docs, text_col, keep)
