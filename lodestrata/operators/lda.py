"""Topic model by online variational Bayes, with a learned prior for each word."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds over a document at most, and the mean change of its topics' weights at which they end.
ROUNDS, SETTLED = 50, 1e-3
#: Words of a block of sums; words of documents that a task takes at once, and of a padded part of those; steps of a pass at most.
BLOCK, TOGETHER, PADDED, STEPS = 4096, 50_000, 50_000, 64
_TINY = 1e-100
#: (x + k) (x + 9 - k) is x (x + 9) + one of these, for k up to 4.
_FACTORS = (0.0, 8.0, 14.0, 18.0, 20.0)


def digamma(x: np.ndarray) -> np.ndarray:
    """Derivative of ln gamma, from the series at x + 10."""
    y = x + 10.0
    z = 1 / (y * y)
    t = x * (x + 9.0)
    return np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132)))) - (2 * x + 9.0) * sum(1 / (t + c) for c in _FACTORS)


def trigamma(x: np.ndarray) -> np.ndarray:
    y = x + 10.0
    z = 1 / (y * y)
    return 1 / y + z / 2 + z / y * (1 / 6 - z * (1 / 30 - z * (1 / 42 - z / 30))) + sum(1 / (x + k) ** 2 for k in range(10))


def ln_gamma(x: np.ndarray) -> np.ndarray:
    y = x + 10.0
    z = 1 / (y * y)
    t = x * (x + 9.0)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z / 1680))) / y - sum(np.log(t + c) for c in _FACTORS)


def expected_logs(x: np.ndarray) -> np.ndarray:
    """Expected logarithms under Dirichlet distributions, one a row."""
    return digamma(x) - digamma(x.sum(1, keepdims=True)) if x.shape[1] else x


@dataclass
class Model:
    """weights: topics by words, the parameters of each topic's distribution; topic_prior and word_prior (one a word) of the Dirichlets."""
    weights: np.ndarray
    topic_prior: float
    word_prior: np.ndarray
    #: Bound on the log-likelihood of a batch's words, by word, as each step began.
    history: list[float] = field(default_factory=list)

    @cached_property
    def logs(self) -> np.ndarray:
        """Expected logarithms of the topics' word shares, which a step needs three times; topic by topic, to keep to the processor's caches."""
        return np.array([expected_logs(w[None])[0] for w in self.weights]).reshape(self.weights.shape)

    @property
    def shares(self) -> np.ndarray:
        return self.weights / self.weights.sum(1, keepdims=True)


def bags(tokens: DataFrame, words: list[str], batches: int = 1, seed: int = 42) -> DataFrame:
    """doc_id, batch, ids, counts of each document's words; batches are dealt by a hash of doc_id, so reruns agree.

    Every partition holds some of each batch, sorted by batch: a step reads its batch from all of them.
    """
    code = tokens.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})

    def run(it):
        for b in it:
            cs = [Counter(filter(lambda i: i is not None, map(code.value.get, ts or ()))) for ts in b.column(1).to_pylist()]
            ids = [sorted(c) for c in cs]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([[c[i] for i in x] for c, x in zip(cs, ids)], pa.list_(pa.int32()))], names=["doc_id", "ids", "counts"])

    d = tokens.select("doc_id", "tokens").mapInArrow(run, "doc_id string, ids array<int>, counts array<int>")
    return d.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(batches)).cast("int").alias("batch"), "ids", "counts").sortWithinPartitions("batch")


def _padded(ids: list[np.ndarray], counts: list[np.ndarray]):
    """Documents with words, in parts of much the same length: their places, and codes and counts as matrices, a row each.

    A shorter row ends in code 0 with count 0, which adds nothing.
    """
    size = np.array([len(i) for i in ids], int)
    order = np.argsort(size, kind="stable")
    order = order[size[order] > 0]
    lo = 0
    while lo < len(order):
        n = size[order[lo:]]
        # sizes rise, so both conditions hold up to some place
        fits = (n <= 16 + 1.25 * n[0]) & (n * np.arange(1, len(n) + 1) <= PADDED)
        rows = order[lo:lo + max(1, int(fits.sum()))]
        n = size[rows]
        held = np.arange(n[-1]) < n[:, None]
        code, count = np.zeros(held.shape, int), np.zeros(held.shape)
        code[held], count[held] = np.concatenate([ids[k] for k in rows]), np.concatenate([counts[k] for k in rows])
        yield rows, code, count
        lo += len(rows)


def _settled(parts: list[tuple[np.ndarray, np.ndarray]], prior: float) -> np.ndarray:
    """Topic weights of some documents, a row each, by fixed-point rounds. parts: words (documents by words by topics) and the words' counts.

    What a round does by document it does for all parts at once, as calls on a few documents are mostly overhead; only
    products with words go part by part. A document that has settled keeps its weights, and is left out of further rounds.
    """
    out = gamma = np.full((sum(len(n) for _, n in parts), parts[0][0].shape[2] if parts else 1), 1.0)
    place, left = np.arange(len(out)), np.ones(len(out), bool)
    for _ in range(ROUNDS):
        if not len(place):
            break
        theta = np.exp(expected_logs(gamma))
        new, lo = np.empty_like(theta), 0
        for words, n in parts:
            norm = np.matmul(words, theta[lo:lo + len(n), :, None])[:, :, 0] + _TINY
            np.matmul((n / norm)[:, None, :], words, out=new[lo:lo + len(n), None, :])
            lo += len(n)
        new = prior + theta * new
        change = np.abs(new - gamma).mean(1)
        gamma = np.where(left[:, None], new, gamma)
        left = left & (change >= SETTLED)
        if 2 * left.sum() <= len(left):
            out[place] = gamma
            cuts = np.split(left, np.cumsum([len(n) for _, n in parts])[:-1])
            parts = [(words[x], n[x]) for (words, n), x in zip(parts, cuts) if x.any()]
            place, gamma, left = place[left], gamma[left], left[left]
    out[place] = gamma
    return out


def infer(ids: list[np.ndarray], counts: list[np.ndarray], beta: np.ndarray, prior: float) -> np.ndarray:
    """Topic weights of some documents (a row each).

    beta: exponentials of expected log word shares, words by topics. A document without words keeps the prior.
    """
    out = np.full((len(ids), beta.shape[1]), prior)
    if parts := list(_padded(ids, counts)):
        out[np.concatenate([rows for rows, _, _ in parts])] = _settled([(beta[code], n) for _, code, n in parts], prior)
    return out


def _groups(b: pa.RecordBatch, first: int):
    """ids and counts of a batch's documents, some TOGETHER words at a time, with the place of the first one."""
    i, c = b.column(first), b.column(first + 1)
    ends, i, c = i.offsets.to_numpy(), i.values.to_numpy(), c.values.to_numpy()
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + TOGETHER, "right")) - 1)
        yield lo, [i[x:y] for x, y in zip(ends[lo:hi], ends[lo + 1:hi + 1])], [c[x:y] for x, y in zip(ends[lo:hi], ends[lo + 1:hi + 1])]
        lo = hi


def _summed(t: pa.Table) -> pa.Table:
    """Sums of one block's rows by word; or, of block -1, of the figures about documents."""
    at, z = ([np.frombuffer(x, k) for x in t.column(c).to_pylist()] for c, k in (("at", np.int32), ("z", np.float64)))
    words = np.unique(np.concatenate(at))
    total = np.zeros((len(words), len(z[0]) // len(at[0])))
    for x, y in zip(at, z):  # a row has a word once
        total[np.searchsorted(words, x)] += y.reshape(len(x), -1)
    return pa.table({"block": t.column("block").slice(0, 1), "at": pa.array([words.astype(np.int32).tobytes()], pa.binary()), "z": pa.array([total.tobytes()], pa.binary())})


def statistics(docs: DataFrame, model: Model) -> tuple[np.ndarray, float, int, int]:
    """Expected counts (topics by words), the documents' part of the bound, and numbers of documents and words.

    As many tasks as there are cores add their documents' counts up, each in one matrix of words by topics, and give
    the rows of the words that they had, by block; they are added up by block, so the driver gets each once.
    """
    topics, size = model.weights.shape
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(np.ascontiguousarray(np.exp(model.logs).T))
    prior = model.topic_prior

    def run(batches):
        beta, total, seen, about = shared.value, np.zeros((size, topics)), np.zeros(size, bool), np.zeros(3)
        for b in batches:
            for _, ids, counts in _groups(b, 0):
                bare = sum(not len(i) for i in ids)
                parts = [(code, beta[code], n) for _, code, n in _padded(ids, counts)]
                settled, lo = _settled([(words, n) for _, words, n in parts], prior) if parts else np.zeros((0, topics)), 0
                weight = np.exp(expected_logs(settled))
                for code, words, n in parts:
                    theta = weight[lo:lo + len(n)]
                    lo += len(n)
                    norm = np.matmul(words, theta[:, :, None])[:, :, 0] + _TINY
                    own = n > 0
                    flat, each = code[own], (n / norm)[own][:, None] * np.repeat(theta, own.sum(1), 0)
                    order = np.argsort(flat, kind="stable")
                    starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
                    found = flat[order[starts]]
                    total[found] += np.add.reduceat(each[order], starts, 0)
                    seen[found] = True
                    about[0] += (n * np.log(norm)).sum()
                    about[2] += n.sum()
                gamma = np.concatenate([np.full((bare, topics), prior), settled])
                about[0] += ((prior - gamma) * expected_logs(gamma) + ln_gamma(gamma)).sum() - ln_gamma(gamma.sum(1)).sum() + len(ids) * (ln_gamma(np.array(topics * prior)) - topics * ln_gamma(np.array(prior)))
                about[1] += len(ids)
        if about[1]:
            words = np.flatnonzero(seen)
            cuts = np.searchsorted(words, np.arange(0, size + BLOCK, BLOCK))
            rows = [(k, words[x:y]) for k, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
            yield pa.RecordBatch.from_arrays([pa.array([-1, *(k for k, _ in rows)], pa.int32()), pa.array([np.zeros(1, np.int32).tobytes(), *((w - k * BLOCK).astype(np.int32).tobytes() for k, w in rows)], pa.binary()),
                                              pa.array([about.tobytes(), *(total[w].tobytes() for _, w in rows)], pa.binary())], names=["block", "at", "z"])

    kinds = "block int, at binary, z binary"
    out, about = np.zeros((size, topics)), np.zeros(3)
    sums = docs.select("ids", "counts").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, kinds).groupBy("block").applyInArrow(_summed, kinds)
    for r in sums.collect():
        z = np.frombuffer(r["z"], np.float64)
        if r["block"] < 0:
            about = z
        else:
            out[r["block"] * BLOCK + np.frombuffer(r["at"], np.int32)] = z.reshape(-1, topics)
    out *= shared.value
    shared.destroy()
    return np.ascontiguousarray(out.T), float(about[0]), int(about[1]), int(about[2])


def topics_bound(model: Model) -> float:
    """The topics' part of the bound."""
    w, e = model.weights, model.word_prior
    return float(sum(((e - x) * y + ln_gamma(x)).sum() for x, y in zip(w, model.logs)) - len(w) * ln_gamma(e).sum() + len(w) * ln_gamma(e.sum()) - ln_gamma(w.sum(1)).sum())


def bound(docs: DataFrame, model: Model) -> float:
    """Lower bound on the log-likelihood of docs (see bags)."""
    return statistics(docs, model)[1] + topics_bound(model)


def newton_step(prior: np.ndarray, weights: np.ndarray, rate: float, logs: np.ndarray | None = None) -> np.ndarray:
    """A share of a Newton step of the word prior towards the likeliest one for the topics (Minka 2000).

    The Hessian is diagonal but for a constant, so the step takes linear time. A step that would leave the
    positive numbers is not made. logs: expected_logs(weights), if known.
    """
    n = len(weights)
    logs = (expected_logs(weights) if logs is None else logs).mean(0)
    slope = n * (digamma(prior.sum()) - digamma(prior) + logs)
    curve, shared = -n * trigamma(prior), n * trigamma(prior.sum())
    step = (slope - (slope / curve).sum() / (1 / shared + (1 / curve).sum())) / curve
    new = prior - rate * step
    return new if (new > 0).all() else prior


def start(n_topics: int, n_words: int, seed: int) -> Model:
    rng = np.random.Generator(np.random.PCG64(seed))
    return Model(rng.gamma(100.0, 0.01, (n_topics, n_words)), 1 / n_topics, np.full(n_words, 1 / n_topics))


def step(model: Model, found: tuple[np.ndarray, float, int, int], n_docs: int, k: int, learn: bool = True) -> Model:
    """The model after step k (from 0): the batch's counts stand for the whole corpus, at a rate that falls with k."""
    counts, part, docs, words = found
    rate = (1.0 + k) ** -0.5
    weights = (1 - rate) * model.weights + rate * (model.word_prior + n_docs / docs * counts)
    # the batch's share of the topics' part
    history = [*model.history, (part + docs / n_docs * topics_bound(model)) / max(1, words)]
    new = Model(weights, model.topic_prior, model.word_prior, history)
    if learn:
        new.word_prior = newton_step(model.word_prior, weights, rate, new.logs)
    return new


def fit(docs: DataFrame, n_words: int, n_topics: int = 20, passes: int = 5, batches: int = 1, seed: int = 42, learn: bool = True) -> Model:
    """Online variational Bayes (Hoffman et al. 2010) over docs (see bags), batch by batch, passes times.

    The driver and each task hold matrices of topics by words, whose size the vocabulary's limit bounds;
    documents stay in their tasks. With learn the words' prior takes a Newton step at each step.
    """
    model, sizes, k = start(n_topics, n_words, seed), {r["batch"]: r["n"] for r in docs.groupBy("batch").agg(F.count("*").alias("n")).collect()}, 0
    for _ in range(passes if n_words else 0):
        for b in (b for b in range(batches) if sizes.get(b)):
            model = step(model, statistics(docs.where(F.col("batch") == b), model), sum(sizes.values()), k, learn)
            k += 1
    return model


def document_topics(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, p: shares of the topics in each document of docs (see bags)."""
    shared = docs.sparkSession.sparkContext.broadcast((np.ascontiguousarray(np.exp(model.logs).T), model.topic_prior))

    def run(batches):
        for b in batches:
            g = np.concatenate([infer(ids, counts, *shared.value) for _, ids, counts in _groups(b, 1)]) if b.num_rows else np.zeros((0, len(model.weights)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array((g / g.sum(1, keepdims=True)).tolist(), pa.list_(pa.float64()))], names=["doc_id", "p"])

    return docs.select("doc_id", "ids", "counts").mapInArrow(run, "doc_id string, p array<double>")
