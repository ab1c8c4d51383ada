import math
import random

import numpy as np
import pytest

from lodestrata import catalog
from lodestrata.operators import lda, topics

SMALL = "/root/testdata/sf0.001"


def alone(docs, n_words, n_topics, passes, batches, seed=42, learn=True):
    """fit() in one process, document by document, word by word."""
    m, k = lda.start(n_topics, n_words, seed), 0
    for _ in range(passes):
        for b in range(batches):
            mine = [d for d in docs if d.batch == b]
            if not mine:
                continue
            beta, counts, part, words = np.exp(lda.expected_logs(m.weights)), np.zeros_like(m.weights), 0.0, 0
            for d in mine:
                g = np.ones(n_topics) if d.ids else np.full(n_topics, m.topic_prior)
                for _ in range(lda.ROUNDS if d.ids else 0):
                    theta = np.exp(lda.expected_logs(g[None])[0])
                    new = np.full(n_topics, m.topic_prior)
                    for i, c in zip(d.ids, d.counts):
                        new += c * theta * beta[:, i] / (theta @ beta[:, i])
                    change, g = np.abs(new - g).mean(), new
                    if change < lda.SETTLED:
                        break
                logs = lda.expected_logs(g[None])[0]
                theta = np.exp(logs)
                for i, c in zip(d.ids, d.counts):
                    counts[:, i] += c * theta * beta[:, i] / (theta @ beta[:, i])
                    part += c * math.log(theta @ beta[:, i])
                    words += c
                part += sum((m.topic_prior - x) * y + math.lgamma(x) - math.lgamma(m.topic_prior) for x, y in zip(g, logs)) + math.lgamma(n_topics * m.topic_prior) - math.lgamma(g.sum())
            m = lda.step(m, (counts, part, len(mine), words), len(docs), k, learn)
            k += 1
    return m


def test_special_functions():
    x = np.array([1e-3, 0.05, 0.5, 1.0, 3.7, 20.0, 1e4])
    assert np.allclose(lda.ln_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    h = 1e-5 * x
    assert np.allclose(lda.digamma(x), (lda.ln_gamma(x + h) - lda.ln_gamma(x - h)) / (2 * h), rtol=1e-6, atol=1e-7)
    assert np.allclose(lda.trigamma(x), (lda.digamma(x + h) - lda.digamma(x - h)) / (2 * h), rtol=1e-6)


def test_rounds_take_all_lengths_at_once(monkeypatch):
    """Documents of any lengths share a round's functions of topics, and have the weights that each has by itself."""
    rng = np.random.default_rng(5)
    beta = np.exp(lda.expected_logs(rng.gamma(2.0, 1.0, (4, 600)))).T.copy()
    ids = [np.sort(rng.choice(600, k, replace=False)) for k in (0, 1, 2, 7, 30, 31, 90, 250, 600, 0, 3)]
    counts = [rng.integers(1, 5, len(i)) for i in ids]

    def alone(i, n):
        gamma = np.ones((1, 4))
        for _ in range(lda.ROUNDS):
            theta = np.exp(lda.expected_logs(gamma))
            new = 0.25 + theta * ((n / (beta[i] @ theta[0])) @ beta[i])
            gamma, change = new, np.abs(new - gamma).mean()
            if change < lda.SETTLED:
                break
        return gamma[0]

    want = np.array([alone(i, n) if len(i) else np.full(4, 0.25) for i, n in zip(ids, counts)])
    calls, logs = [], lda.expected_logs
    monkeypatch.setattr(lda, "expected_logs", lambda x: calls.append(len(x)) or logs(x))
    assert np.allclose(lda.infer(ids, counts, beta, 0.25), want, rtol=1e-9)
    assert len(list(lda._padded(ids, counts))) > 3 and len(calls) <= lda.ROUNDS and calls[0] == 9 and calls[-1] < 9


@pytest.mark.parametrize("learn", [True, False])
def test_fit_agrees_with_one_process(spark, learn):
    tokens = topics.topic_corpus(catalog.corpus(spark, SMALL)).persist()
    words = [r.term for r in topics.vocabulary(tokens).orderBy("term").collect()]
    bags = lda.bags(tokens.repartition(5), words, 3).persist()
    docs = sorted(bags.collect(), key=lambda d: d.doc_id)
    assert {d.doc_id: dict(zip(d.ids, d.counts)) for d in docs} == {d.doc_id: {words.index(w): d.tokens.count(w) for w in set(d.tokens) & set(words)} for d in tokens.collect()}
    got, want = lda.fit(bags, len(words), 5, 2, 3, learn=learn), alone(docs, len(words), 5, 2, 3, learn=learn)
    assert np.allclose(got.weights, want.weights, rtol=1e-6) and np.allclose(got.word_prior, want.word_prior, rtol=1e-6) and np.allclose(got.history, want.history, rtol=1e-6)
    assert learn == (np.ptp(got.word_prior) > 1e-3)


def mixed(spark, n=240, seed=3):
    rng = random.Random(seed)
    groups = [[f"{g}{i}" for i in range(25)] for g in ("red", "sea", "oak")]
    rows = [(str(k), [rng.choice(groups[k % 3]) if rng.random() < 0.9 else "common" for _ in range(40)]) for k in range(n)] + [("empty", ["never"] * 6)]
    return groups, spark.createDataFrame(rows, "doc_id string, tokens array<string>")


def test_bound_rises_and_topics_are_found(spark):
    groups, t = mixed(spark)
    words = sorted({w for g in groups for w in g} | {"common"})
    bags = lda.bags(t, words, 2).persist()
    bounds = [lda.bound(bags, lda.fit(bags, len(words), 3, p, 2)) for p in range(6)]
    assert all(b > a for a, b in zip(bounds, bounds[1:])), bounds
    # a full-batch step with the prior it has is coordinate ascent
    m = lda.fit(bags, len(words), 3, 3, 2)
    assert lda.bound(bags, lda.step(m, lda.statistics(bags, m), t.count(), 0, learn=False)) > lda.bound(bags, m)
    got = topics.train(t, 3, passes=8, chunk=100, no_above=0.999)
    assert sorted({w[:3] for w in (x.word for x in r.terms)} for r in topics.topic_terms(got, 12).collect()) == sorted([{"red"}, {"sea"}, {"oak"}]) or all(len({x.word[:3] for x in r.terms} - {"com"}) == 1 for r in topics.topic_terms(got, 12).collect())
    own = {r.doc_id: r.dominant_topic for r in got.doc_topics.collect()}
    assert len({own[str(k)] for k in range(0, 240, 3)}) == 1 and len(set(own[str(k)] for k in range(3))) == 3 and own["empty"] == 0


def test_a_step_takes_as_many_tasks_as_cores(spark):
    """Each task sends a matrix's rows, so their number must not grow with the partitions; rows of words that no document has stay away."""
    rng = random.Random(5)
    rows = [(sorted(rng.sample(range(9_000), 3)), [1, 2, 3]) for _ in range(100)] + [([], [])]
    docs, m = spark.createDataFrame(rows, "ids array<int>, counts array<int>").repartition(50), lda.start(4, 9_000, 1)
    sc = spark.sparkContext
    sc.setJobGroup("one step", "")
    counts, _, n, words = lda.statistics(docs, m)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("one step")
    sizes = [sc.statusTracker().getStageInfo(k).numTasks for j in jobs for k in sc.statusTracker().getJobInfo(j).stageIds if sc.statusTracker().getStageInfo(k)]
    # the other stages of a step deal out the rows and add them up
    assert 50 not in sizes and jobs
    assert (n, words) == (101, 600) and abs(counts.sum() - 600) < 1e-6 and set(np.flatnonzero(counts.any(0))) == {i for ids, _ in rows for i in ids}
    assert [len(r) for r, _, _ in lda._padded([np.arange(k) for k in (0, 3, 400, 3, 0)], [np.ones(k) for k in (0, 3, 400, 3, 0)])] == [2, 1]


def test_learned_prior_raises_the_likelihood_of_topics(spark):
    rng = np.random.default_rng(1)
    weights = rng.gamma(5.0, 1.0, (20, 40)) * np.linspace(0.2, 8, 40)
    p = np.full(40, 0.05)

    def likely(p):
        return len(weights) * (lda.ln_gamma(p.sum()) - lda.ln_gamma(p).sum()) + ((p - 1) * lda.expected_logs(weights)).sum()

    for _ in range(30):
        q = lda.newton_step(p, weights, 0.5)
        assert likely(q) >= likely(p) - 1e-9
        p = q
    assert np.corrcoef(p, weights.mean(0))[0, 1] > 0.8
    assert (lda.newton_step(np.full(40, 1e-9), weights, 1.0) > 0).all()


def test_saved_model(spark, tmp_path):
    _, t = mixed(spark, 60)
    got = topics.train(t, 3, passes=2, no_above=1.0)
    topics.save(got, str(tmp_path / "m"))
    back = topics.load(spark, str(tmp_path / "m"))
    assert np.array_equal(back.model.weights, got.model.weights) and np.array_equal(back.model.word_prior, got.model.word_prior) and back.words == got.words
    long = spark.createDataFrame([(k, w, float(x)) for k, p in enumerate(got.model.shares) for w, x in zip(got.words, p)], "topic_id int, word string, weight double")
    terms = lambda d: {r.topic_id: [tuple(x) for x in r.terms] for r in d.collect()}
    assert terms(topics.top_terms(long, 7)) == terms(topics.topic_terms(back, 7))
    none = topics.train(t.limit(0), 3, passes=2)
    assert none.words == [] and none.doc_topics.count() == 0


def listed(docs, words, window):
    """Counts by listing every window."""
    n = {("", ""): 0}
    for ts in docs:
        ts = ts or []
        for lo in range(max(1, len(ts) - window + 1)):
            have = sorted(set(ts[lo:lo + window]) & words)
            n["", ""] += 1
            for k, a in enumerate(have):
                for b in have[k:]:
                    n[a, b] = n.get((a, b), 0) + 1
    return n


@pytest.mark.parametrize("window", [1, 2, 5, 110])
def test_windows_against_a_list_of_all(spark, window):
    rng = random.Random(window)
    docs = [None, [], ["a"], ["a", "a"], ["x"] * 9] + [[rng.choice("abcdexyz") for _ in range(rng.randrange(1, 260))] for _ in range(60)]
    terms = spark.createDataFrame([(0, [(w, 1.0) for w in "abc"]), (1, [(w, 1.0) for w in "cde"])], "topic_id int, terms array<struct<word:string,weight:double>>")
    t = spark.createDataFrame([(str(k), d) for k, d in enumerate(docs)], "doc_id string, tokens array<string>").repartition(6)
    near = {(a, b) for g in ("abc", "cde") for a in g for b in g if a <= b} | {("", "")}
    want = {k: v for k, v in listed(docs, set("abcde"), window).items() if k in near}
    counts = topics.window_counts(terms, t, window)
    assert {(r.a, r.b): r.n for r in counts.collect()} == want
    c = topics.coherence(terms, t, window=window).first()
    assert c.n_docs == len(docs) and c.n_topics == 2 and 0 <= c.c_v <= 1
    assert topics.coherence(terms, t, 7, window).first().n_docs == 7


def test_windows_of_a_long_document_and_many_tasks(spark):
    terms = spark.createDataFrame([(0, [("a", 1.0), ("b", 1.0)])], "topic_id int, terms array<struct<word:string,weight:double>>")
    t = spark.createDataFrame([(str(k), ["a", "b", "x"] * 100_000 if k == 0 else ["a", "x"]) for k in range(8)], "doc_id string, tokens array<string>").repartition(8)
    counts = topics.window_counts(terms, t, 3)
    assert {(r.a, r.b): r.n for r in counts.collect()} == {("", ""): 300_005, ("a", "a"): 300_005, ("b", "b"): 299_998, ("a", "b"): 299_998}
    assert t.rdd.getNumPartitions() == 8 and "SinglePartition" not in counts._jdf.queryExecution().toString()
