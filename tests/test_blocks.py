import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata import catalog
from lodestrata.operators import blocks, boolean, index, rank


@pytest.fixture(scope="module")
def made(spark):
    rng = random.Random(2)
    words = ["heap", "smb", "window", "overflow"]
    rows = {}
    for k in range(700):
        d = f"CVE-2024-{k}" if k % 5 else f"T{1000 + k}"
        rows[d] = ("nvd" if k % 5 else "attack", {w: rng.choice([1, 1, 1, 2, 5]) for w in words if rng.random() < (0.5 if w == "heap" else 0.15)}, rng.randrange(200) if k % 9 else 0)
    post = spark.createDataFrame([(w, d, s, n) for d, (s, t, _) in rows.items() for w, n in t.items()], "term string, doc_id string, source string, tf int").persist()
    docs = spark.createDataFrame([(d, s, sum(t.values()) + (more if t else 0)) for d, (s, t, more) in rows.items()], "doc_id string, source string, dl int").persist()
    i = index.Index(docs, post, index.term_stats(post).persist(), len(rows), docs.agg(F.avg("dl")).first()[0])
    return rows, i, blocks.build(i)


def test_blocks_hold_all_postings(made):
    rows, _, b = made
    docs = {r.code: r for r in b.docs.collect()}
    assert sorted(docs) == list(range(len(rows))) and [(r.source, r.dl, r.doc_id) for _, r in sorted(docs.items())] == sorted((s, next(x.dl for x in docs.values() if x.doc_id == d), d) for d, (s, _, _) in rows.items())
    got = {}
    for r in b.lists.collect():
        assert r.n == len(r.list) == bin(r.bits & (2**64 - 1)).count("1") <= blocks.SIZE
        for x in r.list:
            assert r.bits >> x.slot & 1
            got[r.term, docs[r.block * blocks.SIZE + x.slot].doc_id] = x.tf
    assert got == {(w, d): n for d, (_, t, _) in rows.items() for w, n in t.items()}


@pytest.mark.parametrize("how, weights, n", [({}, {"heap": 1.0, "smb": 0.6, "window": 1.0, "none": 2.0}, 1), ({"scorer": "tfidf"}, {"heap": 1.0, "smb": 0.6}, 10), ({"source_weight": False}, {"smb": 1.0}, 10),
                                             ({"scorer": "tfidf", "source_weight": False}, {"heap": 1.0, "window": 1.0}, 1000), ({}, {"none": 1.0}, 10)])
def test_skipping_changes_no_result(made, weights, how, n):
    _, i, b = made
    got, read = blocks.search(b, i, weights, n, **how)
    assert list(map(tuple, got.collect())) == list(map(tuple, rank.top(rank.score(i, weights, **how), n).collect()))
    assert read.postings <= read.of_postings == i.postings.where(F.col("term").isin(list(weights))).count() and read.blocks <= read.of_blocks
    if n == 1 and len(weights) > 1:
        assert read.postings < read.of_postings


def test_weights_as_a_table_and_errors(spark, made):
    _, i, b = made
    w = spark.createDataFrame([("heap", 0.4), ("smb", 1.0)], "term string, weight double")
    got, read = blocks.search(b, i, w, 10)
    assert list(map(tuple, got.collect())) == list(map(tuple, rank.top(rank.score(i, w), 10).collect())) and read.postings < read.of_postings
    assert blocks.search(b, i, {})[0].count() == 0
    with pytest.raises(ValueError):
        blocks.search(b, i, {"heap": 1.0}, scorer="nope")


def test_saved_blocks(spark, made, tmp_path):
    _, i, b = made
    b.save(str(tmp_path / "b"))
    c = blocks.Blocks.load(spark, str(tmp_path / "b"))
    assert list(map(tuple, blocks.search(c, i, {"smb": 1.0})[0].collect())) == list(map(tuple, rank.top(rank.score(i, {"smb": 1.0})).collect()))
    joins = [x for x in blocks.fits(c, boolean.parse("smb AND NOT heap", str.split))._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and all("code" in x or "block" in x for x in joins) and not any("doc_id" in x for x in joins)
    assert "PushedFilters: [In(term" in c.lists.where(F.col("term").isin(["smb", "heap"]))._jdf.queryExecution().toString()


TREES = st.recursive(st.sampled_from(["heap", "smb", "window", "overflow", "zzz", "the"]), lambda x: st.one_of(st.tuples(st.sampled_from(["AND", "OR", "AND NOT"]), x, x), st.tuples(st.just("NOT"), x)), max_leaves=6)


def shown(t):
    return t if isinstance(t, str) else f"({t[0]} ({shown(t[1])}))" if len(t) == 2 else f"(({shown(t[1])}) {t[0]} ({shown(t[2])}))"


@settings(max_examples=15, deadline=None)
@given(TREES)
def test_bits_against_sets(made, tree):
    rows, _, b = made
    every = {d for d, (_, t, _) in rows.items() if t}

    def meant(t):
        if isinstance(t, str):
            return {d for d in every if t in rows[d][1]}
        a = meant(t[1])
        return every - a if t[0] == "NOT" else a & meant(t[2]) if t[0] == "AND" else a | meant(t[2]) if t[0] == "OR" else a - meant(t[2])

    parsed = boolean.parse(shown(tree), lambda q: [w for w in q.split() if w != "the"])
    assert sorted(r.doc_id for r in blocks.fits(b, parsed).collect()) == sorted(meant(tree))


def test_corpus_skips_most(spark):
    e = catalog._blocked(spark, "/root/testdata/sf0.01")
    w = dict.fromkeys(e.terms(catalog.QUERY), 1.0)
    got, read = blocks.search(e.blocks, e.index, w)
    assert list(map(tuple, got.collect())) == list(map(tuple, rank.top(rank.score(e.index, w)).collect()))
    assert 2 * read.postings < read.of_postings
    # more terms than CLOSE: looser bounds, the same result
    many = {t.term: 1.0 for t in e.index.stats.where("df > 3").orderBy("term").limit(blocks.CLOSE + 4).collect()}
    got, read = blocks.search(e.blocks, e.index, many, 5)
    assert len(many) > blocks.CLOSE and list(map(tuple, got.collect())) == list(map(tuple, rank.top(rank.score(e.index, many), 5).collect()))
