import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import analyzer
from lodestrata.operators import index, lsa


def made(spark, n_docs, n_terms, per, seed=6, name="w{}".format):
    rng = random.Random(seed)
    p = [(name(t), f"CVE-2024-{100 + d}", "nvd", rng.randrange(1, 4)) for d in range(n_docs) for t in rng.sample(range(n_terms), per)]
    post = spark.createDataFrame(p, "term string, doc_id string, source string, tf int").persist()
    docs = post.groupBy("doc_id", "source").agg(F.sum("tf").cast("int").alias("dl")).persist()
    return index.Index(docs, post, index.term_stats(post).persist(), n_docs, 30.0)


@pytest.mark.parametrize("n_docs, n_terms", [(40, 90), (90, 40)])
@pytest.mark.parametrize("block", [64_000_000, 700])
def test_against_one_matrix(spark, monkeypatch, n_docs, n_terms, block):
    """The same vectors, up to signs, as a decomposition in one process, however small the blocks are."""
    monkeypatch.setattr(lsa, "BLOCK_BYTES", block)
    monkeypatch.setattr(lsa, "FAN", 2)
    ix = made(spark, n_docs, n_terms, 12)
    m = lsa.build(ix, 6, iterations=8)
    ws = {(r.doc_id, r.term): r.value for r in lsa.weights(ix).collect()}
    ids, terms = sorted({d for d, _ in ws}), sorted({t for _, t in ws})
    a = np.array([[ws.get((d, t), 0.0) for t in terms] for d in ids])
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    assert np.allclose(m.singular, s[:6], rtol=1e-3) and abs(m.explained - (s[:6] ** 2).sum() / (a * a).sum()) < 1e-3
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    got = np.array([{r.doc_id: r.vec for r in m.docs.collect()}[d] for d in ids]), np.array([{r.term: r.vec for r in m.terms.collect()}[t] for t in terms])
    # cosines do not depend on signs
    assert np.allclose(got[0] @ got[0].T, unit(u[:, :6]) @ unit(u[:, :6]).T, atol=0.05) and np.allclose(got[1] @ got[1].T, unit(vt.T[:, :6] * s[:6]) @ unit(vt.T[:, :6] * s[:6]).T, atol=0.05)


def test_all_components_and_documents_without_terms(spark):
    ix = made(spark, 7, 5, 3)
    ix = index.Index(ix.docs.union(spark.createDataFrame([("CVE-2024-1", "nvd", 0)], ix.docs.schema)), ix.postings, ix.stats, 8, 6.0)
    m = lsa.build(ix, 50)
    vec = {r.doc_id: r.vec for r in m.docs.collect()}
    assert len(vec) == 8 and not any(vec["CVE-2024-1"]) and {len(v) for v in vec.values()} == {4} and m.terms.count() == 5
    none = index.Index(ix.docs.limit(0), ix.postings.limit(0), ix.stats.limit(0), 0, 0.0)
    assert lsa.build(none, 3).docs.count() == 0


def test_a_task_holds_one_block(spark, monkeypatch):
    """Products keep to the rows of a block: none is larger than BLOCK_BYTES."""
    monkeypatch.setattr(lsa, "BLOCK_BYTES", 5_000)
    seen, made_by = [], lsa._products

    def watched(cells, dense, rows, width, blocks, back):
        seen.append((rows * width * 8, blocks, cells.agg(F.max("block")).first()[0], cells.select(F.max(F.array_max("c.row"))).first()[0]))
        return made_by(cells, dense, rows, width, blocks, back)

    monkeypatch.setattr(lsa, "_products", watched)
    lsa.build(made(spark, 60, 200, 9), 5, iterations=1)
    assert len(seen) == 2 and all(size <= 5_000 and blocks > 3 and most < blocks and row * 15 * 8 < 5_000 for size, blocks, most, row in seen)


def test_no_dense_matrix_is_collected_on_the_driver(spark, monkeypatch):
    """Spark's estimate of the random start is far below its size, yet no pass broadcasts it."""
    plans, made_by = [], lsa._products

    def watched(*a):
        out = made_by(*a)
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(lsa, "_products", watched)
    lsa.build(made(spark, 60, 200, 9), 5, iterations=2)
    assert len(plans) == 3 and all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)


def test_blocks_do_not_grow_with_partitions(spark, monkeypatch):
    """Each block takes all vectors of the shorter side, so blocks are as many as memory asks for, or cores where little is moved."""
    seen, made_by = [], lsa._products
    monkeypatch.setattr(lsa, "_products", lambda cells, dense, rows, width, blocks, back: seen.append(blocks) or made_by(cells, dense, rows, width, blocks, back))
    ix, was = made(spark, 60, 200, 9), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "40")
        lsa.build(ix, 5, iterations=1)
        monkeypatch.setattr(lsa, "MOVED_BYTES", 2 * 8 * 15 * 60)
        lsa.build(ix, 5, iterations=1)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert max(seen[:2]) <= spark.sparkContext.defaultParallelism < 40 and seen[2:] == [2, 2]


def test_many_queries_equal_single_ones(spark):
    words = [w for a in "bdfgk" for b in "aou" for c in "bdgkmn" if analyzer.analyze(w := f"{a}{b}{c}zork", "query") == [w]]
    assert len(words) >= 80
    m = lsa.build(made(spark, 60, 80, 12, name=words.__getitem__), 8)
    rng = random.Random(7)
    texts = {k: " ".join(rng.choice([*words[:80], "unknownword"]) for _ in range(rng.randrange(5))) for k in range(100)}
    got = {}
    for r in lsa.search_many(m, spark.createDataFrame(list(texts.items()), "query_id long, text string"), 5).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.doc_id, r.source, r.score)
    assert len(got) > 60
    for k, text in list(texts.items())[::7]:
        want = lsa.search(m, text.split(), 5).collect()
        assert [got.get(k, {}).get(i + 1) for i in range(len(want))] == [tuple(r) for r in want] and (k in got) == bool(want)


def test_nearest_many_against_nearest(spark):
    rng = np.random.default_rng(3)
    v = np.round(rng.standard_normal((500, 6)), 1)
    rows = [(k, x.tolist()) for k, x in enumerate(v)] + [(500, None), (501, [1.0]), (502, [])]
    d = spark.createDataFrame(rows, "vec_id long, e array<float>").repartition(7)
    q = spark.createDataFrame([(k, v[k % 3].tolist()) for k in range(40)] + [(40, None), (41, [2.0])], "query_id int, vec array<double>")
    got = {}
    for r in lsa.nearest_many(d, "vec_id", "e", q, 9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(range(40)) | {41} and got[41] == [(1, 501, 2.0)]
    x = v.astype(np.float32).astype(float)
    for k in range(40):
        s = np.round(x @ v[k % 3], 6)
        want = sorted(range(500), key=lambda i: (-s[i], i))[:9]
        assert sorted(got[k]) == [(i + 1, w, s[w]) for i, w in enumerate(want)]
