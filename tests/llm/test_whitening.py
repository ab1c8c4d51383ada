import math
import random

import numpy as np
import pytest

from lodestrata.llm import whitening as W

SCHEMA = "vec_id long, embedding array<float>, x0 string, n int"


def brute(rows, width):
    """What the query says of (vec_id, vector) rows, by numpy and whole numbers in one process."""
    keep = [(i, v) for i, v in rows if v is not None and len(v) == width and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in keep]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    a = np.array(x, float) - np.array(sums) / n
    cov = a.T @ a / n
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:8], v[:, ::-1][:, :8]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x]
    return [i for i, _ in keep], n, deviation, a @ v / np.sqrt(e), e / np.trace(cov)


def compare(got, want):
    ids, n, deviation, w, explained = want
    by = {}
    for r in got:
        by.setdefault(r.component, {}).setdefault(r.vec_id, []).append(r)
        assert r.n == n and r.identity_error <= 1e-9
    assert sorted(by) == list(range(1, w.shape[1] + 1)) and len(got) == w.size
    for k, rows in by.items():
        mine = np.array([rows[i][0].whitened for i in ids])
        assert min(np.abs(mine - w[:, k - 1]).max(), np.abs(mine + w[:, k - 1]).max()) < 1e-8, k
        assert all(r.deviation == d and math.isclose(r.explained, explained[k - 1], rel_tol=1e-9) for i, d in zip(ids, deviation) for r in rows[i])


def query(spark, tmp_path, rows, schema=SCHEMA, parts=3):
    spark.createDataFrame(rows, schema).repartition(parts).write.mode("overwrite").parquet(str(tmp_path / "embeddings.parquet"))
    return W.op12_embedding_whitening(spark, str(tmp_path))


def test_whole_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{d}/embeddings.parquet").collect()]
    got = W.op12_embedding_whitening(spark, d)
    assert [(f.name, f.dataType.simpleString()) for f in got.schema] == [("vec_id", "bigint"), ("component", "int"), ("n", "bigint"), ("deviation", "bigint"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")]
    compare(got.collect(), brute(rows, 64))


def test_odd_vectors(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, k + 1) for k in range(10)]) for i in range(80)]
    rows += [(100 + i, v) for i, v in enumerate([None, [None] + [0.0] * 9, [float("nan")] + [1.0] * 9, [float("inf")] * 10, [1e38] * 10, [], [1.0] * 9])] + [(200, rows[0][1]), (201, rows[0][1])]
    got = query(spark, tmp_path, [(i, v, "x", i % 3) for i, v in rows]).collect()
    compare(got, brute([r for r in rows if r[0] != 104], 10))
    more = query(spark, tmp_path, [(None, v, None, None) for _, v in rows]).collect()
    assert len(more) == len(got) and all(r.vec_id is None for r in more)


def test_without_variance(spark, tmp_path):
    assert query(spark, tmp_path, []).count() == 0
    assert query(spark, tmp_path, [(1, None, "", 1), (2, [], "", 1)]).count() == 0
    assert query(spark, tmp_path, [(i, [0.5, 0.25, 0.0], "", 1) for i in range(5)]).count() == 0
    line = query(spark, tmp_path, [(i, [i / 4, i / 2, 0.5], "", 1) for i in range(9)]).collect()
    assert {r.component for r in line} == {1} and len(line) == 9 and all(math.isclose(r.explained, 1) for r in line)


@pytest.mark.parametrize("size", [1, 1e6, 1e11])
def test_sums_stay_exact_or_become_doubles(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(W, "TILE", 3)
    rng = random.Random(9)
    rows = [(i, [float(np.float32(rng.gauss(3, 1) * size)) for _ in range(5)]) for i in range(60)]
    got = query(spark, tmp_path, [(i, v, "", 1) for i, v in rows], "vec_id long, embedding array<double>, x0 string, n int").collect()
    ids, n, deviation, w, explained = brute(rows, 5)
    assert (max(deviation) < 2**63) == (size == 1)
    deviation = [d if d < 2**63 else None for d in deviation]
    compare(got, (ids, n, deviation, w, explained))


def test_order_of_rows_changes_no_bit(spark, tmp_path):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], "", 1) for i in range(500)]
    fits = []
    for parts in (1, 7):
        x, width = W.entries(spark.createDataFrame(rows[::-1] if parts == 1 else rows, SCHEMA).repartition(parts))
        fits.append(W.fit(x, width))
    assert np.array_equal(fits[0].cov, fits[1].cov) and np.array_equal(fits[0].vectors, fits[1].vectors)
