import math

import numpy as np
import pytest

from lodestrata.llm import embeddings as E


def brute(rows):
    ok = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    top, links = {i: i for i, _ in rows if i is not None}, {}

    def f(x):
        while top[x] != x:
            x = top[x]
        return x
    for a in ok:
        for b in ok:
            if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / math.sqrt((ok[a] @ ok[a]) * (ok[b] @ ok[b])) >= 0.95:
                links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                top[max(f(a), f(b))] = min(f(a), f(b))
    out = [(i, links.get(i, 0), f(i), i == f(i)) for i in top]
    return sorted(out) + [(None, 0, None, True)] * sum(i is None for i, _ in rows)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(E, "CHUNK", chunk)
    rng = np.random.default_rng(chunk)
    rows = []
    for g in range(12):
        base = rng.standard_normal(16)
        for _ in range(25):
            rows.append((base + rng.standard_normal(16) * rng.choice([0, 0.05, 0.2, 0.3])).tolist())
    rows += [rng.standard_normal(16).tolist() for _ in range(100)] + [rng.standard_normal(5).tolist()] * 3
    rows += [None, [], [0.0] * 16, [1.0, None] + [0.0] * 14, [float("nan")] * 16, [float("inf")] + [0.0] * 15, [2.0 * x for x in rows[0]]]
    order = rng.permutation(len(rows)).tolist()
    rows = [(order[i] - 30, v) for i, v in enumerate(rows)] + [(None, [1.0] * 16)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows], "vec_id long, embedding array<float>, label int, v double")
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = sorted((tuple(r) for r in E.near_duplicates(df).collect()), key=lambda r: (r[0] is None, r))
    assert got == brute(rows)


def test_repeated_rows_and_empty(spark):
    s = "vec_id long, embedding array<float>"
    got = E.near_duplicates(spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (1, [2.0, 0.0])], s)).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 1, True), (3, 1, 1, False)]
    assert E.near_duplicates(spark.createDataFrame([], s)).count() == 0


def test_tables_leave_the_stated_miss():
    for n in (2, 1000, 10**9):
        bits, tables = E.plan_tables(n)
        assert (1 - (1 - math.acos(0.95) / math.pi) ** bits) ** tables <= E.MISS
