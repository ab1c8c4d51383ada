import random
from itertools import combinations

import numpy as np
import pytest

from lodestrata.llm import _common as C
from lodestrata.llm import minhash as M
from lodestrata.llm.shingles import shingle_sets

SCHEMA = "doc_id long, text string, cls long, bucket string, n long"


def plain_set(text):
    w = "".join(c.lower() if c < "\x80" else c for c in text or "").translate({i: " " for i in range(9, 14)}).split(" ")
    w = [x for x in w if x]
    return {tuple(w[i:i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute(rows):
    sets = [plain_set(t) for _, t in rows]
    top = {i: i for i, _ in rows}

    def f(x):
        while top[x] != x:
            x = top[x]
        return x
    for (i, s), (j, t) in combinations(zip([r[0] for r in rows], sets), 2):
        if s and t and 100 * len(s & t) >= 80 * len(s | t) and i is not None and j is not None:
            a, b = f(i), f(j)
            top[max(a, b)] = min(a, b)
    return sorted(((i, len(s), f(i) if i is not None else None, i is None or f(i) == i) for (i, _), s in zip(rows, sets)), key=repr)


def run(spark, rows):
    d = spark.createDataFrame([(i, t, 1, "b", 2) for i, t in rows], SCHEMA)
    return sorted((tuple(r) for r in M.near_duplicates(d).collect()), key=repr)


def test_shingles_against_tuples():
    rng = random.Random(5)
    texts = [None, "", " \t\n", "A b", "a B", "x\x0bÉ y", "one two three four", "One  two\nTHREE four\x1cfive"] + [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(80)]
    got = shingle_sets(texts)
    want = [plain_set(t) for t in texts]
    assert [len(s) for s in got] == [len(s) for s in want]
    for i, j in combinations(range(len(texts)), 2):
        assert len(np.intersect1d(got[i], got[j])) == len(want[i] & want[j])


def test_long_texts_in_pieces(monkeypatch):
    from lodestrata.llm import shingles

    texts = ["a b  c " * 40 + "x" * 700 + " d\te " * 30, "y" * 3000, " \n", None, "é A " * 200, "z" * 64, "w" * 65 + " v", "q " * 31 + "r" * 500]
    want, at = shingles.word_hashes(texts)
    monkeypatch.setattr(shingles, "PIECE", 64)
    got, places = shingles.word_hashes(texts)
    assert got.tolist() == want.tolist() and places.tolist() == at.tolist()


def test_representatives_with_any_columns(spark):
    d = spark.createDataFrame([(1, "a b c d e", {"k": 1}, "x"), (1, "a b c d a", {"k": 2}, "y"), (2, "a b c d e", None, "z"), (None, "a b c d e", None, "n"), (3, None, {}, "w")],
                              "doc_id long, text string, row map<string,int>, id string")
    got = M.representatives(d)
    assert got.columns == d.columns
    assert sorted(((r.doc_id, r.text, r.id) for r in got.collect()), key=repr) == [(1, "a b c d a", "y"), (3, None, "w"), (None, "a b c d e", "n")]


def test_odd_sketch_estimates():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 2000, dtype=np.uint64)
    for j in (0.95, 0.9, 0.8):
        n = round(2000 * j)  # union 2000, intersection n
        a, b = np.sort(base[:n + (2000 - n) // 2]), np.sort(np.concatenate([base[:n], base[n + (2000 - n) // 2:]]))
        z = int(np.bitwise_count(M.odd_sketch(M.samples(a)) ^ M.odd_sketch(M.samples(b))).sum())
        assert abs(M.similarity_from_xor(z) - j) < 0.08 and z <= M.MAX_XOR


def edits(rng, n, most):
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(5000)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("chunk", [1024, 16])
def test_against_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(M, "BUCKET_ROWS", chunk)
    monkeypatch.setattr(M, "BLOCK_CLASSES", chunk)
    rng = random.Random(chunk)
    texts = edits(rng, 60, 12) + edits(rng, 40, 5) + edits(rng, 5, 3) + ["short text", "SHORT  text", "", None, "\n", "word"] + [" ".join(f"u{rng.randrange(9**6)}" for _ in range(30)) for _ in range(20)]
    texts += texts[:5] + ["z " * 30_000, "z " * 30_001]
    rng.shuffle(texts)
    rows = [(i * 3 - 40, t) for i, t in enumerate(texts)] + [(None, "short text"), (None, None)]
    assert run(spark, rows) == brute(rows)


def test_repeated_rows_and_empty(spark):
    rows = [(4, "a b c d e"), (4, "a b c d e"), (2, "A b c d e"), (9, "q")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_components_of_a_path_and_a_star(spark):
    e = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in C.components(spark.createDataFrame(e, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and len(got) == 501
