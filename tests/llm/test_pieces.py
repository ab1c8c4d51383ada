import random

import pytest

from lodestrata.llm import pieces as P

RNG = random.Random(6)
TEXTS = ["".join(RNG.choice(al) for _ in range(RNG.randrange(1, 400))) for al in ("ab", "the ing", "aeionrst", "e ", "abc \n\té①😀", "hello world thing") for _ in range(6)] + ["x" * 3000, "theingeration" * 150, " " * 900, "a▁b c", "\x00 \r\n", " lead", "trail "]


@pytest.fixture(scope="module")
def lib():
    with open(P.MODEL, "rb") as f:
        return P.load(f.read())


@pytest.mark.parametrize("size", [5, 40, 1000])
def test_scan_against_the_library(lib, size):
    for t in TEXTS:
        assert P.encode_giant(lib, t, size) == lib.lib.encode(t), t[:50]


def test_distributed(spark, lib):
    rows = [(i, t, "x", [1]) for i, t in enumerate(TEXTS)] + [(900, None, "x", [1]), (901, "", "x", [1]), (None, "ab " * 50, "x", [1]), (902, "same " * 60, "x", [1]), (902, "same " * 60, "x", [1])]
    d = spark.createDataFrame(rows, "doc_id long, text string, s string, ids array<int>")
    for giant in (10**6, 50):
        e = P.encode(d, giant=giant, size=37).persist()
        got = sorted(((r.doc_id, r.ids, r.n_tokens, r.round_trip) for r in e.collect()), key=repr)
        want = sorted(((i, x := lib.lib.encode(t or ""), len(x), "▁" not in (t or "")) for i, t, *_ in rows), key=repr)
        assert got == want
        texts = {r.doc_id: r.text for r in P.decode(e).collect()}
        assert all(texts[i] == (t or "") for i, t, *_ in rows if "▁" not in (t or ""))
        e.unpersist()
    assert P.encode(d.limit(0)).count() == 0


def test_products_are_associative():
    rng = random.Random(9)
    some = lambda: [tuple(rng.randrange(3) for _ in range(4)) for _ in range(rng.randrange(12))]
    for _ in range(200):
        a, b, c = some(), some(), some()
        assert set(P.product(P.product(a, b), c)) == set(P.product(a, P.product(b, c)))
        assert set(P.product(a, b)) == {(*x[:2], *y[2:]) for x in a for y in b if x[2:] == y[:2]}
