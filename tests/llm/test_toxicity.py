import math
import random
import zlib

import pytest

from lodestrata.llm import toxicity as T


def edits(a, b):
    """Optimal string alignment distance."""
    d = [[i + j if not i * j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_against_brute_force():
    rng = random.Random(3)
    terms = {"abc": 1.0, "abcde": 2.0, "bbaca": 3.0, "abcabcabc": 1.5, "cabbacabba": 2.5}
    allowed = {t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0 for t in terms}
    a = T.Automaton(terms)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12))) for _ in range(1500)]
    for t in terms:
        for _ in range(300):
            w = list(t)
            for _ in range(rng.randrange(3)):
                k = rng.randrange(len(w))
                rng.choice([lambda: w.insert(k, rng.choice("abcd")), lambda: w.pop(k), lambda: w.__setitem__(k, "d"), lambda: w.insert(k, w.pop())])()
            words.append("".join(w))
    for w in words:
        fits = [(edits(t, w), -terms[t], t) for t in terms if edits(t, w) <= allowed[t]]
        got = a.match(w)
        assert (got is None) == (not fits), w
        if fits:
            assert got[1] == min(fits)[0] and a.terms[got[0]] == min(fits)[2], w


def test_many_terms_against_brute_force():
    rng = random.Random(5)
    some = lambda lo, hi: "".join(rng.choice("abcdef") for _ in range(rng.randrange(lo, hi)))
    terms = {some(3, 14): float(300 - i) for i in range(300)} | {"abca*": 1.0, "abcabc*": 2.0}
    plain = [t for t in terms if not t.endswith("*")]
    allowed = {t: 2 if len(t) >= 9 else 1 if len(t) >= 5 else 0 for t in plain}
    assert sum(n > 0 for n in allowed.values()) > 150
    found, names, _ = T._finder(terms)
    words = [some(1, 16) for _ in range(60)] + ["abcafff", "abcabcfff", "x" * 20_000, ""]
    for t in plain[-100:]:
        w = list(t)
        for _ in range(rng.randrange(1, 4)):
            k = rng.randrange(len(w))
            rng.choice([lambda: w.insert(k, rng.choice("abg")), lambda: len(w) > 1 and w.pop(k), lambda: w.__setitem__(k, "g"), lambda: w.insert(k, w.pop())])()
        words.append("".join(w))
    found.learn(set(words))
    for w in words:
        fits = [(n, -terms[t], t) for t in plain if abs(len(t) - len(w)) < 3 and (n := edits(t, w)) <= allowed[t]]
        stem = next((s for s in ("abcabc*", "abca*") if w.startswith(s[:-1])), None)
        want = (min(fits)[2], min(fits)[0]) if fits else (stem, 9) if stem else None
        got = found[w]
        assert (got and (names[got[0]], got[1])) == want, w


def test_cuttings_against_brute_force():
    rng = random.Random(2)
    for n in (1, 2, 3, 9, 42):
        words = ["".join(rng.choice("abcé😀") for _ in range(n)) for _ in range(30)]
        for most in (1, 2):
            h = T.cuttings(T.letters(words), most)
            cut = [[w] + [w[:i] + w[i + 1:] for i in range(n)] + ([w[:i] + w[i + 1:j] + w[j + 1:] for i in range(n) for j in range(i + 1, n)] if most > 1 else []) for w in words]
            of = {}
            for texts, hashes in zip(cut, h.tolist()):
                assert len(texts) == len(hashes)
                assert all(of.setdefault(t, x) == x for t, x in zip(texts, hashes))
            assert len(set(of.values())) == len(of)


def test_features_against_the_definition():
    terms = {"scumbag": 5.0, "low*": 4.0, "dungfaces": 3.0}
    found, _, w = T._finder(terms)
    texts = ["you scumbag, not scunbag. He said lowly dungface", "", None, 'x " scumbag " lower', "w " * 500_000 + "scumbag"]
    got = list(T.measured(texts, found, w))
    # you: 5 * 1.3; behind not, one edit: 5 * 0.5 * 0.7, he near: * 1.3; behind said: * 0.3, lowly behind not too
    one = [6.5, 5 * 1.3 * 0.5 * 0.7, 4 * 0.3 * 0.5 * 0.6, 3 * 0.3 * 0.7]
    assert got[0] == pytest.approx([6.5, math.log1p(sum(one)), sum(one) / 8, math.log1p(2), math.log1p(1), math.log1p(2), math.log1p(1), 1.0, math.log1p(3)])
    assert got[1] is None and got[2] is None and got[3][0] == pytest.approx(max(5 * 0.3, 4 * 0.6))
    assert got[4] == pytest.approx([5.0, math.log1p(5), 5 / 500_001, 0, math.log1p(1), 0, 0, 0.0, math.log1p(1)])


def test_stems_and_context():
    terms = {"scumbag": 5.0, "low*": 4.0}
    found, _, w = T._finder(terms)
    f = lambda t: next(T.measured([t], found, w))
    found.learn({"lowest", "scumbag!!", "5cumb4g", "scmubag"})
    assert f("nothing here") is None and f(None) is None and f("") is None
    assert found["lowest"] == (1, 9) and found["scumbag!!"] == (0, 0) and found["5cumb4g"] == (0, 0) and found["scmubag"] == (0, 1)
    assert f("you scumbag")[0] > f("a scumbag")[0] > f('he wrote "scumbag" there')[0]
    assert f("a scumbag")[0] > f("not a scumbag")[0] > 0


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    bad, rows, labels = ["vermink", "dungface", "scumbag"], [], []
    for i in range(600):
        ws = [f"w{rng.randrange(800)}" for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                ws[rng.randrange(40)] = rng.choice(bad)
        rows.append((i, " ".join(ws), "xx", 1))
        if i < 500:
            labels.append((i, int(toxic), 0))
    # labels that are held out must not count: turn them round for a word of their own
    rows += [(1000 + i, "oddword " + " ".join(f"w{rng.randrange(800)}" for _ in range(20)), "xx", 1) for i in range(60)]
    labels += [(1000 + i, 1, 0) for i in range(60) if zlib.crc32(str(1000 + i).encode()) % 5 == 0]
    rows += [(2000, None, "", 0), (2001, "", "", 0), (None, "scumbag", "", 0), (2002, "you vermnik and scunbag and dungfaec", "", 0), (2003, "w1 " * 30_000 + "scumbag dungface vermink", "", 0), (2004, "w1 w2", "", 0), (2004, "w1 w2", "", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    return rows, labels, d, spark.createDataFrame([*labels, (None, 1, 0), (3, None, 1)], "doc_id long, toxic int, quality int")


def test_held_out_accuracy(corpus):
    rows, labels, d, l = corpus
    got = T.detect(d, l).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for i, toxic, _ in labels:
        if i < 500:
            assert by[i].predicted == toxic
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    assert not any(by[1000 + i].predicted for i in range(60))
    assert by[2000].score == by[2001].score and not by[2000].predicted
    assert by[2002].predicted and by[2003].score > by[2000].score


def test_without_labels(spark, corpus):
    _, _, d, l = corpus
    assert len({r.score for r in T.detect(d, l.limit(0)).collect()}) == 1
    assert T.detect(d.limit(0), l).count() == 0
