import math
import random
import re

from pyspark.sql import functions as F

from lodestrata.llm import quality as Q

SCHEMA = "doc_id long, text string, lang string, kept string, w int, n_chars long"


def brute(text):
    t = text or ""
    w = [x for x in re.split("[ \t-\r]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^ \t-\r]", x)]
    at = {}
    for i in range(len(w) - 4):
        at.setdefault(tuple(w[i:i + 5]), []).append(i)
    cover = {i + k for v in at.values() if len(v) > 1 for i in v for k in range(5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover)


def test_base_counts(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\x0b ", "a\n\na \na", "é😀 # | x", "a b c d e " * 7, "x y z", "1 2 3 4 5", "1 2 3 4 5 1 2 3 4 5"] + [" ".join(rng.choice("ab c\n#".split(" ")) for _ in range(rng.randrange(90))) for _ in range(60)] + [" ".join(f"w{i}" for i in range(50))] + ["z " * 40_000 + "y"]
    rows = [(i, t, None if i % 5 == 0 else ("en", "xx", "fr")[i % 3], "no", 3, None) for i, t in enumerate(texts)] + [(None, "a b", "en", "no", 1, 1)] * 2
    d = spark.createDataFrame(rows, SCHEMA)
    got, text = Q.judge(d).collect(), {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    out = Q.clean(d)
    assert out.columns == d.columns
    assert sorted(x.doc_id for x in out.collect()) == sorted(x.doc_id for x in got if x.kept)
    for r in got:
        n, chars, symbols, lines, repeat = brute(text[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeat), r.doc_id
        assert r.base_failed == (n < 10 or 100 * repeat > 20 * n)
        assert not (r.kept and r.base_failed)
    assert Q.judge(d.limit(0)).count() == 0


def jsd(a, b):
    p, q = ([x / sum(h) for x in h] for h in (a, b))
    kl = lambda x, m: sum(u * math.log2(u / v) for u, v in zip(x, m) if u)
    m = [(u + v) / 2 for u, v in zip(p, q)]
    return math.sqrt((kl(p, m) + kl(q, m)) / 2)


def test_distance(spark):
    rows = [([1.0, 2.0, 0.0], [3.0, 0.0, 1.0]), ([1.0, 1.0], [5.0, 5.0]), ([0.0, 1.0], [1.0, 0.0]), ([0.0], [1.0]), (None, [1.0])]
    got = [r.d for r in spark.createDataFrame(rows, "a array<double>, b array<double>").select(Q.distance(F.col("a"), F.col("b")).alias("d")).collect()]
    assert abs(got[0] - jsd(*rows[0])) < 1e-6
    assert got[1] == 0 and got[2] == 1 and got[3] is None and got[4] is None


def test_odd_documents_are_told_from_prose(spark):
    rng = random.Random(1)
    common, rare = Q.COMMON["en"], [f"{chr(97 + i % 26)}{'aeiou'[i % 5]}{chr(97 + i // 26)}" for i in range(400)]
    prose = [" ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(200)) for _ in range(60)]
    odd = [" ".join(w + "###" for w in prose[0].split()), prose[1].upper(), " | ".join(rng.choice(rare) for _ in range(150))]
    d = spark.createDataFrame([(i, t, "en", "", 0, 0) for i, t in enumerate(prose + odd)], SCHEMA)
    kept = {r.doc_id: r.kept for r in Q.judge(d).collect()}
    assert all(kept[i] for i in range(60)) and not any(kept[i] for i in (60, 61, 62))
