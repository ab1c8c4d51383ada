import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestrata.llm import licenses as L

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(text, phrases):
    """n_words and (place, words, label) of phrases, by comparing words at each place."""
    w = WORD.findall(lowered(text))
    return len(w), sorted((i, len(p.split()), x) for p, x in phrases.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split())


def one(text, **how):
    return L.scan_text(text.encode(), tuple(L.BASE.items()), tuple(L.NOTICES.items()), **how)


def all_phrases():
    every = {**L.BASE, **L.NOTICES}
    return {p: x for p, x in {**{p.replace("license", "licence"): x for p, x in every.items()}, **every}.items() if x != L.EXCEPTION}


def check(r, text):
    n, hits = brute(text, all_phrases())
    _, base = brute(text, L.BASE)
    at = [i for i, _, _ in base]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), min(at, default=None), max(at, default=None)), text
    assert r["base_labels"] == ",".join(sorted({x for _, _, x in base}))
    assert set(r["labels"].split(",")) >= {x for _, _, x in hits} and 0 <= r["score"] <= 1
    return sorted((h["word"], h["words"], h["label"]) for h in r["hits"]) == hits


def test_base_and_hits_against_brute_force(spark):
    rng = random.Random(4)
    bits = [w for p in (*L.BASE, *L.NOTICES) for w in p.split()] + ["CC", "BY", "cc-by", "Licence", "é", "İ", "ſ", "K", "or", "and", "with", "\x00", "\x7f", "\n", "CC_BY", "all\nrights\treserved"]
    texts = [None, "", "  \n", "cc", "by cc by", "cc by cc by cc by", "All rights--reserved!", "GENERAL PUBLIC LICENSES", "éall rights reserved", "all rights reservedé", "general general public license public license"]
    texts += ["".join(rng.choice(bits) + rng.choice([" ", " ", "-", "  ", ". ", "\n", "é "]) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i, t, "x", None) for i, t in enumerate(texts)] + [(None, "cc by", "x", 1)] * 2
    d = spark.createDataFrame(rows, "doc_id long, text string, hits string, labels long").repartition(3)
    got = L.scan(d).collect()
    assert len(got) == len(rows) and sum(r.doc_id is None for r in got) == 2
    for r in got:
        text = "cc by" if r.doc_id is None else texts[r.doc_id]
        assert check(r.asDict(True), text), text
    assert L.scan(d.limit(0)).count() == 0


@pytest.mark.parametrize("text, labels, score", [
    ("", "", 0), ("nothing here", "", 0), ("Licensed under CC BY-NC 4.0.", "cc-by,cc-by-nc", L.LIMITED), ("GNU General Public License, version 3", "gpl", L.STRONG),
    ("GNU Lesser General Public License", "gpl,lgpl", L.WEAK), ("the MIT license or the GNU General Public License", "gpl,mit", L.PERMISSIVE),
    ("MIT License and GNU General Public License", "gpl,mit", L.STRONG), ("MIT license. " + "word " * 40 + "or General Public License", "gpl,mit", L.STRONG),
    ("GNU General Public License with the Classpath Exception", "gpl", L.WEAK), ("linking exception", "", 0),
    ("// SPDX-License-Identifier: MIT OR Apache-2.0\ncode", "apache,mit", L.PERMISSIVE), ("/* SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0 */", "gpl", L.WEAK),
    ("SPDX-License-Identifier: (MIT AND GPL-3.0-or-later) OR CC0-1.0", "cc0,gpl,mit", L.PUBLIC), ("SPDX-License-Identifier: MIT AND GPLv3 OR CC0-1.0 AND MIT", "cc0,gpl,mit", L.PERMISSIVE),
    ("SPDX-License-Identifier: Strange-1", "other", L.UNKNOWN), ("License: strange thing", "", 0), ("License: MIT/BSD-3-Clause", "bsd,mit", L.PERMISSIVE),
    ("SPDX-License-Identifier:\nMIT", "", 0), ("SPDX-License-Identifier: MIT AND", "mit", L.PERMISSIVE), ("SPDX-License-Identifier: ((MIT", "mit", L.PERMISSIVE),
    ("license: MIT license: AGPL-3.0", "agpl,mit", L.STRONG), ("All rights reserved", "reserved", L.RESERVED), ("CC0 or all rights reserved", "cc0,reserved", L.PUBLIC)])
def test_labels_and_score(text, labels, score):
    r = one(text)
    assert (r["labels"], r["score"]) == (labels, score)
    check(r, text)


NAMES = {"mit": L.PERMISSIVE, "gpl-3.0": L.STRONG, "lgpl": L.WEAK, "cc0-1.0": L.PUBLIC, "cc-by-nc-4.0": L.LIMITED}


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.3:
        return rng.choice(list(NAMES))
    return (rng.choice(["and", "or"]), tree(rng, depth - 1), tree(rng, depth - 1))


def shown(t, rng):
    """The tree with only the brackets that it needs, and some others."""
    if isinstance(t, str):
        return t if rng.random() < 0.8 else f"({t})"
    part = lambda x, right: f"({shown(x, rng)})" if not isinstance(x, str) and (t[0] == "and" and x[0] == "or" or right and x[0] == t[0] or rng.random() < 0.2) else shown(x, rng)
    return f"{part(t[1], False)} {rng.choice([t[0], t[0].upper()])} {part(t[2], True)}"


def meant(t):
    return NAMES[t] if isinstance(t, str) else (max if t[0] == "and" else min)(meant(t[1]), meant(t[2]))


def test_expressions_against_trees():
    rng = random.Random(5)
    for _ in range(500):
        t = tree(rng, 5)
        r = one(f"SPDX-License-Identifier: {shown(t, rng)}\n")
        assert len(r["expressions"]) == 1 and r["expressions"][0]["valid"] and r["score"] == meant(t)


def test_broken_expressions_never_fail():
    rng = random.Random(6)
    for _ in range(2000):
        r = one("SPDX-License-Identifier: " + " ".join(rng.choice(["(", ")", "and", "or", "with", "mit", "gpl", "x-exception", "/", "?"]) for _ in range(rng.randrange(12))))
        assert 0 <= r["score"] <= 1


@pytest.mark.parametrize("text", ["cc by " * 200_000, "license: mit " * 80_000, "SPDX-License-Identifier: " + "(" * 1_000_000, "SPDX-License-Identifier: " + "(mit and " * 100_000, "SPDX-License-Identifier: mit" + " or mit" * 150_000, "x" * 1_000_000, "\n" * 1_000_000])
def test_long_texts_take_linear_time(text):
    began = time.time()
    one(text)
    assert time.time() - began < 10


def test_query(spark):
    d = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()}
    got = L.op11_license_scans(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        _, base = brute(docs[r.doc_id], L.BASE)
        assert r.n_base == len(base) and r.base_labels == ",".join(sorted({x for _, _, x in base})) and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    assert any(r.score > 0 for r in got)
    assert [f.dataType.simpleString() for f in L.op11_license_scans(spark, d).schema] == ["bigint"] * 5 + ["string", "string", "double"]
