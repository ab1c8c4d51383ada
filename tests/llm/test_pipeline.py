import random
from collections import Counter

import corpus_pipeline as P
from lodestrata.llm import minhash, mixing, pieces, secrets

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
COMMON = "the of and to a in is that it for was on".split()


def test_whole_run(spark, tmp_path):
    rng = random.Random(11)
    prose = lambda n: " ".join(rng.choice(COMMON) if rng.random() < 0.4 else f"{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}{rng.choice('aeiou')}" for _ in range(n))
    rows = [(i, prose(rng.randrange(80, 200)), "en", f"s{i % 3}") for i in range(60)]
    rows += [(100, rows[0][1], "en", "s1"), (101, rows[1][1] + " end", "en", None), (102, "too short", "en", "s0"), (103, "### " * 100, "en", "s0"), (104, None, None, None), (105, "", "en", "s2"),
             (106, prose(120) + " password=b7db7aa4a5fcc78305 " + prose(10), "en", "s2"), (107, prose(30_000), "en", "s0")]
    rows = [(*r, len(r[1] or "")) for r in rows]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    docs, ids = spark.read.parquet(str(tmp_path / "documents.parquet")), [{r[0] for r in rows}]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    everything = ids[0]
    assert ids[1] == everything - {102, 103, 104, 105}
    assert ids[2] == ids[1] - {100, 101}
    assert ids[3] == ids[2] and ids[4] <= ids[3]
    masked = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "secret_scans")).collect()}
    assert secrets.MASK in masked[106] and "b7db" not in masked[106] and sum(secrets.MASK in t for t in masked.values()) == 1
    sizes, took = Counter(), Counter()
    for r in spark.read.parquet(str(tmp_path / "secret_scans")).collect():
        sizes[r.source] += len(r.text.split())
    for r in docs.collect():
        took[r.source] += len(r.text.split())
    for s, t in mixing.targets(dict(sizes)).items():
        assert abs(took[s] - t) <= 1
    got = P.run(spark, str(tmp_path)).collect()
    mixed = Counter((r.doc_id, r.text) for r in docs.collect())
    with open(pieces.MODEL, "rb") as f:
        lib = pieces.load(f.read()).lib
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == Counter({k: v for k, v in Counter((i, tuple(lib.encode(t))) for i, t in mixed.elements()).items()})
    assert all(r.round_trip for r in got)


def test_empty(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert P.run(spark, str(tmp_path)).count() == 0


def test_repeated_ids_stay_once(spark):
    d = spark.createDataFrame([(1, "a b c d e f", "en", "s", 1), (1, "a b c d e f", "en", "s", 1), (1, "q r s t u v", "en", "s", 1), (None, "x", None, None, 0)], COLUMNS)
    assert sorted(((r.doc_id, r.text) for r in minhash.representatives(d).collect()), key=repr) == [(1, "a b c d e f"), (None, "x")]
