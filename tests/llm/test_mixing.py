import time
from collections import Counter

from pyspark.sql import functions as F

from lodestrata.llm import mixing as M

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, key string, at int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, None, s, None, 7, "k", 1) for i, t, s in rows], SCHEMA)


def test_targets_cap_and_share():
    t = M.targets({"b": 100, "a": 1000, None: 10_000, "c": 5})
    assert t["c"] == 15 and t["b"] == 300  # both at three times their size
    assert abs(sum(t.values()) - 11_105) < 1e-6
    # a weighs 5, None weighs 5 (fourth in turn); a is at its limit too
    assert t["a"] == 3000 and t[None] == 11_105 - 3315
    assert M.targets({}) == {} and M.targets({"x": 0}) == {"x": 0.0}


def test_shards_give_each_slot_once():
    got = Counter()
    for shard, i, first, n in M.plan_shards({"x": 5000, "y": 70_000, "z": 0}, per_shard=100, shards=50, run=300):
        got.update((i, j) for j in range(first, first + n))
    assert set(got.values()) == {1} and len(got) == 75_000


def test_permutation(spark):
    for n in (1, 2, 3, 17, 1000):
        df = spark.range(n).select(M.permuted(F.col("id"), F.lit(n).cast("long"), F.lit("k")).alias("p"))
        assert sorted(r.p for r in df.collect()) == list(range(n))


def test_mix_keeps_to_targets(spark):
    rows = [(i, "w " * (i * 37 % 900), f"s{i % 5}" if i % 7 else None) for i in range(400)] + [(400, None, "s1"), (401, "", "s9"), (402, "one two", "tiny"), (402, "one two", "tiny"), (None, "x y z", "s2")]
    d = docs(spark, rows)
    got = M.mix_sources(d, block=64).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.taken <= 3 * r.size
    by = Counter()
    for r in got:
        by[r.source] += r.taken
    for r in got:
        assert abs(by[r.source] - r.target) <= 0.5
    again = M.mix_sources(d.repartition(5), block=64).collect()
    assert Counter(tuple(r) for r in got) == Counter(tuple(r) for r in again)
    # the documents of the mix hold just the words taken
    out = M.mixed_documents(d, block=64)
    assert out.columns == d.columns
    words = Counter()
    for r in out.collect():
        words[r.source] += len(r.text.split())
        assert r.n_chars == len(r.text)
    assert words == Counter({k: v for k, v in by.items() if v})
    # as brute force: full turns take whole documents
    whole = {(r.doc_id, r.source): r.taken // r.size for r in got if r.size}
    assert all(v <= 3 for v in whole.values())


def test_empty(spark):
    d = docs(spark, [])
    assert M.mix_sources(d).count() == 0
    assert M.mixed_documents(d).count() == 0


def test_mix_against_brute_force(spark):
    """Slots walked one by one over streams of single words."""
    block = 16
    rows = [(i, "w " * (i * 37 % 90), f"s{i % 4}" if i % 7 else None) for i in range(90)] + [(400, "one two", "tiny"), (400, "one two", "tiny"), (401, None, "s1"), (None, "x y z", "s2")]
    d = M._measured(docs(spark, rows))
    n = M._sizes(d)
    sizes = {r["source"]: r["size"] for r in n}
    goal = M.targets(sizes)
    placed = M.place(d, n).select("doc_id", "source", "size", "at").collect()
    slots = sorted(M.slots_of(spark, sizes, goal, block).collect(), key=lambda s: (s.source or "~", s.slot))
    stream = {s: [None] * size for s, size in sizes.items()}
    for k, r in enumerate(placed):
        for w in range(r.at, r.at + r["size"]):
            assert stream[r.source][w] is None
            stream[r.source][w] = k
    taken, given, seen = Counter(), Counter(), {}
    for s in slots:
        blocks, need = -(-sizes[s.source] // block), min(round(goal[s.source]), 3 * sizes[s.source])
        assert s.turn == s.slot // blocks and s.block not in seen.setdefault((s.source, s.turn), set())
        seen[s.source, s.turn].add(s.block)
        words = stream[s.source][s.block * block:(s.block + 1) * block]
        words = words[:need - given[s.source]]
        assert s.words == len(words) > 0
        given[s.source] += len(words)
        taken.update(words)
    assert given == Counter({s: min(round(goal[s]), 3 * z) for s, z in sizes.items() if z})
    want = Counter((r.doc_id, r.source, r["size"], taken[k]) for k, r in enumerate(placed))
    assert Counter((r.doc_id, r.source, r["size"], r.taken) for r in M.mix_sources(docs(spark, rows), block=block).collect()) == want


def test_time_grows_with_a_text(spark):
    text = " ".join(f"w{i}" for i in range(1_000_000))
    began = time.time()
    got = M.mixed_documents(docs(spark, [(1, text, "a"), (2, "x " * 40_000, "b"), (3, "y " * 100_000, "c")])).select("doc_id", "text").collect()
    assert time.time() - began < 60
    whole, have = text.split(), Counter()
    for r in got:
        if r.doc_id == 1:
            have.update(r.text.split())
    assert have and max(have.values()) <= 3 and set(have) <= set(whole)
