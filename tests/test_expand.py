import random

import numpy as np
import pyarrow as pa
import pytest

from lodestrata.operators import expand


def sets(rng, n, most, words):
    # few words are frequent, most are rare
    return {f"{'CVE-2024-' if most else 'T'}{k}": {min(int(rng.expovariate(0.15)), words - 1) for _ in range(rng.randrange(most or 30))} for k in range(n)}


@pytest.mark.parametrize("least", [1, 2, 3, 6])
def test_overlaps_against_all_pairs(spark, least):
    rng = random.Random(least)
    docs, techs = sets(rng, 120, 40, 60), sets(rng, 25, 0, 60)
    want = sorted((d, t, len(x & y)) for d, x in docs.items() for t, y in techs.items() if len(x & y) >= least)
    left = spark.createDataFrame([(d, f"w{w}") for d, x in docs.items() for w in x], "a string, term string")
    right = spark.createDataFrame([(t, f"w{w}") for t, x in techs.items() for w in x], "b string, term string")
    assert sorted((r.a, r.b, r.overlap) for r in expand.overlaps(left, right, least).collect()) == want
    assert sorted((r.a, r.b, r.overlap) for r in expand._counted(left, [(r.b, r.term) for r in right.collect()], least).collect()) == want
    assert expand.overlaps(left.limit(0), right, least).count() == expand._counted(left, [], least).count() == expand._counted(left.limit(0), [("T1", "w1")], least).count() == 0


def test_frequent_terms_join_little(spark):
    """Prefixes leave out what joins most: of pairs by the two most frequent terms, below a tenth is left."""
    rng = random.Random(9)
    docs = {f"d{k}": {"the", "of"} | {f"w{rng.randrange(4000)}" for _ in range(12)} for k in range(300)}
    techs = {f"t{k}": {"the", "of"} | {f"w{rng.randrange(4000)}" for _ in range(12)} for k in range(100)}
    left = spark.createDataFrame([(d, w) for d, x in docs.items() for w in x], "a string, term string")
    right = spark.createDataFrame([(t, w) for t, x in techs.items() for w in x], "b string, term string")
    common = spark.createDataFrame([(w, sum(w in x for x in docs.values()) * sum(w in x for x in techs.values())) for w in set().union(*docs.values()) & set().union(*techs.values())], "term string, n long")
    by = lambda x, y: {r.term: r["count"] for r in x.join(y, "term").groupBy("term").count().collect()}
    whole, less = by(left, right), by(expand._prefixes(left, "a", common, 3), expand._prefixes(right, "b", common, 3))
    assert whole["the"] == 30_000 and less.get("the", 0) + less.get("of", 0) < 0.1 * (whole["the"] + whole["of"]) and sum(less.values()) < 0.1 * sum(whole.values())


def test_both_ways_give_one_map(spark, monkeypatch):
    from lodestrata import catalog

    d = "/root/testdata/sf0.001"
    e = catalog._engine(spark, d)
    rows = lambda: sorted(map(tuple, expand.technique_cve(e.index.postings, catalog.techniques(spark, d)).collect()))
    held = rows()
    monkeypatch.setattr(expand, "BROADCAST_TERMS", 10)
    assert held == rows() and held


def test_matches_that_a_task_holds_are_bounded(monkeypatch):
    """A batch of sets whose terms all techniques have is counted in parts: rows alone do not tell what is held."""
    starts = np.arange(0, 51 * 40, 40)  # each of 50 terms is 40 techniques'
    b = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(300)]), pa.array([list(range(k % 51)) for k in range(300)], pa.list_(pa.int32()))], names=["a", "codes"])
    monkeypatch.setattr(expand, "MATCHES", 5_000)
    got = list(expand._parts(b.slice(7), starts, 40))
    assert [lo for lo, _ in got] == [0, *(hi for _, hi in got[:-1])] and got[-1][1] == 293
    sizes = [sum((7 + k) % 51 * 40 for k in range(lo, hi)) for lo, hi in got]
    assert max(sizes) <= 5_000 and min(sizes[:-1]) > 2_500
    monkeypatch.setattr(expand, "MATCHES", 1)
    assert all(sum((7 + k) % 51 for k in range(lo, hi)) == 0 or hi == lo + 1 for lo, hi in expand._parts(b.slice(7), starts, 40))


def test_a_map_of_texts_needs_no_index(spark, monkeypatch):
    """F16: the map straight from texts equals that of the index's postings; only texts are shuffled, and the heat map's query builds no index."""
    from lodestrata import catalog
    from lodestrata.operators import index

    rng, words = random.Random(4), ["heaps", "overflow", "Kernel,", "smb", "xss", "T1021.002", "remote", "codes", "executing", "the", "<b>", "café", "http://x.org/y", "2021"]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rows = [(f"{'CVE' if k % 3 else 'cve'}-2024-{k}", "nvd", text(rng.choice([0, 4, 30]))) for k in range(400)] + [("CVE-2024-900", "nvd", None), ("T1", "attack", text(30)), (None, "nvd", text(30))]
    corpus = spark.createDataFrame(rows, "doc_id string, source string, text string")
    techs = spark.createDataFrame([(f"T{k}", text(2), text(rng.choice([1, 8])), None, ["Linux"], None) for k in range(9)], "tid string, name string, description string, detection string, platforms array<string>, data_sources array<string>")
    got = expand.technique_cve_of_texts(corpus, techs)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan
    found = sorted(map(tuple, got.collect()))
    assert found and found == sorted(map(tuple, expand.technique_cve(index.Index.build(corpus).postings, techs).collect()))
    assert expand.technique_cve_of_texts(corpus, techs.limit(0)).count() == expand.technique_cve_of_texts(corpus.limit(0), techs).count() == 0
    monkeypatch.setattr(expand, "BROADCAST_TERMS", 3)
    assert found == sorted(map(tuple, expand.technique_cve_of_texts(corpus, techs).collect()))
    monkeypatch.setattr(expand, "BROADCAST_TERMS", 1_000_000)
    monkeypatch.setattr(catalog, "_cache", {})
    monkeypatch.setattr(catalog, "_engine", lambda s, d: pytest.fail("an index was built"))
    assert catalog.QUERIES["tactic_topic_heatmap"](spark, "/root/testdata/sf0.001").count() == len(catalog.TACTICS)


def test_expansions_take_whole_descriptions(spark, tmp_path):
    """terms behind a description's 500th and a detection's 200th character link advisories too, in the queries and their SQL."""
    import duckdb

    from lodestrata import catalog

    t = spark.createDataFrame([("T1", "name", "filler " * 80 + "overflow", "watch " * 40 + "kernel", None, None)], "tid string, name string, description string, detection string, platforms array<string>, data_sources array<string>")
    terms = lambda **how: {r.term for r in expand.technique_terms(t, **how).collect()}
    assert terms() - terms(beginning=expand.BEGINNING) == {"overflow", "kernel"}
    behind = "thtion " + "padding " * 70 + "zebra quartz violin"
    docs = [(1, "zebra quartz violin"), (2, "something about CVE-2024-1 here"), (3, "thtion only"), (4, None), (5, "")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, behind), (1, "another text")], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for x in ("documents", "benchmark"):
        con.execute(f"create view {x} as select * from '{tmp_path}/{x}.parquet/*.parquet'")
    sql = catalog.sql()
    for q in ("bm25_expanded", "saved_bm25_expanded", "technique_cve"):
        got = catalog.QUERIES[q](spark, str(tmp_path))
        rows = sorted(tuple(r) for r in got.collect())
        assert rows == sorted(con.execute(f"select {', '.join(got.columns)} from ({sql[q]})").fetchall())
        # the map by itself is that of beginnings
        assert ("CVE-2024-2" in {r[1] for r in rows}) == (q != "technique_cve") and (rows == []) == (q == "technique_cve")
