"""What grows with the corpus: tables instead of caches, what is shuffled, and sizes of tasks."""
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.functions import analyzer
from lodestrata.operators import index


def _exchanges(df):
    return re.findall(r"(\w*Exchange)\b", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture(scope="module")
def words():
    """Words of their own stems: consonants only."""
    return ["".join(random.Random(k).choices("bcdfghjklmnpqrtvwx", k=7)) for k in range(1500)]


def test_an_index_is_a_table_by_document(spark, words):
    """lengths and postings are read from rows of bounded size, without an exchange, and nothing is kept in caches but statistics."""
    rng = random.Random(1)
    texts = {f"CVE-2024-{k}": " ".join(rng.choices(words, k=rng.choice([0, 1, 30, 3000]))) for k in range(60)} | {"T1": None}
    c = spark.createDataFrame([(d, "nvd" if d[0] == "C" else "attack", t) for d, t in texts.items()], "doc_id string, source string, text string")
    i = index.Index.build(c)
    assert _exchanges(i.docs) == _exchanges(i.postings) == [] and "InMemoryTableScan" not in i.docs._jdf.queryExecution().executedPlan().toString()
    want = {d: {} for d in texts}
    for d, t in texts.items():
        for w in analyzer.analyze(t):
            want[d][w] = want[d].get(w, 0) + 1
    assert {(r.term, r.doc_id): r.tf for r in i.postings.collect()} == {(w, d): n for d, ws in want.items() for w, n in ws.items()} and i.postings.count() == sum(map(len, want.values()))
    assert {r.doc_id: r.dl for r in i.docs.collect()} == {d: sum(ws.values()) for d, ws in want.items()} and i.docs.count() == len(texts)
    assert max(map(len, want.values())) > analyzer.LISTED == i.lists.agg(F.max(F.size("list"))).first()[0]
    i.release()


def test_tasks_of_the_analysis_do_not_follow_the_files(spark, tmp_path):
    """a file of many splits and one row group is one task's rows until it is dealt anew."""
    rows = [(f"CVE-2024-{k}", "nvd", "text") for k in range(4000)]
    spark.createDataFrame(rows, "doc_id string, source string, text string").coalesce(1).write.parquet(str(tmp_path / "x"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        c = spark.read.parquet(str(tmp_path / "x"))
        most = lambda x: x.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
        assert c.rdd.getNumPartitions() >= 8 and most(c) == 4000 and most(analyzer.spread(c)) < 1000
    finally:
        for k, v in zip(("maxPartitionBytes", "openCostInBytes"), old):
            spark.conf.set(f"spark.sql.files.{k}", v)


def test_patterns_are_left_out_only_where_they_cannot_match():
    """most texts have no identifiers; they are split at once, and give what all patterns would."""
    rng, bits = random.Random(3), ["CVE-2021-", "cve-", "12", "2021-7", "cwe-79", "CWE-", "T1021", ".002", "TA0001", "t1021", "ms17-010", "Mſ17-010", "MS", "capec-66", " ", " ", "\n", "RCE", "xss", "heaps", "ß", "-", ","]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randrange(12)))
        rest = text
        for p in analyzer._IDS:
            rest = p.sub(" ", rest)
        every = [x.upper() for p in analyzer._IDS for x in p.findall(text)] + [analyzer.L.ACRONYMS.get(t.lower(), t) for t in rest.split()]
        assert analyzer.words(text) == every and analyzer.analyze(text) == [t for w in every if (t := analyzer._index_term(w))]
    assert analyzer._id_patterns("plain words, some 12 of them") == []


def test_blocks_shuffle_documents_not_postings(spark, words, monkeypatch):
    """blocks of a built index equal those of any index, over range, batch and row borders, and need no aggregation of postings."""
    from lodestrata.operators import blocks

    rng = random.Random(5)
    texts = {f"{'T' if k % 7 == 0 else 'CVE-2024-'}{k}": " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 1200]))) for k in range(700)}
    i = index.Index.build(spark.createDataFrame([(d, "attack" if d[0] == "T" else "nvd", t) for d, t in texts.items()], "doc_id string, source string, text string"))
    monkeypatch.setattr(blocks, "HELD", 2_000)
    b = blocks.build(i)
    assert len(blocks._cuts(b.docs)) > 1 and all(c % blocks.SIZE == 0 for c, _ in blocks._cuts(b.docs))
    assert "Aggregate" not in b.lists._jdf.queryExecution().executedPlan().toString()
    num = {r.code: r for r in b.docs.collect()}
    got = [(r.term, num[r.block * blocks.SIZE + x.slot].doc_id, x.tf) for r in b.lists.collect() for x in r.list]
    assert sorted(got) == sorted((r.term, r.doc_id, r.tf) for r in i.postings.collect()) and b.lists.count() == b.lists.select("term", "block").distinct().count()
    other = blocks.build(index.Index(i.docs, i.postings, i.stats, i.n_docs, i.avg_dl))
    rows = lambda x: sorted((*r[:-1], sorted(map(tuple, r[-1]))) for r in x.lists.collect())
    assert rows(b) == rows(other)


def test_a_saved_index_has_the_same_postings(spark, words, monkeypatch, tmp_path):
    """codes of frequent terms reach postings without a shuffle, those of the others by a join, ties of frequency included; tasks sort a bounded number."""
    rng = random.Random(6)
    i = index.Index.build(spark.createDataFrame([(f"CVE-2024-{k}", "nvd", " ".join(rng.choices(words[:200], k=20) + [words[0]])) for k in range(300)], "doc_id string, source string, text string"))
    monkeypatch.setattr(index, "FREQUENT", 20)
    monkeypatch.setattr(index, "SORTED", 200)
    i.save(str(tmp_path / "x"))
    j = index.Index.load(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, j.postings.collect())) == sorted(map(tuple, i.postings.collect())) and j.coded.count() == i.postings.count()
    files = j.coded.groupBy(F.input_file_name()).count().collect()
    assert len(files) > 8 and max(r["count"] for r in files) < 1000
    plan = index.with_codes(i.postings, j.codes)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_expanded_queries_shuffle_no_postings(spark, words):
    """Terms of an expansion that the index lacks are left out first, the others reach the scan."""
    from lodestrata.operators import blocks, rank

    rng = random.Random(7)
    i = index.Index.build(spark.createDataFrame([(f"CVE-2024-{k}", "nvd", " ".join(rng.choices(words[:50], k=20))) for k in range(200)], "doc_id string, source string, text string"))
    w = spark.createDataFrame([(words[0], 1.0), (words[1], 0.5), *((f"CVE-1-{k}", 0.4) for k in range(3000))], "term string, weight double")
    want = rank.top(rank.score(i, {words[0]: 1.0, words[1]: 0.5})).collect()
    s = rank.score(i, w)
    assert rank.top(s).collect() == want == blocks.search(blocks.build(i), i, w)[0].collect()
    plan = s._jdf.queryExecution().optimizedPlan().toString()
    assert words[0] in plan and "CVE-1-7" not in plan.split("InMemoryRelation")[0]


def test_buckets_follow_the_first_batch(spark, words, tmp_path):
    """a bucket is no larger than a task of the analysis, and rows that end others are found within buckets."""
    from lodestrata.operators.generations import Generations

    rng = random.Random(8)
    made = lambda ks: spark.createDataFrame([(f"CVE-2024-{k}", "nvd", " ".join(rng.choices(words[:60], k=15))) for k in ks], "doc_id string, source string, text string")
    c = made(range(200)).repartition(10)
    g = Generations.open(spark, str(tmp_path / "g"), corpus=c)
    assert g.buckets == 40
    g.append(c, 0)
    assert "Window" not in g.postings()._jdf.queryExecution().optimizedPlan().toString()
    g.append(made(range(0, 200, 3)), 1)
    dead = g._dead(g._live(2).where("cast(substring(doc_id, 10) as int) % 3 = 0"), 2)
    got = {tuple(r) for r in dead.collect()}
    assert set(_exchanges(dead)) <= {"BroadcastExchange"}
    assert got and got == {(r.doc_id, r.term) for r in g._rows("postings").where("tf = 0").collect()}


def test_rules_by_their_ends_are_the_rules_in_order():
    """F16: rules are found by a word's last letters, and a word that no rule takes is left at once; both as a scan of all rules would have it."""
    from lodestrata.functions import porter

    def scan(w, rules, least):
        for suffix, other in rules:
            if w.endswith(suffix):
                n = len(w) - len(suffix)
                return w[:n] + other if porter._shape(w[:n]).count("VC") > least and (suffix != "ion" or w[n - 1:n] in ("s", "t")) else w
        return w

    def shape(w):
        out = ""
        for c in w:
            out += "V" if c in "aeiou" or c == "y" and out[-1:] == "C" else "C"
        return out

    four, rng = [(x, "") for x in porter.STEP4], random.Random(2)
    ends = [x for x, _ in (*porter.STEP2, *porter.STEP3, *four)] + ["s", "ies", "sses", "ed", "eed", "ied", "ing", "y", "e", "ll", "logi", "at", "tt"]
    for _ in range(20_000):
        w = "".join(rng.choices("aeiouybcdlnrstwxé1", k=rng.randrange(5))) + "".join(rng.choices(ends, k=rng.randrange(3)))
        assert porter._shape(w) == shape(w)
        for rules, held, least in ((porter.STEP2, porter._STEP2, 0), (porter.STEP3, porter._STEP3, 0), (four, porter._STEP4, 1)):
            assert porter._by_rules(w, held, least) == scan(w, rules, least)
        if len(w) > 2 and w[-1] not in "esy" and w[-2:] not in porter._ENDS:
            assert porter.stem(w) == w == porter._derivation(porter._inflection(w)) == scan(scan(w, porter.STEP3, 0), four, 1)


def test_cleaning_is_left_out_only_where_it_changes_nothing():
    """F16: tokens of letters only, and those without a sign of what is cleaned, give the terms that all steps would."""
    rng, bits = random.Random(9), ["http://", "https://x", "www", ".", "com", ".io", "&", "amp;", "<", ">", "lt;", "gt", "</", "_", "[", "#", "9", "٣", "²", "heaps", "Word", "é", "K", ",", "'", "-", "/", "T1021", "CVE-2021-", "12"]
    for _ in range(20_000):
        token = x = "".join(rng.choices(bits, k=rng.randrange(1, 6)))
        for p in analyzer._CLEAN:
            x = p.sub("", x)
        x = x.strip(analyzer.string.punctuation)
        word = "" if any(map(str.isdigit, x)) else re.sub("[^a-zA-Z]", "", x).lower()
        want = "" if len(word) <= 2 or word in analyzer._INDEX_STOPS else analyzer.porter.stem(word)
        assert analyzer._index_term(token) == (token.upper() if analyzer._ID_TOKEN.match(token) else want if len(want) > 2 else ""), token
