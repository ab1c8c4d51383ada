import gzip
import json
import math
import os
import random
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestrata.functions import analyzer, porter
from lodestrata.operators import boolean, expand, index, lsa, rank, topics
from lodestrata.plans.engine import Engine
from lodestrata.sources import files, nvd

DOCS = {"CVE-2024-1": ("nvd", "heap overflow heap smb"), "CVE-2024-2": ("nvd", "smb window"), "T1001": ("attack", "smb window heap"), "CVE-2024-4": ("nvd", "")}


@pytest.fixture(scope="module")
def micro(spark):
    p = [(w, d, s, t.split().count(w)) for d, (s, t) in DOCS.items() for w in set(t.split())]
    post = spark.createDataFrame(p, "term string, doc_id string, source string, tf int").persist()
    docs = spark.createDataFrame([(d, s, len(t.split())) for d, (s, t) in DOCS.items()], "doc_id string, source string, dl int").persist()
    return index.Index(docs, post, index.term_stats(post).persist(), 4, 2.25)


STEMS = """caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing hopping hop falling fall hissing hiss filing file
happy happi sky sky relational relat rational ration triplicate triplic hopeful hope revival reviv adoption adopt probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil conditional condit digitizer digit operator oper feudalism feudal formality formal sensibility sensibl electrical electr allowance allow
airliner airlin replacement replac adjustment adjust effective effect tanned tan conflated conflat troubled troubl sized size flies fli dies die ties tie dying die crying cri say say""".split()


def test_porter():
    assert [(w, porter.stem(w)) for w, want in zip(STEMS[::2], STEMS[1::2]) if porter.stem(w) != want] == []


def test_porter_against_expressions():
    rng = random.Random(1)
    ends = [x for x, _ in (*porter.STEP2, *porter.STEP3)] + [*porter.STEP4, "s", "ed", "ing", "y", "e", "ll", "ies", "eed", "ied", "sses", "logi", ""]
    words = sorted({"".join(rng.choice("aeioubcdlsty-yrnw2é") for _ in range(rng.randrange(1, 6))) + rng.choice(ends) + rng.choice(ends) for _ in range(20000)} | set(STEMS))
    con = duckdb.connect()
    con.execute("create table t (word varchar)")
    con.execute("insert into t select unnest(?)", [words])
    got = con.execute(f"select word, stem from ({porter.stem_sql('select word from t', 'word', 'stem')})").fetchall()
    assert len(got) == len(words) and [(w, x) for w, x in got if porter.stem(w) != x] == []


def test_import_without_spark_jars(tmp_path):
    """Queries and SQL are listed where pyspark has no jars and no session can start."""
    import pyspark

    (tmp_path / "pyspark").mkdir()
    for f in Path(pyspark.__file__).parent.iterdir():
        if f.name != "jars":
            (tmp_path / "pyspark" / f.name).symlink_to(f)
    code = "import pyspark, __spark_entry__ as e; assert not __import__('pathlib').Path(pyspark.__file__).parent.joinpath('jars').exists(); q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), set(s) <= set(q))"
    env = {**os.environ, "PYTHONPATH": f"{tmp_path}:{Path(__file__).resolve().parent.parent}"}
    env.pop("SPARK_HOME", None)
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and out.stdout.strip().endswith("True"), out.stderr


def test_analyzer_cases(spark):
    cases = {"use-after-free": "useafterfre", "heap.": "heap", "java.io.File": None, "foo.component": None, "www.x.y": None, "log4j": None, "don't": "dont", "<b>heap</b>": "heap",
             "&lt;b&gt;Heap": "bheap", "réseau": "rseau", "os": None, "NVD-CWE-noinfo": None, "cve-2021-1": "CVE-2021-1", "cve-2021-1,": None, "RCE": "rce", "c2": None, "x²abc": None}
    df = spark.createDataFrame([(k, "nvd", k) for k in cases], "doc_id string, source string, text string")
    got = {r.doc_id: r.term for r in analyzer.terms(df, "query").collect()}
    assert got == {k: v for k, v in cases.items() if v}
    text = "patch CWE-79, cve-2020-1 then CVE-2021-44228 and T1021.002, t1190 MS17-010 RCE c2 RCE,"
    df = spark.createDataFrame([("a", "nvd", text), ("b", "nvd", None)], "doc_id string, source string, text string")
    got = {r.doc_id: r.tokens for r in analyzer.token_arrays(df).collect()}
    assert got["a"] == ["CVE-2020-1", "CVE-2021-44228", "CWE-79", "T1021.002", "MS17-010", "patch", "T1190", "remotecodeexecut", "commandcontrol", "rce"] and got["b"] == []
    t = spark.createDataFrame([("a", "nvd", "Log4j <b>heap</b> CAPEC-86 CVE-2021-1 fix overflow")], "doc_id string, source string, text string")
    assert analyzer.topic_tokens(t).first().tokens == ["logj", "heap", "capec", "overflow"]


@pytest.mark.parametrize("weights, how, want", [
    ({"heap": 1.0, "smb": 1.0}, {}, [("T1001", 1.186755), ("CVE-2024-1", 1.056372), ("CVE-2024-2", 0.375447)]),
    ({"heap": 1.0, "smb": 1.0}, {"source_weight": False}, [("CVE-2024-1", 1.056372), ("T1001", 0.912889), ("CVE-2024-2", 0.375447)]),
    ({"heap": 1.0, "smb": 1.0}, {"scorer": "tfidf"}, [("CVE-2024-1", 1.530275), ("T1001", 1.364769), ("CVE-2024-2", 0.356675)]),
    ({"heap": 1.0, "smb": 0.6}, {}, [("T1001", 1.025476), ("CVE-2024-1", 0.950690), ("CVE-2024-2", 0.225268)])])
def test_scores(micro, weights, how, want):
    got = [(r.doc_id, r.score) for r in rank.top(rank.score(micro, weights, **how)).collect()]
    assert [d for d, _ in got] == [d for d, _ in want] and all(abs(a - b) < 2e-6 for (_, a), (_, b) in zip(got, want))


def test_index_tables(spark, micro):
    assert {r.term: r.word_code for r in index.dictionary(micro.stats).collect()} == {"heap": 0, "overflow": 1, "smb": 2, "window": 3}
    assert {r.term: r.df for r in micro.stats.collect()} == {"heap": 2, "overflow": 1, "smb": 3, "window": 2}
    assert tuple(index.collection_stats(micro.docs).first()) == (4, 2.25)
    with pytest.raises(ValueError):
        rank.score(micro, {"heap": 1.0}, "nope")
    two = index.merge(micro.postings.where("source = 'nvd'"), micro.postings.where("source = 'attack'"))
    assert sorted(map(tuple, two.collect())) == sorted(map(tuple, micro.postings.collect()))
    d = spark.createDataFrame([("a", "x", 1, 0), ("a", "y", 1, 5), ("a", "z", 0, 9)], "doc_id string, text string, feed int, place int")
    assert index.dedup(d).first().text == "y"
    assert sorted(map(tuple, index.dedup(d.select("doc_id", "text")).collect())) == [("a", "z")]
    many = spark.createDataFrame([(f"CVE-2024-{k}",) for k in range(500)] + [("heap",), ("a",)], "term string")
    assert [r.term for r in index.dictionary(many).orderBy("word_code").collect()] == sorted(r.term for r in many.collect())
    assert index.dictionary(many.limit(0)).count() == 0


def test_vocabulary_and_map_totals(spark):
    t = spark.createDataFrame([(str(k), ["common", "common", f"w{k % 3}"] + (["half"] if k % 2 else [])) for k in range(30)], "doc_id string, tokens array<string>")
    v = lambda **how: {r.term: r.df for r in topics.vocabulary(t, **how).collect()}
    assert v(no_above=0.5) == {"half": 15, "w0": 10, "w1": 10, "w2": 10} and v(no_below=11, no_above=1.0) == {"common": 30, "half": 15} and v(no_above=1.0, keep=2) == {"common": 30, "half": 15}
    assert topics.vocabulary(t.limit(0)).count() == 0
    p = spark.createDataFrame([("T1", "C1"), ("T1", "C1"), ("T2", "C1")], "tid string, cve_id string")
    assert tuple(expand.map_totals(p).first()) == (2, 2) and tuple(expand.map_totals(p.limit(0)).first()) == (0, 0)


ANALYZE = lambda t: [w for w in t.lower().split() if w != "the"]


@pytest.mark.parametrize("query, want", [
    ("heap AND window", ["T1001"]), ("heap OR window", ["CVE-2024-1", "CVE-2024-2", "T1001"]), ("NOT heap", ["CVE-2024-2"]), ("smb AND NOT heap", ["CVE-2024-2"]),
    ("heap window OR overflow", ["CVE-2024-1", "T1001"]), ("heap OR smb AND window", ["CVE-2024-1", "CVE-2024-2", "T1001"]), ("(heap OR smb) AND window", ["CVE-2024-2", "T1001"]),
    ("the AND smb", []), ("NOT the", ["CVE-2024-1", "CVE-2024-2", "T1001"]), ("the", [])])
def test_boolean(micro, query, want):
    assert sorted(r.doc_id for r in boolean.execute(micro, boolean.parse(query, ANALYZE)).collect()) == want


@pytest.mark.parametrize("query", ["heap NOT smb", "heap (smb)", "NOT NOT heap", "(heap", "AND heap", "a AND NOT NOT b", "", "heap)"])
def test_boolean_errors(query):
    with pytest.raises(boolean.BooleanSyntaxError):
        boolean.parse(query, ANALYZE)


TREES = st.recursive(st.sampled_from(["heap", "smb", "window", "overflow", "zzz"]), lambda x: st.one_of(
    st.tuples(st.sampled_from(["AND", "OR", "AND NOT"]), x, x), st.tuples(st.just("NOT"), x)), max_leaves=6)


def shown(t):
    return t if isinstance(t, str) else f"({t[0]} ({shown(t[1])}))" if len(t) == 2 else f"(({shown(t[1])}) {t[0]} ({shown(t[2])}))"


def meant(t):
    all_ = {d for d, (_, x) in DOCS.items() if x}
    if isinstance(t, str):
        return {d for d in all_ if t in DOCS[d][1].split()}
    a = meant(t[1])
    return all_ - a if t[0] == "NOT" else a & meant(t[2]) if t[0] == "AND" else a | meant(t[2]) if t[0] == "OR" else a - meant(t[2])


@settings(max_examples=12, deadline=None)
@given(TREES)
def test_boolean_against_sets(micro, tree):
    assert {r.doc_id for r in boolean.execute(micro, boolean.parse(shown(tree), ANALYZE)).collect()} == meant(tree)


def test_expansion(spark):
    k = spark.createDataFrame([("heap", "T1001"), ("heap", "T1002"), ("smb", "T1001"), ("T1001", "T1001")], "keyword string, tid string")
    p = spark.createDataFrame([("T1001", "CVE-2024-1"), ("T1001", "CVE-2024-2")], "tid string, cve_id string")
    f = lambda *t: {r.term: r.weight for r in expand.expand(list(t), k, p).collect()}
    assert f("smb", "CVE-2024-2") == {"smb": 1.0, "CVE-2024-2": 1.0, "T1001": 0.6, "CVE-2024-1": 0.4}
    assert f("T1001") == {"T1001": 1.0, "CVE-2024-1": 0.4, "CVE-2024-2": 0.4} and f("zzz") == {"zzz": 1.0}


def test_heatmap_and_urls(spark):
    tac = spark.createDataFrame([("T1001", "Execution"), ("T1001", "Persistence"), ("T1002", "Execution"), ("T1003", "Impact")], "tid string, tactic string")
    pairs = spark.createDataFrame([("T1001", "C1"), ("T1001", "C2"), ("T1002", "C1")], "tid string, cve_id string")
    d = spark.createDataFrame([("c1", 0), ("C2", 1)], "doc_id string, dominant_topic int")
    assert [tuple(r) for r in topics.tactic_topic(pairs, tac, d, 3).collect()] == [("Execution", 2, 1, 0), ("Impact", 0, 0, 0), ("Persistence", 1, 1, 0)]
    u = spark.createDataFrame([("CVE-2024-1",), ("T1021.002",), ("X1",)], "d string").select(rank.result_url(F.col("d")))
    assert [r[0] for r in u.collect()] == ["https://nvd.nist.gov/vuln/detail/CVE-2024-1", "https://attack.mitre.org/techniques/T1021/002/", ""]


def test_lsa(micro):
    m = lsa.build(micro, 2)
    got = {r.doc_id: r.score for r in lsa.search(m, ["heap", "smb"], 10).collect()}
    want = {"CVE-2024-1": 0.791846, "T1001": 0.728679, "CVE-2024-2": 0.439650, "CVE-2024-4": 0.0}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-4 for k in want)
    assert lsa.search(m, ["zzz"], 5).count() == 0 and 0 < m.explained <= 1 and math.isclose(m.memory_mb(), 16 * 4 / 2**20)


def test_lsa_query_has_all_components(spark, monkeypatch):
    import numpy as np

    from lodestrata import catalog

    rng = random.Random(6)
    words = ["thtion", "erbl", "attion", *(f"w{i}" for i in range(120))]
    p = [(w, f"CVE-2024-{100 + d}", "nvd", rng.randrange(1, 4)) for d in range(80) for w in rng.sample(words, 15)]
    post = spark.createDataFrame(p, "term string, doc_id string, source string, tf int").persist()
    docs = post.groupBy("doc_id", "source").agg(F.sum("tf").cast("int").alias("dl")).persist()
    e = Engine(spark, index.Index(docs, post, index.term_stats(post).persist(), 80, 30.0))
    monkeypatch.setattr(catalog, "_engine", lambda s, d: e)
    got = {r.doc_id: r.score for r in catalog.QUERIES["lsa_top10"](spark, "").collect()}
    assert len(e.semantic.singular) == 79
    ws = {(r.doc_id, r.term): r.value for r in lsa.weights(e.index).collect()}
    ids, terms = sorted({d for d, _ in ws}), sorted({t for _, t in ws})
    u, s, vt = np.linalg.svd(np.array([[ws.get((d, t), 0.0) for t in terms] for d in ids]), full_matrices=False)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    q = sum(unit(vt.T[:, :79] * s[:79])[terms.index(t)] for t in words[:3])
    want = dict(zip(ids, unit(u[:, :79]) @ (q / np.linalg.norm(q))))
    assert set(got) == set(sorted(ids, key=lambda d: -want[d])[:10]) and all(abs(got[d] - want[d]) < 1e-4 for d in got)


V1 = {"CVE_Items": [{"cve": {"CVE_data_meta": {"ID": "cve-2024-1"}, "description": {"description_data": [{"lang": "en", "value": "Heap overflow"}, {"lang": "fr", "value": "non"}]},
      "problemtype": {"problemtype_data": [{"description": [{"lang": "en", "value": "CWE-79"}]}]},
      "references": {"reference_data": [{"name": "http://x.test/a", "tags": ["Patch"]}, {"name": "Vendor Bulletin", "tags": ["Exploit"]}]}}}]}
V2 = {"vulnerabilities": [{"cve": {"id": "CVE-2024-2", "descriptions": [{"lang": "en", "value": "SMB"}, {"lang": "es", "value": "no"}],
      "weaknesses": [{"description": [{"lang": "es", "value": "CWE-1"}, {"lang": "en", "value": "CWE-2"}]}, {"description": []}]}}, {"cve": {"id": ""}}]}
T = {"type": "attack-pattern", "name": "Remote Services", "revoked": False, "x_mitre_deprecated": False, "description": "line one\nline two", "external_references": [
    {"source_name": "other", "description": "note"}, {"source_name": "mitre-attack", "external_id": "t1021.002"}], "x_mitre_detection": "watch", "x_mitre_platforms": ["Windows"],
    "x_mitre_data_sources": ["Logs"], "kill_chain_phases": [{"phase_name": "lateral-movement"}]}
DEAD = [{**T, "revoked": True}, {**T, "x_mitre_deprecated": True}, {**T, "type": "malware"}, {**T, "external_references": [{"source_name": "other"}]}]


@pytest.fixture(scope="module")
def feeds(tmp_path_factory):
    d = tmp_path_factory.mktemp("feeds")
    (d / "nvd").mkdir()
    with gzip.open(d / "nvd/a.json.gz", "wt") as f:
        json.dump(V1, f)
    (d / "nvd/b.json").write_text(json.dumps(V2))
    (d / "nvd/c.json").write_text(json.dumps({**json.loads(json.dumps(V1).replace("2024-1", "2024-3")), **json.loads(json.dumps(V2).replace("2024-2", "2024-4"))}))
    (d / "bundle.json").write_text(json.dumps({"objects": [T, *DEAD]}))
    (d / "list.json").write_text(json.dumps([T, *DEAD]))
    return d


def test_sources(spark, feeds):
    got = {r.doc_id: r.text for r in nvd.read_nvd(spark, str(feeds / "nvd")).collect()}
    assert got == {f"CVE-2024-{i}": "Heap overflow CWE-79 Patch Vendor Bulletin Exploit" if i % 2 else "SMB CWE-1" for i in (1, 2, 3, 4)}
    for name in ("bundle.json", "list.json"):
        s = nvd.read_stix(spark, str(feeds / name))
        r = nvd.attack_corpus(s).collect()
        assert [(x.doc_id, x.text.split()) for x in r] == [("T1021.002", "Remote Services note line one line two watch Windows Logs lateral-movement".split())]
        assert nvd.technique_tactics(s).where("tid = 'T1021.002'").first().tactic == "Lateral Movement"


def test_engine_round_trip(spark, feeds, tmp_path):
    e = Engine.ingest(spark, str(feeds / "nvd"), str(feeds / "bundle.json"), 2)
    e.save(str(tmp_path / "ix"))
    e = Engine.load(spark, str(tmp_path / "ix"))
    assert [r.doc_id for r in e.search("heap overflow", expanded=False).collect()] == ["CVE-2024-1", "CVE-2024-3"]
    assert [r.doc_id for r in e.search("heap AND NOT remote").collect()] == ["CVE-2024-1", "CVE-2024-3"]
    assert e.search("watch services").first().doc_id == "T1021.002"
    assert e.search("smb", scorer="lsa").count() > 0 and e.search("heap AND smb").count() == 0
    assert [r.doc_id for r in e.search("heap OR smb", rerank="overfetch", top_n=2).collect()] == ["CVE-2024-2", "CVE-2024-4"]
    with pytest.raises(FileNotFoundError):
        Engine.load(spark, str(tmp_path / "none"))


def test_text_layouts(spark, micro, tmp_path):
    lines = files.postings_lines(micro.postings, index.dictionary(micro.stats))
    bad = spark.createDataFrame([("x y z",), ("1 a b (d,1,nvd)",), ("",)], "value string")
    back = files.parse_postings(lines.union(bad)).select("term", "doc_id", "source", "tf")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, micro.postings.select("term", "doc_id", "source", "tf").collect()))
    t = spark.createDataFrame([("T1", "attack", ["a", "b"]), ("C1", "nvd", [])], "doc_id string, source string, tokens array<string>")
    files.write_corpus_text(t, str(tmp_path / "c"))
    assert sorted((r.doc_id, r.text) for r in files.read_corpus_text(spark, str(tmp_path / "c")).collect()) == [("C1", ""), ("T1", "a b")]
    (tmp_path / "m.json").write_text('{"t1": ["C1", "C2", "C1"]}')
    assert sorted(map(tuple, files.read_technique_map(spark, str(tmp_path / "m.json")).collect())) == [("T1", "C1"), ("T1", "C2")]


def test_a_map_is_not_one_row(spark, tmp_path):
    """Techniques are written and read apart, so no task has the whole map; one without pairs is an empty map."""
    p = spark.createDataFrame([(f"T{k % 9}", f"C{k}") for k in range(90)], "tid string, cve_id string")
    files.write_technique_map(p, str(tmp_path / "m"))
    assert spark.read.text(str(tmp_path / "m")).count() == len([x for x in (tmp_path / "m").glob("part-*") if x.stat().st_size]) == 9
    assert sorted(map(tuple, files.read_technique_map(spark, str(tmp_path / "m")).collect())) == sorted(map(tuple, p.collect()))
    files.write_technique_map(p.limit(0), str(tmp_path / "n"))
    assert files.read_technique_map(spark, str(tmp_path / "n")).count() == 0


def test_map_file_and_broken_feeds(spark, feeds, tmp_path):
    p = spark.createDataFrame([("T1", "C2"), ("T1", "C1"), ("T2", "C1"), ("T1", "C1")], "tid string, cve_id string")
    files.write_technique_map(p, str(tmp_path / "m"))
    assert sorted(map(tuple, files.read_technique_map(spark, str(tmp_path / "m")).collect())) == [("T1", "C1"), ("T1", "C2"), ("T2", "C1")]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/a.json").write_text('{"CVE_Items": [')
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        nvd.read_nvd(spark, str(tmp_path / "bad")).collect()
    (tmp_path / "bad/a.json").rename(tmp_path / "bad/a.json.bak")
    assert nvd.read_nvd(spark, str(tmp_path / "bad")).count() == 0


def test_saved_topics(spark, tmp_path):
    rng = random.Random(3)
    t = spark.createDataFrame([(str(k), [rng.choice(["heap", "stack", "smb", "window"] if k % 2 else ["cloud", "token", "bucket", "role"]) for _ in range(12)]) for k in range(60)], "doc_id string, tokens array<string>")
    got = topics.train(t, 2, passes=3, no_above=1.0)
    topics.save(got, str(tmp_path / "t"), 4, topics.coherence(topics.topic_terms(got, 4), t))
    back = topics.load(spark, str(tmp_path / "t"))
    words = lambda x: [[w.word for w in r.terms] for r in x.orderBy("topic_id").collect()]
    assert words(topics.topic_terms(back, 4)) == words(topics.load_topic_terms(spark, str(tmp_path / "t"))) == words(topics.topic_terms(got, 4))
    assert {r.doc_id: r.dominant_topic for r in back.doc_topics.collect()} == {r.doc_id: r.dominant_topic for r in got.doc_topics.collect()}
    assert 0 <= spark.read.json(str(tmp_path / "t/coherence")).first().c_v <= 1
