import random
import re

import pytest
from pyspark.sql import functions as F

from lodestrata.operators.generations import TABLES, Generations
from lodestrata.operators.index import Index
from lodestrata.plans.engine import Engine
from lodestrata.streaming import incremental

SCHEMA = "doc_id string, source string, text string"
WORDS = ["heap", "smb", "window", "overflow", "kernel", "buffer", "remote", "shell"]


def _batches():
    """Four batches and what is left after them: ids that come again with other texts, leave, and come back."""
    rng, left, out = random.Random(4), {}, []
    for k in range(4):
        add = {f"CVE-{rng.randrange(40)}": " ".join(["heap", *rng.choices(WORDS, k=rng.randrange(6))]) for _ in range(25)}
        add |= {f"T{k}": None, f"T{k + 10}": ""}
        gone = sorted({f"CVE-{rng.randrange(40)}" for _ in range(6)} | {"CVE-99"})
        for d in gone:
            left.pop(d, None)
        left |= add
        out.append((add, gone))
    return out, left


def _frame(spark, docs):
    return spark.createDataFrame([(d, "attack" if d[0] == "T" else "nvd", t) for d, t in docs.items()], SCHEMA)


def _add(spark, g, batches, numbers):
    for k in numbers:
        add, gone = batches[k]
        g.append(_frame(spark, add), k, spark.createDataFrame([(x,) for x in gone], "doc_id string"))


def _read(g):
    return (sorted((r.term, r.doc_id, r.source, r.tf) for r in g.postings().collect()), sorted((r.doc_id, r.source, r.dl) for r in g.docs().collect()))


def _want(spark, left):
    i = Index.build(_frame(spark, left), persist=False)
    return (sorted(tuple(r) for r in i.postings.select("term", "doc_id", "source", "tf").collect()), sorted(tuple(r) for r in i.docs.select("doc_id", "source", "dl").collect()))


def _exchanges(df):
    return [x for x in re.findall(r"(\w*Exchange)\b", df._jdf.queryExecution().executedPlan().toString())]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    g = Generations.open(spark, str(tmp_path_factory.mktemp("generations") / "index"), 4, 3)
    batches, left = _batches()
    _add(spark, g, batches, range(4))
    return g, batches, _want(spark, left)


def test_generations_equal_one_build(made):
    g, _, want = made
    assert g.committed() == [0, 2, 4, 6] and _read(g) == want
    rows = g._rows("postings").where("tf = 0")
    assert rows.count() > 20 and g.summary().first()["postings"] == len(want[0])


def test_reading_takes_no_shuffle(spark, made):
    g, _, _ = made
    assert _exchanges(g.postings()) == [] and _exchanges(g.docs()) == [] and _exchanges(g._terms(g._live().hint("merge"))) == []
    assert g.postings().rdd.getNumPartitions() == 4
    one = g.postings().where("term = 'heap'")
    assert "EqualTo(term,heap)" in one._jdf.queryExecution().executedPlan().toString()
    # a term's postings lie in the buckets of its slices, so none is bound to fill one
    at = g.postings().select("term", F.spark_partition_id().alias("got"), F.pmod(F.hash("term", "slice"), F.lit(4)).alias("want")).collect()
    assert all(r.got == r.want for r in at) and any(len({r.got for r in at if r.term == w}) > 1 for w in WORDS)


def test_an_engine_over_generations(spark, made):
    g, _, _ = made
    _, left = _batches()
    for q in ("heap smb", "heap AND NOT kernel"):
        a, b = (Engine(spark, i).search(q, expanded=False).collect() for i in (g.index(), Index.build(_frame(spark, left), persist=False)))
        assert a == b and a


def test_a_batch_again_and_one_broken_off(spark, tmp_path):
    g = Generations.open(spark, str(tmp_path / "index"), 4, 3)
    batches, left = _batches()
    _add(spark, g, batches, (0, 1, 1))
    write = Generations._write

    def broken(self, name, *more, **how):
        if name == "docs":
            raise OSError("lost")
        write(self, name, *more, **how)

    before = _read(g)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(Generations, "_write", broken)
        with pytest.raises(OSError):
            _add(spark, g, batches, (2,))
        assert _read(g) == before
        with pytest.raises(OSError):
            g.compact()
        assert _read(g) == before
    _add(spark, g, batches, (2, 3))
    assert _read(g) == _want(spark, left)


def test_compaction_at_any_moment(spark, tmp_path):
    g = Generations.open(spark, str(tmp_path / "index"), 4, 3)
    batches, left = _batches()
    _add(spark, g, batches, range(4))
    want, seen, drop = _want(spark, left), [], spark.sql
    assert g.compact(keep=True) == 7 and g.committed() == [0, 2, 4, 6, 7] and _read(g) == want
    g.spark = type("Watched", (), {"sql": lambda self, q: (drop(q), seen.append(_read(g)) if q.startswith("alter") else None)[0], "__getattr__": lambda self, n: getattr(spark, n)})()
    g.compact()
    g.spark = spark
    assert seen == [want] * (4 * len(TABLES)) and g.committed() == [7]
    assert g._rows("postings").where("tf = 0").isEmpty() and g._rows("forward").count() == len(want[0])
    # batches that are compacted stay as they are, later ones count, a new session's tables find all
    _add(spark, g, batches, (3,))
    assert g.committed() == [7]
    g.append(_frame(spark, {"CVE-1": "kernel"}), 4)
    for name in TABLES:
        spark.sql(f"drop table {g._table(name)}")
    g = Generations.open(spark, g.path, 99, 99)
    assert (g.buckets, g.slices, g.committed()) == (4, 3, [7, 8])
    assert _read(g) == _want(spark, left | {"CVE-1": "kernel"})
    assert g.compact() == 9 and _read(g) == _want(spark, left | {"CVE-1": "kernel"})


def test_empty(spark, tmp_path):
    g = Generations.open(spark, str(tmp_path / "index"), 4, 3)
    assert _read(g) == ([], []) and g.compact() is None and g.index().n_docs == 0
    g.append(_frame(spark, {"CVE-1": "heap"}).limit(0), 0)
    assert _read(g) == ([], [])
    g.append(_frame(spark, {"CVE-1": None}), 1)
    assert _read(g) == ([], [("CVE-1", "nvd", 0)])


def test_a_stream_replaces_documents(spark, tmp_path):
    parts = [[("CVE-1", "nvd", "heap heap smb"), ("CVE-2", "nvd", None)], [("T1", "attack", "smb"), ("CVE-1", "nvd", "smb kernel")], [("CVE-2", "nvd", "shell")]]
    Generations.open(spark, str(tmp_path / "out"), 2, 2)
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        incremental.index_stream(incremental.document_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "check"), 2).awaitTermination()
    g = Generations.open(spark, str(tmp_path / "out"))
    assert g.committed() == [5]
    assert _read(g) == ([("kernel", "CVE-1", "nvd", 1), ("shell", "CVE-2", "nvd", 1), ("smb", "CVE-1", "nvd", 1), ("smb", "T1", "attack", 1)], [("CVE-1", "nvd", 2), ("CVE-2", "nvd", 1), ("T1", "attack", 1)])
