import pytest

from lodestrata.llm import _common as C


@pytest.mark.parametrize("write", ["cut", "spill"])
def test_what_is_written_is_read_back_and_memory_is_trimmed(spark, write, monkeypatch):
    trimmed, trim = [], C.trim
    monkeypatch.setattr(C, "trim", lambda s: trimmed.append(trim(s)))
    out = getattr(C, write)(spark.range(10))
    assert (out if write == "cut" else out[0]).count() == 10
    assert len(trimmed) == 1 and (trimmed[0] is None or "Trim native heap" in trimmed[0])


def test_let(spark):
    d = spark.createDataFrame([(1, "a b c"), (2, None)], "i int, t string")
    got = d.select("i", C.let(C.words(d.t), lambda ws: C.F.transform(ws, lambda w: C.F.concat(w, C.F.get(ws, C.F.lit(0))))).alias("x")).collect()
    assert {r.i: r.x for r in got} == {1: ["aa", "ba", "ca"], 2: []}
