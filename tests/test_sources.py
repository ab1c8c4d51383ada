import gzip
import json
import random
import tracemalloc

import pytest

from lodestrata.sources import items, nvd


def made(rng, depth=0):
    k = rng.randrange(7 if depth < 4 else 4)
    if k == 0:
        return rng.choice([None, True, False, 0, -12.5e3, 123456789])
    if k < 4:
        return "".join(rng.choice('a é😀"\\\n{}[],:0') for _ in range(rng.randrange(12)))
    if k == 4:
        return [made(rng, depth + 1) for _ in range(rng.randrange(4))]
    return {f"k{i}": made(rng, depth + 1) for i in range(rng.randrange(4))}


@pytest.mark.parametrize("size", [1, 7, 1 << 20])
def test_items_against_a_whole_parse(monkeypatch, size):
    monkeypatch.setattr(items, "CHUNK", size)
    rng = random.Random(size)
    for _ in range(60):
        data = {"x": made(rng), "one": [made(rng) for _ in range(rng.randrange(5))], "y": [made(rng)], "two": rng.choice([[made(rng)], [], "no list"]), "z": 12}
        raw = json.dumps(data, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])).encode()
        want = [(k, i, x) for k in ("one", "two") if isinstance(data[k], list) for i, x in enumerate(data[k])]
        for packed in (False, True):
            body = gzip.compress(raw) if packed else raw
            assert [(k, i, json.loads(x)) for k, i, x in items.items(items.chunks(memoryview(body), packed), ("one", "two"))] == want
        assert [(k, json.loads(x)) for k, _, x in items.items([json.dumps(data["y"]).encode()], ("one",))] == [("", x) for x in data["y"]]


@pytest.mark.parametrize("raw", [b"", b"nope", b'{"one": [', b'{"one": [1, }', b'{"one": [1] "two": 1}', b'{"one": 1} x', b'{"one": [1 2]}', b'{1: 2}', b'{"x": tru'])
def test_broken_files_raise(raw):
    with pytest.raises(ValueError):
        list(items.items([raw], ("one",)))


def test_memory_does_not_grow_with_a_file():
    one = json.dumps({"cve": {"id": "CVE-1", "text": "x" * 900}}).encode()

    def parts():
        yield b'{"head": "' + b"h" * 3_000_000 + b'", "vulnerabilities": ['
        for k in range(400):
            yield b",".join([one] * 200) + (b"," if k < 399 else b"")
        yield b"]}"

    tracemalloc.start()
    n = sum(1 for _ in items.items(parts(), ("vulnerabilities",)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 80_000 and peak < 40e6


def test_undecodable_bytes_and_empty_folders(spark, tmp_path):
    (tmp_path / "a").mkdir()
    with pytest.warns(UserWarning, match="no files"):
        assert nvd.read_nvd(spark, str(tmp_path / "a")).count() == 0
    body = json.dumps({"vulnerabilities": [{"cve": {"id": "cve-2024-1", "descriptions": [{"lang": "en", "value": "bad @@ bytes"}]}}]}).encode().replace(b"@@", b"\xff\xfe")
    (tmp_path / "a/x.json").write_bytes(body)
    (tmp_path / "a/y.json.gz").write_bytes(gzip.compress(body.replace(b"2024-1", b"2024-2")) + gzip.compress(b" \n"))
    (tmp_path / "a/notes.txt").write_text("no feed")
    got = {r.doc_id: (r.text, r.place) for r in nvd.read_nvd(spark, str(tmp_path / "a")).collect()}
    assert got == {f"CVE-2024-{k}": ("bad �� bytes ", 1 << 40) for k in (1, 2)}
    (tmp_path / "a/z.json").write_text('{"CVE_Items": [{}, {"cve": {}}], "vulnerabilities": [{}]}')
    assert nvd.read_nvd(spark, str(tmp_path / "a")).count() == 2
    (tmp_path / "a/z.json").write_text('{"CVE_Items": [')
    with pytest.raises(Exception, match="malformed"):
        nvd.read_nvd(spark, str(tmp_path / "a")).count()
