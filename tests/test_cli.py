import gzip
import json

import pytest

from lodestrata import cli
from lodestrata.operators import topics


@pytest.fixture(scope="module")
def feeds(tmp_path_factory):
    d = tmp_path_factory.mktemp("cli")
    (d / "nvd").mkdir()
    v = [{"cve": {"id": f"CVE-2024-{k}", "descriptions": [{"lang": "en", "value": text}]}} for k, text in enumerate(["heap overflow in server", "smb overflow window", "heap spray window server", "remote smb services watch"])]
    with gzip.open(d / "nvd/a.json.gz", "wt") as f:
        json.dump({"vulnerabilities": v}, f)
    t = {"type": "attack-pattern", "name": "Remote Services", "description": "smb services watch", "external_references": [{"source_name": "mitre-attack", "external_id": "T1021"}], "kill_chain_phases": [{"phase_name": "lateral-movement"}]}
    (d / "bundle.json").write_text(json.dumps({"objects": [t]}))
    return d


def test_build_in_steps(spark, feeds, tmp_path, capsys):
    at = str(tmp_path / "ix")
    build = ["build", "--nvd", str(feeds / "nvd"), "--attack", str(feeds / "bundle.json"), "--index", at]
    with pytest.raises(FileNotFoundError):
        cli.main([*build, "--skip-ingest"])
    cli.main([*build, "--skip-index", "--shard-size", "2"])
    shards = list((tmp_path / "ix/corpus").glob("source=*/*.parquet"))
    assert len(shards) >= 3 and not (tmp_path / "ix/index").exists()
    cli.main([*build, "--skip-ingest"])
    cli.main(["lsa", "--components", "2", "--index", at])
    for args, want in ((["search", "heap overflow", "--no-expand"], "CVE-2024-0"), (["search", "heap overflow", "--scorer", "lsa", "--no-expand"], "CVE-2024-0"), (["boolean", "smb AND NOT window", "--no-rank"], "CVE-2024-3"), (["build-map", "--attack", str(feeds / "bundle.json")], "1")):
        capsys.readouterr()
        cli.main([*args, "--index", at])
        assert want in capsys.readouterr().out


def test_add_and_merge(spark, feeds, tmp_path, capsys):
    at = str(tmp_path / "ix")
    build = ["build", "--nvd", str(feeds / "nvd"), "--attack", str(feeds / "bundle.json"), "--index", at]
    cli.main(build)
    with pytest.raises(FileNotFoundError, match="no generations"):
        cli.main(["merge", "--index", at])
    v = [{"cve": {"id": f"CVE-2024-{k}", "descriptions": [{"lang": "en", "value": text}]}} for k, text in ((0, "kernel smb"), (9, "heap kernel"))]
    (tmp_path / "later").mkdir()
    (tmp_path / "later/b.json").write_text(json.dumps({"vulnerabilities": v}))

    def found(query):
        capsys.readouterr()
        cli.main(["boolean", query, "--no-rank", "--index", at])
        return {x for x in capsys.readouterr().out.replace("|", " ").split() if x[:4] == "CVE-" or x[:2] == "T1"}

    assert found("heap OR watch") == {"CVE-2024-0", "CVE-2024-2", "CVE-2024-3", "T1021"}
    cli.main(["add", "--nvd", str(tmp_path / "later"), "--index", at])
    left = {"CVE-2024-9", "CVE-2024-2", "CVE-2024-3", "T1021"}
    assert found("heap OR watch") == left and found("kernel") == {"CVE-2024-0", "CVE-2024-9"}
    for keep, parts in ((["--keep"], {"0", "2", "3"}), ([], {"3"})):
        cli.main(["merge", *keep, "--index", at])
        assert {x.name.split("=")[1] for x in (tmp_path / "ix/generations/docs").glob("generation=*")} == parts and found("heap OR watch") == left
    cli.main(["build", "--skip-ingest", *build[1:]])
    assert found("heap OR watch") == {"CVE-2024-0", "CVE-2024-2", "CVE-2024-3", "T1021"}
    cli.main(["add", "--nvd", str(tmp_path / "later"), "--index", at])
    assert found("kernel") == {"CVE-2024-0", "CVE-2024-9"}


def test_nothing_to_draw(spark):
    pairs, none = spark.createDataFrame([("T1", "C1")], "tid string, cve_id string"), spark.createDataFrame([], "tid string, tactic string")
    tac, d = spark.createDataFrame([("T1", "Impact")], "tid string, tactic string"), spark.createDataFrame([("c1", 0)], "doc_id string, dominant_topic int")
    with pytest.warns(UserWarning, match="no tactics"):
        assert topics.heat_map(pairs, none, d, 2) is None
    with pytest.warns(UserWarning, match="empty"):
        assert topics.heat_map(pairs.limit(0), tac, d, 2) is None
    assert [tuple(r) for r in topics.heat_map(pairs, tac, d, 2).collect()] == [("Impact", 1, 0)]
