import hashlib
import random
import re
import time
import zlib

import duckdb
import pytest

from lodestrata.llm import repair as R

SCHEMA = "conv_id long, turn long, role string, text string, head string, gone int"
BLANK = " \t\n\x0b\f\r"


def cheapest(codes):
    """Least (cost, audit) by trying all edits row by row; states are what the last turn was."""
    after = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    best = {"": (0, "")}
    for c in [*codes, None]:
        for _ in range(4):  # insertions before the row
            for s, (cost, audit) in list(best.items()):
                t = after[s][0]
                best[t] = min(best.get(t, (10**9, "")), (cost + 5, audit + "I"))
        if c is None:
            break
        new = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 2, "D")]
            if c != "-":
                extra = 5 if c.isupper() else 0
                if c.lower() == after[s][0] or c.lower() == "s" and s == "":
                    ways.append((c.lower(), cost + extra, "K"))
                ways.append((after[s][0], cost + 1 + extra, "R"))
            for t, x, e in ways:
                new[t] = min(new.get(t, (10**9, "")), (x, audit + e))
        best = new
    return min(v for s, v in best.items() if s in ("", "a"))


def test_chart_against_all_edits():
    rng = random.Random(11)
    for n in range(9):
        for _ in range(400):
            codes = "".join(rng.choice("uuuaaasoUAS-") for _ in range(n))
            assert R.earley(codes) == cheapest(codes), codes
    codes = "".join(rng.choice("uuuaaasoUAS-") for _ in range(400))
    assert R.earley(codes) == cheapest(codes)


def test_every_audit_repairs():
    rng = random.Random(12)
    for _ in range(500):
        codes = "".join(rng.choice("uasoUAS-") for _ in range(rng.randrange(12)))
        roles = [{"u": "user", "a": "assistant", "s": "system"}.get(c.lower(), "tool") for c in codes]
        out = [r for e, r, _ in R.edits(R.earley(codes)[1], zip(roles, codes)) if e != "D"]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r in out)), codes


def brute(rows):
    """conv_id -> the query's row, one conversation after the other."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r[:4] for r in rows if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            f = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if f == 1 else re.sub("[.!?]", "", text) if f == 2 else text
            mine += [(turn, "user" if f == 4 else role, text)] * (0 if f == 0 else 2 if f == 3 else 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, n = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in mine:
            i = role[:1] if role[:1] in ("u", "a", "s") else "o"
            if not text.strip(BLANK):
                n["blank"] += 1
                i = "-"
            elif (role, text) in seen:
                n["duplicate"] += 1
                i = "-"
            elif text.rstrip(BLANK)[-1] not in ".!?":
                n["truncated"] += 1
                i = i.upper()
            seen.add((role, text))
            codes += i
        turns = [t for t, _, _ in mine if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        cost, audit = cheapest(codes)
        lines, k, due = [], 0, "user"
        for e in audit:
            role, text = (due, "") if e == "I" else mine[k][1:]
            k += e != "I"
            if e != "D":
                role = due if e == "R" else role
                lines.append(f"{role}:{text}")
                due = "assistant" if role[:1] == "u" else "user"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *n.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, tmp_path, rows, sql=True):
    at = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.mode("overwrite").parquet(at)
    got = R.op13_conversation_repair(spark, str(tmp_path)).collect()
    want = brute(rows)
    assert len(got) == len(want) and {r[0]: tuple(r[1:]) for r in got} == want
    if sql:
        con = duckdb.connect()
        con.execute(f"create view conversations as select * from '{at}/*.parquet'")
        assert {r[0]: r[1:] for r in con.execute(R.SQL).fetchall()} == want


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(13)
    texts = ["Yes.", "No!", "why?  \n", "cut off", "", " \x0b", "é.", "a.b", None, ".", "\xa0", "Yes. " * 30 + "x.", "Yes. " * 30 + "w."]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "User", "umpire"]
    rows = [(c, rng.choice([t, t, t, t + 3, None, 2]), rng.choice(roles), rng.choice(texts), "x", 1) for c in range(80) for t in range(rng.randrange(1, 14))]
    rows += [(None, t, "user", "Hm.", None, None) for t in range(5)] + [rows[0]] * 2
    check(spark, tmp_path, rows)
    check(spark, tmp_path, [])


def test_long_conversation(spark, tmp_path):
    rng = random.Random(14)
    check(spark, tmp_path, [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["So.", "And"]) + (str(t) + "." if rng.random() < 0.7 else ""), "", 0) for t in range(3000)], sql=False)
    began = time.time()
    R.earley("suaUAo-" * 15_000)
    assert time.time() - began < 30


def test_repaired_rows(spark):
    rows = spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "user", "Hello."), (1, 2, "user", ""), (2, 0, "tool", "x"), (3, 5, "assistant", "A."), (3, 6, "user", "B."), (3, 7, "assistant", "C.")], "conv_id int, turn int, role string, text string")
    plans = R.plan(rows)
    assert {r.conv_id: (r.gaps, r.blank, r.truncated, r.illegal, r.cost, r.audit) for r in plans.collect()} == {1: (0, 1, 0, 2, 3, "KRD"), 2: (0, 0, 1, 0, 2, "D"), 3: (0, 0, 0, 0, 2, "DKK")}
    got = sorted(map(tuple, R.repaired(rows, plans).collect()))
    assert got == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Hello."), (3, 0, "K", "user", "B."), (3, 1, "K", "assistant", "C.")]
    assert R.plan(rows.limit(0)).count() == 0 and R.repaired(rows.limit(0), plans.limit(0)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_whole_table(spark, sf):
    d = f"/root/testdata/{sf}"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = R.op13_conversation_repair(spark, d)
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 7 + ["string"] * 2
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == brute(rows)
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{d}/conversations.parquet'")
    assert {r[0]: r[1:] for r in con.execute(R.SQL).fetchall()} == brute(rows)
