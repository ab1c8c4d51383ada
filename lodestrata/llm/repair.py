"""Conversation structure repair by error-correcting Earley parsing."""

from __future__ import annotations

import functools
import hashlib
import heapq
from itertools import groupby, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import _common as C

#: Costs of the edits (a turn that is cut off adds TRUNCATED unless it is deleted) and their initials.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Initials of roles, as they may follow each other.
LEGAL = ("su", "ua", "au")
#: Longest conversation of which a worker keeps the repair for others of the same kind.
SHORT = 24
#: Characters of a text by which rows of equal turn and role are ordered, before its digest.
HEAD = 64

# The grammar reads a conversation from its last row to its first. A suffix's name says what may stand
# before it: 'opening' nothing, 'system' a system turn, 'user' a user turn, 'assistant' an assistant turn.
# Each suffix grows by one turn or by a row that is deleted.
SUFFIXES = (
    ("assistant", ()), ("opening", ()),
    ("assistant", ("user", "USER")), ("user", ("assistant", "ASSISTANT")),
    ("system", ("user", "USER")), ("opening", ("user", "USER")), ("opening", ("system", "SYSTEM")),
    *((x, (x, "GONE")) for x in ("assistant", "user", "system", "opening")))
# A turn is a row that is kept or gets another role, or is inserted; with its initial and cost.
TURNS = (
    ("USER", ("u",), "K", KEEP), ("USER", ("row",), "R", REROLE), ("USER", (), "I", INSERT),
    ("ASSISTANT", ("a",), "K", KEEP), ("ASSISTANT", ("row",), "R", REROLE), ("ASSISTANT", (), "I", INSERT),
    ("SYSTEM", ("s",), "K", KEEP), ("GONE", ("any",), "D", DELETE))
RULES = [(lhs, rhs, "", 0) for lhs, rhs in SUFFIXES] + list(TURNS)
NAMES = ("assistant", "user", "system", "opening")
#: Rules of each turn, and for each suffix those that begin with it.
OF = {x: [i for i, r in enumerate(RULES) if r[0] == x] for x in ("USER", "ASSISTANT", "SYSTEM", "GONE")}
AFTER = {x: [i for i, (_, rhs) in enumerate(SUFFIXES) if rhs and rhs[0] == x] for x in NAMES}
#: No step: an empty suffix.
NONE = (255, 255)


def scanned(terminal: str, code: str) -> int | None:
    """What a row costs as a terminal, None if it cannot be that.

    code: the role's initial (u, a, s, else o); in capitals if the row is cut off, '-' if it must go.
    """
    if terminal == "any":
        return 0
    if code == "-" or terminal != "row" and terminal != code.lower():
        return None
    return TRUNCATED if code.isupper() else 0


def earley(codes: str) -> tuple[int, str]:
    """Least cost of a repair, and the least audit in ASCII order among the cheapest repairs' audits.

    An item of the chart is (rule, dot, origin) with the least (cost, initial of its latest edit, rules
    of its last step) by which it can be reached. As rows are read from the last on, an item covers a suffix, and
    its latest edit is the first of its audit. Different steps to an item have different initials, so
    initials decide between audits of equal cost, and steps give the whole audit at the end. A heap
    finishes a column's least items first, so each is finished once. The grammar is left-recursive:
    suffixes begin at column 0, turns at their own column or the one before. So a column has some 30
    items whatever the length, two columns are held, and eight bytes of steps a row.
    """
    steps = {x: bytearray() for x in NAMES}
    waited: dict[str, list] = {}
    scans: list = []
    for k in range(len(codes) + 1):
        best: dict = {}
        finished: set = set()
        suffixes: set = set()
        empty: dict = {}
        waits: dict[str, list] = {}
        heap: list = []

        def offer(item, value):
            if item not in best or value < best[item]:
                best[item] = value
                heapq.heappush(heap, (value, item))

        if k == 0:  # the suffixes' rules are predicted; those without symbols are complete
            for r, (_, rhs) in enumerate(SUFFIXES):
                if not rhs:
                    offer((r, 0, 0), (0, "", NONE))
        for r in scans:  # scanner
            more = scanned(RULES[r][1][0], codes[-k])
            if more is not None:
                offer((r, 1, k - 1), (RULES[r][3] + more, RULES[r][2], NONE))
        scans = []
        while heap:
            value, item = heapq.heappop(heap)
            if item in finished:
                continue
            finished.add(item)
            r, dot, origin = item
            lhs, rhs, initial, _ = RULES[r]
            if dot < len(rhs) and rhs[dot] in OF:  # a suffix that waits for a turn: predictor
                turn = rhs[dot]
                if turn not in waits:
                    waits[turn] = []
                    for p in OF[turn]:
                        offer((p, 0, k), (0, "", NONE) if RULES[p][1] else (RULES[p][3], RULES[p][2], NONE))
                waits[turn].append((r, value[0]))
                if turn in empty:
                    p, cost = empty[turn]
                    offer((r, 2, 0), (value[0] + cost, RULES[p][2], (r, p)))
            elif dot < len(rhs):  # a turn that waits for a row
                scans.append(r)
            elif lhs in OF:  # a complete turn: completer
                if origin == k:
                    empty[lhs] = r, value[0]
                for w, cost in (waits if origin == k else waited).get(lhs, ()):
                    offer((w, 2, 0), (cost + value[0], initial, (w, r)))
            elif lhs not in suffixes:  # a complete suffix: completer, for what began at column 0
                suffixes.add(lhs)
                steps[lhs] += bytes(value[2])
                for w in AFTER[lhs]:
                    offer((w, 1, 0), (value[0], "", NONE))
                if lhs == "opening":
                    total = value[0]
        waited = waits
    return total, traced(steps, len(codes))


def traced(steps: dict[str, bytearray], k: int) -> str:
    """Initials of the edits, from the first row on."""
    out, at = [], "opening"
    while (step := tuple(steps[at][2 * k:2 * k + 2])) != NONE:
        r, p = step
        out.append(RULES[p][2])
        k -= RULES[p][2] != "I"
        at = RULES[r][1][0]
    return "".join(out)


@functools.lru_cache(65536)
def _known(codes: str) -> tuple[int, str]:
    return earley(codes)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copy (0, or 1 for a repeated row), gone: rows with the faults that crc32 of 'conv_id:turn' deals them.

    Of 20 remainders 0 drops a row (gone), 1 empties its text, 2 removes its full stops, exclamation and question marks, 3
    repeats it, 4 makes it a user's. A null role or text is one blank, a null conv_id or turn too where
    the remainder is taken.
    """
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    d = rows.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy"), (F.col("fault") == 0).alias("gone"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Rows of a conversation side by side, by turn (nulls first), role, text; long texts by their digest."""
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", *first, F.asc_nulls_first("turn"), "role", "head", "digest", *(c for c in ("nth",) if c in rows.columns))


def _with_order(rows: DataFrame) -> DataFrame:
    return rows.withColumn("head", F.substring("text", 1, HEAD)).withColumn("digest", F.unhex(F.md5("text")))


def _code(role: Column, text: Column, repeated: Column) -> tuple[Column, Column]:
    """A row's fault (blank, duplicate, truncated, else null) and its code for scanned()."""
    blank, whole = ~text.rlike(C.WORD), text.rlike(f"[.!?][{C.SPACES}]*\\z")
    fault = F.when(blank, "blank").when(repeated, "duplicate").when(~whole, "truncated")
    initial = F.substring(role, 1, 1)
    code = F.when(initial.isin("u", "a", "s"), initial).otherwise("o")
    return fault, F.when(fault.isin("blank", "duplicate"), "-").when(fault == "truncated", F.upper(code)).otherwise(code)


PLAN = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def plan(rows: DataFrame) -> DataFrame:
    """conv_id and PLAN for each conv_id of rows (conv_id, turn, role, text; optional gone: rows that only name their conversation).

    Counts of faults, of missing turn numbers and of neighbours whose roles do not follow each other, and the cheapest
    repair (see earley). Texts stay where they are: their digests, codes and first characters meet, sorted,
    in the task of their conversation, which reads them as a stream and keeps a byte for each row, and eight of the
    chart. Duplicates are numbered among the rows of equal role and digest. A null conv_id is a
    conversation of its own; null turns come first; equal turns go by role, then text; a null role or text counts
    as one blank; an empty table gives no rows; other columns are not read.
    """
    d = rows if "gone" in rows.columns else rows.withColumn("gone", F.lit(False))
    d = _with_order(d.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")), "gone"))
    # what a text says of its row, before texts are left behind
    fault, code = _code(F.col("role"), F.col("text"), F.lit(False))
    d = d.select("conv_id", "turn", "role", "head", "digest", "gone", fault.alias("fault"), code.alias("code"), F.substring("role", 1, 1).alias("initial"))
    nth = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "digest").orderBy(F.asc_nulls_first("turn")))
    d = _in_order(d.withColumn("nth", nth), "gone")
    again = (F.col("nth") > 1) & (F.coalesce("fault", F.lit("")) != "blank")
    d = d.select("conv_id", "turn", "gone", "initial", F.when(again, "duplicate").otherwise(F.col("fault")).alias("fault"), F.when(again, "-").otherwise(F.col("code")).alias("code"))
    kind = d.schema["conv_id"].dataType.simpleString()

    def one(rows):
        codes, faults, illegal, last = [], dict(blank=0, duplicate=0, truncated=0), 0, None
        least = most = turn = None
        turns = 0
        for _, t, gone, initial, fault, code in rows:
            if gone:
                continue
            codes.append(code)
            if fault:
                faults[fault] += 1
            if last is not None and last + initial not in LEGAL:
                illegal += 1
            last = initial
            if t is not None:
                least, most, turns, turn = t if least is None else least, t, turns + (t != turn), t
        codes = "".join(codes)
        cost, audit = (_known if len(codes) <= SHORT else earley)(codes)
        return (0 if least is None else most - least + 1 - turns, *faults.values(), illegal, cost, audit)

    def run(batches):
        for conv, rows in groupby((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: r[0]):
            yield conv, *one(rows)

    return d.mapInArrow(_batched(run, f"conv_id {kind}, {PLAN}"), f"conv_id {kind}, {PLAN}")


def _batched(run, schema: str, size: int = 4096):
    """A function for mapInArrow from one that yields tuples."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def batches(it):
        rows = run(it)
        while part := list(islice(rows, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), arrow)], schema=arrow)

    return batches


def edits(audit: str, rows):
    """(initial, role, text) of each edit from the rows (role, text) in order; a deleted row's too."""
    rows, due = iter(rows), "user"
    for e in audit:
        role, text = ("", "") if e == "I" else next(rows)
        if e in "RI":
            role = due
        if e != "D":
            due = "assistant" if role[:1] == "u" else "user"
        yield e, role, text


def _replay(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, audit, role, text: each conversation's audit before its rows, in order."""
    d = rows.where("not gone") if "gone" in rows.columns else rows
    d = _with_order(d.select("conv_id", "turn", *(F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text"))))
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    heads = plans.select("conv_id", none("turn", rows.schema["turn"].dataType), none("role", "string"), none("text", "string"), none("head", "string"), none("digest", "binary"), "audit", F.lit(0).alias("place"))
    return _in_order(heads.unionByName(d.withColumn("audit", F.lit(None).cast("string")).withColumn("place", F.lit(1))), "place").select("conv_id", "audit", "role", "text")


def _replayed(batches):
    """(conv_id, its edits) from the stream of _replay()."""
    stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
    for conv, rows in groupby(stream, key=lambda r: r[0]):
        yield conv, edits(next(rows)[1], ((r[2], r[3]) for r in rows))


def repaired(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place (from 0), edit, role, text: the repaired conversations of rows by plan(rows), as rows.

    Rows and audits stream through the task of their conversation; nothing of it is held.
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, place long, edit string, role string, text string"

    def run(batches):
        for conv, es in _replayed(batches):
            for k, e in enumerate(e for e in es if e[0] != "D"):
                yield conv, k, *e

    d = _replay(rows, plans)
    return d.mapInArrow(_batched(run, schema, 256), schema)


def digests(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of the repaired rows as lines 'role:text', read as a stream; the digest of no lines is that of an empty string."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, repaired_sha256 string"

    def run(batches):
        for conv, es in _replayed(batches):
            sha, first = hashlib.sha256(), True
            for e, role, text in es:
                if e != "D":
                    sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                    first = False
            yield conv, sha.hexdigest()

    d = _replay(rows, plans)
    return d.mapInArrow(_batched(run, schema), schema)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired."""
    d = damaged(C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    plans = C.cut(plan(d))
    sha = digests(d, plans)
    return plans.join(sha, plans.conv_id.eqNullSafe(sha.conv_id)).select(plans["*"], "repaired_sha256")


# The same by dynamic programming over states, not by a chart: cheapest audits after each row at the
# opening (o), behind a system (s), a user (u) and an assistant turn (a), as structs of cost and audit.
_BEST = "list_sort([{}])[1]"
_TURN = "struct_pack(c := {0}.c + case when must then 1000000 when initial = '{1}' then cut else 1 + cut end, a := {0}.a || case when initial = '{1}' then 'K' else 'R' end)"
_GONE = "struct_pack(c := {0}.c + 2, a := {0}.a || 'D')"
_NEW = "struct_pack(c := {0}.c + 5, a := {0}.a || 'I')"
SQL = rf"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    flatten(list_transform(string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), ''), lambda c: [ord(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as bits
  from conversations),
dealt as (
  select conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::bigint, bits), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, (a & 1) * 3988292384) end), 4294967295) % 20 as fault
  from given),
harmed as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
    case fault when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from dealt where fault <> 0),
numbered as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as n,
    lag(left(role, 1)) over (partition by conv_id order by turn nulls first, role, text, copy) as before,
    row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as nth from harmed),
faulty as (
  select *, left(role, 1) as initial, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when nth > 1 then 'duplicate' when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') then 'truncated' else '' end as fault
  from numbered),
coded as (select *, fault in ('blank', 'duplicate') as must, case when fault = 'truncated' then 5 else 0 end as cut from faulty),
walk as (
  select conv_id, 0::bigint as n, struct_pack(c := 0, a := '') as o, struct_pack(c := 1000000, a := '') as s, struct_pack(c := 5, a := 'I') as u, struct_pack(c := 10, a := 'II') as a
  from (select distinct conv_id from conversations)
  union all
  select conv_id, n, o, s, u, {_BEST.format("a, " + _NEW.format("u"))} as a from (
    select conv_id, n, o, s, {_BEST.format("u, " + ", ".join(_NEW.format(x) for x in "osa"))} as u, a from (
      select w.conv_id, r.n, {_GONE.format("w.o")} as o,
        {_BEST.format(_GONE.format("w.s") + ", struct_pack(c := w.o.c + case when must or initial <> 's' then 1000000 else cut end, a := w.o.a || 'K')")} as s,
        {_BEST.format(_GONE.format("w.u") + ", " + ", ".join(_TURN.format(f"w.{x}", "u") for x in "osa"))} as u,
        {_BEST.format(_GONE.format("w.a") + ", " + _TURN.format("w.u", "a"))} as a
      from walk w join coded r on w.conv_id is not distinct from r.conv_id and r.n = w.n + 1))),
cheapest as (select conv_id, arg_max({_BEST.format("o, a")}, n) as best from walk group by conv_id),
letters as (
  select conv_id, k, substr(best.a, k::int, 1) as e, length(regexp_replace(left(best.a, k::int), 'I', '', 'g')) as n
  from (select conv_id, best, unnest(range(1, length(best.a) + 1)) as k from cheapest)),
placed as (
  select l.conv_id, l.k, l.e, c.role, c.text, c.initial, row_number() over (partition by l.conv_id order by l.k) as m
  from letters l left join coded c on l.conv_id is not distinct from c.conv_id and l.n = c.n where l.e <> 'D'),
lines as (
  select conv_id, k, case when e = 'K' then role when (m - first_value(case when e = 'K' and initial = 's' then 1 else 0 end) over (partition by conv_id order by k)) % 2 = 1 then 'user' else 'assistant' end
    || ':' || case when e = 'I' then '' else text end as line from placed),
hashed as (select conv_id, sha256(string_agg(line, chr(10) order by k)) as h from lines group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
    count(*) filter (fault = 'truncated') as truncated, count(*) filter (before || initial not in ('su', 'ua', 'au')) as illegal from coded group by conv_id)
select b.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated,
  coalesce(illegal, 0)::bigint as illegal, best.c::bigint as cost, best.a as audit, coalesce(h, sha256('')) as repaired_sha256
from cheapest b left join counts c on b.conv_id is not distinct from c.conv_id left join hashed x on b.conv_id is not distinct from x.conv_id
"""
QUERIES = {"op13_conversation_repair": (op13_conversation_repair, SQL)}
