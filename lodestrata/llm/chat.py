"""Chat formatting by event-sourced reconstruction, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import _common as C

#: The template's control strings. A turn is OPEN role CLOSE text END.
OPEN, CLOSE, END = "[INST]", "[/INST]", "</s>"
#: Characters in which a formatted text is read back at once.
CHUNK = 1024


def escape(text: Column) -> Column:
    """Double each backslash, then put one inside each control string, so none is left whole."""
    twice = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(twice, r"([\[<])(/?INST\]|/?s>)", r"$1\\$2")


def unescape(text: Column) -> Column:
    """Inverse of escape(): each backslash stands for the character behind it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def events_of(rows: DataFrame) -> DataFrame:
    """The event log of a table of turns (conv_id, turn, role, text): a 'message' event for each row.

    Sequence numbers count a conversation's rows by turn, then role, then text, nulls first; a row is
    a turn of its own, so repeated rows and equal turns stay apart.
    """
    order = W.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    n = F.row_number().over(order).cast("long")
    return rows.select("conv_id", n.alias("seq"), n.alias("turn"), F.lit("message").alias("kind"), "role", "text")


def fold(events: DataFrame) -> DataFrame:
    """Final messages of an event log.

    events: conv_id long, seq long, turn long, kind string, role string, text string. Kinds, in seq
    order within a turn: 'message' and 'edit' replace the turn's text so far, 'regenerate' empties
    it, 'delta' (and what else, or null) appends. A turn's role is the last one given that is not
    null; a turn whose last state was never written (only a regeneration) is an empty message.
    Events of one seq are taken by kind, role, text, so reruns agree. Null text is empty. What counts
    is a turn's last event that replaces its text and the deltas behind it, so the work grows with
    the number of events. Returns conv_id, turn, role, text. Turns are folded apart; a turn's events
    meet in one row.
    """
    e = events.select("conv_id", "turn", F.struct(
        "seq", F.coalesce("kind", F.lit("delta")).alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    g = e.groupBy("conv_id", "turn").agg(F.sort_array(F.collect_list("e")).alias("es"))
    begins = F.transform("es", lambda x, i: F.when(x["kind"].isin("message", "edit", "regenerate"), i).otherwise(0))
    g = g.select("conv_id", "turn", "es", F.array_max(begins).alias("at"))
    parts = F.transform(F.slice("es", F.col("at") + 1, F.size("es")), lambda x: F.when(x["kind"] == "regenerate", "").otherwise(x["text"]))
    roles = F.filter(F.transform("es", lambda x: x["role"]), lambda r: r.isNotNull())
    return g.select("conv_id", "turn", F.get(roles, F.size(roles) - 1).alias("role"), F.array_join(parts, "").alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted string, mask array<struct<start,len>>.

    messages: conv_id, turn, role, text; a null turn comes first, a null role or text is empty, and
    repeated rows are turns of their own. Equal turns go by role, then text. mask holds the spans
    (1-based code points of formatted) of the texts of loss_role; their places are running sums over
    the conversation's turns. A conversation is one row, as its output is one string. An empty table
    gives no rows; other columns are not read.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    piece = F.concat(F.lit(OPEN), escape(role), F.lit(CLOSE), escape(text), F.lit(END))
    m = messages.select("conv_id", "turn", role.alias("role"), text.alias("text"), piece.alias("piece"), F.length(escape(text)).alias("len"))
    upto = F.sum(F.length("piece")).over(W.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(W.unboundedPreceding, W.currentRow))
    m = m.select("conv_id", F.struct("turn", "role", "text", upto.alias("upto"), "piece", "len").alias("m"))
    g = m.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    spans = F.transform(F.filter("ms", lambda x: x["role"] == loss_role), lambda x: F.struct(
        (x["upto"] - len(END) - x["len"] + 1).cast("int").alias("start"), x["len"].alias("len")))
    return g.select("conv_id", F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"), spans.alias("mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Turns (array<struct<role,text>>) and the unescaped text under the mask, from render()'s output.

    A span is taken from the chunks of CHUNK characters that it touches, so the work grows with the
    text's length, not with that times the number of turns.
    """
    pieces = F.filter(F.split("formatted", END, -1), lambda p: p != "")
    turns = F.transform(pieces, lambda p: F.struct(
        unescape(F.regexp_extract(p, r"(?s)^\[INST\](.*?)\[/INST\](.*)$", 1)).alias("role"),
        unescape(F.regexp_extract(p, r"(?s)^\[INST\](.*?)\[/INST\](.*)$", 2)).alias("text")))
    r = rendered.select("*", turns.alias("turns"), F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0)).alias("chunks"))

    def under(x):
        first = F.floor((x["start"] - 1) / CHUNK).cast("int")
        count = F.floor((x["start"] + x["len"] - 2) / CHUNK).cast("int") - first + 1
        return F.substring(F.array_join(F.slice("chunks", first + 1, count), ""), x["start"] - first * CHUNK, x["len"])

    spans = F.transform(F.filter("mask", lambda x: x["len"] > 0), lambda x: unescape(under(x)))
    return r.select("*", F.array_join(spans, "").alias("loss_text")).drop("chunks")


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """fold() and render(): conv_id, formatted, mask."""
    return render(fold(events), loss_role)


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and the planted conversation -1, as event logs folded, formatted and read back."""
    c = C.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    out = read_back(format_chats(events_of(c.unionByName(planted))))
    line = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(line, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


_ESC = r"regexp_replace(replace({0}, '\', '\\'), '([\[<])(/?INST\]|/?s>)', '\1\\\2', 'g')"
SQL = rf"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id::bigint as conv_id, count(*)::bigint as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(case when role = 'assistant' then text end, '' order by turn, role, text), '')) as loss_sha256,
  sum(17 + length({_ESC.format('role')}) + length({_ESC.format('text')}))::bigint as formatted_chars
from c group by conv_id
"""
QUERIES = {"op10_chat_formatting": (op10_chat_formatting, SQL)}
