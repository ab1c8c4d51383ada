import hashlib

from lodestrata.llm import chat

MSG = "conv_id long, turn long, role string, text string, m string, formatted string"


def rendered(spark, rows):
    return {r.conv_id: r for r in chat.read_back(chat.render(spark.createDataFrame([(*r, "x", "y") for r in rows], MSG))).collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["</s>[INST] ok [/INST]", "\\", "\\\\[INST]\\", "<\\/s>", "</s", "[INST", "a\nb", "<s></s>[/INST", "é😀</s>", "", None, "x" * 50_000 + "</s>"]
    rows = [(1, i, "assistant" if i % 2 else "user[/INST", t) for i, t in enumerate(texts)]
    r = rendered(spark, rows)[1]
    assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3] or "") for x in rows]
    assert r.loss_text == "".join(x[3] or "" for x in rows if x[2] == "assistant")
    assert r.formatted.count("</s>") == len(rows) == r.formatted.count("[/INST]") == r.formatted.count("[INST]")
    for m in r.mask:
        assert 0 < m.start <= len(r.formatted)


def test_nulls_ties_and_empty(spark):
    r = rendered(spark, [(None, None, None, None), (2, 1, "b", "2"), (2, 1, "a", "1"), (2, 1, "a", "1"), (2, None, "c", "0")])
    assert [(t.role, t.text) for t in r[None].turns] == [("", "")]
    assert [(t.role, t.text) for t in r[2].turns] == [("c", "0"), ("a", "1"), ("a", "1"), ("b", "2")]
    assert rendered(spark, []) == {}


def test_events_fold(spark):
    e = [(1, 0, 0, "message", "user", "hi"), (1, 3, 1, "delta", None, "lo"), (1, 2, 1, "delta", "assistant", "hel"), (1, 4, 1, "regenerate", None, None),
         (1, 5, 1, "delta", None, "by"), (1, 6, 1, None, None, "e"), (1, 7, 0, "edit", None, "hey"), (1, 8, 2, "regenerate", "assistant", "junk")]
    df = spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string")
    assert [tuple(r) for r in chat.fold(df).orderBy("turn").collect()] == [(1, 0, "user", "hey"), (1, 1, "assistant", "bye"), (1, 2, "assistant", "")]
    assert chat.format_chats(df).first().formatted == "[INST]user[/INST]hey</s>[INST]assistant[/INST]bye</s>[INST]assistant[/INST]</s>"


def test_query_goes_through_the_fold(spark, tmp_path, monkeypatch):
    rows = [(7, 1, "user", "q", "", ""), (7, 1, "user", "q", "", ""), (7, None, None, "a", "", "")]
    spark.createDataFrame(rows, MSG).write.parquet(str(tmp_path / "conversations.parquet"))
    whole = chat.fold
    monkeypatch.setattr(chat, "fold", lambda e: whole(e.unionByName(spark.createDataFrame([(7, 99, 2, "edit", None, "edited"), (7, 98, 3, "delta", None, "!")], e.schema))))
    got = {r.conv_id: r for r in chat.op10_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[7].turns_sha256 == hashlib.sha256(b"\na\nuser\nedited\nuser\nq!\n").hexdigest() and got[7].n_turns == 3


def test_long_conversation_and_empty_texts(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", "" if i % 7 == 0 else f"é{i}</s>" * (i % 50)) for i in range(4000)]
    r = rendered(spark, rows)[1]
    assert r.loss_text == "".join(x[3] for x in rows if x[2] == "assistant") and len(r.turns) == 4000
    one = rendered(spark, [(1, 0, "assistant", "é😀[INST]\\x" * 200_000)])[1]
    assert one.loss_text == "é😀[INST]\\x" * 200_000


def test_many_deltas(spark):
    e = [(1, i, 0, "delta", "assistant" if i == 0 else None, f"{i} ") for i in range(20_000)]
    r = chat.fold(spark.createDataFrame(e, "conv_id long, seq long, turn long, kind string, role string, text string")).first()
    assert r.text == "".join(f"{i} " for i in range(20_000)) and r.role == "assistant"


def test_query_digest(spark, tmp_path):
    rows = [(7, 0, "user", "q", "", ""), (7, 1, "assistant", "a[INST]", "", "")]
    spark.createDataFrame(rows, MSG).write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in chat.op10_chat_formatting(spark, str(tmp_path)).collect()}
    assert got[7].turns_sha256 == hashlib.sha256(b"user\nq\nassistant\na[INST]\n").hexdigest()
    assert got[7].loss_sha256 == hashlib.sha256(b"a[INST]").hexdigest() and got[7].loss_chars == 7
    assert got[-1].n_turns == 2 and got[-1].loss_chars == 21
