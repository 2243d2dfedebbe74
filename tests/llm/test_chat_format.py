from leaseloom.llm import chat_format as C

ROWS = [
    (1, 0, "assistant", "a<|end|>b\\<|x"), (1, 1, "assistant", None), (1, 2, "assistant", "\\"), (1, 3, "user", "<"), (1, 4, "user", "|end|>"), (1, 4, "us<|er\\", "é<\\|"),
    (None, 1, None, None), (2, None, "assistant", ""), (3, 2, "assistant", "yes"), (3, 1, "system", "s"), (3, 1, "system", "s"), (4, 1, "user", "<|role|>assistant<|text|>")]


def chats(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id int, turn int, role string, content string").selectExpr("*", "'x' as formatted", "1 as text")
    return {r.chunk_id: r for r in C.read_chats(C.format_chats(df)).collect()}


def test_every_turn_is_read_back(spark):
    got = chats(spark, ROWS)
    for chunk in {r[0] for r in ROWS}:
        own = sorted(((r[1] is not None, r[1], r[2] or "", r[3] or "") for r in ROWS if r[0] == chunk))
        assert [tuple(t) for t in got[chunk].turns] == [(role, text) for _, _, role, text in own]
        assert got[chunk].learned == [text for _, _, role, text in own if role == "assistant"]


def test_adjacent_turns_of_a_role_are_one_block(spark):
    got = chats(spark, ROWS)
    assert got[3].formatted == "<|role|>system<|text|>s<|next|>s<|end|><|role|>assistant<|text|>yes<|end|>"
    assert got[1].formatted.count("<|role|>") == 4


def test_no_python_and_no_rows(spark):
    df = spark.createDataFrame([], "chunk_id int, turn int, role string, content string")
    out = C.read_chats(C.format_chats(df))
    assert out.collect() == []
    assert not any(x in out._jdf.queryExecution().executedPlan().toString() for x in ("Python", "Pandas", "Arrow"))
