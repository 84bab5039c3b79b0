import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pitspark.llm import chat

NASTY = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "[", " ", "[INST", "s>", "x", "\n", "é"]), max_size=8).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", ""]) | NASTY, NASTY), max_size=4))
def test_round_trip(turns):
    rendered = "".join(chat.render(role, text)[0] for role, text in turns)
    assert [t[:2] for t in chat.parse(rendered)] == turns


def test_escaping_only_where_needed():
    assert chat.render("user", "plain text") == ("<s>[INST] plain text [/INST]</s>", 10, 20, 0)
    assert chat.render("assistant", "a </s> b")[3] == 1
    rendered, start, end, _ = chat.render("assistant", "[INST] \\ </s>")
    assert chat.unescape(rendered[start:end]) == "[INST] \\ </s>"


def test_read_back_over_batches(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"text {i} </s>") for i in range(50)] + [(None, None, None, None)]
    source = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.conv_id: r for r in chat.read_back(chat.format_turns(source)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    whole = "".join(f"{r[2]}\n{r[3]}\n" for r in rows[:50])
    loss = "".join(r[3] for r in rows[:50] if r[2] == "assistant")
    assert got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (50, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert (got[None].n_turns, got[None].turns_sha256) == (1, hashlib.sha256(b"\n\n").hexdigest())


def test_no_rows(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_turns(empty)).count() == 0
