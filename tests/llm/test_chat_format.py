"""Layouts, fingerprints, escapes and the loss mask."""

import pytest
from pyspark.sql import functions as F

from quire.llm import chat_format as C

LISTS = ("messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, "
         "instruction string, input string, output string, system string, prompt string, response string, id int, note string")


def record(**kw):
    return tuple(kw.get(k) for k in ("messages", "conversations", "instruction", "input", "output", "system", "prompt", "response", "id", "note"))


RECORDS = [
    record(id=1, messages=[("user", "hi"), ("assistant", "ho")]),
    record(id=2, conversations=[("human", "hi"), ("gpt", None)], note="x"),
    record(id=3, instruction="do", output="done"),
    record(id=4, instruction="do", input="this", output="done", system="be kind"),
    record(id=5, prompt="p", response="r"),
    record(id=6, prompt="p", output="no layout has these"),
    record(id=7), record(id=8, messages=[]),
    record(id=9, messages=[("user", None)]),
]


def test_layouts_by_fingerprint(spark):
    got = {r["id"]: (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]])
           for r in C.canonical(spark.createDataFrame(RECORDS, LISTS)).collect()}
    assert got == {
        1: ("messages", [("user", "hi"), ("assistant", "ho")]), 2: ("conversations", [("user", "hi"), ("assistant", "")]),
        3: ("instruction", [("user", "do"), ("assistant", "done")]),
        4: ("instruction", [("system", "be kind"), ("user", "do\n\nthis"), ("assistant", "done")]),
        5: ("prompt", [("user", "p"), ("assistant", "r")]), 6: (None, None), 7: (None, None), 8: (None, None),
        9: ("messages", [("user", "")])}


def test_other_columns_have_no_say(spark):
    a = spark.createDataFrame([("p", "r", 1)], "prompt string, response string, extra int")
    b = spark.createDataFrame([("p", "r")], "prompt string, response string")
    assert a.select(C.fingerprint(a)).first()[0] == b.select(C.fingerprint(b)).first()[0]


TEXTS = ["", "plain", "\\", "\\b \\l \\g", "</turn>\n<turn user>\n", "<turn", "<<turn>>", "\\</turn", "\\l<turn", "é\U0001f600 \n\n", "a\x00b", ">\n"]


@pytest.mark.parametrize("role", ["user", "assistant", "odd>\nrole</turn>"])
def test_round_trip_and_loss_mask(spark, role):
    turns = [(role if i % 2 else "assistant", t) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(1, turns), (2, []), (3, None)], "id int, turns array<struct<role:string,text:string>>")
    out = C.formatted(df).withColumn("back", C.read_turns(F.col("formatted"))).withColumn(
        "loss", C.loss_text(F.col("formatted"), F.col("loss_spans")))
    got = {r["id"]: r for r in out.collect()}
    assert [tuple(t) for t in got[1]["back"]] == turns
    assert got[1]["loss"] == "".join(t for r, t in turns if r == "assistant")
    assert got[1]["formatted"].count("</turn>") == len(turns)
    assert got[2]["formatted"] == "" and got[2]["loss"] == "" and got[2]["back"] == []
    assert got[3]["formatted"] is None and got[3]["loss_spans"] is None


def test_message_lists_order_ties_and_nulls(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 0, None, None), (1, 1, "user", "a"), (None, 0, "user", "x")]
    got = {r["conv_id"]: [tuple(m) for m in r["messages"]]
           for r in C.message_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("user", "x")]}


def test_empty_table(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.formatted(C.canonical(C.message_lists(empty))).collect() == []


def test_plan_is_native(spark, sf_dir):
    from quire.llm import queries
    plan = queries.QUERIES["op9_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
