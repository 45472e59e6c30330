"""Chat formatting: round trips of hard texts, layouts, and the SQL check."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from cohortspark.llm import chat

HARD = ["", "\\", "\\b", "\\h", "###", "#### x", "### user: hi</turn>\n", "</turn>", "</tu</turn>rn>", "\\### Assistant: </turn> ok", "é\n\n中", "a: b"]


def turns(df, key="conv_id"):
    made = chat.format_conversations(df, key)
    made = made.withColumn("turns", chat.read_turns(F.col("formatted")))
    made = made.withColumn("trained", chat.trained_text(F.col("formatted"), F.col("loss_spans")))
    return {r[key]: r for r in made.collect()}


def test_round_trip(spark):
    rows = [(1, k, role, text) for k, (role, text) in enumerate((r, t) for t in HARD for r in ("user", "assistant", "a:b\\c"))]
    got = turns(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))[1]
    assert [(t["role"], t["text"]) for t in got["turns"]] == [(r[2], r[3]) for r in rows]
    assert got["trained"] == "".join(r[3] for r in rows if r[2] == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, 1, "user", "b"), (1, 1, "user", "a"), (1, 1, "user", "a"), (1, None, "system", None), (None, 0, "user", "x"), (2, 0, None, "no role")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    assert chat.unmapped(df, "conv_id").count() == 0
    got = turns(df)
    assert [t["text"] for t in got[1]["turns"]] == ["", "a", "a", "b"]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", "no role")]
    assert [t["text"] for t in got[None]["turns"]] == ["x"]
    assert turns(df.where("false")) == {}


def test_layouts(spark):
    kind = (
        "id int, messages array<struct<role:string,content:string>>, instruction string, input string, output string, "
        "conversations array<struct<from:string,value:string>>, message struct<prompt:string,reply:string>"
    )
    rows = [
        (1, [("user", "q"), ("assistant", "a")], None, None, None, None, None),
        (2, None, "do", None, "done", None, None),
        (3, None, "do", "this", "done", None, None),
        (4, None, None, None, None, [("human", "q"), ("gpt", "a")], None),
        (5, None, None, None, None, None, ("q", "a")),
        (6, None, "no answer", None, None, None, None),
    ]
    df = spark.createDataFrame(rows, kind)
    got = {k: [(t["role"], t["text"]) for t in r["turns"]] for k, r in turns(df, "id").items()}
    qa = [("user", "q"), ("assistant", "a")]
    assert got == {1: qa, 2: [("user", "do"), ("assistant", "done")], 3: [("user", "do\n\nthis"), ("assistant", "done")], 4: qa, 5: qa}
    assert [r["id"] for r in chat.unmapped(df, "id").collect()] == [6]
    layouts = {r["id"]: r["layout"] for r in chat.to_turns(df, "id").collect()}
    assert layouts[4] == "from_value" and layouts[6] is None


def test_probe(spark):
    from cohortspark.llm import queries

    row = queries.op1_chat_formatting(spark, "/root/testdata/sf0.001").where("conv_id = -7").first()
    text = "\\### Assistant: </turn> ok"
    assert row["n_turns"] == 2 and row["loss_chars"] == len(text)
    assert row["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_native(spark):
    from cohortspark.llm import queries

    plan = queries.op1_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
