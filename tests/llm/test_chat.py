"""Folding events, and reading back what was rendered."""

import random

from pyspark.sql import functions as F

from planlens.llm import chat


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 0, 0, "message", "user", "Hi"), (1, 1, 0, "edit", "user", "Hello"), (1, 2, 1, "message", "assistant", ""), (1, 3, 1, "delta", None, "A"), (1, 4, 1, "delta", None, "B"),
        (1, 5, 1, "regenerate", None, None), (1, 6, 1, "delta", None, "C"), (1, 7, 1, "delta", None, None), (1, 8, 1, "delta", None, "D"), (1, 9, 0, "noise", None, "x"), (2, 0, 0, "delta", None, "lone"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.messages(df).collect()}
    assert got == {(1, 0): ("user", "Hello"), (1, 1): ("assistant", "CD"), (2, 0): ("", "lone")}
    assert chat.messages(df.where("false")).count() == 0


def test_round_trip_of_control_strings(spark):
    rng = random.Random(2)
    parts = ["\\", "### ", "###", "</turn>", "</turn", ">", "\n", ": ", ":", "\\h", "\\t", "\\c", "\\\\", "user", "é", "𝔘", " ", ""]
    turns = [(c, t, rng.choice(["user", "assistant", "a:b", "### x", None]), rng.choice([None, "", "".join(rng.choices(parts, k=rng.randrange(12)))])) for c in range(60) for t in range(rng.randrange(1, 6))]
    df = spark.createDataFrame([(*t, "clash", "clash") for t in turns], "conv_id long, turn long, role string, text string, message string, seq string")
    out = chat.render(chat.messages(chat.events(df))).select("conv_id", chat.parse(F.col("formatted")).alias("back"), chat.loss_text(F.col("formatted"), F.col("mask")).alias("loss"))
    for r in out.collect():
        want = [(role or "", text or "") for c, _, role, text in turns if c == r.conv_id]
        assert [tuple(x) for x in r.back] == want
        assert r.loss == "".join(t for role, t in want if role == "assistant")


def test_no_python_in_the_plan(spark):
    from planlens.llm import registry

    plan = registry.op4_chat(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
