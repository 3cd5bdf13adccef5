import random

import pytest

from scholia.llm.conversations import END, backward, damaged, repair_conversations, repair_report, rerun
from scholia.llm.queries import op11_conversation_repair

from repair_by_hand import report

SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return {r[0]: tuple(r[1:]) for r in df.collect()}


def test_query_equals_shortest_path(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    assert rows_of(op11_conversation_repair(spark, sf_dir)) == report([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("chunk", [2, 5])
def test_chunks_of_any_size(spark, chunk):
    """One conversation holds half of the rows, one nothing but unknown roles (its vectors pass through every chunk), one the same row again and again."""
    rng = random.Random(chunk)
    texts = ["Yes.", "No!", "Well", "", " \t", "And?", "So it is. ", "é.", "x"]
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", ""]), f"{t} {rng.choice(texts)}") for t in range(30)]
    rows += [(2, t, "tool", f"{t}.") for t in range(7)] + [(3, 4, "user", "again.")] * 6 + [(3, 5, "assistant", "once.")]
    rows += [(c, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(texts)) for c in range(4, 12) for t in rng.sample(range(12), rng.randrange(1, 7))]
    got = rows_of(repair_report(df := spark.createDataFrame(rows, SCHEMA), df, chunk=chunk))
    assert got == report(rows, damaged=False)


def test_nulls_empty_and_extra_columns(spark):
    rows = [(None, None, None, None), (None, 1, "user", "Hi."), (7, None, "user", "A."), (7, None, "user", "A."), (7, None, "assistant", None), (8, 3, None, "word."), (9, 2, "user", None), (9, 2**62, "assistant", "b.")]
    wide = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA + ", row string, at int")
    assert rows_of(repair_report(wide, wide, chunk=2)) == report(rows, damaged=False)
    assert rows_of(repair_report(wide, damaged(wide))) == report(rows)
    nothing = wide.where("false")
    assert repair_report(nothing, nothing).count() == 0
    # conversations of which every row is gone
    assert rows_of(repair_report(wide, nothing)) == {r[0]: report([], damaged=False).get(r[0], (0, 0, 0, 0, 0, 0, "", "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855")) for r in rows}


def test_very_long_text_and_turns(spark):
    rows = [(1, 0, "user", "a " * 300_000 + "."), (1, 1, "assistant", "b" * 500_000)]
    summary, turns = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    assert summary.first()["audit"] == "KK" and summary.first()["cost"] == 3
    assert [(r["edit"], r["role"], len(r["text"])) for r in turns.orderBy("row", "place").collect()] == [("K", "user", 600_001), ("K", "assistant", 500_000)]


def test_rerun_stops_at_parallel_vectors():
    letters = "uaUAoxsu" * 5
    old = backward(letters, (0, 0, 0, 0))
    assert rerun(letters, (0, 0, 0, 0), END, old[0]) == backward(letters, END)[0]
    assert rerun(letters, (0, 0, 0, 0), (5, 5, 5, 5), old[0]) == old[0]


def test_turns_give_what_the_audit_says(spark):
    rows = [(1, 1, "assistant", "Late."), (1, 2, "user", "Q?"), (2, 1, "system", "S."), (3, 1, "user", "only")]
    _, turns = repair_conversations(spark.createDataFrame(rows, SCHEMA))
    seen = {}
    for r in turns.orderBy("conv_id", "row", "place").collect():
        seen.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    assert seen[2] == [("D", None, None)] and seen[3] == [("D", None, None)]
    assert seen[1] == [("I", "user", ""), ("K", "assistant", "Late."), ("K", "user", "Q?"), ("I", "assistant", "")]
