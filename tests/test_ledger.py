"""Requests that are paid for once, whatever fails in between."""

import pytest
from pyspark.sql import functions as F

from scholia.plans import notes as P
from scholia.plans.ledger import _asked, answers, generate_once


def counted(path, stop=None):
    """A generator that writes down what it is asked; at one request it ends its task."""

    def fn(texts):
        with open(path, "a") as f:
            f.writelines(f"{t}\n" for t in texts)
        if stop and stop in texts:
            raise SystemExit(stop)
        return [(t.upper(), {"calls": 1, "input_tokens": len(t)}) for t in texts]

    return fn


def asked(path):
    return path.read_text().split("\n")[:-1] if path.exists() else []


def test_shared_requests_are_asked_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"q{i % 4}") for i in range(20)] + [(20, None)], "id int, request string")
    log = tmp_path / "log"
    for _ in range(2):
        got = {r["id"]: r["generated"]["text"] for r in generate_once(df, "request", counted(str(log)), str(tmp_path / "ledger")).collect()}
        assert got == {i: f"Q{i % 4}" for i in range(20)} | {20: ""}
    assert sorted(asked(log)) == ["", "q0", "q1", "q2", "q3"]
    assert generate_once(df, "request", counted(str(log)), str(tmp_path / "ledger"), model="other").count() == 21 and len(asked(log)) == 10


def test_a_failed_job_goes_on_where_it_stopped(spark, tmp_path):
    df = spark.createDataFrame([(i, f"r{i:02d}") for i in range(40)], "id int, request string")
    log = tmp_path / "log"
    with pytest.raises(Exception):
        generate_once(df, "request", counted(str(log), stop="r17"), str(tmp_path / "ledger"), batch=3).count()
    before = asked(log)
    kept = {r["text"].lower() for r in answers(spark, f"file://{tmp_path}/ledger").collect()}
    assert kept and "r17" in before and "r17" not in kept
    got = generate_once(df, "request", counted(str(log)), str(tmp_path / "ledger"), batch=3)
    assert {r["id"]: r["generated"]["text"] for r in got.collect()} == {i: f"R{i:02d}" for i in range(40)}
    again = asked(log)[len(before) :]
    assert not kept & set(again) and set(again) | kept == {f"r{i:02d}" for i in range(40)}, "what has an answer is never asked again"


def test_a_task_that_is_tried_again_asks_what_is_open(tmp_path):
    import pandas as pd

    log, folder = tmp_path / "log", f"file://{tmp_path}/answers/run=1"
    rows = pd.DataFrame({"key": [f"k{i}" for i in range(7)], "request": [f"r{i}" for i in range(7)]})
    with pytest.raises(SystemExit):
        list(_asked(iter([rows]), folder, counted(str(log), stop="r5"), 2))
    assert asked(log) == [f"r{i}" for i in range(6)]
    assert list(_asked(iter([rows]), folder, counted(str(log)), 2))[0]["asked"][0] == 3
    assert asked(log)[6:] == ["r4", "r5", "r6"]


def test_errors_are_asked_again_by_the_next_call_alone(spark, tmp_path):
    df = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, request string")

    def fails(texts):
        if "bad" in texts:
            raise ValueError("no")
        return [(t, {}) for t in texts]

    path, log = str(tmp_path / "ledger"), tmp_path / "log"
    assert {r["id"]: r["generated"]["error"] for r in generate_once(df, "request", fails, path).collect()} == {1: None, 2: "ValueError: no"}
    assert {r["id"]: r["generated"]["error"] for r in generate_once(df, "request", counted(str(log)), path).collect()} == {1: None, 2: None}
    assert asked(log) == ["bad"]


def test_retry_pays_for_failed_sections_alone(spark, tmp_path):
    requests = spark.createDataFrame([("d", i, 1, 2, f"t{i}", None, f"request {i}") for i in range(6)], "deck_id string, section_index int, first_slide int, last_slide int, card_title string, chunks array<struct<citation:string>>, request string")

    def flaky(texts):
        if any(t.endswith(("2", "4")) for t in texts):
            raise TimeoutError("late")
        return [(t, {}) for t in texts]

    ledger, log = str(tmp_path / "ledger"), tmp_path / "log"
    first = P.expand_sections(requests, flaky, ledger).drop("usage").withColumnRenamed("deck_id", "document_id")
    assert first.where("error is not null").count() == 2
    merged = P.retry_failed(first, requests, counted(str(log)), ledger)
    assert merged.where(F.col("error").isNotNull()).count() == 0 and sorted(set(asked(log))) == ["request 2", "request 4"] and len(asked(log)) == 2
