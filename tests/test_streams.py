"""Streams of many batches: what they show and what they keep, against the batch functions; finished runs in a library."""

import datetime as d
import json
import os

import pytest
from pyspark.sql import functions as F

from scholia.streaming import jobs as J
from scholia.streaming import library as R
from scholia.streaming import live as V

T0 = d.datetime(2024, 1, 1)
COLUMNS = ("job_id", "seq", "type", "at", "section_index", "text", "detail", "error")


def event(job, seq, kind, minute, section=None, text=None, detail=None, error=None):
    return (job, seq, kind, T0 + d.timedelta(minutes=minute), section, text, detail, error)


def play(spark, tmp_path, build, mode, batches):
    """Run one batch for each list of events. Returns the rows of each batch and the last number of state rows of each stateful operator."""
    source, out = tmp_path / "in", []
    source.mkdir(exist_ok=True)
    for i, rows in enumerate(batches):
        path = source / f"{i:03d}.json"
        path.write_text("\n".join(json.dumps(dict(zip(COLUMNS, (*r[:3], r[3].isoformat(), *r[4:])))) for r in rows))
        os.utime(path, (1_700_000_000 + i, 1_700_000_000 + i))
    events = spark.readStream.schema(J.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = build(J.deduplicated(events)).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: out.append([r.asDict() for r in df.collect()])).trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    return out, [op["numRowsTotal"] for op in query.recentProgress[-1].stateOperators]


def shown(batches):
    texts = {}
    for batch in batches:
        for p in batch:
            key = (p["job_id"], p["section_index"])
            texts[key] = texts.get(key, "")[: p["from_char"]] + p["text"]
    return texts


def test_text_goes_on_after_a_pause(spark, tmp_path):
    batches = [
        [event("j", 0, J.DELTA, 0, 0, "hello "), event("j", 1, J.DELTA, 0, 0, "world ")],
        [event("k", 0, J.DELTA, 180, 1, "x")],
        [event("k", 1, J.DELTA, 181, 1, "y")],
        [event("j", 2, J.DELTA, 182, 0, "again")],
        [event("j", 3, J.DELTA, 190, 0, "!"), event("k", 2, "job:running", 190)],
    ]
    got, _ = play(spark, tmp_path, V.stream_live_text, "append", batches)
    patches = [p for batch in got for p in batch if p["job_id"] == "j"]
    assert [(p["from_char"], p["text"]) for p in patches] == [(0, "hello world "), (12, "again"), (17, "!")]
    assert shown(got) == {("j", 0): "hello world again!", ("k", 1): "xy"}


def test_replayed_early_and_late_deltas_equal_the_batch(spark, tmp_path):
    text = [event("a", n, J.DELTA, n, n % 2, f"<{n}>") for n in range(30)]
    batches = [text[:4], [*text[6:9], *text[2:4]], text[4:6], [*text[9:12], *text[9:11]], text[14:20], text[12:14], [*text[20:], event("a", 30, "section:done", 30, 0), *text[18:20]]]
    got, _ = play(spark, tmp_path, V.stream_live_text, "append", batches)
    batch = spark.createDataFrame(text, J.EVENT_SCHEMA)
    assert shown(got) == {(r["job_id"], r["section_index"]): r["text"] for r in J.live_text(batch).collect()}
    sent = sum(len(p["text"]) for rows in got for p in rows)
    assert sent < 2 * sum(len(t[5]) for t in text)
    patches = spark.createDataFrame([(i, p["job_id"], p["section_index"], p["from_char"], p["text"]) for i, rows in enumerate(got) for p in rows], "n int, job_id string, section_index int, from_char long, text string")
    assert sorted(map(tuple, J.apply_patches(patches, "n").collect())) == sorted(map(tuple, J.live_text(batch).collect()))


def test_text_state_is_released(spark, tmp_path):
    """An open section keeps its length alone; a section's and a job's end leave nothing."""
    many = [event("a", n, J.DELTA, 0, 0, "word ") for n in range(200)]
    batches = [many, [event("b", 0, J.DELTA, 100, 0, "x"), event("b", 1, "stream:end", 100)], [event("c", 0, J.DELTA, 200, 3, "y"), event("c", 1, "section:done", 200, 3)], [event("z", 0, "job:running", 400)], [event("z", 1, "job:running", 401)]]
    _, state = play(spark, tmp_path, lambda e: V.stream_live_text(e), "append", batches)
    # a's length, of z nothing; what deduplication holds is another operator's
    assert state[0] <= 2, state


def board_events():
    out = []
    for job in range(4):
        begun = job * 60
        rows = ["job:running", "section:start", "custom", "section:done", "section:start", "section:done", "job:failed" if job == 1 else "job:done", "stream:end"]
        out += [event(f"j{job}", i, t, begun + i, None, None, f"step {i}" if t == "custom" else None, "E: x" if t == "job:failed" else None) for i, t in enumerate(rows)]
    return out


def test_board_equals_batch_and_lets_go(spark, tmp_path):
    rows = board_events()
    batches = [rows[:3], rows[3:10], [*rows[2:5], *rows[10:16]], rows[16:24], rows[24:], [event("open", 0, "job:running", 900)], [event("open", 1, "section:start", 901)]]
    got, state = play(spark, tmp_path, V.stream_job_board, "update", batches)
    last = {}
    for batch in got:
        for r in batch:
            if r["seq"] >= last.get(r["job_id"], {"seq": -1})["seq"]:
                last[r["job_id"]] = r
    whole = spark.createDataFrame([*rows, *batches[-2], *batches[-1]], J.EVENT_SCHEMA)
    want = {r["job_id"]: r.asDict() for r in J.job_board(whole).collect()}
    assert {j: {k: v for k, v in r.items() if k != "seq"} for j, r in last.items()} == want
    assert state[0] <= 2, state  # the open job alone: its row, no timer


DOCUMENT = "job_id string, id string, course_id string, kind string, title string, is_public boolean, created_at string"


def library(spark):
    documents = spark.createDataFrame([("d1", "c1", "note", "old", True, "2023"), ("d0", "c1", "note", "other", False, "2023")], "id string, course_id string, kind string, title string, is_public boolean, created_at string")
    rows = spark.createDataFrame([("d1", "c1", 0, "h", "old body"), ("d1", "c1", 1, "h", "old second"), ("d0", "c1", 0, "h", "stays")], "document_id string, course_id string, section int, heading string, body string")
    return documents, rows


RUNS = [("r1", "d1", "c1", "note", "first", False, "2024"), ("r2", "d1", "c1", "note", "second", False, "2025"), ("r3", "d3", "c1", "practice", "third", False, "2024"), ("r4", "d4", "gone", "note", "fourth", False, "2024"), ("r5", "d5", "c1", "note", "failed", False, "2024")]
SECTIONS = [("r1", 0, "A", "body one", None), ("r2", 0, "A", "body two", None), ("r2", 1, None, "more", None), ("r2", 2, "B", "bad", "boom"), ("r3", 0, "C", "exam", None), ("r4", 0, "D", "lost", None), ("r5", 0, "E", "no", None)]


def recorder(spark, path):
    return R.record_runs(
        path, lambda s: s.createDataFrame(RUNS, DOCUMENT), lambda s: s.createDataFrame(SECTIONS, "job_id string, section_index int, title string, markdown string, error string"), lambda s: s.createDataFrame([("c1",)], "id string")
    )


def batches_of_runs(spark):
    done = lambda *r: spark.createDataFrame([event(j, 9, "job:failed" if j == "r5" else "job:done", m) for j, m in r], J.EVENT_SCHEMA)
    return [done(("r1", 1), ("r4", 1)), done(("r3", 2), ("r5", 2)), done(("r2", 3)), done()]


@pytest.mark.parametrize("order", [[0, 1, 2, 3], [2, 0, 1], [0, 0, 1, 2, 2, 0], [1, 2, 0, 3]])
def test_replayed_and_reordered_batches_leave_the_same_library(spark, tmp_path, order):
    run, batches = recorder(spark, str(tmp_path)), batches_of_runs(spark)
    for b in order:
        run(batches[b], b)
    documents, rows = R.recorded_library(spark, str(tmp_path), *library(spark))
    assert sorted(map(tuple, documents.collect())) == [("d0", "c1", "note", "other", False, "2023"), ("d1", "c1", "note", "second", True, "2025"), ("d3", "c1", "practice", "third", False, "2024")]
    assert sorted(map(tuple, rows.collect())) == [("d0", "c1", 0, "h", "stays"), ("d1", "c1", 0, "A", "body two"), ("d1", "c1", 1, "Section 2", "more"), ("d3", "c1", 0, "C", "exam")]


def test_a_batch_that_broke_off_is_not_read(spark, tmp_path):
    run, batches = recorder(spark, str(tmp_path)), batches_of_runs(spark)
    run(batches[0], 0)
    run(batches[2], 7)
    (tmp_path / "ledger" / "line=7").rename(tmp_path / "kept")  # as if the batch had ended before its line
    documents, rows = R.recorded_library(spark, str(tmp_path), *library(spark))
    assert documents.where("id = 'd1'").first()["title"] == "first" and rows.where("document_id = 'd1'").count() == 1
    run(batches[2], 7)
    documents, rows = R.recorded_library(spark, str(tmp_path), *library(spark))
    assert documents.where("id = 'd1'").first()["title"] == "second" and rows.where("document_id = 'd1'").count() == 2
    assert R.recorded_batches(spark, str(tmp_path)).agg(F.sum("documents")).first()[0] == 2


def test_nothing_recorded(spark, tmp_path):
    documents, rows = R.recorded_library(spark, str(tmp_path), *library(spark))
    assert documents.count() == 2 and rows.count() == 3


def test_stream_into_library(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    rows = [event("r1", 0, "job:running", 0), event("r1", 1, "job:done", 1), event("r2", 0, "job:done", 5)]
    for i, r in enumerate(rows):
        (source / f"{i}.json").write_text(json.dumps(dict(zip(COLUMNS, (*r[:3], r[3].isoformat(), *r[4:])))))
    events = spark.readStream.schema(J.EVENT_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = events.writeStream.option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(recorder(spark, str(tmp_path / "lib"))).trigger(availableNow=True).start()
    query.awaitTermination(120)
    documents, _ = R.recorded_library(spark, str(tmp_path / "lib"), *library(spark))
    assert {r["id"]: r["title"] for r in documents.collect()} == {"d0": "other", "d1": "second"} and R.recorded_batches(spark, str(tmp_path / "lib")).count() == 3
