"""Layout operators on hand-written pages, and streams against their batch twins."""

import datetime as d
import json

import pandas as pd
from pyspark.sql import functions as F

from scholia.operators import layout as L
from scholia.streaming import jobs as J
from scholia.streaming import live as V

WORDS = "doc_id string, page_no int, text string, x0 double, x1 double, top double, bottom double, size double"
OBJECTS = "doc_id string, page_no int, kind string, x0 double, x1 double, top double, bottom double"
BOXES = "doc_id string, page_no int, x0 double, y0 double, x1 double, y1 double"


def word(text, x0, top, size=10.0, page=1):
    return ("d", page, text, float(x0), float(x0 + 6 * len(text)), float(top), float(top + size), size)


def page(spark):
    words = [word(w, x, 330, 9.0) for w, x in (("Figure", 100), ("6.5", 140), ("A", 165), ("cache", 175))] + [word(w, x, 341, 9.0) for w, x in (("with", 100), ("sets.", 130))]
    words += [word("label", 200, 186, 7.0), word("Body", 100, 500, 10.0)]
    objects = [("d", 1, "rect", 150.0 + 10 * i, 160.0 + 10 * i, 200.0 + i, 300.0) for i in range(9)] + [("d", 1, "rect", 10.0, 20.0, 700.0, 710.0)]
    return spark.createDataFrame(words, WORDS), spark.createDataFrame(objects, OBJECTS), spark.createDataFrame([("d", 1, 0.0, 0.0, 600.0, 800.0)], BOXES)


def test_lines_and_clusters(spark):
    words, objects, _ = page(spark)
    assert "Figure 6.5 A cache" in [r["text"] for r in L.assemble_lines(words).collect()]
    clusters = L.drawing_clusters(objects).collect()
    assert [(r["n"], r["c_top"], r["c_bottom"]) for r in clusters] == [(9, 200.0, 300.0)]


def test_captioned_cluster_becomes_a_figure(spark):
    words, objects, boxes = page(spark)
    found = L.find_figures(words, objects, boxes).collect()
    assert len(found) == 1 and found[0]["number"] == "6.5" and found[0]["caption"] == "A cache with sets"
    box = found[0]["bbox"]
    assert box["top"] <= 186 - 9 and box["bottom"] >= 350 and box["x0"] <= 100 - 9 and box["x1"] >= 240
    other = spark.createDataFrame([("d", 2)], "doc_id string, page_no int")
    assert L.find_figures(words, objects, boxes, pages=other).count() == 0
    assert L.find_figures(words.where("text != 'Figure'"), objects, boxes).count() == 0


def test_same_number_merges_when_near(spark):
    schema = "doc_id string, page_no int, cluster_id int, number string, caption string, bbox struct<x0:double,top:double,x1:double,bottom:double>"
    rows = [("d", 1, 0, "1.1", "", (0.0, 0.0, 10.0, 10.0)), ("d", 1, 1, "1.1", "cap", (5.0, 50.0, 20.0, 60.0)), ("d", 2, 0, "1.2", "a", (0.0, 0.0, 10.0, 10.0)), ("d", 2, 1, "1.2", "b", (0.0, 500.0, 90.0, 600.0))]
    got = {r["number"]: r for r in L.merge_same_number(spark.createDataFrame(rows, schema)).collect()}
    assert tuple(got["1.1"]["bbox"]) == (0.0, 0.0, 20.0, 60.0) and got["1.1"]["caption"] == "cap" and got["1.2"]["caption"] == "b"


def test_title_is_the_largest_font_in_adjacent_lines(spark):
    words = [word("Summary:", 10, 20, 24.0), word("Basic", 10, 50, 24.0), word("Rules", 90, 51, 24.0), word("body", 10, 120, 12.0), word("Late", 10, 300, 24.0), word("12", 500, 780, 30.0), word("x", 10, 10, 12.0, page=2)]
    got = {r["page_no"]: r["title"] for r in L.extract_title(spark.createDataFrame(words, WORDS)).collect()}
    assert got == {1: "Summary: Basic Rules", 2: "x"}


def test_shape_counts_and_latest_figures(spark):
    _, objects, _ = page(spark)
    assert L.count_shapes(objects).first()["shape_count"] == 10
    box = "book_id string, number string, caption string, page int, bbox struct<x0:double,top:double,x1:double,bottom:double>"
    f = spark.createDataFrame([("b", "1.1", "old", 3, (0.0, 0.0, 1.0, 1.0)), ("b", "1.1", "new", 9, (0.0, 0.0, 2.0, 2.0))], box)
    assert L.latest_figures(f).first()["caption"] == "new"


def feed():
    at = d.datetime(2024, 1, 1)
    out = [("a", 0, "job:running", None, None, None), ("a", 1, "custom:step", None, None, "half"), ("a", 2, "job:done", None, None, None), ("a", 3, "stream:end", None, None, None)]
    out += [("b", 0, "job:running", None, None, None), ("b", 1, "job:failed", None, None, None), ("b", 2, "stream:end", None, None, None)]
    out += [("c", i, "section:delta", 0, f"{i},", None) for i in range(50)] + [("c", 50, "section:done", 0, None, None)]
    return [(j, s, t, at + d.timedelta(seconds=s), i, x, det, "ValueError: bad" if t == "job:failed" else None) for j, s, t, i, x, det in out]


def test_job_views(spark):
    e = spark.createDataFrame(feed(), J.EVENT_SCHEMA)
    state = {r["job_id"]: (r["status"], r["error"], r["ended"]) for r in J.job_state(e).collect()}
    assert state == {"a": ("done", None, True), "b": ("failed", "ValueError: bad", True), "c": ("queued", None, False)}
    assert [r["type"] for r in J.event_history(e).where("job_id = 'c'").collect()] == ["section:done"]
    assert {r["job_id"]: r["seconds"] for r in J.job_duration(e).collect()} == {"a": 2.0, "b": 1.0, "c": 0.0}
    assert J.live_text(e).first()["text"] == "".join(f"{i}," for i in range(50))
    assert {r["job_id"]: r["last_detail"] for r in J.job_progress(e).collect()}["a"] == "half"


def streamed(spark, tmp_path, build, mode, repeat=False):
    source, out = tmp_path / "in", []
    source.mkdir()
    rows = feed() * (2 if repeat else 1)
    (source / "x.json").write_text("\n".join(json.dumps(dict(zip(("job_id", "seq", "type", "at", "section_index", "text", "detail", "error"), (*r[:3], r[3].isoformat(), *r[4:])))) for r in rows))
    events = spark.readStream.schema(J.EVENT_SCHEMA).json(str(source))
    query = build(events).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: out.extend(df.collect())).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return out


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.createDataFrame(feed(), J.EVENT_SCHEMA)
    got = streamed(spark, tmp_path, J.job_state, "update")
    assert sorted(map(str, got)) == sorted(map(str, J.job_state(batch).collect()))


def test_streamed_text_equals_batch(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda e: V.stream_live_text(J.deduplicated(e)), "append", repeat=True)
    patches = spark.createDataFrame([(i, *r) for i, r in enumerate(got)], "n int, job_id string, section_index int, from_char long, text string")
    assert sorted(map(tuple, J.apply_patches(patches, "n").collect())) == sorted(map(tuple, J.live_text(spark.createDataFrame(feed(), J.EVENT_SCHEMA)).collect()))


def test_stream_drops_repeated_events(spark, tmp_path):
    got = streamed(spark, tmp_path, lambda e: J.event_history(J.deduplicated(e)), "append", repeat=True)
    assert len(got) == len([r for r in feed() if r[2] != J.DELTA])


def test_lines_of_a_page_take_one_step_a_word():
    """Long pages: lines come from one walk over all batches' words, not from arrays that are copied for each word."""
    import time

    import pyarrow as pa

    n = 300_000
    word = pa.StructArray.from_arrays([pa.array([100.0 + 12.0 * (i // 9) + 0.5 * (i % 3) for i in range(n)]), pa.array([9.0] * n), pa.array(["w"] * n)], ["top", "size", "text"])
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([0], pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), word)], ["doc_id", "page_no", "words"])
    begun = time.monotonic()
    out = pa.Table.from_batches(L._lines_of(iter([batch])))
    assert time.monotonic() - begun < 20
    assert out.num_rows == -(-n // 9) and out["line"][1].as_py() == 112.0 and len(out["texts"][0]) == 9
    none = pa.StructArray.from_arrays([pa.array([None, None, 1.0, 3.0, 3.6, float("nan"), float("nan")], pa.float64()), pa.array([9.0] * 7), pa.array(list("abcdefg"))], ["top", "size", "text"])
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 0], pa.int32()), pa.ListArray.from_arrays(pa.array([0, 7, 7], pa.int32()), none)], ["doc_id", "page_no", "words"])
    assert pa.Table.from_batches(L._lines_of(iter([batch])))["texts"].to_pylist() == [["a", "b"], ["c", "d"], ["e"], ["f", "g"]]


def test_pages_of_words_give_what_single_words_give_without_a_shuffle(spark):
    words = [(1, 0, t, x, x + 30.0, top, top and top + 8, z) for t, x, top, z in (("Figure", 90.0, 300.0, 8.0), ("6.5", 125.0, 300.4, 8.0), ("A", 160.0, 300.2, 8.0), ("b", 90.0, 312.0, 8.0), ("b", 90.0, 312.0, 8.0), ("big", 125.0, 312.0, 12.0), ("?", 160.0, None, None), ("label", 95.0, 185.0, 7.0))]
    rows = spark.createDataFrame([*words, (2, 0, "alone", 1.0, 2.0, 3.0, 4.0, 9.0)], "doc_id long, page_no int, text string, x0 double, x1 double, top double, bottom double, size double")
    pages = rows.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct(*L.WORD)).alias("words")).union(spark.createDataFrame([(3, 0, [])], "doc_id long, page_no int, words array<struct<x0:double,x1:double,top:double,bottom:double,size:double,text:string>>")).localCheckpoint()
    objects = spark.createDataFrame([(d, 0, "line", 90.0 + k, 200.0 + k, 200.0 + 9 * k, 204.0 + 9 * k) for d in (1, 2, 3) for k in range(10)], "doc_id long, page_no int, kind string, x0 double, x1 double, top double, bottom double")
    boxes = spark.createDataFrame([(d, 0, 0.0, 0.0, 600.0, 800.0) for d in (1, 2, 3)], "doc_id long, page_no int, x0 double, y0 double, x1 double, y1 double")
    lines = L.assemble_lines(pages)
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(str, lines.collect())) == sorted(map(str, L.assemble_lines(rows).collect()))
    assert {(r["doc_id"], r["row"]): r["text"] for r in lines.collect()} == {(1, 100): "Figure 6.5 A", (1, 104): "b b big", (1, None): "?", (1, 62): "label", (2, 1): "alone"}
    assert sorted(L.extract_title(pages).collect()) == sorted(L.extract_title(rows).collect())
    found = L.find_figures(pages, objects, boxes).collect()
    assert found == L.find_figures(rows, objects, boxes).collect() and [(r["number"], r["caption"]) for r in found] == [("6.5", "A b b")]
