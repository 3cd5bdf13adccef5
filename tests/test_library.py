"""Library maintenance, results, estimates, sources."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from scholia.functions.scalars import usage_add
from scholia.operators import estimate as E
from scholia.operators import library as L
from scholia.operators import results as X
from scholia.plans import notes as N
from scholia.plans import requests as R
from scholia.sources import tables as T

MATERIAL = "id long, course_id long, kind string, sha string"
DOCUMENT = "id string, course_id long, kind string, failed array<int>, is_public boolean, created_at timestamp"


def test_same_content_in_two_courses_is_one_blob(spark):
    m = spark.createDataFrame([(1, 1, "book", "s"), (2, 2, "book", "s"), (3, 1, "book", "t")], MATERIAL)
    tables = {"courses": spark.createDataFrame([(1,), (2,)], "id long"), "materials": m, "documents": spark.createDataFrame([("a", 1)], "id string, course_id long"), "doc_sections": spark.createDataFrame([("a", 1)], "document_id string, course_id long")}
    kept, gone = L.delete_courses(tables, spark.createDataFrame([(1,)], "id long"))
    assert [r["sha"] for r in gone.collect()] == ["t"]
    assert {n: t.count() for n, t in kept.items()} == {"courses": 1, "materials": 1, "documents": 0, "doc_sections": 0}


def test_adding_material_twice_keeps_the_first_row(spark):
    old = spark.createDataFrame([(1, 1, "book", "s")], MATERIAL)
    new = spark.createDataFrame([(9, 1, "book", "s"), (10, 1, "lecture", "s"), (11, 1, "lecture", "s"), (12, 1, "movie", "s")], MATERIAL)
    found = L.add_materials(old, new)
    assert found.count() == 2 and found.where("kind = 'book'").first()["id"] == 1


def test_upsert_replaces_and_keeps_the_public_flag(spark):
    import datetime as d

    at = d.datetime(2024, 1, 1)
    old = spark.createDataFrame([("x", 1, "note", [2, 5], True, at)], DOCUMENT)
    new = spark.createDataFrame([("x", 1, "note", [5, 6], False, at + d.timedelta(1)), ("x", 1, "note", [5], False, at + d.timedelta(2)), ("y", 1, "note", [], False, at), ("z", 1, "song", [], False, at)], DOCUMENT)
    once = L.upsert_documents(old, new)
    row = once.where("id = 'x'").first()
    assert once.count() == 2 and row["failed"] == [5] and row["is_public"] is True
    assert sorted(map(str, L.upsert_documents(once, new).collect())) == sorted(map(str, once.collect()))


def test_usage_ignores_exams_and_deleting_clears_references(spark):
    docs = spark.createDataFrame([("a", 1, 1, 3), ("b", 1, 2, 3), ("c", None, 1, 1)], "id string, lecture_id long, book_id long, exam_id long")
    m = spark.createDataFrame([(1, 1, "book", "s"), (2, 1, "book", "t"), (3, 1, "exam", "u")], MATERIAL)
    assert {r["id"]: r["uses"] for r in L.material_usage(m, docs).collect()} == {1: 3, 2: 1, 3: 0}
    kept, cleared, gone = L.delete_materials(m, docs, spark.createDataFrame([(1,)], "id long"))
    assert kept.count() == 2 and [r["sha"] for r in gone.collect()] == ["s"]
    assert sorted((r["id"], r["lecture_id"], r["book_id"], r["exam_id"]) for r in cleared.collect()) == [("a", None, None, 3), ("b", None, 2, 3), ("c", None, None, None)]


def test_schema_evolves_once(spark):
    schema = StructType([StructField("id", StringType()), StructField("kind", StringType()), StructField("duration", DoubleType())])
    old = spark.createDataFrame([("a",)], "id string")
    once = L.evolve_schema(old, schema, {"kind": "note", "duration": 0.0})
    assert tuple(once.first()) == ("a", "note", 0.0)
    assert L.evolve_schema(once, schema, {"kind": "other"}).collect() == once.collect()


def test_recent_seconds_by_backend_and_kind(spark):
    import datetime as d

    rows = [("a", "cli", "note", 800.0, 8, 1), ("b", "cli", "note", 600.0, 4, 2), ("c", "api", "note", 60.0, 6, 3), ("d", "cli", "note", 0.0, 4, 4), ("e", "api", "practice", 40.0, 12, 5)]
    docs = spark.createDataFrame([(*r[:5], d.datetime(2024, 1, r[5])) for r in rows], "id string, backend string, kind string, duration double, sections int, created_at timestamp")
    runs = E.section_seconds(docs)
    assert sorted(r["seconds"] for r in runs.where("backend = 'cli'").collect()) == [100.0, 150.0]
    assert {r["backend"]: (r["seconds"], r["source"]) for r in E.seconds_per_section(runs).collect()} == {"api": (10.0, "history"), "cli": (125.0, "history"), "codex": (190.0, "estimate"), "demo": (1.0, "estimate")}
    assert len(E.section_seconds(docs, limit=1).where("backend = 'cli'").collect()) == 1


QUESTIONS = '{"questions":[{"number":4,"prompt":"a","slides":[1,"2"],"points":"3"},{"number":4,"prompt":"b","slides":"üç"},{"number":4,"prompt":" "},{"prompt":"no number"},{"number":1,"prompt":"c","topic":null},{"number":"7","prompt":"d","choices":["x","y"]}]}'


def test_bad_questions_are_dropped_and_the_rest_numbered(spark):
    got = X.coerce_questions(spark.createDataFrame([("e", "answer: " + QUESTIONS)], "exam_id string, json string")).orderBy("number").collect()
    assert [(r["number"], r["prompt"], r["slides"], r["points"]) for r in got] == [(1, "a", [1, 2], 3), (2, "d", [], 0)]
    assert got[1]["choices"] == ["x", "y"] and got[1]["topic"] == ""


SECTION = "document_id string, section_index int, title string, markdown string, citations array<string>, slide_first int, slide_last int, error string"


def test_retry_never_worsens(spark):
    old = spark.createDataFrame([("d", 0, "A", "a", [], 1, 2, None), ("d", 1, "B", "", [], 3, 4, "RuntimeError: x"), ("d", 2, "C", "", [], 5, 6, "RuntimeError: y")], SECTION)
    again = spark.createDataFrame([("d", 1, "B", "new", ["l"], 3, 4, None), ("d", 2, "C", "", [], 5, 6, "still")], SECTION)
    got = {r["section_index"]: (r["markdown"], r["error"]) for r in X.merge_retry(old, again).collect()}
    assert got == {0: ("a", None), 1: ("new", None), 2: ("", "RuntimeError: y")}
    facts = X.document_facts(X.merge_retry(old, again)).first()
    assert facts["failed"] == [2] and facts["ok_sections"] == 2
    assert X.retry_mismatch(spark.createDataFrame([("d", [2, 9])], "document_id string, failed array<int>"), old).first()["section_index"] == 9


def test_figures_resolve_and_audit_names_the_rest(spark):
    s = spark.createDataFrame([("d", "b", 0, "see [BOOKFIGURE: 6.5] and [BOOKFIGURE: 99.9] [B: known] [B: invented]", None)], "document_id string, book_id string, section_index int, markdown string, error string")
    figures = spark.createDataFrame([("b", "6.5")], "book_id string, number string")
    found, absent = X.resolve_figures(s, figures)
    assert [r["number"] for r in found.collect()] == ["6.5"] and [r["number"] for r in absent.collect()] == ["99.9"]
    offered = spark.createDataFrame([("d", 0, "known")], "document_id string, section_index int, citation string")
    quoted = spark.createDataFrame([("e", 1, "Explain this."), ("e", 2, "Never asked.")], "exam_id string, number int, modeled_on string")
    exams = spark.createDataFrame([("e", "1. Explain this. 2. More")], "exam_id string, exam_text string")
    audit = X.grounding_audit(s, offered, spark.createDataFrame([("d", "6.5")], "document_id string, number string"), quoted, exams)
    assert sorted((r["problem"], r["value"]) for r in audit.collect()) == [("citation not offered", "invented"), ("quote not in exam", "Never asked."), ("unknown figure", "99.9")]


def test_exam_markdown_keeps_answers_for_the_end(spark):
    exams = spark.createDataFrame([("e", "Bits", "")], "exam_id string, lecture_title string, profile string")
    q = spark.createDataFrame([("e", 1, 10, "First?", ["a", "b"], "A", "Because.", ["L, p. 1"], ""), ("e", 2, 0, "Second?", [], "", "", [], "Old one")], "exam_id string, number int, points int, prompt string, choices array<string>, answer string, solution string, citations array<string>, modeled_on string")
    text = X.exam_markdown(exams, q).first()["markdown"]
    assert text.index("Second?") < text.index("# Answer key") < text.index("**Answer:** A")
    assert "A) a\nB) b" in text and "(10 points)" in text and "**Source question:** Old one" in text and text.count("::: exam") == 1


def test_requests_are_stable_and_say_when_nothing_matches(spark):
    sections = spark.createDataFrame([("d", 0, [(1, "T", "x", True)], 1, 1, "raw", ["T"])], "deck_id string, section_index int, slides array<struct<number:int,title:string,text:string,is_visual:boolean>>, first_slide int, last_slide int, raw_text string, titles array<string>")
    cards = N.topic_cards(sections)
    none = spark.createDataFrame([], "deck_id string, section_index int, chunks array<struct<rank:int,citation:string,text:string>>")
    made = R.section_request(sections, cards, none, extras=("quiz", "unknown")).first()["request"]
    assert R.DEFAULT_WORDING.no_support in made and "Images of slides 1" in made and R.DEFAULT_WORDING.extras["quiz"] in made
    assert made == R.section_request(sections, cards, none, extras=("quiz", "unknown")).first()["request"]


def test_generator_failures_become_rows(spark):
    def fn(texts):
        if any("bad" in t for t in texts):
            raise RuntimeError("refused")
        return [(t.upper(), {"input_tokens": len(t)}) for t in texts]

    got = {r["k"]: r["generated"] for r in N.generate(spark.createDataFrame([(1, "ok"), (2, "bad"), (3, "fine")], "k int, r string").coalesce(1), "r", fn).collect()}
    assert got[1]["text"] == "OK" and got[3]["usage"]["input_tokens"] == 4 and got[2]["error"] == "RuntimeError: refused"


def test_usage_adds_by_field(spark):
    kind = "struct<input_tokens:long,output_tokens:long,cache_creation_tokens:long,cache_read_tokens:long,calls:long>"
    row = spark.createDataFrame([((100, 50, 0, 0, 3), (1, 2, 3, 4, 5))], f"a {kind}, b {kind}").select(usage_add(F.col("a"), F.col("b")).alias("s")).first()["s"]
    assert tuple(row) == (101, 52, 3, 4, 8)


def test_index_is_read_only_when_complete_and_current(spark, tmp_path):
    pages = spark.createDataFrame([("b1", 1, "word " * 100), ("b2", 1, "other " * 100)], "book_id string, page_no int, text string")
    sections = spark.createDataFrame([("b1", 0, "A", 0, 1, 1), ("b2", 0, "B", 0, 1, 1)], "book_id string, ordinal int, title string, level int, page_start int, page_end int")
    path = str(tmp_path / "index")
    assert T.pending_books(pages.select("book_id"), T.manifest(spark, path)).count() == 2
    first = T.load_or_build(spark, path, pages.where("book_id = 'b1'"), sections)
    assert {r["book_id"] for r in first["chunks"].collect()} == {"b1"}
    both = T.load_or_build(spark, path, pages, sections)
    assert {r["book_id"] for r in both["postings"].collect()} == {"b1", "b2"} and T.manifest(spark, path).count() == 2
    assert T.pending_books(pages.select("book_id"), T.manifest(spark, path)).count() == 0
    assert T.pending_books(pages.select("book_id"), T.manifest(spark, path), version="5").count() == 2


def test_pages_are_read_once_for_a_whole_index(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        seen.add(1)
        return text

    pages = spark.createDataFrame([("b", i, f"page {i} " * 100) for i in range(1, 5)], "book_id string, page_no int, text string").withColumn("text", counted.asNondeterministic()("text"))
    sections = spark.createDataFrame([("b", 0, "A", 0, 1, 4)], "book_id string, ordinal int, title string, level int, page_start int, page_end int")
    index = T.load_or_build(spark, str(tmp_path / "index"), pages, sections)
    assert seen.value == 4 and index["chunks"].count() == 1 and set(index) >= {"chunks", "postings", "doc_len", "term_df", "corpus_stats"}


def test_rows_that_are_no_documents_are_rejected(spark):
    rows = spark.createDataFrame([(1, '{"a": 1, "b": [1, 2], "c": {"d": "x"}}'), (2, "not json"), (3, '{"a": "text"}'), (4, None), (5, '{"b": []}'), (6, '{"a": 2, "b": 7}'), (7, "")], "k int, json string")
    good, bad = T.documents_from_json(rows, "a int, b array<int>, c struct<d:string>")
    assert [tuple(r) for r in good.orderBy("a").collect()] == [(None, [], None), (1, [1, 2], ("x",))]
    assert {r["k"] for r in bad.collect()} == {2, 3, 4, 6, 7} and bad.columns == ["k", "json"]
    again, none = T.documents_from_json(T.documents_to_json(good.withColumn("document_id", F.lit(1))), "a int, b array<int>, c struct<d:string>")
    assert again.exceptAll(good).count() == 0 and none.count() == 0


def test_outlines_of_any_depth(spark):
    node = '{"title":"leaf","page_idx":9}'
    for depth in range(8):
        node = f'{{"title":"n{depth}","page_idx":{depth},"children":[{node}]}}'
    flat = T.read_outline(spark.createDataFrame([("b", f"[{node}]"), ("c", None), ("d", "[]")], "book_id string, outline string")).orderBy("ordinal").collect()
    assert [(r["book_id"], r["title"], r["level"]) for r in flat] == [("b", f"n{7 - i}", i) for i in range(8)] + [("b", "leaf", 8)]
    assert T.read_outline(spark.createDataFrame([("c", None)], "book_id string, outline string")).count() == 0


def test_markdown_is_one_table(spark, tmp_path):
    T.write_markdown(spark.createDataFrame([("a", "# A"), ("b", "# B\n")], "document_id string, markdown string"), str(tmp_path / "m"))
    assert [r["markdown"] for r in T.read_markdown(spark, str(tmp_path / "m"), ["b"]).collect()] == ["# B\n"]
    assert not [p for p in (tmp_path / "m").iterdir() if p.is_dir()]


def test_sources(spark, tmp_path):
    (tmp_path / "f.pdf").write_bytes(b"%PDF-1")
    blob = T.read_blobs(spark, str(tmp_path)).first()
    assert blob["name"] == "f.pdf" and blob["size"] == 6 and blob["sha"].startswith(blob["short_key"])
    exams = spark.createDataFrame([("e",), ("none",)], "exam_id string")
    text = T.load_exam_text(spark.createDataFrame([("e", 2, " two "), ("e", 1, "one"), ("e", 3, " ")], "exam_id string, page_no int, text string"), exams)
    assert {r["exam_id"]: r["exam_text"] for r in text.collect()} == {"e": "one\n\ntwo", "none": ""}
    outline = '[{"title":"A","page_idx":0,"children":[{"title":"A1","page_idx":1,"children":[]},{"title":"","page_idx":2}]},{"title":"B","page_idx":5}]'
    flat = T.read_outline(spark.createDataFrame([("b", outline)], "book_id string, outline string")).orderBy("ordinal").collect()
    assert [(r["title"], r["level"], r["page_idx"]) for r in flat] == [("A", 0, 0), ("A1", 1, 1), ("B", 0, 5)]
    good, bad = T.validate_manifest(spark.createDataFrame([("x", "a.pdf", 10), ("x", "../b.pdf", 10), ("y", "c.pdf", 10**9)], "batch_id string, name string, size long"))
    assert [r["name"] for r in good.collect()] == ["a.pdf"] and {r["error"] for r in bad.collect()} == {"unsafe name", "batch too large"}


@pytest.mark.parametrize("broadcast", [True, False])
def test_search_rows_of_deleted_documents_meet_in_small_tasks(spark, monkeypatch, broadcast):
    monkeypatch.setattr(L, "TASK_ROWS", 500, raising=False)
    if not broadcast:
        monkeypatch.setattr(L, "few", lambda df: df, raising=False)
    documents = spark.range(3000).select("id", *[F.concat(F.col("id").cast("string"), F.lit(e)).alias(f"{e}_path") for e in ("pdf", "md", "doc", "html")])
    sections = spark.range(12000).select((F.col("id") % 3000).alias("document_id"), F.col("id").alias("row"))
    kept, rows, paths = L.delete_documents(documents, sections, documents.where("id % 4 = 1").select("id"))
    assert max(r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()) <= 1000
    assert rows.columns == sections.columns and sorted(r["row"] for r in rows.collect()) == [i for i in range(12000) if i % 3000 % 4 != 1]
    assert sorted(r["id"] for r in kept.collect()) == [i for i in range(3000) if i % 4 != 1]
    assert sorted(r["path"] for r in paths.collect()) == sorted(f"{i}{e}" for i in range(1, 3000, 4) for e in ("pdf", "md", "doc", "html"))
