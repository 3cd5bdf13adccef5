"""BM25 search, ranges, figures, prefix search with snippets."""

import math
import re
from collections import Counter

from pyspark.sql import functions as F

from scholia.operators import blockmax as X
from scholia.operators import index as I
from scholia.operators import search as S

CHUNKS = [
    ("b", "c1", "Two's complement is the standard signed integer representation.", "Integer Representations", 96, 98),
    ("b", "c2", "Little endian stores the least significant byte at the lowest address.", "Information Storage", 70, 72),
    ("b", "c3", "Floating point uses IEEE 754 encoding with sign, exponent and fraction.", "Floating Point", 140, 142),
]


def index_of(spark, chunks=CHUNKS):
    return I.build_bm25_index(spark.createDataFrame(chunks, "book_id string, chunk_id string, text string, section_title string, page_start int, page_end int"))


def queries(spark, *texts):
    return spark.createDataFrame([(i, "b", t) for i, t in enumerate(texts)], "query_id long, book_id string, text string")


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append(r["chunk_id"])
    return out


def test_best_chunk_first_and_empty_queries(spark):
    got = ids(S.bm25_search(index_of(spark), queries(spark, "two's complement signed integer", "", "!!! ???", "((")))
    assert got[0][0] == "c1" and set(got) == {0}


def test_page_range_filters_but_keeps_statistics(spark):
    q = queries(spark, "byte address endian")
    ranges = spark.createDataFrame([(0, 60, 80)], "query_id long, lo int, hi int")
    inside = S.bm25_search(index_of(spark), q, page_ranges=ranges)
    assert ids(inside) == {0: ["c2"]}
    free = S.bm25_search(index_of(spark), q).where("chunk_id = 'c2'").first()["score"]
    assert inside.first()["score"] == free
    far = spark.createDataFrame([(0, 200, 300)], "query_id long, lo int, hi int")
    assert S.bm25_search(index_of(spark), q, page_ranges=far).count() == 0


def test_retrieve_falls_back_only_without_hits(spark):
    q = queries(spark, "byte address", "byte address", "byte point", "byte point")
    align = spark.createDataFrame([(0, 200, 300, "high"), (1, 60, 80, "high"), (2, 60, 80, "medium"), (3, 0, 0, "low")], "query_id long, page_start int, page_end int, confidence string")
    got = ids(S.retrieve(index_of(spark), q, align))
    assert got[0] == ["c2"] and got[1] == ["c2"] and got[2] == ["c2"] and set(got[3]) == {"c2", "c3"}


def plain_scores(chunks, query):
    docs = {c[1]: re.findall(r"[^\W_]+", f"{c[2]} {c[3]}".lower()) for c in chunks}
    mean = sum(map(len, docs.values())) / len(docs)
    out = Counter()
    for t in dict.fromkeys(w for w in re.sub(r"[^\w\s]", " ", query).lower().split() if len(w) > 1):
        df = sum(t in d for d in docs.values())
        idf = max(math.log((len(docs) - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
        for name, d in docs.items():
            tf = d.count(t)
            if tf:
                out[name] += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
    return out


def test_scores_equal_the_formula(spark):
    chunks = CHUNKS + [("b", f"x{i}", f"byte integer filler{i} point point", "Storage", i, i) for i in range(5)]
    query = "integer byte point representation"
    got = {r["chunk_id"]: r["score"] for r in S.score_queries(index_of(spark, chunks), queries(spark, query)).collect()}
    want = plain_scores(chunks, query)
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_underscore_makes_a_phrase(spark):
    chunks = [("b", "p", "the foo bar thing", "", 1, 1), ("b", "q", "bar then foo", "", 2, 2)]
    assert ids(S.bm25_search(index_of(spark, chunks), queries(spark, "foo_bar"))) == {0: ["p"]}


def test_restricted_index_scores_alike(spark):
    q = queries(spark, "byte address integer")
    whole = S.score_queries(index_of(spark), q)
    terms = q.select(F.explode(F.split("text", " ")).alias("term"))
    chunks = index_of(spark)["chunks"]
    part = S.score_queries(I.build_bm25_index(chunks, terms=terms), q)
    assert sorted(whole.collect()) == sorted(part.collect())


def test_collect_chunks_dedups_and_caps(spark):
    cards = spark.createDataFrame([("d", i, "b", t) for i, t in enumerate(["byte endian", "byte integer", "floating byte"])], "deck_id string, section_index int, book_id string, text string")
    found = S.collect_chunks(index_of(spark), cards, per_section=2, cap=2).orderBy("position").collect()
    assert [r["position"] for r in found] == [1, 2] and len({r["chunk_id"] for r in found}) == 2 and found[0]["chunk_id"] == "c2"


def test_figures_by_area_on_pages_of_hits(spark):
    schema = "book_id string, number string, caption string, page int, bbox struct<x0 double, top double, x1 double, bottom double>"
    figures = spark.createDataFrame([("b", "1.1", "small", 42, (0.0, 0.0, 60.0, 40.0)), ("b", "1.2", "large", 43, (0.0, 0.0, 400.0, 300.0)), ("b", "6.5", "far", 613, (0.0, 0.0, 99.0, 99.0))], schema)
    hits = spark.createDataFrame([(1, "b", 1, 40, 45), (2, "b", 1, 700, 800)], "query_id long, book_id string, rank int, page_start int, page_end int")
    found = S.retrieve_figures(figures, hits).orderBy("figure_rank").collect()
    assert [r["number"] for r in found] == ["1.2", "1.1"]


def test_section_search_needs_all_terms_with_a_prefix(spark, tmp_path):
    sections = spark.createDataFrame(
        [("d1", "k", 0, "Integers", "Two's complement numbers are signed and the complement is found by adding one to the inverted bits of a number"), ("d1", "k", 1, "Floats", "Signed zero exists"), ("d2", "other", 0, "Integers", "complement of two signed")],
        "document_id string, course_id string, section int, heading string, body string",
    )
    documents = spark.createDataFrame([("d1", "Doc one", "note"), ("d2", "Doc two", "note")], "id string, title string, kind string")
    q = spark.createDataFrame([(1, "k", "signed compl"), (2, "k", "signed missing"), (3, "k", "!!!"), (4, "k", "zero")], "query_id long, course_id string, text string")
    X.write_search_index(sections.withColumn("scope", F.lit("")), str(tmp_path / "i"), ["document_id", "section"], ["heading", "body"], ["course_id"])
    found = S.search_sections(X.read_search_index(spark, str(tmp_path / "i")), sections, documents, q).orderBy("query_id").collect()
    assert [(r["query_id"], r["document_id"], r["section"]) for r in found] == [(1, "d1", 0), (4, "d1", 1)]
    assert "<mark>complement</mark>" in found[0]["snippet"] and "<mark>signed</mark>" in found[0]["snippet"] and found[0]["snippet"].endswith("…")
    assert found[0]["document_title"] == "Doc one"


def test_practice_exam_needs_a_paper_and_questions(spark):
    from scholia.operators import sections as X
    from scholia.plans import notes as N

    slides = spark.createDataFrame([(d, n, f"byte order {n}", "little endian address", False) for d in ("good", "mute", "bare") for n in (1, 2, 3)], "deck_id string, number int, title string, text string, is_visual boolean")
    marked = X.mark_dividers(slides)
    decks = spark.createDataFrame([(d, "b") for d in ("good", "mute", "bare")], "deck_id string, book_id string")
    titles = decks.select("deck_id", F.col("deck_id").alias("title"))
    exams = spark.createDataFrame([("good", "1. What is a byte?"), ("mute", "1. What?"), ("bare", " ")], "deck_id string, exam_text string")
    answer = lambda texts: [('{"questions":[{"number":9,"prompt":"Why?"}]}' if "# COURSE: good" in t and "[B: " in t else "none", {}) for t in texts]
    chunks = index_of(spark)["chunks"].withColumn("citation", F.lit("Storage, p. 70"))
    questions, status = N.practice_exam(slides.withColumn("is_divider", F.lit(False)), X.deck_sections(X.section_deck(slides)), titles, decks, exams, I.build_bm25_index(chunks), answer)
    assert marked.count() == 9 and [(r["deck_id"], r["number"], r["prompt"]) for r in questions.collect()] == [("good", 1, "Why?")]
    assert {r["deck_id"]: (r["status"], r["error"]) for r in status.collect()} == {"good": ("ok", None), "mute": ("failed", "no question was produced"), "bare": ("failed", "the exam has no text")}


def test_chunks_of_a_deck_come_from_any_hits(spark):
    """A deck's chunks are taken from hits, wherever those were scored: each once, in section order, up to the cap."""
    hits = spark.createDataFrame([("d", 1, 1, "b", 7), ("d", 0, 2, "b", 7), ("d", 0, 1, "b", 9), ("d", 2, 1, "b", 3), ("e", 0, 1, "b", 7)], "deck_id string, section_index int, rank int, book_id string, chunk_id int")
    got = sorted((r["deck_id"], r["position"], r["chunk_id"]) for r in S.first_chunks(hits, 2).collect())
    assert got == [("d", 1, 9), ("d", 2, 7), ("e", 1, 7)]


def test_requests_from_a_stored_index_equal_those_from_memory(spark, tmp_path):
    from scholia.plans import notes as N

    rows = [("k", f"c{i:03d}", f"heap word{i % 7} " + "stack_frame " * (i % 3) + "tree " * (i % 5), f"Part {i % 4}", i, i + 1) for i in range(60)]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id string, text string, section_title string, page_start int, page_end int").withColumn("citation", F.col("chunk_id"))
    X.write_search_index(chunks.withColumnRenamed("book_id", "scope").withColumn("part", F.col("section_title")), str(tmp_path / "i"), ["chunk_id"], ["text", "section_title"], ["part", "page_start", "page_end"])
    stored = X.read_search_index(spark, str(tmp_path / "i"))
    stored |= {"rows": stored["rows"].withColumnRenamed("part", "section_title"), "chunks": chunks}
    slide = [(1, "word3 tree", "t", False), (2, "stack_frame", "t", False), (3, "nothing here", "t", False)]
    sections = spark.createDataFrame([(1, i, "", [s], s[0], s[0], "raw", [s[1]]) for i, s in enumerate(slide)], "deck_id long, section_index int, agenda_context string, slides array<struct<number:int,title:string,text:string,is_visual:boolean>>, first_slide int, last_slide int, raw_text string, titles array<string>")
    decks = spark.createDataFrame([(1, "k")], "deck_id long, book_id string")
    got, want = (N.prepare_requests(sections, decks, index, limit=3).orderBy("section_index").collect() for index in (stored, I.build_bm25_index(chunks)))
    assert got == want and [len(r["chunks"] or []) for r in got] == [3, 3, 0]


def test_postings_are_made_without_moving_tokens(spark, monkeypatch):
    import pyarrow as pa

    rows = spark.createDataFrame([(1, "a b a", "b c"), (2, None, ""), (3, "c_a c", None)], "id long, text string, title string")
    made = I.postings_of(rows, ["id"], "text", "title")
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = sorted(tuple(r) for r in made.collect())
    assert got == [(1, "a", 2, [0, 2]), (1, "b", 2, [1, 4]), (1, "c", 1, [5]), (3, "a", 1, [1]), (3, "c", 2, [0, 2])]
    named = I.postings_of(rows, ["id"], "text", "title", terms=spark.createDataFrame([("c",), ("c",)], "term string"))
    assert sorted(tuple(r) for r in named.collect()) == [(1, "c", 1, [5]), (3, "c", 2, [0, 2])]
    monkeypatch.setattr(I, "GROUPED_TOKENS", 3)
    batch = pa.RecordBatch.from_pylist([{"id": 1, "tokens": ["x", None, "y", "x"]}, {"id": 2, "tokens": None}, {"id": 3, "tokens": ["y"]}, {"id": 4, "tokens": ["x", "z", "x"]}], schema=pa.schema([("id", pa.int64()), ("tokens", pa.list_(pa.string()))]))
    parts = list(I._row_postings(iter([batch])))
    assert len(parts) > 1 and [tuple(r.values()) for part in parts for r in part.to_pylist()] == [(1, "x", 2, [0, 3]), (1, "y", 1, [2]), (3, "y", 1, [0]), (4, "x", 2, [0, 2]), (4, "z", 1, [1])]
