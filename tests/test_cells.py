"""Many queries that meet postings in cells, against exhaustive scoring."""

import random

import pytest
from pyspark.sql import functions as F

from scholia.operators import blockmax as X
from scholia.operators import cells as C
from scholia.operators import index as I
from scholia.operators import search as S
from scholia.plans import notes as N

WORDS = [f"w{i}" for i in range(30)] + ["alpha", "gamma", "x_y", "é", "éclair", "naïve"]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(11)
    texts = [" ".join(rng.choices(WORDS, weights=[1 / (n + 1) for n in range(len(WORDS))], k=rng.randrange(0, 40))) for _ in range(900)]
    rows = [(f"b{i % 3}", i, t, f"Part {i % 4}", i, i + i % 2) for i, t in enumerate(texts)] + [("b0", 2000 + i, "gamma gamma tie", None, 2000 + i, 2000 + i) for i in range(300)]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id long, text string, section_title string, page_start int, page_end int").cache()
    path = str(tmp_path_factory.mktemp("index"))
    X.write_search_index(chunks.withColumnRenamed("book_id", "scope").withColumn("part", F.col("section_title")), path, ["chunk_id"], ["text", "section_title"], ["part", "page_start", "page_end"])
    index = X.read_search_index(spark, path)
    return chunks, index | {"rows": index["rows"].withColumnRenamed("part", "section_title"), "chunks": chunks}


def cards(spark):
    rng = random.Random(12)
    texts = [" ".join(rng.sample(WORDS, rng.randrange(1, 9))) for _ in range(60)] + ["gamma tie", "x_y w1", "w0", "nothing here", "", "w1_w0 gamma", "é e", None]
    return spark.createDataFrame([(i, f"b{i % 3}", t) for i, t in enumerate(texts)], "query_id long, book_id string, text string")


def scoped(rows):
    return rows.withColumnRenamed("book_id", "scope")


@pytest.mark.parametrize("postings", [500, 1 << 40])
def test_cells_equal_exhaustive_scoring(spark, library, monkeypatch, postings):
    monkeypatch.setattr(C, "CELL_POSTINGS", postings)
    chunks, index = library
    q = cards(spark)
    asked = C.CellSearch(index, scoped(q))
    assert asked.cells > 2
    same = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    want = S.top_hits(S.score_queries(I.build_bm25_index(chunks), q), 4)
    got = asked.top(4).join(index["rows"], "ord")
    assert same(got) == same(want) and got.count() > 200


def test_cells_retrieve_in_ranges(spark, library):
    chunks, index = library
    q = cards(spark)
    ranges = q.select("query_id", (F.col("query_id") * 12).alias("page_start"), (F.col("query_id") * 12 + F.when(F.col("query_id") % 7 == 0, 5000).otherwise(150)).alias("page_end"), F.when(F.col("query_id") % 5 == 0, "low").otherwise("high").alias("confidence"))
    same = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["in_range"], round(r["score"], 5)) for r in df.collect())
    got = C.CellSearch(index, scoped(q)).retrieve(ranges)
    assert same(got) == same(S.retrieve(I.build_bm25_index(chunks), q, ranges)) and {r["in_range"] for r in got.collect()} == {True, False}


def test_alignment_by_cells_equals_one_in_memory(spark, library):
    chunks, index = library
    cards_ = cards(spark).select(F.lit("d").alias("deck_id"), F.col("query_id").cast("int").alias("section_index"), "book_id", F.col("text").alias("query"))
    same = lambda made: sorted(map(str, made.collect()))
    assert same(N.align_to_book(index, cards_)) == same(N.align_to_book(I.build_bm25_index(chunks), cards_))


def test_few_terms_or_many(spark, library, monkeypatch):
    """Named terms that are too many to broadcast leave the postings of all terms; results stay."""
    _, index = library
    same = lambda df: sorted((r["query_id"], r["rank"], r["ord"]) for r in df.collect())
    want = same(C.CellSearch(index, scoped(cards(spark))).top(3))
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert same(C.CellSearch(index, scoped(cards(spark))).top(3)) == want


def test_notes_make_no_pairs_of_cards_and_blocks(spark, library, monkeypatch):
    """Bounds of every card and block grow with cards times documents."""

    def refused(*_):
        raise AssertionError("pairs of cards and blocks")

    monkeypatch.setattr(X.BlockSearch, "__init__", refused)
    slide = "array<struct<number:int,title:string,text:string,is_visual:boolean>>"
    sections = spark.createDataFrame([(1, 0, "", [(1, "gamma tie", "t", False)], 1, 1, "raw", ["gamma tie"])], f"deck_id long, section_index int, agenda_context string, slides {slide}, first_slide int, last_slide int, raw_text string, titles array<string>")
    index = library[1] | {"chunks": library[0].withColumn("citation", F.col("chunk_id").cast("string"))}
    made = N.prepare_requests(sections, spark.createDataFrame([(1, "b0")], "deck_id long, book_id string"), index, limit=3).first()
    assert [c["citation"] for c in made["chunks"]] == ["2000", "2001", "2002"]
