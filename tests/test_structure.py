"""Sections, runs, chunks, decks."""

import random

from pyspark.sql import functions as F

from scholia.operators import chunks as C
from scholia.operators import sections as S


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).orderBy(*columns).collect()]


def pages_of(spark, texts, book="b"):
    return spark.createDataFrame([(book, i + 1, t) for i, t in enumerate(texts)], "book_id string, page_no int, text string")


def test_outline_ranges_end_where_the_next_begins(spark):
    entries = spark.createDataFrame([("b", 0, "One", 0, 0), ("b", 1, "Two", 1, 3), ("b", 2, " ", 0, 4), ("b", 3, "Three", 0, 3)], "book_id string, ordinal int, title string, level int, page_idx int")
    books = spark.createDataFrame([("b", 10)], "book_id string, page_count int")
    assert rows(S.outline_ranges(entries, books), "ordinal", "title", "page_start", "page_end") == [(0, "One", 1, 3), (1, "Two", 4, 4), (2, "Three", 4, 9)]


def test_heading_ranges_and_fallback(spark):
    pages = pages_of(spark, ["1 First Chapter\nx", "text", "1.1 Second Part\ny", "z"])
    assert rows(S.heading_ranges(pages), "title", "level", "page_start", "page_end") == [("1 First Chapter", 0, 1, 2), ("1.1 Second Part", 1, 3, 3)]
    none = spark.createDataFrame([], "book_id string, ordinal int, title string, level int, page_idx int")
    assert S.book_sections(none, pages).count() == 2


def sections_of(spark, *parts):
    return spark.createDataFrame([("b", i, *p) for i, p in enumerate(parts)], "book_id string, ordinal int, title string, level int, page_start int, page_end int")


def test_deepest_section_wins(spark):
    m = S.page_section_map(sections_of(spark, ("Chapter", 0, 1, 5), ("Part", 1, 2, 3), ("Other", 1, 3, 3)))
    assert rows(m, "page_no", "title") == [(1, "Chapter"), (2, "Part"), (3, "Other"), (4, "Chapter"), (5, "Chapter")]


def test_chunks_stay_in_their_section(spark):
    pages = pages_of(spark, ["alpha beta " * 200] * 3 + ["gamma delta " * 200] * 3)
    chunks = C.chunk_pages(pages, sections_of(spark, ("A", 0, 1, 3), ("B", 0, 4, 6)), target_tokens=200)
    found = chunks.collect()
    assert found and {r["section_title"] for r in found} == {"A", "B"}
    for r in found:
        assert r["page_end"] <= 3 if r["section_title"] == "A" else r["page_start"] >= 4
        assert ("gamma" in r["text"]) == (r["section_title"] == "B")
    assert sorted(r["chunk_id"] for r in found) == [f"c{i:05d}" for i in range(len(found))]


def test_front_and_back_matter_give_no_chunks(spark):
    pages = pages_of(spark, ["word " * 200] * 6)
    chunks = C.chunk_pages(pages, sections_of(spark, ("Contents", 0, 1, 2), ("Information Storage", 0, 3, 4), ("Index", 0, 5, 6)), target_tokens=200)
    assert {r["section_title"] for r in chunks.collect()} == {"Information Storage"}


def test_blank_pages_and_tables_without_rows(spark):
    pages = pages_of(spark, ["", None, "word " * 100, "", ""])
    last = C.chunk_pages(pages, sections_of(spark, ("A", 0, 1, 5))).collect()
    assert [(r["page_start"], r["page_end"]) for r in last] == [(3, 5)]
    assert C.chunk_pages(pages.limit(0), sections_of(spark, ("A", 0, 1, 5))).count() == 0


def sequential(texts, target, overlap):
    """A plain reading of the rule for one run: pages are added until the target is reached, then a chunk is cut and its tail carried on."""
    out, held, size, start = [], [], 0, 1
    for page, text in enumerate(texts, 1):
        start = page if size == 0 else start
        held, size = [*held, text], size + len(text)
        if size >= target:
            joined = "\n".join(held).strip()
            if len(joined) >= 200:
                out.append((joined, start, page))
                tail = joined[-overlap:] if overlap else ""
                held, size, start = [tail] if tail else [], len(tail), page
            else:
                held, size = [], 0
    joined = "\n".join(held).strip()
    if size and len(joined) >= 200:
        out.append((joined, start, len(texts)))
    return out


def packed(spark, runs, target, overlap, drop=False):
    """Chunks of runs of page texts by pack_run."""
    df = spark.createDataFrame([(i, [(n, t) for n, t in enumerate(texts, 1)], len(texts)) for i, texts in enumerate(runs)], "i int, run array<struct<page_no:int,text:string>>, last int")
    found = df.select("i", C.pack_run(F.col("run"), F.col("last"), target, overlap, drop).alias("c")).collect()
    return [[tuple(c) for c in r["c"]] for r in sorted(found)]


def test_packing_equals_sequential_reading(spark):
    rng = random.Random(1)
    runs = [["".join(rng.choices("abcdef", k=rng.randint(1, 900))) for _ in range(rng.randint(1, 12))] for _ in range(200)]
    for overlap in (150, 0):
        assert packed(spark, runs, 1000, overlap) == [sequential(texts, 1000, overlap) for texts in runs]


def test_tail_only_chunks_can_be_dropped(spark):
    assert len(packed(spark, [["x" * 1200]], 1000, 300)[0]) == 2
    assert len(packed(spark, [["x" * 1200]], 1000, 300, True)[0]) == 1


def test_scanned_books(spark):
    assert rows(C.looks_scanned(pages_of(spark, ["a" * 500] * 80)), "scanned") == [(False,)]
    assert rows(C.looks_scanned(pages_of(spark, ["a"] * 80)), "scanned") == [(True,)]


def deck(spark, slides, name="d"):
    return spark.createDataFrame([(name, i + 1, t, x, False) for i, (t, x) in enumerate(slides)], "deck_id string, number int, title string, text string, is_visual boolean")


AGENDA = "Topics of today and all the ones that are still to come"


def test_repeated_agenda_marks_dividers(spark):
    d = S.mark_dividers(deck(spark, [("Intro", "a"), ("x", AGENDA), ("One", "b"), ("y", AGENDA), ("Two", "c")]))
    assert rows(d.where("is_divider"), "number") == [(2,), (4,)]
    t = S.mark_dividers(deck(spark, [("Today: bits", "a"), ("Planning", "b"), ("plan: x", "c"), ("Outline", "d")]))
    assert rows(t.where("is_divider"), "number") == [(1,), (3,)]


def ranges(sectioned):
    return rows(sectioned.groupBy("section_index").agg(F.min("number").alias("a"), F.max("number").alias("z")), "section_index", "a", "z")


def test_tiny_first_section_joins_the_next(spark):
    built = S.build_sections(S.mark_dividers(deck(spark, [("Intro", "a"), ("x", AGENDA), ("One", "b"), ("More", "b2"), ("y", AGENDA), ("Two", "c"), ("Last", "d")])))
    assert ranges(built) == [(0, 1, 1), (1, 3, 4), (2, 6, 7)]
    merged = S.merge_tiny(built)
    assert ranges(merged) == [(0, 1, 4), (1, 6, 7)]
    assert {r["agenda_context"] for r in merged.collect()} == {AGENDA}


def plain_merge(sizes, least=2):
    out = []
    for n in sizes:
        if out and (n < least or out[-1] < least):
            out[-1] += n
        else:
            out.append(n)
    return out


def test_merge_equals_sequential_merging(spark):
    rng = random.Random(4)
    decks = {f"d{i}": [rng.randint(1, 4) for _ in range(rng.randint(1, 7))] for i in range(40)}
    data = [(name, s, k + 1, f"t{k}", "") for name, sizes in decks.items() for k, s in enumerate(j for j, n in enumerate(sizes) for _ in range(n))]
    df = spark.createDataFrame(data, "deck_id string, section_index int, number int, title string, agenda_context string")
    got = {}
    for r in S.merge_tiny(df).groupBy("deck_id", "section_index").count().orderBy("section_index").collect():
        got.setdefault(r["deck_id"], []).append(r["count"])
    assert got == {name: plain_merge(sizes) for name, sizes in decks.items()}


def test_split_is_balanced(spark):
    for n, most, want in ((16, 8, [8, 8]), (10, 4, [4, 4, 2]), (4, 8, [4]), (9, 0, [9])):
        d = deck(spark, [("t", f"s{i}") for i in range(n)]).withColumn("section_index", F.lit(0)).withColumn("agenda_context", F.lit(""))
        parts = S.split_large(d, most).groupBy("section_index").count().orderBy("section_index")
        assert [r["count"] for r in parts.collect()] == want


def test_long_deck_without_agenda_falls_back_to_blocks(spark):
    sectioned = S.section_deck(deck(spark, [(f"t{i}", f"s{i}") for i in range(14)]))
    assert ranges(sectioned) == [(0, 1, 6), (1, 7, 12), (2, 13, 14)]
    whole = S.deck_sections(sectioned).orderBy("section_index").first()
    assert whole["raw_text"].startswith("--- Slide 1: t0 ---\ns0\n\n--- Slide 2") and whole["last_slide"] == 6
    facts = S.inspect_deck(sectioned, deck(spark, [("t", "x")] * 14)).first()
    assert (facts["slides"], facts["sections"], facts["visual_slides"]) == (14, 3, 0)


def plain_deck(slides):
    """{number: (section_index, agenda)} of a deck's (title, text) by reading it in order."""
    bodies = [x.strip() for _, x in slides]
    blocks, agenda, fresh = [], "", True
    for number, ((title, text), body) in enumerate(zip(slides, bodies, strict=True), 1):
        if title.startswith("Today:") or (len(body) > 40 and bodies.count(body) > 1):
            agenda, fresh = text, True
            continue
        if fresh:
            blocks.append((agenda, []))
        blocks[-1][1].append(number)
        fresh = False
    if len(slides) > 10 and len(blocks) <= 1:
        content = [n for _, block in blocks for n in block]
        blocks = [("", content[i : i + 6]) for i in range(0, len(content), 6)]
    merged = []
    for i, (agenda, block) in enumerate(blocks):
        if merged and (len(block) < 2 or len(merged[-1][1]) < 2):
            kept = agenda if i == 1 and len(block) >= 2 and merged[0][0] == "" else merged[-1][0]
            merged[-1] = (kept, merged[-1][1] + block)
        else:
            merged.append((agenda, block))
    parts = []
    for agenda, block in merged:
        size = -(-len(block) // -(-len(block) // 8))
        parts += [(agenda, block[i : i + size]) for i in range(0, len(block), size)]
    return {n: (i, agenda) for i, (agenda, block) in enumerate(parts) for n in block}


def test_decks_equal_sequential_sectioning(spark):
    rng = random.Random(5)
    decks = {f"d{i}": [(f"t{k}" if rng.random() > rate else "Today: next", rng.choice([f"s{k}", f"s{k}", AGENDA, f" {AGENDA}\n", f"{k} {AGENDA}"]) if rng.random() < 2 * rate else f"s{k}") for k in range(rng.randint(1, 40))] for i in range(60) for rate in [rng.choice([0, 0.05, 0.2, 0.6])]}
    df = spark.createDataFrame([(name, k, t, x, False) for name, slides in decks.items() for k, (t, x) in enumerate(slides, 1)], "deck_id string, number int, title string, text string, is_visual boolean")
    got = {}
    for r in S.section_deck(df).collect():
        got.setdefault(r["deck_id"], {})[r["number"]] = (r["section_index"], r["agenda_context"])
    assert got == {name: want for name, slides in decks.items() if (want := plain_deck(slides))}


def test_slides_are_read_and_moved_once(spark, tmp_path):
    deck(spark, [(f"t{i}", f"s{i}") for i in range(14)]).write.parquet(f"{tmp_path}/slides")
    plan = S.deck_sections(S.section_deck(spark.read.parquet(f"{tmp_path}/slides")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
