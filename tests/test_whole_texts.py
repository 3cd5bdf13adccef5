"""Decks are made from whole texts: twins in Python on small tables of long pages and long first lines."""

import pytest

from scholia.queries import estimates, roles, structure

START = "The same opening words stand at the head of every page of this book. " * 4


@pytest.fixture
def long_pages(spark, tmp_path):
    """One book of 14 pages that begin alike; page 5 is an agenda by its title, pages 3 and 8 are equal, the others differ at their end only."""
    texts = {n: START + ("again" if n in (3, 8) else f"end {n} " * n) for n in range(1, 15)}
    spark.createDataFrame([(n, "s", t) for n, t in texts.items()], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path), texts


def test_books_are_sectioned_by_their_whole_pages(spark, long_pages):
    sf_dir, texts = long_pages
    want, section, agenda = [], -1, ""
    opened = True
    for n, text in sorted(texts.items()):
        if n % 9 == 5 or list(texts.values()).count(text) > 1:
            agenda, opened = text, True
            continue
        section, opened = section + opened, False
        want.append((n, section, len(agenda)))
    rows = structure.build_sections(spark, sf_dir).collect()
    assert sorted((r["number"], r["section_index"], r["agenda_chars"]) for r in rows) == want
    merged = structure.merge_tiny(spark, sf_dir).collect()
    assert sorted(r["number"] for r in merged) == [w[0] for w in want] and {r["agenda_chars"] for r in merged} <= {0, *map(len, texts.values())}
    assert sorted(r["number"] for r in structure.split_large(spark, sf_dir).collect()) == [w[0] for w in want]
    decks = structure.section_decks(spark, sf_dir).collect()
    assert sum(r["n_slides"] for r in decks) == len(want) and sum(r["raw_chars"] for r in decks) > sum(len(texts[n]) for n, _, _ in want)


def test_no_character_of_a_turn_is_lost(spark, tmp_path):
    turns = {0: "first line " * 20, 1: "short\n" + "body\nline " * 9, 2: "x" * 200 + "\n" + "y" * 200, 3: "\nno title", 4: None}
    spark.createDataFrame([(7, n, t) for n, t in turns.items()], "conv_id long, turn int, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["number"] - 1: (r["title"], r["text"]) for r in roles.slides(spark, str(tmp_path)).collect()}
    assert got == {n: tuple((t or "").partition("\n")[::2]) for n, t in turns.items()}
    context = estimates.request_assembly(spark, str(tmp_path)).first()["context"]
    assert all(line in context for t in turns.values() for line in (t or "").split("\n"))
