"""Text columns: what must be cut and what must survive, terms, markers."""

import re

import pytest
from pyspark.sql import functions as F

from scholia.functions import scalars as S
from scholia.functions import text as T


def one(spark, column, **values):
    kinds = {str: "string", int: "int", float: "double", bool: "boolean"}
    schema = ", ".join(f"{k} " + ("array<string>" if isinstance(v, list) else "string" if v is None else kinds[type(v)]) for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("out")).first()["out"]


@pytest.mark.parametrize(
    "given,kept",
    [
        ("start 35 105 110 99 108 117 100 101 32 60 115 116 100 105 111 end", "start end"),
        ("#includeSP <stdio intSP main voidSP (x) charSP 'c", "#include <stdio int main void (x) char 'c"),
        ("a SP SP SP SP b", "a b"),
        ("2.1 Information Storage 70 2.2 Integer Representations 95 2.3 Integer Arithmetic 120 2.4 Floating Point 144 rest", "rest"),
        ("int main() { return 0; }", "int main() { return 0; }"),
        ("0 4 8 16 24 32 40 48", "0 4 8 16 24 32 40 48"),
        ("the SP register", "the SP register"),
        ("see 2.1 Information Storage 70 for more", "see 2.1 Information Storage 70 for more"),
        ("intSP main voidSP (x", "intSP main voidSP (x"),
    ],
)
def test_scrub_cuts_artifacts_alone(spark, given, kept):
    assert one(spark, T.scrub_artifacts(F.col("t")), t=given) == kept


def test_normalize_and_tokens(spark):
    assert one(spark, T.normalize_text(F.col("t")), t="  a \t b\r\n\n\n\nc\u00a0\n") == "a b\n\nc"
    assert one(spark, T.estimate_tokens(F.col("t")), t="a" * 350) == 100
    assert one(spark, T.estimate_tokens(F.col("t")), t="") == 0


def test_content_sections(spark):
    rows = spark.createDataFrame([("Contents", False), ("index", False), ("About the Authors", False), ("List of figures", False), ("Information Storage", True), (None, True), ("Indexing", True)], "t string, want boolean")
    assert rows.where(T.is_content_section(F.col("t")) != F.col("want")).count() == 0


def test_lines_heading_and_fragments(spark):
    assert one(spark, T.clean_lines(F.col("t")), t="Carnegie Mellon\n 12 \r\nreal line\n\nBryant and O'Hallaron\n") == ["real line"]
    assert one(spark, T.split_lines(F.col("t")), t="") == []
    assert one(spark, T.split_lines(F.col("t")), t="a\n\nb\n") == ["a", "", "b"]
    assert one(spark, T.heading(F.col("t")), t="x\n 2.1.3 Information Storage \ny").asDict() == {"title": "2.1.3 Information Storage", "level": 2}
    assert one(spark, T.heading(F.col("t")), t="1\n2\n3\n4\n5\n6\n2.1 Too late") is None
    assert one(spark, T.fragment_ratio(F.col("t")), t=["abc", "long enough", "123456"]) == pytest.approx(2 / 3)
    assert one(spark, T.fragment_ratio(F.col("t")), t=[]) == 0.0


def test_query_terms(spark):
    assert one(spark, T.query_terms_or(F.col("t")), t="Two's complement two's a Signed!") == ["two", "complement", "signed"]
    for empty in ("", "!!! ???", "(("):
        assert one(spark, T.query_terms_or(F.col("t")), t=empty) == []
        assert one(spark, T.query_terms_and_prefix(F.col("t")), t=empty) == []
    assert [tuple(x) for x in one(spark, T.query_terms_and_prefix(F.col("t")), t="Byte order compl")] == [("byte", False), ("order", False), ("compl", True)]
    assert len(one(spark, T.query_terms_or(F.col("t")), t=" ".join(f"w{i}" for i in range(40)))) == 24


def test_labels_and_citations(spark):
    assert one(spark, T.citation_label(F.col("s"), F.col("a"), F.col("b")), s="Floating Point", a=96, b=98) == "Floating Point, p. 96-98"
    assert one(spark, T.citation_label(F.col("s"), F.col("a"), F.col("b")), s="", a=7, b=7) == "p. 7"
    text = "x [B: Part, p. 4] y [K: Old, p. 1-2] z [S: 3, 14] `[S: 9]`\n[FIGURE: slide 6]\n[BOOKFIGURE: 6.5.]"
    refs = one(spark, T.citation_refs(F.col("t")), t=text)
    assert refs["book"] == ["Part, p. 4", "Old, p. 1-2"] and refs["slides"] == [3, 14, 9]
    assert one(spark, T.figure_refs(F.col("t")), t=text) == ["6.5"]
    assert one(spark, T.slide_figure_refs(F.col("t")), t=text) == [6]
    assert "`" not in one(spark, T.untick_markers(F.col("t")), t=text)
    assert one(spark, T.untick_markers(F.col("t")), t="`code` `[S: 1]`") == "`code` [S: 1]"
    chips = one(spark, T.citations_to_chips(F.col("t")), t="a [B: <x> & y] b [S: 1, 2] c")
    assert chips == 'a <span class="cite cite-book" data-src="&lt;x&gt; &amp; y">&lt;x&gt; &amp; y</span> b <span class="cite cite-slide">Slide 1,2</span> c'
    notes = one(spark, T.marker_notes(F.col("t")), t=text)
    assert "[FIGURE" not in notes and "[BOOKFIGURE" not in notes and "Slide 6 image" in notes


def test_names_options_choices(spark):
    assert one(spark, T.safe_name(F.col("t")), t="C:\\a\\b/c.pdf") == "c.pdf"
    assert one(spark, T.stem(F.col("t")), t="x/y/book.v2.pdf") == "book.v2"
    assert one(spark, T.normalize_options(F.col("t")), t=["derin", "quiz"]) == ["deep", "quiz"]
    assert one(spark, T.lettered_choices(F.col("t")), t=list("abcdefghi"))[-2:] == ["H) h", "9) i"]
    assert one(spark, T.tokenize(F.col("t")), t="É foo_bar Ñandú 3x") == ["e", "foo", "bar", "nandu", "3x"]
    assert one(spark, T.html_escape(F.col("t")), t="<a href='x'>&\"") == "&lt;a href=&#x27;x&#x27;&gt;&amp;&quot;"
    assert one(spark, T.escape_snippet(F.col("t")), t="<b> <mark>x</mark>") == "&lt;b&gt; <mark>x</mark>"
    assert one(spark, T.excerpt(F.col("t")), t="a  b\n" * 200) == ("a b " * 200)[:260] + "…"


@pytest.mark.parametrize("key,safe", [("a/b.pdf", True), ("", False), ("/a", False), ("C:\\x", False), ("a/../b", False), ("./a", False), (None, False), ("a\\..\\b", False)])
def test_safe_keys(spark, key, safe):
    assert one(spark, S.safe_key(F.col("k")), k=key) is safe


def test_costs_and_sizes(spark):
    args = {"i": 1_000_000, "o": 0, "w": 0, "r": 0}
    cost = S.token_cost(F.col("i"), F.col("o"), F.col("w"), F.col("r"), F.lit(3.0), F.lit(15.0))
    assert one(spark, cost, **args) == pytest.approx(3.0)
    assert one(spark, cost, **(args | {"i": 0, "w": 1_000_000})) == pytest.approx(3.75)
    assert one(spark, cost, **(args | {"i": 0, "r": 1_000_000})) == pytest.approx(0.30)
    assert one(spark, cost, **(args | {"i": 0, "o": 1_000_000})) == pytest.approx(15.0)
    assert one(spark, S.image_tokens(F.col("w"), F.col("h")), w=1100, h=825) == 1210
    assert one(spark, S.render_scale(F.col("w"), F.col("h")), w=100, h=50) == 3.0
    assert one(spark, S.crop_scale(F.col("w"), F.col("h")), w=2000, h=50) == 1.0


def test_salvaged_json(spark):
    schema = "questions array<string>"
    assert one(spark, S.salvage_json(F.col("t"), schema), t='note {"questions":["a"]} end')["questions"] == ["a"]
    assert one(spark, S.salvage_json(F.col("t"), schema), t='{"questions":["a"]}')["questions"] == ["a"]
    assert one(spark, S.salvage_json(F.col("t"), schema), t="nothing here") is None


def test_usage_of_logs(spark):
    from scholia.operators.estimate import usage_of_logs

    deep = '{"a": [0, {"b": {"c": {"d": {"input_tokens": 5, "output_tokens": 2, "cached_input_tokens": 1}}}}]}'
    rows = [
        (1, 1, deep), (2, 1, '{"usage": {"input_tokens": 1, "output_tokens": 1, "sub": {"input_tokens": 8, "output_tokens": 9, "cache_read_input_tokens": 3}}, "other": 1}'), (3, 1, deep), (3, 2, "{broken"), (3, 3, '{"type": "x"}'),
        (4, 1, '{"z": {"input_tokens": 1, "output_tokens": 1}, "a": {"input_tokens": 2, "output_tokens": 2, "cached_input_tokens": null, "cache_read_input_tokens": 4}}'), (5, 1, None), (6, 1, '"{\\"input_tokens\\":1,\\"output_tokens\\":1}"'),
        (7, 2, '{"input_tokens": 1, "output_tokens": 1}'), (7, 1, '{"input_tokens": 9, "output_tokens": 9}'),
    ]
    got = {r["log_id"]: tuple(r)[1:] for r in usage_of_logs(spark.createDataFrame(rows, "log_id int, line_no int, line string")).collect()}
    assert got == {1: (5, 2, 1, 1), 2: (8, 9, 3, 1), 3: (5, 2, 1, 1), 4: (2, 2, 0, 1), 5: (0, 0, 0, 1), 6: (0, 0, 0, 1), 7: (1, 1, 0, 1)}
    assert usage_of_logs(spark.createDataFrame([], "log_id int, line_no int, line string")).count() == 0



def test_python_strip_agrees(spark):
    samples = ["\u2003a b\u00a0", "\n\t", "x", " \x1c y \u3000"]
    for s in samples:
        got = one(spark, T.py_strip(F.col("t")), t=s)
        assert got == re.sub(r"^\s+|\s+$", "", s)


def test_terms_are_made_once(spark):
    """A text's words are cut once, not again for each term."""
    rows = spark.createDataFrame([("One two one THREE",), ("",), ("a",)], "text string").select(T.query_terms_and_prefix(F.col("text")).alias("t"))
    assert rows._jdf.queryExecution().analyzed().toString().count("regexp_replace") == 1
    assert [[tuple(x) for x in r["t"]] for r in rows.collect()] == [[("one", False), ("two", False), ("three", True)], [], []]


def test_pages_are_cleaned_once(spark):
    """A filter on cleaned text stands above its making, so that texts aren't cleaned for the filter too; cuts are those of the patterns alone."""
    from scholia.operators.chunks import clean_pages

    texts = ["1.1 Intro 12 1.2 More 13 1.3 Else 14 1.4 Last 15 end", "x " + "12 " * 14 + "y", "a SP SP b", "int,SP xSP ySP z", "plain 3.5 7 8", "٣ " * 13 + "٣", None, " \n "]
    pages = spark.createDataFrame([("b", i, t) for i, t in enumerate(texts)], "book_id string, page_no int, text string")
    got = clean_pages(pages).where("text != ''")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("{11,}") == 1
    assert {r["page_no"]: r["text"] for r in got.collect()} == {0: "end", 1: "x y", 2: "a b", 3: "int, x y z", 4: "plain 3.5 7 8"}
