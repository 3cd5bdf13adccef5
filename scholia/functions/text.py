"""Text columns: cleaning, headings, citations, query terms, markers.

Patterns are Java regular expressions; ``(?U)`` makes word and space classes Unicode-aware, as the semantics need.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

CHARS_PER_TOKEN = 3.5

# Patterns whose matches define the results.
NON_CONTENT = r"(?i)^\s*(contents|index|bibliography|preface|about the authors?|copyright|title page|cover|dedication|acknowledg\w*|list of (figures|tables)|references)\b"
INLINE_TOC = r"(?U)(?:\d{1,2}\.\d{1,2}[ ]\S[^\n]{2,90}?[ ]\d{2,4}\s+){4,}"
BYTE_RUN = r"(?U)(?:\b\d{1,3}\b[ ]+){11,}\b\d{1,3}\b"
SPACE_MARK_RUN = r"(?U)(?:\bSP\b[ ]*){2,}"
SPACE_MARK_GLUED = r"""(?U)(?<=[\w,])SP(?=[\s<("'])"""
BOILERPLATE = r"(?i)^(carnegie mellon|bryant and o.?hallaron|computer systems:.*|\d{1,3})$"
AGENDA_TITLE = r"(?iuU)^\s*(today|outline|agenda|roadmap|plan|bugün|i̇çerik)\b[:\s]"
HEADING = r"^\s*(\d+(?:\.\d+){0,2})\s+([A-Z][^\n]{3,80})\s*$"
CITE_BOOK = r"\[(?:B|K):\s*([^\]]+?)\]"
CITE_SLIDE = r"\[S:\s*(\d+(?:\s*,\s*\d+)*)\]"
SLIDE_FIGURE = r"(?imu)^[ \t]*\[(?:FIGURE:\s*slide|ŞEKİL:\s*slayt)\s*(\d+)\s*\][ \t]*$"
BOOK_FIGURE_LINE = r"(?imu)^[ \t]*\[(?:BOOKFIGURE|KŞEKİL):\s*([\d.]+?)\s*\][ \t]*$"
BOOK_FIGURE_REF = r"(?iu)\[(?:BOOKFIGURE|KŞEKİL):\s*([\d.]+?)\s*\]"
TICKED_MARKER = r"(?iu)`(\[(?:B|K|S|BOOKFIGURE|KŞEKİL|FIGURE|ŞEKİL):[^\]`]*\])`"
SPACE = r"[\s\x1c-\x1f]"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
LEGACY_OPTIONS = {"özet": "summary", "standart": "standard", "derin": "deep", "analoji": "analogy", "örnek": "example", "soru": "quiz", "sözlük": "glossary"}


def _accents() -> tuple[str, str]:
    """Lower-case letters that are a letter a-z with one mark, and those letters."""
    parts = {c: unicodedata.decomposition(c).split() for c in map(chr, range(0xC0, 0x1F00)) if c == c.lower()}
    bases = {c: chr(int(p[0], 16)) for c, p in parts.items() if len(p) == 2 and p[0][0] != "<"}
    known = {c: base for c, base in bases.items() if "a" <= base <= "z"}
    return "".join(known), "".join(known.values())


ACCENTED, UNACCENTED = _accents()


def py_strip(c: Column) -> Column:
    """Strip Unicode white space from both ends."""
    return F.regexp_replace(F.regexp_replace(c, f"(?U)^{SPACE}+", ""), f"(?U){SPACE}+$", "")


def split_lines(c: Column) -> Column:
    """Lines without their ends; a final line end doesn't open another line, and an empty text has no lines."""
    lines = F.split(F.regexp_replace(c, f"(?:{LINE_BREAK})\\z", ""), LINE_BREAK)
    return F.when(F.length(c) > 0, lines).otherwise(F.array().cast("array<string>"))


def normalize_text(c: Column) -> Column:
    """Drop carriage returns, squeeze blanks to one and blank lines to one, strip."""
    return py_strip(F.regexp_replace(F.regexp_replace(F.replace(c, F.lit("\r"), F.lit("")), r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a costly value that it names several times: written out, the value would be made again for each."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scrub_artifacts(c: Column) -> Column:
    """Cut inline tables of contents, byte dumps and space marks; glued marks only where a page has three or more.

    A cut is tried where a text holds what any match holds (numbers with a dot or blanks between them, the mark), which is far cheaper to look for.
    """

    def cut(x: Column, holds: Column, pattern: str) -> Column:
        return F.when(holds, F.regexp_replace(x, pattern, " ")).otherwise(x)

    c = named(c, lambda x: cut(x, x.rlike(r"\p{Nd}\.\p{Nd}"), INLINE_TOC))
    c = named(c, lambda x: cut(x, x.rlike(r"\p{Nd} +\p{Nd}"), BYTE_RUN))
    c = named(c, lambda x: cut(x, x.contains("SP"), SPACE_MARK_RUN))
    c = named(c, lambda x: cut(x, x.contains("SP") & (F.regexp_count(x, F.lit(SPACE_MARK_GLUED)) >= 3), SPACE_MARK_GLUED))
    return py_strip(F.regexp_replace(c, r"[ \t]+", " "))


def estimate_tokens(c: Column) -> Column:
    return F.floor(F.length(c) / CHARS_PER_TOKEN).cast("int")


def is_content_section(title: Column) -> Column:
    return ~F.coalesce(title, F.lit("")).rlike(NON_CONTENT)


def clean_lines(c: Column, boilerplate: str = BOILERPLATE) -> Column:
    return F.filter(F.transform(split_lines(c), py_strip), lambda line: (line != "") & ~line.rlike(boilerplate))


def slide_body(lines: Column, title: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != title), "\n")


def fragment_ratio(lines: Column) -> Column:
    """Share of lines of six characters or fewer; 0 for no lines."""
    return F.when(F.size(lines) > 0, F.size(F.filter(lines, lambda line: F.length(line) <= 6)) / F.size(lines)).otherwise(F.lit(0.0))


def heading(text: Column) -> Column:
    """struct(title, level) of the first numbered heading among the first six lines, or null."""
    first = F.get(F.filter(F.slice(split_lines(text), 1, 6), lambda line: line.rlike(HEADING)), F.lit(0))
    number, name = F.regexp_extract(first, HEADING, 1), py_strip(F.regexp_extract(first, HEADING, 2))
    level = (F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))).cast("int")
    return F.when(first.isNotNull(), F.struct(F.concat_ws(" ", number, name).alias("title"), level.alias("level")))


def citation_label(section: Column, page_start: Column, page_end: Column) -> Column:
    pages = F.when(page_start == page_end, F.concat(F.lit("p. "), page_start.cast("string"))).otherwise(F.concat(F.lit("p. "), page_start.cast("string"), F.lit("-"), page_end.cast("string")))
    return F.concat_ws(", ", F.nullif(section, F.lit("")), pages)


def slide_label(number: Column, title: Column) -> Column:
    return F.concat(F.lit("Slide "), number.cast("string"), F.when(title != "", F.concat(F.lit(": "), title)).otherwise(F.lit("")))


def raw_text(slides: Column) -> Column:
    """Text of a section from its array of slides (number, title, text)."""
    return F.array_join(F.transform(slides, lambda s: F.concat(F.lit("--- "), slide_label(s["number"], s["title"]), F.lit(" ---\n"), s["text"])), "\n\n")


def section_titles(slides: Column) -> Column:
    return F.filter(F.transform(slides, lambda s: s["title"]), lambda t: t != "")


def card_query(title: Column, key_terms: Column, gaps: Column) -> Column:
    return F.array_join(F.concat(F.array(title), key_terms, gaps), " ")


def _words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, r"(?U)[^\w\s]", " "), f"(?U){SPACE}+"), lambda w: w != "")


def query_terms_or(c: Column, max_terms: int = 24) -> Column:
    """Terms for recall: longer than one character, lower-cased, first occurrences, at most ``max_terms``."""
    return F.slice(F.array_distinct(F.transform(F.filter(_words(c), lambda w: F.length(w) > 1), F.lower)), 1, max_terms)


def query_terms_and_prefix(c: Column, max_terms: int = 12) -> Column:
    """Terms for precision as array<struct<term, is_prefix>>: all must occur, the last as a prefix. Length is tested after lower-casing."""
    terms = F.slice(F.array_distinct(F.filter(F.transform(_words(c), F.lower), lambda w: F.length(w) > 1)), 1, max_terms)
    # the terms are named first: written out inside the lambda they would be made again for each term
    return F.get(F.transform(F.array(terms), lambda all_terms: F.transform(all_terms, lambda w, i: F.struct(w.alias("term"), (i == F.size(all_terms) - 1).alias("is_prefix")))), F.lit(0))


def is_agenda_title(title: Column) -> Column:
    return F.coalesce(title, F.lit("")).rlike(AGENDA_TITLE)


def figure_refs(c: Column) -> Column:
    """Numbers of all textbook figures that a text asks for, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit(BOOK_FIGURE_REF), F.lit(1)), lambda n: F.btrim(n, F.lit(".")))


def citation_refs(c: Column) -> Column:
    """struct(book array<string>, slides array<int>): all cited labels and slide numbers, in order."""
    book = F.transform(F.regexp_extract_all(c, F.lit(CITE_BOOK), F.lit(1)), py_strip)
    slides = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(CITE_SLIDE), F.lit(1)), lambda x: F.transform(F.split(x, r"\s*,\s*"), lambda n: n.cast("int"))))
    return F.struct(book.alias("book"), slides.alias("slides"))


def slide_figure_refs(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(SLIDE_FIGURE), F.lit(1)), lambda n: n.cast("int"))


def untick_markers(c: Column) -> Column:
    return F.regexp_replace(c, TICKED_MARKER, "$1")


def html_escape(c: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(plain), F.lit(entity))
    return c


def escape_snippet(c: Column) -> Column:
    """Escape all but the highlighting tags."""
    return F.replace(F.replace(html_escape(c), F.lit("&lt;mark&gt;"), F.lit("<mark>")), F.lit("&lt;/mark&gt;"), F.lit("</mark>"))


def citations_to_chips(c: Column) -> Column:
    """Replace citation markers by chips. The text is cut at the markers, so that labels alone are escaped."""

    def chips(text: Column, pattern: str, shown) -> Column:
        labels = F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
        gaps = F.split(text, pattern, -1)
        return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(shown(F.get(labels, i)), F.lit("")))), "")

    def book(label: Column) -> Column:
        escaped = html_escape(py_strip(label))
        return F.concat(F.lit('<span class="cite cite-book" data-src="'), escaped, F.lit('">'), escaped, F.lit("</span>"))

    def slide(numbers: Column) -> Column:
        return F.concat(F.lit('<span class="cite cite-slide">Slide '), html_escape(F.replace(numbers, F.lit(" "), F.lit(""))), F.lit("</span>"))

    return chips(chips(c, CITE_BOOK, book), CITE_SLIDE, slide)


def marker_notes(c: Column) -> Column:
    """Turn figure markers that can't be resolved into visible notes."""
    c = F.regexp_replace(c, SLIDE_FIGURE, '\n<p class="figure-missing">Slide $1 image — could not be inserted because the lecture PDF was not provided.</p>\n')
    return F.regexp_replace(c, BOOK_FIGURE_LINE, '\n<p class="figure-missing">Textbook figure $1 — could not be inserted because the textbook PDF was not provided.</p>\n')


def normalize_option(c: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in LEGACY_OPTIONS.items() for x in pair])
    return F.coalesce(F.element_at(aliases, c), c)


def normalize_options(c: Column) -> Column:
    return F.transform(c, normalize_option)


def safe_name(path: Column) -> Column:
    return F.element_at(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), -1)


def stem(path: Column) -> Column:
    return F.regexp_replace(safe_name(path), r"(?<=.)\.[^.]*$", "")


def excerpt(c: Column, length: int = 260) -> Column:
    squeezed = F.array_join(F.split(py_strip(c), f"(?U){SPACE}+"), " ")
    return F.concat(F.substring(squeezed, 1, length), F.lit("…"))


def lettered_choices(choices: Column) -> Column:
    letters = F.array(*[F.lit(x) for x in "ABCDEFGH"])
    return F.transform(choices, lambda x, i: F.concat(F.coalesce(F.get(letters, i), (i + 1).cast("string")), F.lit(") "), x))


def fold(c: Column) -> Column:
    """Lower-case and take single marks off Latin letters; combining marks go. Texts of one byte a character have none, and skip that."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(F.regexp_replace(F.lower(c), r"\p{M}+", ""), ACCENTED, UNACCENTED))


def tokenize(c: Column) -> Column:
    """Index terms: folded runs of letters and digits; an underscore separates."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def tail(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)
