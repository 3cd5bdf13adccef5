"""Sections of books and decks: outlines, headings, page maps, dividers, grouping of slides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T


def outline_ranges(entries: DataFrame, books: DataFrame) -> DataFrame:
    """Page ranges of outline ``entries`` (book_id, ordinal, title, level, page_idx from 0); ``books`` has book_id and page_count.

    A section ends where the next begins; the last ends a page before the book's end. Untitled or unresolved entries are left out.
    """
    usable = entries.where("trim(title) != '' and page_idx is not null").join(books.select("book_id", "page_count"), "book_id")
    order = Window.partitionBy("book_id").orderBy("page_idx", "ordinal")
    following = F.lead("page_idx", 1).over(order)
    return usable.select(
        "book_id", (F.row_number().over(order) - 1).alias("ordinal"), F.trim("title").alias("title"), F.col("level").cast("int").alias("level"), (F.col("page_idx") + 1).cast("int").alias("page_start"),
        F.greatest(F.col("page_idx") + 1, F.coalesce(following, F.col("page_count") - 1)).cast("int").alias("page_end"),
    )


def heading_ranges(pages: DataFrame) -> DataFrame:
    """Page ranges from numbered headings at the top of ``pages`` (book_id, page_no, text), one for each page."""
    found = pages.select("book_id", "page_no", T.heading(F.coalesce("text", F.lit(""))).alias("h")).where("h is not null")
    entries = found.select("book_id", F.col("page_no").alias("ordinal"), F.col("h.title").alias("title"), F.col("h.level").alias("level"), (F.col("page_no") - 1).alias("page_idx"))
    return outline_ranges(entries, pages.groupBy("book_id").agg(F.max("page_no").alias("page_count")))


def book_sections(entries: DataFrame, pages: DataFrame) -> DataFrame:
    """Outline ranges, or heading ranges for books without an outline."""
    books = pages.groupBy("book_id").agg(F.max("page_no").alias("page_count"))
    outlined = outline_ranges(entries, books)
    rest = pages.join(outlined.select("book_id").distinct(), "book_id", "left_anti")
    return outlined.unionByName(heading_ranges(rest))


def page_section_map(sections: DataFrame) -> DataFrame:
    """(book_id, page_no, title): the deepest section that covers a page; of equal depth the later one."""
    covered = sections.where("page_end >= page_start").select("book_id", "title", "level", "ordinal", F.explode(F.sequence("page_start", "page_end")).alias("page_no"))
    return covered.groupBy("book_id", "page_no").agg(F.max_by("title", F.struct("level", "ordinal")).alias("title"))


def section_runs(pages: DataFrame, page_map: DataFrame) -> DataFrame:
    """Non-blank ``pages`` with their section and the run of equal sections that they belong to.

    A page without a section takes the one of the page before; before any, that of page 1, else none. Runs count from 0 in page order.
    """
    first = page_map.where("page_no = 1").select("book_id", F.col("title").alias("first_title"))
    placed = pages.where("text != ''").join(page_map, ["book_id", "page_no"], "left").join(first, "book_id", "left")
    order = Window.partitionBy("book_id").orderBy("page_no")
    filled = F.coalesce(F.last("title", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "first_title", F.lit(""))
    runs = placed.withColumn("section_title", filled)
    changed = F.coalesce((F.col("section_title") != F.lag("section_title").over(order)).cast("int"), F.lit(0))
    return runs.withColumn("_changed", changed).withColumn("run_id", F.sum("_changed").over(order).cast("int")).drop("title", "first_title", "_changed")


def mark_dividers(slides: DataFrame) -> DataFrame:
    """``slides`` (deck_id, number, title, text, ...) with is_divider: an agenda title, or a body over 40 characters that repeats in the deck.

    Long bodies are compared by their SHA-256, so that no second copy of a text is sorted.
    """
    key = T.named(T.py_strip(F.coalesce("text", F.lit(""))), lambda body: F.when(F.length(body) > 40, F.sha2(body, 256)).otherwise(body))
    repeated = (F.length("_body") > 40) & (F.count("*").over(Window.partitionBy("deck_id", "_body")) >= 2)
    return slides.withColumn("_body", key).withColumn("is_divider", T.is_agenda_title(F.col("title")) | repeated).drop("_body")


def build_sections(slides: DataFrame) -> DataFrame:
    """Content slides with section_index and agenda_context: blocks between dividers, with the text of the last divider before."""
    order = Window.partitionBy("deck_id").orderBy("number")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    marked = slides.withColumn("_gap", F.sum(F.col("is_divider").cast("int")).over(so_far)).withColumn("_agenda", F.last(F.when(F.col("is_divider"), F.col("text")), ignorenulls=True).over(so_far))
    # blocks are counted where the gap changes, in the order that the rows have already
    content = marked.where("not is_divider").withColumn("_opens", F.coalesce((F.col("_gap") != F.lag("_gap").over(order)).cast("int"), F.lit(0)))
    blocks = content.withColumn("section_index", F.sum("_opens").over(so_far).cast("int"))
    return blocks.withColumn("agenda_context", F.coalesce("_agenda", F.lit(""))).drop("_gap", "_agenda", "_opens")


def _block(size: int) -> Column:
    return F.floor((F.row_number().over(Window.partitionBy("deck_id").orderBy("number")) - 1) / size).cast("int")


def fallback_sections(slides: DataFrame, size: int = 6) -> DataFrame:
    """Content slides in blocks of ``size``, without agenda."""
    return slides.where("not is_divider").withColumn("section_index", _block(size)).withColumn("agenda_context", F.lit(""))


def merge_tiny(sectioned: DataFrame, min_slides: int = 2) -> DataFrame:
    """Join sections of fewer than ``min_slides`` slides to the one before; a tiny first section joins the second.

    Sizes of whole groups decide: a section opens a group if it is the first, or large enough, unless only the tiny first one stands before it.
    Everything is windows of a deck in one order, so that slides are neither made nor moved again to learn the sizes.
    """
    deck, section = Window.partitionBy("deck_id"), Window.partitionBy("deck_id", "section_index")
    order = deck.orderBy("section_index", "number")
    sized = sectioned.withColumn("_head", F.row_number().over(section.orderBy("number")) == 1).withColumn("_n", F.count("*").over(section))
    placed = sized.withColumn("_at", F.sum(F.col("_head").cast("int")).over(order) - 1).withColumn("_first", F.first("_n").over(order))
    opens = F.col("_head") & ((F.col("_at") == 0) | ((F.col("_n") >= min_slides) & ~((F.col("_at") == 1) & (F.col("_first") < min_slides))))
    agenda = F.struct(F.col("agenda_context").alias("agenda"))
    grouped = placed.withColumn("_opens", opens).withColumn("_group", (F.sum(F.col("_opens").cast("int")).over(order) - 1).cast("int")).withColumn("_lead", F.last(F.when(F.col("_opens"), agenda), ignorenulls=True).over(order)["agenda"])
    # the first member's agenda, or, where a tiny first section met a large second one and has none, the second's
    second = F.max(F.when(F.col("_head") & (F.col("_at") == 1), F.struct("_n", F.col("agenda_context").alias("agenda")))).over(deck)
    met = grouped.withColumn("_second", second)
    taken = F.when((F.col("_group") == 0) & (F.col("_first") < min_slides) & (F.col("_second")["_n"] >= min_slides) & (F.col("_lead") == ""), F.col("_second")["agenda"]).otherwise(F.col("_lead"))
    return met.withColumns({"agenda_context": taken, "section_index": F.col("_group")}).drop("_head", "_n", "_at", "_first", "_opens", "_group", "_lead", "_second")


def split_large(sectioned: DataFrame, max_slides: int = 8) -> DataFrame:
    """Cut sections of more than ``max_slides`` slides into balanced parts that inherit the agenda; 0 or less turns it off."""
    if max_slides <= 0:
        return sectioned
    section = Window.partitionBy("deck_id", "section_index")
    n, at = F.count("*").over(section), F.row_number().over(section.orderBy("number")) - 1
    sized = sectioned.withColumn("_at", at).withColumn("_n", n).withColumn("_starts", F.col("_at") % F.ceil(F.col("_n") / F.ceil(F.col("_n") / max_slides)) == 0)
    so_far = Window.partitionBy("deck_id").orderBy("section_index", "number").rowsBetween(Window.unboundedPreceding, 0)
    parts = sized.withColumn("_index", (F.sum(F.col("_starts").cast("int")).over(so_far) - 1).cast("int"))
    return parts.drop("section_index", "_n", "_at", "_starts").withColumnRenamed("_index", "section_index")


def section_deck(slides: DataFrame, max_slides: int = 8) -> DataFrame:
    """Slides with dividers marked, sectioned, tiny sections merged and large ones split, as one composition for all decks.

    Decks of more than ten slides with one section or none are cut into blocks of six instead. No step joins: a deck's slides meet once, and each is read once.
    """
    deck = Window.partitionBy("deck_id")
    built = build_sections(mark_dividers(slides).withColumn("_slides", F.count("*").over(deck)))
    placed = built.withColumn("_last", F.max("section_index").over(deck)).withColumn("_block", _block(6))
    flat = (F.col("_slides") > 10) & (F.col("_last") == 0)
    chosen = placed.withColumns({"section_index": F.when(flat, F.col("_block")).otherwise(F.col("section_index")), "agenda_context": F.when(flat, F.lit("")).otherwise(F.col("agenda_context"))})
    return split_large(merge_tiny(chosen.drop("_slides", "_last", "_block")), max_slides)


def deck_sections(sectioned: DataFrame) -> DataFrame:
    """One row for each section: its slides in order, range, raw text and titles."""
    fields = ["number", "title", "text", *[c for c in ("is_visual", "shape_count", "image_count") if c in sectioned.columns]]
    grouped = sectioned.groupBy("deck_id", "section_index").agg(F.first("agenda_context").alias("agenda_context"), F.array_sort(F.collect_list(F.struct(*fields))).alias("slides"))
    return grouped.select(
        "deck_id", "section_index", "agenda_context", "slides", F.col("slides")[0]["number"].alias("first_slide"), F.element_at("slides", -1)["number"].alias("last_slide"),
        T.raw_text(F.col("slides")).alias("raw_text"), T.section_titles(F.col("slides")).alias("titles"),
    )


def inspect_deck(sectioned: DataFrame, slides: DataFrame) -> DataFrame:
    """Per deck: slides, sections and visual slides."""
    facts = slides.groupBy("deck_id").agg(F.count("*").alias("slides"), F.count_if(F.coalesce("is_visual", F.lit(False))).alias("visual_slides"))
    sections = sectioned.groupBy("deck_id").agg(F.count_distinct("section_index").alias("sections"))
    return facts.join(sections, "deck_id", "left").na.fill(0, ["sections"])
