"""Assembly of generator requests: the shared context of a deck, section requests, practice requests, output directives.

Every text is a native expression over ordered aggregations, byte-stable for equal inputs. Wording is a parameter (``Wording``); the order of blocks and what
makes a block appear are fixed.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T


@dataclass(frozen=True)
class Wording:
    """Texts of the blocks. Replace any of them to talk to another generator."""

    scope: str = "Everything asked must come from these slides."
    form: str = "Follow the form, length and weight of this paper; quote the question that served as a model."
    support: str = "Use these excerpts for solutions and name their labels."
    no_support: str = "(No excerpt matches; stay with the slides.)"
    exam_rule: str = "Connect the material to these questions where they bear on it, and never invent one."
    figures: str = "Ask for a figure with [BOOKFIGURE: number] on a line of its own."
    same_count: str = "Write as many questions as the paper has, from 4 to 25."
    exact_count: str = "Write exactly %d questions."
    closing: str = "Start with a level-two heading and write this section alone."
    language: str = "Write in %s and keep all [B: ...], [S: ...], [FIGURE: ...] and [BOOKFIGURE: ...] markers as they are."
    depths: dict = field(default_factory=lambda: {"summary": "Depth: a paragraph for each point at most.", "standard": "", "deep": "Depth: derive every formula and look at the limits."})
    extras: dict = field(default_factory=lambda: {"analogy": "Add an analogy and say where it fails.", "example": "Add a worked example.", "quiz": "End with three to five questions and their answers.", "glossary": "End with a table of terms."})


DEFAULT_WORDING = Wording()


def ordered_text(rows: DataFrame, keys: list[str], order: list[str], part: Column, name: str, separator: str = "\n") -> DataFrame:
    """Parts of every key joined in order. Parts are bounded by a deck or a book."""
    ordered = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in order], part.alias("_part"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["_part"]), separator).alias(name))


def toc_outline(sections: DataFrame, max_level: int = 1, limit: int = 400) -> DataFrame:
    """(book_id, outline): indented titles with pages of the first ``limit`` sections down to ``max_level``."""
    first = Window.partitionBy("book_id").orderBy("ordinal")
    lines = sections.where(F.col("level") <= max_level).withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= limit)
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), "title", F.lit("  (s. "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(")"))
    return ordered_text(lines, ["book_id"], ["_n"], line, "outline")


def alignment_note(alignments: DataFrame) -> DataFrame:
    """(deck_id, note): a line for every section that has a range."""
    line = F.concat(F.lit("- Section "), F.col("section_index").cast("string"), F.lit(": "), F.array_join("book_sections", ", "), F.lit(" (p. "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(")"))
    return ordered_text(alignments.where("page_start is not null and page_start != 0"), ["deck_id"], ["section_index"], line, "note")


def lecture_context(slides: DataFrame, sectioned: DataFrame, titles: DataFrame, notes: DataFrame | None = None, exams: DataFrame | None = None, wording: Wording = DEFAULT_WORDING) -> DataFrame:
    """(deck_id, context): the prefix shared by all requests of a deck. ``titles`` has deck_id and title, ``notes`` deck_id and note, ``exams`` deck_id and exam_text."""
    shown = F.concat(F.lit("### Slide "), F.col("number").cast("string"), F.lit(": "), "title", F.when(F.col("is_divider"), " [AGENDA]").otherwise(""), F.when(F.col("text") != "", F.concat(F.lit("\n"), "text")).otherwise(""), F.lit("\n"))
    bodies = ordered_text(slides, ["deck_id"], ["number"], shown, "body")
    counts = slides.groupBy("deck_id").agg(F.count("*").alias("slides")).join(sectioned.groupBy("deck_id").agg(F.count_distinct("section_index").alias("sections")), "deck_id", "left")
    rows = titles.join(counts, "deck_id").join(bodies, "deck_id")
    rows = rows.join(notes, "deck_id", "left") if notes is not None else rows.withColumn("note", F.lit(None).cast("string"))
    rows = rows.join(exams.select("deck_id", "exam_text"), "deck_id", "left") if exams is not None else rows.withColumn("exam_text", F.lit(None).cast("string"))
    head = F.concat(F.lit("# COURSE: "), "title", F.lit("\n"), F.col("slides").cast("string"), F.lit(" slides, "), F.coalesce("sections", F.lit(0)).cast("string"), F.lit(" sections.\n\n## Lecture\n"))
    note = F.when(F.coalesce("note", F.lit("")) != "", F.concat(F.lit("## Textbook alignment\n"), "note", F.lit("\n")))
    exam = F.when(F.coalesce("exam_text", F.lit("")) != "", F.concat(F.lit("## Past exam\n"), "exam_text", F.lit(f"\n\n{wording.exam_rule}\n")))
    return rows.select("deck_id", F.concat_ws("\n", head, "body", note, exam).alias("context"))


def output_directives(language: Column, depth: Column, extras: Column, wording: Wording = DEFAULT_WORDING) -> Column:
    """Directives for depth, each extra in order, and language; options that aren't known say nothing."""

    def looked_up(texts: dict, key: Column) -> Column:
        return F.nullif(F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), key), F.lit(""))

    before, after = wording.language.split("%s")
    chosen = F.array_compact(F.concat(F.array(looked_up(wording.depths, T.normalize_option(depth))), F.transform(T.normalize_options(extras), lambda e: looked_up(wording.extras, e))))
    return F.array_join(F.concat(chosen, F.array(F.concat(F.lit(before), language, F.lit(after)))), "\n")


def _excerpts(chunks: Column) -> Column:
    return F.array_join(F.transform(chunks, lambda c: F.concat(F.lit("### [B: "), c["citation"], F.lit("]\n"), c["text"], F.lit("\n"))), "\n")


def offered_chunks(hits: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, chunks): a request's excerpts in rank order."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", "citation", "text")))
    return hits.groupBy(*keys).agg(ordered.alias("chunks"))


def offered_figures(figures: DataFrame, keys: list[str]) -> DataFrame:
    return figures.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("figure_rank", "number", "caption", "page"))).alias("figures"))


def section_request(sections: DataFrame, cards: DataFrame, chunks: DataFrame, figures: DataFrame | None = None, language: str = "English", depth: str = "standard", extras: tuple[str, ...] = (), wording: Wording = DEFAULT_WORDING) -> DataFrame:
    """``sections`` (one row each, see deck_sections) with their request. ``cards``, ``chunks`` and ``figures`` are keyed by deck_id and section_index."""
    keys = ["deck_id", "section_index"]
    rows = sections.join(cards.select(*keys, F.col("title").alias("card_title"), "gaps"), keys, "left").join(chunks, keys, "left")
    rows = rows.join(figures, keys, "left") if figures is not None else rows.withColumn("figures", F.lit(None).cast("array<struct<figure_rank:int,number:string,caption:string,page:int>>"))
    head = F.concat(F.lit("# SECTION: "), F.coalesce("card_title", F.lit("")), F.lit("\nSlides "), F.col("first_slide").cast("string"), F.lit("–"), F.col("last_slide").cast("string"), F.lit(".\n\n## Slides\n"), "raw_text", F.lit("\n"))
    gaps = F.when(F.size(F.coalesce("gaps", F.array().cast("array<string>"))) > 0, F.concat(F.lit("## Points to explain\n"), F.array_join(F.transform("gaps", lambda g: F.concat(F.lit("- "), g)), "\n"), F.lit("\n")))
    found = F.coalesce(F.size("chunks"), F.lit(0)) > 0
    support = F.concat(F.lit("## Excerpts\n"), F.when(found, _excerpts(F.col("chunks"))).otherwise(wording.no_support + "\n"))
    line = F.transform("figures", lambda f: F.concat(F.lit("- `"), f["number"], F.lit("` — "), F.coalesce(F.nullif(f["caption"], F.lit("")), F.lit("(no caption)")), F.lit(" (p. "), f["page"].cast("string"), F.lit(")")))
    drawn = F.when(F.coalesce(F.size("figures"), F.lit(0)) > 0, F.concat(F.lit(f"## Figures\n{wording.figures}\n"), F.array_join(line, "\n"), F.lit("\n")))
    numbers = F.transform(F.filter("slides", lambda s: s["is_visual"]), lambda s: s["number"].cast("string"))
    visual = F.when(F.size(numbers) > 0, F.concat(F.lit("Images of slides "), F.array_join(numbers, ", "), F.lit(" are attached.")))
    asked = F.concat(F.lit("## Instructions\n"), output_directives(F.lit(language), F.lit(depth), F.array(*map(F.lit, extras)).cast("array<string>"), wording), F.lit("\n" + wording.closing))
    return rows.withColumn("request", F.concat_ws("\n", head, gaps, support, drawn, visual, asked)).drop("card_title", "gaps")


def practice_request(slides: DataFrame, titles: DataFrame, exams: DataFrame, chunks: DataFrame, language: str = "English", count: int = 0, wording: Wording = DEFAULT_WORDING) -> DataFrame:
    """(deck_id, request) for a whole exam: slides without dividers, the paper, excerpts (deck_id, chunks), the task."""
    shown = F.concat(F.lit("### Slide "), F.col("number").cast("string"), F.lit(": "), "title", F.when(F.col("text") != "", F.concat(F.lit("\n"), "text")).otherwise(""), F.lit("\n"))
    rows = titles.join(ordered_text(slides.where("not is_divider"), ["deck_id"], ["number"], shown, "body"), "deck_id", "left").join(exams.select("deck_id", "exam_text"), "deck_id", "left").join(chunks, "deck_id", "left")
    support = F.when(F.coalesce(F.size("chunks"), F.lit(0)) > 0, F.concat(F.lit(f"{wording.support}\n"), _excerpts(F.col("chunks")))).otherwise(wording.no_support + "\n")
    amount = wording.same_count if count <= 0 else wording.exact_count % count
    return rows.select("deck_id", F.concat_ws(
        "\n", F.concat(F.lit("# COURSE: "), "title", F.lit("\n\n## SCOPE\n" + wording.scope + "\n")), "body", F.concat(F.lit(f"## FORMAT\n{wording.form}\n"), F.coalesce(F.nullif("exam_text", F.lit("")), F.lit("(no text)")), F.lit("\n")),
        F.concat(F.lit("## ACCURACY\n"), support), F.lit(f"## Task\n{amount}\nWrite in {language}."),
    ).alias("request"))


def preview_request(requests: DataFrame, blocks: dict[str, Column]) -> DataFrame:
    """Estimated tokens of every named block of a request and of all together."""
    sizes = {name: T.estimate_tokens(F.coalesce(block, F.lit(""))) for name, block in blocks.items()}
    total = sum((s for s in sizes.values()), F.lit(0))
    return requests.select("*", *[s.alias(f"{name}_tokens") for name, s in sizes.items()], total.alias("total_tokens"))
