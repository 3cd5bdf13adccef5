"""What comes back from a generator: questions, merged retries, markdown, figure references, the grounding audit, rows for search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.scalars import coerce_question, has_choices, is_failed, is_grounded, salvage_json


def coerce_questions(raw: DataFrame) -> DataFrame:
    """Questions of ``raw`` (exam_id, json with a list ``questions``): invalid elements are dropped, the rest numbered from 1 in order."""
    elements = salvage_json(F.col("json"), "questions array<string>")["questions"]
    items = raw.select("exam_id", F.posexplode(elements).alias("at", "item")).select("exam_id", "at", coerce_question(F.col("item")).alias("q")).where("q is not null")
    number = F.row_number().over(Window.partitionBy("exam_id").orderBy("at"))
    return items.withColumn("n", number.cast("int")).select("exam_id", F.col("n").alias("number"), *[f"q.{f}" for f in ("kind", "points", "topic", "slides", "prompt", "choices", "answer", "solution", "citations", "modeled_on")])


def exam_facts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("exam_id").agg(F.count("*").alias("questions"), F.sum("points").alias("total_points"), F.count_if(is_grounded(F.col("modeled_on"))).alias("grounded"))


def _joined(rows: DataFrame, key: str, order: str, part: F.Column, name: str, separator: str = "\n") -> DataFrame:
    """Text parts of every key in order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), part.alias("t"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), separator).alias(name))


def notes_markdown(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, markdown): title and sections in order; a failed section is a warning with its slides."""
    warning = F.concat(F.lit("## "), "title", F.lit("\n> ⚠️ This section could not be generated ("), "error", F.lit("). Slides "), F.col("slide_first").cast("string"), F.lit("-"), F.col("slide_last").cast("string"), F.lit(".\n"))
    part = F.when(is_failed(F.col("error")), warning).otherwise(F.concat("markdown", F.lit("\n")))
    bodies = _joined(sections, "document_id", "section_index", part, "body")
    return documents.join(bodies, "document_id", "left").select("document_id", F.concat(F.lit("# "), "title", F.lit("\n"), F.coalesce(F.concat(F.lit("\n"), "body"), F.lit(""))).alias("markdown"))


def exam_markdown(exams: DataFrame, questions: DataFrame) -> DataFrame:
    """(exam_id, markdown): all questions first, then the answer key; a source question is quoted where there is one."""
    points = F.when(F.coalesce("points", F.lit(0)) != 0, F.concat(F.lit(" ("), F.col("points").cast("string"), F.lit(" points)"))).otherwise("")
    choices = F.when(has_choices(F.col("choices")), F.concat(F.lit("\n\n"), F.array_join(T.lettered_choices(F.col("choices")), "\n"))).otherwise("")
    asked = F.concat(F.lit("## Question "), F.col("number").cast("string"), points, F.lit("\n\n"), "prompt", choices, F.lit("\n"))

    def shown(text: F.Column) -> F.Column:
        return F.when(F.coalesce(text, F.lit("")) != "", F.concat(text, F.lit("\n")))

    source = F.when(is_grounded(F.col("modeled_on")), F.concat(F.lit("::: exam\n**Source question:** "), T.py_strip(F.col("modeled_on")), F.lit("\n:::\n")))
    cited = F.array_join(F.transform("citations", lambda c: F.concat(F.lit("[B: "), c, F.lit("]"))), " ")
    solved = F.concat_ws("\n", F.concat(F.lit("## Question "), F.col("number").cast("string"), F.lit("\n")), F.when(F.col("answer") != "", F.concat(F.lit("**Answer:** "), "answer", F.lit("\n"))), shown(F.col("solution")), shown(cited), source)
    parts = _joined(questions, "exam_id", "number", asked, "asked").join(_joined(questions, "exam_id", "number", solved, "solved"), "exam_id")
    head = F.concat(F.lit("# "), "lecture_title", F.lit(" — practice exam\n"))
    profile = F.when(F.coalesce("profile", F.lit("")) != "", F.concat(F.lit("> "), "profile", F.lit("\n")))
    return exams.join(parts, "exam_id", "left").select("exam_id", F.concat_ws("\n", head, profile, "asked", F.lit("\n# Answer key\n"), "solved").alias("markdown"))


def table_of_contents(sections: DataFrame) -> DataFrame:
    """(document_id, toc): titles and slides of documents of two sections or more."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")))
    item = F.concat(F.lit("<li>"), T.html_escape(title), F.lit(" <span>slides "), F.col("slide_first").cast("string"), F.lit("–"), F.col("slide_last").cast("string"), F.lit("</span></li>"))
    counted = sections.groupBy("document_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct(F.col("section_index").alias("o"), item.alias("t")))).alias("items"))
    return counted.where("n >= 2").select("document_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("items", lambda x: x["t"]), ""), F.lit("</ol>")).alias("toc"))


def document_facts(sections: DataFrame) -> DataFrame:
    """Per document: sections that succeeded, slides covered, and the failed indices."""
    failed = is_failed(F.col("error"))
    return sections.groupBy("document_id").agg(
        F.count_if(~failed).alias("ok_sections"), F.min("slide_first").alias("first_slide"), F.max("slide_last").alias("last_slide"),
        F.array_sort(F.collect_list(F.when(failed, F.col("section_index")))).alias("failed"),
    )


def merge_retry(sections: DataFrame, retried: DataFrame) -> DataFrame:
    """Sections with those replaced whose retry succeeded; a retry that failed again changes nothing."""
    key, rest = ["document_id", "section_index"], [c for c in sections.columns if c not in ("document_id", "section_index")]
    good = retried.where(~is_failed(F.col("error"))).select(*key, F.struct(*rest).alias("_new"))
    merged = sections.join(good, key, "left").withColumn("_row", F.coalesce("_new", F.struct(*rest)))
    return merged.select(*key, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*sections.columns)


def retry_mismatch(documents_failed: DataFrame, sections: DataFrame) -> DataFrame:
    """(document_id, section_index) recorded as failed without such a section."""
    listed = documents_failed.select("document_id", F.explode("failed").alias("section_index"))
    return listed.join(sections.select("document_id", "section_index"), ["document_id", "section_index"], "left_anti")


def resolve_figures(sections: DataFrame, figures: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(figures a document asks for, each once in order of first reference; references to numbers that don't exist). ``sections`` carries book_id."""
    refs = sections.where(~is_failed(F.col("error"))).select("document_id", "book_id", "section_index", F.posexplode(T.figure_refs(F.col("markdown"))).alias("at", "number"))
    first = refs.groupBy("document_id", "book_id", "number").agg(F.min(F.struct("section_index", "at")).alias("seen"))
    found = first.join(figures, ["book_id", "number"])
    position = F.row_number().over(Window.partitionBy("document_id").orderBy("seen"))
    return found.withColumn("position", position).drop("seen"), first.join(figures.select("book_id", "number"), ["book_id", "number"], "left_anti").select("document_id", "number")


def grounding_audit(sections: DataFrame, offered: DataFrame, figures: DataFrame, questions: DataFrame | None = None, exams: DataFrame | None = None) -> DataFrame:
    """Claims that nothing supports: (document_id, section_index, problem, value).

    A cited label must be one that was offered to its section (document_id, section_index, citation), a figure number must exist (document_id, number), a quoted source
    question must occur word for word in the exam (exam_id, exam_text).
    """
    cited = sections.select("document_id", "section_index", F.explode(F.array_distinct(T.citation_refs(F.col("markdown"))["book"])).alias("value"))
    unknown = cited.join(offered.select("document_id", "section_index", F.col("citation").alias("value")).distinct(), ["document_id", "section_index", "value"], "left_anti")
    asked = sections.select("document_id", "section_index", F.explode(F.array_distinct(T.figure_refs(F.col("markdown")))).alias("value"))
    absent = asked.join(figures.select("document_id", F.col("number").alias("value")).distinct(), ["document_id", "value"], "left_anti")
    out = unknown.select("document_id", "section_index", F.lit("citation not offered").alias("problem"), "value").unionByName(absent.select("document_id", "section_index", F.lit("unknown figure").alias("problem"), "value"))
    if questions is not None and exams is not None:
        quoted = questions.where(is_grounded(F.col("modeled_on"))).join(exams, "exam_id").where(~F.expr("contains(exam_text, trim(modeled_on))"))
        out = out.unionByName(quoted.select(F.col("exam_id").alias("document_id"), F.col("number").alias("section_index"), F.lit("quote not in exam").alias("problem"), F.col("modeled_on").alias("value")))
    return out


def note_search_rows(sections: DataFrame) -> DataFrame:
    """Search rows of notes: every section that succeeded."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(F.concat(F.lit("Section "), (F.col("section_index") + 1).cast("string")))
    return sections.where(~is_failed(F.col("error"))).select("document_id", "course_id", F.col("section_index").alias("section"), title.alias("heading"), F.col("markdown").alias("body"))


def exam_search_rows(questions: DataFrame) -> DataFrame:
    heading = F.concat(F.lit("Soru "), F.col("number").cast("string"), F.when(F.coalesce("topic", F.lit("")) != "", F.concat(F.lit(" — "), "topic")).otherwise(""))
    body = F.array_join(F.concat(F.array("prompt"), "choices", F.array("answer", "solution")), "\n")
    return questions.select(F.col("exam_id").alias("document_id"), "course_id", F.col("number").alias("section"), heading.alias("heading"), body.alias("body"))
