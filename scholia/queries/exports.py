"""Requests, papers, exports and sources over conversations and documents: texts that leave the library and tables that enter it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import scalars as N
from scholia.functions import text as T
from scholia.operators import chunks as C
from scholia.operators import results as X
from scholia.operators import sections as S
from scholia.plans import requests as R
from scholia.sources import tables as tables
from scholia.sources.materialise import shared_folder

from .roles import OUTLINE_SQL, PAGES_SQL, SLIDES_SQL, TOKENS, outline, pages, slides, table
from .structure import CHUNKS_SQL, chunk_pages, outline_ranges


def heading_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third page opens with a numbered heading."""
    p = pages(spark, sf_dir)
    number = F.when(F.col("page_no") % 2 == 0, F.col("page_no").cast("string")).otherwise(F.concat(F.col("page_no").cast("string"), F.lit("."), (F.col("page_no") % 4).cast("string")))
    head = F.when(F.col("page_no") % 3 == 1, F.concat(number, F.lit("  Chapter of "), "book_id", F.lit(" \n"))).otherwise("")
    return S.heading_ranges(p.withColumn("text", F.concat(head, "text"))).select("book_id", F.col("ordinal").cast("int").alias("ordinal"), "title", "level", "page_start", "page_end")


def text_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("\\"), "lang", F.lit("/doc."), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(""))
    choices = T.lettered_choices(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 10 + 1).cast("int")), lambda i: i.cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.excerpt(F.coalesce("text", F.lit("")))).alias("digest"), T.safe_name(path).alias("name"), T.stem(path).alias("stem"), F.array_join(choices, "|").alias("choices"))


def marker_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number").cast("string")
    made = F.concat(F.lit("See `[B:  P & Q <"), n, F.lit("> ]` and [S: 1 , "), n, F.lit("]\n [FIGURE: slide "), n, F.lit("] \n[BOOKFIGURE: 1."), n, F.lit("]\nend"))
    rows = slides(spark, sf_dir).select("deck_id", "number", made.alias("m"))
    return rows.select("deck_id", "number", T.untick_markers(F.col("m")).alias("unticked"), T.citations_to_chips(T.untick_markers(F.col("m"))).alias("chips"), T.marker_notes(F.col("m")).alias("notes"), F.array_join(T.slide_figure_refs(F.col("m")).cast("array<string>"), ",").alias("slides"))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    empty = F.array().cast("array<string>")
    return slides(spark, sf_dir).select(
        F.col("deck_id").alias("exam_id"), F.col("deck_id").cast("string").alias("course_id"), n.alias("number"), (n % 3 * 5).alias("points"), F.when(n % 2 == 0, F.concat(F.lit("Topic "), n.cast("string"))).otherwise("").alias("topic"), F.col("title").alias("prompt"),
        F.when(n % 2 == 0, F.array(F.lit("yes"), F.lit("no"), n.cast("string"))).otherwise(empty).alias("choices"), F.when(n % 4 != 0, "yes").otherwise("").alias("answer"), F.when(n % 3 != 0, F.concat(F.lit("Because "), n.cast("string"))).otherwise("").alias("solution"),
        F.when(n % 2 == 1, F.array(F.concat(F.lit("Part, p. "), n.cast("string")))).otherwise(empty).alias("citations"), F.when(n % 5 == 0, F.concat(F.lit(" Old question "), n.cast("string"), F.lit(" "))).alias("modeled_on"),
    )


def exam_papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = _questions(spark, sf_dir)
    exams = q.select("exam_id").distinct().select("exam_id", F.concat(F.lit("Deck "), F.col("exam_id").cast("string")).alias("lecture_title"), F.when(F.col("exam_id") % 2 == 0, "Two hours").alias("profile"))
    return X.exam_markdown(exams, q).join(X.exam_facts(q), "exam_id").select("exam_id", "markdown", "questions", "total_points", "grounded")


def exam_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.exam_search_rows(_questions(spark, sf_dir))


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("number")
    return slides(spark, sf_dir).select(F.col("deck_id").alias("document_id"), F.lit("c").alias("course_id"), n.alias("section_index"), F.when(n % 4 == 0, "").otherwise(F.col("title")).alias("title"), F.concat(F.lit("[BOOKFIGURE: 1."), (n % 3).cast("string"), F.lit("]\n[KŞEKİL: 2."), n.cast("string"), F.lit("]")).alias("markdown"), n.alias("slide_first"), (n + 1).alias("slide_last"), F.when(n % 3 == 0, "TimeoutError: late").alias("error"), F.concat(F.lit("b"), (F.col("deck_id") % 2).cast("string")).alias("book_id"))


def section_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.table_of_contents(_generated(spark, sf_dir))


def note_search_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return X.note_search_rows(_generated(spark, sf_dir))


def retry_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generated(spark, sf_dir)
    return X.retry_mismatch(g.groupBy("document_id").agg(F.array(F.max("section_index"), F.max("section_index") + 1).alias("failed")), g)


def resolved_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _generated(spark, sf_dir)
    figures = g.select("book_id", F.concat(F.lit("2."), F.col("section_index").cast("string")).alias("number")).distinct().where("number != '2.2'").union(g.select("book_id", F.lit("1.1").alias("number")).distinct())
    found, absent = X.resolve_figures(g, figures)
    return found.select("document_id", "number", "position").unionByName(absent.select("document_id", "number", F.lit(0).alias("position")))


def exam_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
    return tables.load_exam_text(turns.select(F.col("conv_id").alias("exam_id"), F.col("turn").alias("page_no"), F.coalesce("text", F.lit("")).alias("text")), turns.select(F.col("conv_id").alias("exam_id")).distinct())


def nested_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outlines of documents' books as nested JSON, read back."""
    entries = outline(pages(spark, sf_dir).drop("text"))
    child = F.when(F.col("level") == 1, F.struct("title", "page_idx"))
    parts = entries.groupBy("book_id", F.expr("ordinal div 2").alias("part")).agg(F.min_by("title", "ordinal").alias("title"), F.min("page_idx").alias("page_idx"), F.array_compact(F.collect_list(child)).alias("children"))
    books = parts.groupBy("book_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("part", "title", "page_idx", "children"))), lambda x: x.dropFields("part"))).alias("outline"))
    return tables.read_outline(books).select("book_id", F.col("ordinal").cast("int").alias("ordinal"), "title", "level", "page_idx")


def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON and back; some rows are cut, some hold a text where a number belongs."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", "text", F.struct("lang", F.array("source").alias("tags")).alias("facts"), F.col("n_chars").alias("size"))
    written = tables.documents_to_json(docs, "doc_id")
    broken = F.when(F.col("doc_id") % 10 == 3, F.substring("json", 1, 10)).when(F.col("doc_id") % 10 == 4, F.replace("json", F.lit('"doc_id":'), F.lit('"doc_id":"x'))).otherwise(F.col("json"))
    good, bad = tables.documents_from_json(written.withColumn("json", broken).withColumnRenamed("doc_id", "key"), "doc_id long, text string, facts struct<lang:string,tags:array<string>>, size long")
    return good.select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), "facts.lang", F.col("facts.tags")[0].alias("source"), F.coalesce("size", F.lit(-1).cast("long")).alias("size"), F.lit(False).alias("rejected")).unionByName(
        bad.select(F.col("key").alias("doc_id"), *[F.lit(None).cast("string").alias(c) for c in ("digest", "lang", "source")], F.lit(-1).cast("long").alias("size"), F.lit(True).alias("rejected"))
    )


def upload_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    name = F.when(F.col("l_partkey") % 50 == 0, F.concat(F.lit("../"), F.col("l_partkey").cast("string"))).otherwise(F.concat(F.lit("a/"), F.col("l_partkey").cast("string"), F.lit(".pdf")))
    files = items.select(F.col("l_orderkey").alias("batch_id"), name.alias("name"), F.when(F.col("l_suppkey") % 40 == 0, 0).otherwise(F.col("l_quantity").cast("long") * 1_000_000).alias("size"))
    good, bad = tables.validate_manifest(files, max_files=6, max_megabytes=150)
    return good.withColumn("error", F.lit("")).unionByName(bad).groupBy("batch_id", "error").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def book_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    books = p.select("book_id").distinct().select("book_id", F.concat(F.lit("/x/"), "book_id", F.lit(".pdf")).alias("path"), F.when(F.col("book_id").endswith("1-0"), F.concat(F.lit(" Title of "), "book_id", F.lit(" "))).otherwise(" ").alias("meta_title"))
    return tables.book_metadata(books, p)


def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all books, built on disk and read back: statistics and terms by book."""
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    index = tables.load_or_build(spark, path, pages(spark, sf_dir).select("book_id", "page_no", "text"), outline_ranges(spark, sf_dir))
    terms = index["term_df"].groupBy("book_id").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"))
    return index["corpus_stats"].join(terms, "book_id").join(C.chunk_totals(index["chunks"]), "book_id").select("book_id", "n_docs", F.round("avg_len", 6).alias("avg_len"), "terms", "postings", "chunks", "tokens")


def chunk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_totals(chunk_pages(spark, sf_dir))


def _offered(spark: SparkSession, sf_dir: str, keys: list[str]) -> DataFrame:
    """Every deck's turns as excerpts; for sections, the turn itself where its number is even."""
    rows = slides(spark, sf_dir) if keys == ["deck_id"] else slides(spark, sf_dir).where("number % 2 = 0")
    return R.offered_chunks(rows.select("deck_id", F.col("number").alias("section_index"), F.col("number").alias("rank"), F.concat(F.lit("Part, p. "), F.col("number").cast("string")).alias("citation"), F.col("title").alias("text")), keys)


def practice_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir).withColumn("is_divider", F.col("number") % 4 == 3)
    titles = rows.select("deck_id").distinct().withColumn("title", F.concat(F.lit("Deck "), F.col("deck_id").cast("string")))
    exams = titles.where("deck_id % 3 = 0").select("deck_id", F.lit("Old paper").alias("exam_text"))
    return R.practice_request(rows, titles, exams, _offered(spark, sf_dir, ["deck_id"]).where("deck_id % 2 = 0"), count=7)


def section_request_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(sections with their requests, cards): every turn as a section of its own."""
    rows = slides(spark, sf_dir)
    slide = F.array(F.struct("number", "title", "text", "is_visual"))
    sections = rows.select("deck_id", F.col("number").alias("section_index"), F.col("number").alias("first_slide"), F.col("number").alias("last_slide"), T.raw_text(slide).alias("raw_text"), slide.alias("slides"))
    cards = rows.where("number % 3 != 0").select("deck_id", F.col("number").alias("section_index"), "title", F.when(F.col("number") % 2 == 1, F.array(F.lit("gap one"), F.lit("gap two"))).alias("gaps"))
    figures = R.offered_figures(rows.where("number % 5 = 1").select("deck_id", F.col("number").alias("section_index"), F.lit(1).alias("figure_rank"), F.lit("3.4").alias("number"), F.when(F.col("number") == 1, "A drawing").otherwise("").alias("caption"), F.col("number").alias("page")), ["deck_id", "section_index"])
    made = R.section_request(sections, cards, _offered(spark, sf_dir, ["deck_id", "section_index"]), figures, language="Turkish", depth="derin", extras=("örnek", "quiz", "none"))
    return made, cards


def section_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_request_rows(spark, sf_dir)[0].select("deck_id", "section_index", "request")


def usage_and_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kind = "struct<input_tokens:long,output_tokens:long,cache_creation_tokens:long,cache_read_tokens:long,calls:long>"

    def usage(*values: F.Column) -> F.Column:
        return F.struct(*values).cast(kind)

    both = N.usage_add(usage(F.col("l_partkey"), F.col("l_suppkey"), F.lit(None), F.col("l_linenumber"), F.lit(1)), usage(F.col("l_orderkey"), F.lit(2), F.lit(3), F.lit(None), F.lit(1)))
    key = F.element_at(F.array(F.lit("a/b.pdf"), F.lit("/a"), F.lit("a/../b"), F.lit("c:\\x"), F.lit("a\\b"), F.lit(""), F.lit("a/./b")), F.col("l_linenumber").cast("int"))
    return items.select("l_orderkey", "l_linenumber", *[both[c].alias(c) for c in ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "calls")], N.safe_key(key).alias("safe"), N.short_hash(F.col("l_orderkey").cast("string"), F.col("l_partkey").cast("string")).alias("id"))


QUERIES = {
    "heading_ranges": heading_ranges, "text_excerpts": text_excerpts, "marker_rewrites": marker_rewrites, "exam_papers": exam_papers, "exam_search_rows": exam_search_rows, "section_contents": section_contents,
    "note_search_rows": note_search_rows, "retry_mismatch": retry_mismatch, "resolved_figures": resolved_figures, "exam_texts": exam_texts, "nested_outlines": nested_outlines, "json_round_trip": json_round_trip,
    "upload_batches": upload_batches, "book_facts": book_facts, "stored_index": stored_index, "chunk_totals": chunk_totals, "practice_requests": practice_requests, "section_requests": section_requests, "usage_and_keys": usage_and_keys,
}

_HTML = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"

_QUESTIONS = f"""{SLIDES_SQL}, q as (
    select deck_id as exam_id, number, number % 3 * 5 as points, case when number % 2 = 0 then 'Topic ' || number else '' end as topic, title as prompt, case when number % 2 = 0 then ['yes', 'no', cast(number as varchar)] else [] end as choices,
        case when number % 4 <> 0 then 'yes' else '' end as answer, case when number % 3 <> 0 then 'Because ' || number else '' end as solution, case when number % 2 = 1 then 'Part, p. ' || number end as citation, case when number % 5 = 0 then 'Old question ' || number end as modeled_on
    from slides)"""

_GENERATED = f"""{SLIDES_SQL}, g as (
    select deck_id as document_id, number as section_index, case when number % 4 = 0 then '' else title end as title, '[BOOKFIGURE: 1.' || number % 3 || ']' || chr(10) || '[KŞEKİL: 2.' || number || ']' as markdown,
        number as slide_first, number + 1 as slide_last, number % 3 = 0 as failed, 'b' || deck_id % 2 as book_id from slides)"""

_W = R.DEFAULT_WORDING

ORACLE_SQL = {
    "heading_ranges": rf"""
with {PAGES_SQL}, t as (
    select book_id, page_no, case when page_no % 3 = 1 then case when page_no % 2 = 0 then cast(page_no as varchar) else page_no || '.' || page_no % 4 end || '  Chapter of ' || book_id || ' ' || chr(10) else '' end || text as text from pages
), l as (select book_id, page_no, list_filter(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))[1:6], lambda x: regexp_matches(x, '^\s*(\d+(?:\.\d+){{0,2}})\s+([A-Z][^\n]{{3,80}})\s*$'))[1] as h from t),
e as (select book_id, page_no - 1 as page_idx, regexp_extract(h, '^\s*(\d+(?:\.\d+){{0,2}})\s+', 1) as number, trim(regexp_extract(h, '^\s*\d+(?:\.\d+){{0,2}}\s+([A-Z][^\n]{{3,80}})\s*$', 1)) as name from l where h is not null),
c as (select book_id, max(page_no) as n from pages group by book_id)
select e.book_id, cast(row_number() over (partition by e.book_id order by page_idx) - 1 as integer) as ordinal, number || ' ' || name as title, cast(length(number) - length(replace(number, '.', '')) as integer) as level, cast(page_idx + 1 as integer) as page_start,
    cast(greatest(page_idx + 1, coalesce(lead(page_idx) over (partition by e.book_id order by page_idx), n - 1)) as integer) as page_end from e join c on c.book_id = e.book_id
""",
    "text_excerpts": r"""
select doc_id, md5(left(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), 260) || '…') as digest, 'doc.' || doc_id || case when doc_id % 2 = 0 then '.pdf' else '' end as name, case when doc_id % 2 = 0 then 'doc.' || doc_id else 'doc' end as stem,
    array_to_string(list_transform(generate_series(1, doc_id % 10 + 1), lambda i: coalesce(['A', 'B', 'C', 'D', 'E', 'F', 'G', 'H'][i], cast(i as varchar)) || ') ' || i), '|') as choices from documents
""",
    "marker_rewrites": f"""
with {SLIDES_SQL}, m as (select deck_id, number, chr(10) || ' [FIGURE: slide ' || number || '] ' || chr(10) || '[BOOKFIGURE: 1.' || number || ']' || chr(10) || 'end' as rest, 'P &amp; Q &lt;' || number || '&gt;' as label from slides)
select deck_id, number, 'See [B:  P & Q <' || number || '> ] and [S: 1 , ' || number || ']' || rest as unticked,
    'See <span class="cite cite-book" data-src="' || label || '">' || label || '</span> and <span class="cite cite-slide">Slide 1,' || number || '</span>' || rest as chips,
    'See `[B:  P & Q <' || number || '> ]` and [S: 1 , ' || number || ']' || chr(10) || chr(10) || '<p class="figure-missing">Slide ' || number || ' image — could not be inserted because the lecture PDF was not provided.</p>' || chr(10) || chr(10) || chr(10)
        || '<p class="figure-missing">Textbook figure 1.' || number || ' — could not be inserted because the textbook PDF was not provided.</p>' || chr(10) || chr(10) || 'end' as notes, cast(number as varchar) as slides from m
""",
    "exam_papers": f"""
with {_QUESTIONS}, p as (
    select exam_id, string_agg('## Question ' || number || case when points <> 0 then ' (' || points || ' points)' else '' end || chr(10) || chr(10) || prompt || case when len(choices) > 0 then chr(10) || chr(10) || 'A) yes' || chr(10) || 'B) no' || chr(10) || 'C) ' || number else '' end || chr(10), chr(10) order by number) as asked,
        string_agg(concat_ws(chr(10), '## Question ' || number || chr(10), case when answer <> '' then '**Answer:** ' || answer || chr(10) end, case when solution <> '' then solution || chr(10) end, '[B: ' || citation || ']' || chr(10),
            '::: exam' || chr(10) || '**Source question:** ' || modeled_on || chr(10) || ':::' || chr(10)), chr(10) order by number) as solved,
        count(*) as questions, sum(points) as total_points, count(modeled_on) as grounded from q group by exam_id
)
select exam_id, concat_ws(chr(10), '# Deck ' || exam_id || ' — practice exam' || chr(10), case when exam_id % 2 = 0 then '> Two hours' || chr(10) end, asked, chr(10) || '# Answer key' || chr(10), solved) as markdown, questions, cast(total_points as bigint) as total_points, grounded from p
""",
    "exam_search_rows": f"""
with {_QUESTIONS}
select exam_id as document_id, cast(exam_id as varchar) as course_id, number as section, 'Soru ' || number || case when topic <> '' then ' — ' || topic else '' end as heading, array_to_string(list_concat(list_concat([prompt], choices), [answer, solution]), chr(10)) as body from q
""",
    "section_contents": f"""
with {_GENERATED} select document_id, '<ol>' || string_agg('<li>' || {_HTML.format("case when title <> '' then title else 'Section ' || (section_index + 1) end")} || ' <span>slides ' || slide_first || '–' || slide_last || '</span></li>', '' order by section_index) || '</ol>' as toc
from g group by document_id having count(*) >= 2
""",
    "note_search_rows": f"with {_GENERATED} select document_id, 'c' as course_id, section_index as section, case when title <> '' then title else 'Section ' || (section_index + 1) end as heading, markdown as body from g where not failed",
    "retry_mismatch": f"with {_GENERATED} select document_id, cast(max(section_index) + 1 as integer) as section_index from g group by document_id",
    "resolved_figures": f"""
with {_GENERATED}, refs as (select document_id, book_id, section_index, 0 as place, '1.' || section_index % 3 as number from g where not failed union all select document_id, book_id, section_index, 1, '2.' || section_index from g where not failed),
f as (select distinct book_id, '2.' || section_index as number from g where section_index <> 2 union select distinct book_id, '1.1' from g),
s as (select document_id, book_id, number, min(section_index * 2 + place) as seen from refs group by document_id, book_id, number)
select s.document_id, s.number, cast(case when f.number is null then 0 else row_number() over (partition by s.document_id, (f.number is null) order by seen) end as integer) as position from s left join f on f.book_id = s.book_id and f.number = s.number
""",
    "exam_texts": """
with c as (select conv_id as exam_id, turn, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as t from conversations where conv_id is not null and turn is not null)
select exam_id, coalesce(left(string_agg(t, chr(10) || chr(10) order by turn) filter (where t <> ''), 20000), '') as exam_text from c group by exam_id
""",
    "nested_outlines": f"with {OUTLINE_SQL} select book_id, cast(ordinal as integer) as ordinal, title, cast(level as integer) as level, cast(page_idx as integer) as page_idx from outline",
    "json_round_trip": """
select doc_id, case when doc_id % 10 in (3, 4) then null else md5(coalesce(text, '')) end as digest, case when doc_id % 10 not in (3, 4) then lang end as lang, case when doc_id % 10 not in (3, 4) then source end as source,
    coalesce(case when doc_id % 10 not in (3, 4) then cast(n_chars as bigint) end, -1) as size, doc_id % 10 in (3, 4) as rejected from documents where doc_id is not null
""",
    "upload_batches": """
with f as (select l_orderkey as batch_id, l_partkey % 50 = 0 as unsafe, case when l_suppkey % 40 = 0 then 0 else cast(l_quantity as bigint) * 1000000 end as size from lineitem),
b as (select *, count(*) over (partition by batch_id) as n, sum(size) over (partition by batch_id) / 1e6 as mb from f),
e as (select *, case when n > 6 then 'too many files' when mb > 150 then 'batch too large' when unsafe then 'unsafe name' when size <= 0 then 'empty file' else '' end as error from b)
select batch_id, error, count(*) as files, cast(sum(size) as bigint) as bytes from e group by batch_id, error
""",
    "book_facts": f"with {PAGES_SQL} select book_id, case when ends_with(book_id, '1-0') then 'Title of ' || book_id else book_id end as title, cast(count(*) as integer) as page_count from pages group by book_id",
    "chunk_totals": f"with recursive {CHUNKS_SQL} select book_id, count(*) as chunks, cast(sum(token_estimate) as bigint) as tokens from chunks group by book_id",
    "stored_index": f"""
with recursive {CHUNKS_SQL}, toks as (select book_id, chunk_id, token_estimate, list_concat({TOKENS.format("text")}, {TOKENS.format("section_title")}) as t from chunks),
stats as (select book_id, count(*) as n_docs, round(avg(len(t)), 6) as avg_len, count(*) as chunks, cast(sum(token_estimate) as bigint) as tokens from toks group by book_id),
spread as (select book_id, chunk_id, unnest(t) as term from toks), posts as (select distinct book_id, chunk_id, term from spread), df as (select book_id, count(distinct term) as terms, count(*) as postings from posts group by book_id)
select stats.book_id, n_docs, avg_len, terms, postings, stats.chunks, tokens from stats join df on df.book_id = stats.book_id
""",
    "practice_requests": f"""
with {SLIDES_SQL}, b as (select deck_id, string_agg('### Slide ' || number || ': ' || title || case when text <> '' then chr(10) || text else '' end || chr(10), chr(10) order by number) as body from slides where number % 4 <> 3 group by deck_id),
c as (select deck_id, string_agg('### [B: Part, p. ' || number || ']' || chr(10) || title || chr(10), chr(10) order by number) as chunks from slides where deck_id % 2 = 0 group by deck_id),
t as (select distinct deck_id from slides)
select t.deck_id, concat_ws(chr(10), '# COURSE: Deck ' || t.deck_id || chr(10) || chr(10) || '## SCOPE' || chr(10) || '{_W.scope}' || chr(10), body, '## FORMAT' || chr(10) || '{_W.form}' || chr(10) || case when t.deck_id % 3 = 0 then 'Old paper' else '(no text)' end || chr(10),
    '## ACCURACY' || chr(10) || case when chunks is not null then '{_W.support}' || chr(10) || chunks else '{_W.no_support}' || chr(10) end, '## Task' || chr(10) || 'Write exactly 7 questions.' || chr(10) || 'Write in English.') as request
from t left join b on b.deck_id = t.deck_id left join c on c.deck_id = t.deck_id
""",
    "section_requests": f"""
with {SLIDES_SQL}
select deck_id, number as section_index, concat_ws(chr(10),
    '# SECTION: ' || case when number % 3 <> 0 then title else '' end || chr(10) || 'Slides ' || number || '–' || number || '.' || chr(10) || chr(10) || '## Slides' || chr(10) || '--- Slide ' || number || case when title <> '' then ': ' || title else '' end || ' ---' || chr(10) || text || chr(10),
    case when number % 3 <> 0 and number % 2 = 1 then '## Points to explain' || chr(10) || '- gap one' || chr(10) || '- gap two' || chr(10) end,
    '## Excerpts' || chr(10) || case when number % 2 = 0 then '### [B: Part, p. ' || number || ']' || chr(10) || title || chr(10) else '{_W.no_support}' || chr(10) end,
    case when number % 5 = 1 then '## Figures' || chr(10) || '{_W.figures}' || chr(10) || '- `3.4` — ' || case when number = 1 then 'A drawing' else '(no caption)' end || ' (p. ' || number || ')' || chr(10) end,
    case when is_visual then 'Images of slides ' || number || ' are attached.' end,
    '## Instructions' || chr(10) || '{_W.depths["deep"]}' || chr(10) || '{_W.extras["example"]}' || chr(10) || '{_W.extras["quiz"]}' || chr(10) || '{_W.language % "Turkish"}' || chr(10) || '{_W.closing}') as request from slides
""",
    "usage_and_keys": """
select l_orderkey, l_linenumber, l_partkey + l_orderkey as input_tokens, l_suppkey + 2 as output_tokens, cast(3 as bigint) as cache_creation_tokens, cast(l_linenumber as bigint) as cache_read_tokens, cast(2 as bigint) as calls, l_linenumber in (1, 5) as safe,
    substring(sha256(l_orderkey || chr(0) || l_partkey), 1, 12) as id from lineitem
""",
}
