"""Generation over conversations as decks: sections expanded and retried through a ledger, defaults of cards and alignments, previews, practice questions, usage of logs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import scalars as N
from scholia.functions import text as T
from scholia.operators import estimate as E
from scholia.operators import results as X
from scholia.operators import sections as S
from scholia.plans import notes as P
from scholia.plans import requests as R
from scholia.sources import tables as tables
from scholia.sources.materialise import materialised, shared_folder

from .exports import ORACLE_SQL as EXPORTS_SQL
from .exports import _offered, _questions, section_request_rows
from .roles import SLIDES_SQL, slides, table
from .structure import CHUNKS_SQL, chunk_pages


def _answer(texts: list[str]) -> list[tuple[str, dict]]:
    """A generator that needs no model: it says how long a request is, and can't answer every ninth length."""
    out = []
    for text in texts:
        if len(text) % 9 == 0:
            raise ValueError(f"no answer to {len(text)}")
        out.append((f"## {len(text)} characters", {"input_tokens": len(text) // 4, "output_tokens": 3, "calls": 1}))
    return out


def _second_answer(texts: list[str]) -> list[tuple[str, dict]]:
    """Answers odd lengths alone."""
    for text in texts:
        if len(text) % 2 == 0:
            raise TimeoutError("late")
    return [(f"## Again {len(text)}", {"calls": 1}) for text in texts]


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, cards = section_request_rows(spark, sf_dir)
    return made.join(cards.select("deck_id", "section_index", F.col("title").alias("card_title")), ["deck_id", "section_index"], "left")


def _ledger(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/answers-{uuid.uuid4().hex}"


def expanded_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn's request answered once, by way of a ledger."""
    out = P.expand_sections(_requests(spark, sf_dir), _answer, _ledger(spark))
    return out.select("deck_id", "section_index", "title", "markdown", F.array_join("citations", "|").alias("citations"), "slide_first", "slide_last", "error", F.col("usage.input_tokens").alias("input_tokens"), F.col("usage.calls").alias("calls"))


def retried_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that failed are asked again, by a generator that fails in other cases; the others stay."""
    ledger, requests = _ledger(spark), materialised(_requests(spark, sf_dir))
    first = P.expand_sections(requests, _answer, ledger).drop("usage").withColumnRenamed("deck_id", "document_id")
    return P.retry_failed(materialised(first), requests, _second_answer, ledger).select("document_id", "section_index", "markdown", "error")


def default_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards for all sections from cards that some turns give, several of them twice."""
    rows = slides(spark, sf_dir).withColumn("section_index", (F.col("number") - 1) % 3)
    given = rows.where("number % 4 != 3 and section_index < 2").select("deck_id", "section_index", F.col("number").alias("seq"), "title", F.array(F.lit("term"), F.col("number").cast("string")).alias("key_terms"), F.array().cast("array<string>").alias("formulas"), F.array(F.lit("gap")).alias("gaps"))
    filled = P.fill_cards(rows.select("deck_id", "section_index").distinct(), given)
    return filled.select("deck_id", "section_index", "title", F.array_join("key_terms", ",").alias("key_terms"), F.size("formulas").alias("formulas"), F.array_join("gaps", ",").alias("gaps"), "query")


def default_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir).withColumn("section_index", (F.col("number") - 1) % 3)
    given = rows.where("number % 4 != 3 and section_index < 2").select("deck_id", "section_index", F.col("number").alias("seq"), F.array(F.lit("Part"), F.col("number").cast("string")).alias("book_sections"), F.col("number").alias("page_start"), (F.col("number") + 2).alias("page_end"), F.when(F.col("number") % 2 == 0, "high").otherwise("medium").alias("confidence"))
    filled = P.fill_alignments(rows.select("deck_id", "section_index").distinct(), given)
    return filled.select("deck_id", "section_index", F.array_join("book_sections", ",").alias("book_sections"), "page_start", "page_end", "confidence")


def alignment_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir).select("deck_id", F.col("number").alias("section_index"), F.array(F.lit("Part"), F.col("number").cast("string")).alias("book_sections"), F.when(F.col("number") % 3 != 0, F.col("number") * 2).alias("page_start"), (F.col("number") * 2 + 5).alias("page_end"))
    return R.alignment_note(rows)


def deck_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir).withColumn("is_visual", F.when(F.col("number") % 5 != 0, F.col("is_visual")))
    return S.inspect_deck(rows.where("number % 4 != 0").withColumn("section_index", F.expr("number div 3")), rows)


def request_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = section_request_rows(spark, sf_dir)
    shown = R.preview_request(made.select("deck_id", "section_index", "request", "raw_text"), {"request": F.col("request"), "slides": F.col("raw_text"), "none": F.lit(None).cast("string")})
    return shown.select("deck_id", "section_index", "request_tokens", "slides_tokens", "none_tokens", "total_tokens")


def average_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.average_chunk(chunk_pages(spark, sf_dir)).select("book_id", F.round("avg_chunk", 6).alias("avg_chunk"), E.exam_size_guess(F.length("book_id") * 7001).alias("guess"))


def extracted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions from every deck's titles, excerpts and paper; every third deck has a paper of numbered lines."""
    rows = slides(spark, sf_dir).withColumn("is_divider", F.col("number") % 4 == 3)
    lines = F.concat(F.lit("intro\n1. first "), F.col("deck_id").cast("string"), F.lit("\n  2) second\nQ3 third\nnone"))
    exams = rows.select("deck_id").distinct().where("deck_id % 3 = 0").select("deck_id", lines.alias("exam_text"))
    made = P.extractive_questions(rows, _offered(spark, sf_dir, ["deck_id"]).where("deck_id % 2 = 0"), exams)
    return made.select("deck_id", "number", "kind", "topic", F.array_join(F.col("slides").cast("array<string>"), ",").alias("slides"), "prompt", F.size("choices").alias("choices"), F.md5("solution").alias("solution"), F.array_join("citations", "|").alias("citations"), "modeled_on")


def practice_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each deck's exam came about: every fifth has no paper, every seventh no question."""
    decks = slides(spark, sf_dir).select("deck_id").distinct()
    exams = decks.where("deck_id % 5 != 4").select("deck_id", F.when(F.col("deck_id") % 5 == 3, "  ").otherwise("Paper").alias("exam_text"))
    return P.practice_status(decks, exams, _questions(spark, sf_dir).withColumnRenamed("exam_id", "deck_id").where("deck_id % 7 != 6"))


def quoted_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit's quotes: of the questions that name a model, those whose words aren't in the paper."""
    q = _questions(spark, sf_dir)
    exams = q.select("exam_id").distinct().select("exam_id", F.concat(F.lit("Paper: Old question "), F.when(F.col("exam_id") % 2 == 1, "5").otherwise("7")).alias("exam_text"))
    none = slides(spark, sf_dir).where("false").select(F.col("deck_id").alias("document_id"), F.col("number").alias("section_index"), F.col("title").alias("markdown"), F.col("title").alias("citation"))
    found = X.grounding_audit(none.drop("citation"), none.drop("markdown"), none.select("document_id", F.col("citation").alias("number")), q, exams)
    return found.select("document_id", "section_index", "problem", "value")


def log_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage of orders' logs: line items are lines, whose number says how deep and in what their usage stands."""
    items = table(spark, sf_dir, "lineitem")
    use = F.format_string('{"input_tokens": %d, "output_tokens": %d, "cached_input_tokens": %d}', "l_partkey", "l_suppkey", "l_linenumber")
    other = F.format_string('{"output_tokens": %d, "x": null, "input_tokens": %d, "cache_read_input_tokens": 7}', "l_suppkey", "l_partkey")
    shapes = [
        F.concat(F.lit('{"type": "a", "usage": '), use, F.lit("}")),
        F.concat(F.lit('{"z": {"y": {"x": {"w": {"v": '), use, F.lit('}}}}, "a": 1}')),
        F.concat(F.lit('[1, "s", [{"k": '), use, F.lit('}, {"last": '), other, F.lit("}]]")),
        F.concat(F.lit('{"b": '), use, F.lit(', "a": '), other, F.lit("}")),
        F.concat(F.lit('{"text": "{\\"input_tokens\\": 1, \\"output_tokens\\": 2}"}')),
        F.concat(F.lit("not json "), use),
        F.concat(F.lit('{"input_tokens": null, "output_tokens": 4, "inner": {"input_tokens": 5}}')),
    ]
    lines = items.select(F.col("l_orderkey").alias("log_id"), F.expr("l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey").alias("line_no"), F.element_at(F.array(*shapes), ((F.col("l_partkey") % 7) + 1).cast("int")).alias("line"))
    return E.usage_of_logs(lines)


def material_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as uploads of several kinds, names, contents and sizes."""
    key = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("lecture", "book", "exam", "slide"))), (key % 4 + 1).cast("int"))
    name = F.concat(F.lit("f"), key.cast("string"), F.when(key % 5 == 0, ".txt").when(key % 5 == 1, ".PDF").otherwise(".pdf"))
    content = F.when(key % 6 == 0, "%PNG-1").otherwise("%PDF-1.7").cast("binary")
    size = F.when(key % 7 == 0, 0).when(key % 7 == 1, None).otherwise(key * 1000)
    limit = 1_500_000
    return table(spark, sf_dir, "part").select("p_partkey", tables.reject_reason(kind, name, content, size, ["lecture", "book", "exam"], limit).alias("error"))


def slide_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Body, fragments and looks of every turn as a slide, and whether a retry of its failed parts is on offer."""
    rows = slides(spark, sf_dir).withColumn("lines", T.clean_lines(F.concat_ws("\n", "title", "text")))
    n = F.col("number")
    failed = F.when(n % 3 == 0, F.array(n)).otherwise(F.array().cast("array<int>"))
    return rows.select("deck_id", "number", F.md5(T.slide_body(F.col("lines"), T.py_strip(F.col("title")))).alias("body"), F.size("lines").alias("n_lines"), N.is_visual(n % 4 - 2, n * 4, F.col("lines"), F.lit(0.6)).alias("visual"), N.can_retry(failed, n % 2 == 0).alias("retry"))


QUERIES = {
    "expanded_sections": expanded_sections, "retried_sections": retried_sections, "default_cards": default_cards, "default_alignments": default_alignments, "alignment_notes": alignment_notes, "deck_profiles": deck_profiles,
    "request_previews": request_previews, "average_chunks": average_chunks, "extracted_questions": extracted_questions, "practice_states": practice_states, "quoted_questions": quoted_questions, "log_usage": log_usage,
    "material_rejects": material_rejects, "slide_flags": slide_flags,
}

_MADE = EXPORTS_SQL["section_requests"].replace(f"with {SLIDES_SQL}", "", 1)
_ASKED = f"with {SLIDES_SQL}, r as ({_MADE}), a as (select r.*, length(request) as n, s.title from r join slides s on s.deck_id = r.deck_id and s.number = r.section_index)"

ORACLE_SQL = {
    "expanded_sections": f"""{_ASKED}
select deck_id, section_index, case when section_index % 3 <> 0 then title else '' end as title, case when n % 9 = 0 then '' else '## ' || n || ' characters' end as markdown, case when section_index % 2 = 0 then 'Part, p. ' || section_index else '' end as citations,
    section_index as slide_first, section_index as slide_last, case when n % 9 = 0 then 'ValueError: no answer to ' || n end as error, case when n % 9 = 0 then 0 else n // 4 end as input_tokens, cast(n % 9 <> 0 as bigint) as calls from a
""",
    "retried_sections": f"""{_ASKED}
select deck_id as document_id, section_index, case when n % 9 <> 0 then '## ' || n || ' characters' when n % 2 = 1 then '## Again ' || n else '' end as markdown, case when n % 9 = 0 and n % 2 = 0 then 'ValueError: no answer to ' || n end as error from a
""",
    "default_cards": f"""
with {SLIDES_SQL}, s as (select distinct deck_id, (number - 1) % 3 as section_index from slides),
g as (select deck_id, (number - 1) % 3 as section_index, max(number) as seq, arg_max(title, number) as title from slides where number % 4 <> 3 and (number - 1) % 3 < 2 group by all),
f as (select s.*, coalesce(title, 'Section ' || (s.section_index + 1)) as title, seq from s left join g on g.deck_id = s.deck_id and g.section_index = s.section_index)
select deck_id, section_index, title, case when seq is null then '' else 'term,' || seq end as key_terms, 0 as formulas, case when seq is null then '' else 'gap' end as gaps, title || case when seq is null then '' else ' term ' || seq || ' gap' end as query from f
""",
    "default_alignments": f"""
with {SLIDES_SQL}, s as (select distinct deck_id, (number - 1) % 3 as section_index from slides),
g as (select deck_id, (number - 1) % 3 as section_index, max(number) as seq from slides where number % 4 <> 3 and (number - 1) % 3 < 2 group by all)
select s.deck_id, s.section_index, case when seq is null then '' else 'Part,' || seq end as book_sections, seq as page_start, seq + 2 as page_end, case when seq is null then 'low' when seq % 2 = 0 then 'high' else 'medium' end as confidence
from s left join g on g.deck_id = s.deck_id and g.section_index = s.section_index
""",
    "alignment_notes": f"with {SLIDES_SQL} select deck_id, string_agg('- Section ' || number || ': Part, ' || number || ' (p. ' || number * 2 || '-' || (number * 2 + 5) || ')', chr(10) order by number) as note from slides where number % 3 <> 0 group by deck_id",
    "deck_profiles": f"with {SLIDES_SQL} select deck_id, count(*) as slides, count(*) filter (where is_visual and number % 5 <> 0) as visual_slides, count(distinct case when number % 4 <> 0 then number // 3 end) as sections from slides group by deck_id",
    "request_previews": f"""{_ASKED}, t as (select a.*, cast(floor(n / 3.5) as integer) as request_tokens, cast(floor(length('--- Slide ' || number || case when s.title <> '' then ': ' || s.title else '' end || ' ---' || chr(10) || text) / 3.5) as integer) as slides_tokens from a join slides s on s.deck_id = a.deck_id and s.number = a.section_index)
select deck_id, section_index, request_tokens, slides_tokens, 0 as none_tokens, request_tokens + slides_tokens as total_tokens from t
""",
    "average_chunks": f"with recursive {CHUNKS_SQL} select book_id, round(coalesce(nullif(avg(token_estimate), 0.0), 900.0), 6) as avg_chunk, cast(least(length(book_id) * 7001 // 3, 20000) as integer) as guess from chunks group by book_id",
    "extracted_questions": rf"""
with {SLIDES_SQL}, w as (select deck_id, number, title, row_number() over (partition by deck_id order by number) - 1 as i, count(*) over (partition by deck_id) as n from slides where number % 4 <> 3 and trim(title, ' ') <> ''),
c as (select deck_id, number, title, row_number() over (partition by deck_id order by number) - 1 as i, count(*) over (partition by deck_id) as m from slides where deck_id % 2 = 0),
p as (select deck_id, ['1. first ' || deck_id, '2) second', 'Q3 third'] as source from (select distinct deck_id from slides) where deck_id % 3 = 0),
t as (select w.*, c.number as chunk, c.title as chunk_text, p.source from w left join c on c.deck_id = w.deck_id and c.i = w.i % c.m left join p on p.deck_id = w.deck_id where w.i < least(4, w.n))
select deck_id, cast(i + 1 as integer) as number, case when i % 2 = 0 then 'multiple choice' else 'calculation' end as kind, title as topic, cast(number as varchar) as slides, 'Explain what slide ' || number || ' says about ' || title || '.' as prompt,
    case when i % 2 = 0 then 4 else 0 end as choices, md5(case when chunk is null then '' else left(trim(regexp_replace(chunk_text, '\s+', ' ', 'g')), 260) || '…' end) as solution, case when chunk is null then '' else 'Part, p. ' || chunk end as citations, coalesce(source[i % 3 + 1], '') as modeled_on from t
""",
    "practice_states": f"""
with {SLIDES_SQL}, d as (select deck_id, count(*) filter (where deck_id % 7 <> 6) as questions, case when deck_id % 5 in (3, 4) then 'the exam has no text' when deck_id % 7 = 6 then 'no question was produced' end as error from slides group by deck_id)
select deck_id, case when error is null then 'ok' else 'failed' end as status, error, questions from d
""",
    "quoted_questions": f"""
with {SLIDES_SQL}, q as (select deck_id, number, 'Old question ' || number as quote, 'Paper: Old question ' || case when deck_id % 2 = 1 then '5' else '7' end as paper from slides where number % 5 = 0)
select deck_id as document_id, number as section_index, 'quote not in exam' as problem, ' ' || quote || ' ' as value from q where not contains(paper, quote)
""",
    "log_usage": """
with l as (select distinct l_orderkey as log_id, l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey as line_no, l_linenumber as place, l_partkey % 7 as shape, l_partkey as p, l_suppkey as s from lineitem),
h as (select log_id, line_no, shape, case when shape = 6 then 0 else p end as input_tokens, case when shape = 6 then 4 else s end as output_tokens, case when shape in (0, 1) then place when shape = 6 then 0 else 7 end as cache_read_tokens from l where shape not in (4, 5)),
b as (select log_id, max(line_no) as line_no from h group by log_id)
select o.log_id, cast(coalesce(input_tokens, 0) as bigint) as input_tokens, cast(coalesce(output_tokens, 0) as bigint) as output_tokens, cast(coalesce(cache_read_tokens, 0) as bigint) as cache_read_tokens, cast(1 as bigint) as calls
from (select distinct log_id from l) o left join b on b.log_id = o.log_id left join h on h.log_id = b.log_id and h.line_no = b.line_no
""",
    "material_rejects": """
with u as (select p_partkey, p_partkey % 4 = 3 as odd_kind, p_partkey % 5 = 0 as odd_name, case when p_partkey % 7 in (0, 1) then 0 else p_partkey * 1000 end as size, p_partkey % 6 = 0 as odd_content from part)
select p_partkey, case when odd_kind then 'unknown kind' when odd_name then 'not a .pdf name' when size = 0 then 'empty file' when size > 1500000 then 'too large' when odd_content then 'not a PDF' end as error from u
""",
}
