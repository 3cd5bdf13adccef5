"""Calibration and projection over events and conversations, and assembled texts of decks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import estimate as E
from scholia.operators import results as X
from scholia.operators import sections as S
from scholia.plans import requests as R

from .roles import SLIDES_SQL, slides, table

_PRICES = [("small", 1.0, 5.0), ("large", 3.0, 15.0)]


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    backend = F.element_at(F.create_map(*[F.lit(x) for x in ("view", "api", "click", "cli", "signup", "codex", "purchase", "demo", "error", "none")]), F.col("event_type"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), backend.alias("backend"), F.when(F.col("event_id") % 3 == 0, "practice").otherwise("note").alias("kind"), F.col("value").alias("duration"), (F.col("event_id") % 7).alias("sections"), F.col("ts").alias("created_at"))


def recent_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.seconds_per_section(E.section_seconds(_runs(spark, sf_dir))).select("backend", F.round("seconds", 6).alias("seconds"), "source")


def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length(F.coalesce("text", F.lit("")))
    calls = table(spark, sf_dir, "conversations").select("conv_id", F.when(F.col("conv_id") % 3 == 0, "small").when(F.col("conv_id") % 3 == 1, "large").otherwise("other").alias("model"), (n * 4).alias("input_tokens"), n.alias("output_tokens"), (n * 2).alias("cache_creation_tokens"), (n * 8).alias("cache_read_tokens"), F.lit(1).alias("calls"))
    costed = E.usage_costs(E.usage_totals(calls, "conv_id", "model"), spark.createDataFrame(_PRICES, "model string, input_price double, output_price double"))
    return costed.select("conv_id", "model", "input_tokens", "output_tokens", "calls", F.round("cost", 9).alias("cost"))


def _decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir)
    return rows.groupBy("deck_id").agg(F.count("*").alias("sections"), F.sum(T.estimate_tokens(F.col("text"))).alias("section_tokens"), F.sum(T.estimate_tokens(F.col("text")) + T.estimate_tokens(F.col("title"))).alias("slide_tokens"), F.count_if("is_visual").alias("visual_slides")).withColumn(
        "backend", F.element_at(F.array(*map(F.lit, ("api", "cli", "codex", "demo"))), (F.col("deck_id") % 4 + 1).cast("int"))
    )


def project_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = _decks(spark, sf_dir).select("*", F.when(F.col("deck_id") % 2 == 0, 3).alias("limit_sections"), (F.col("slide_tokens") + 100).alias("context_tokens"), F.lit(500).alias("system_tokens"), (F.col("deck_id") * 300).alias("exam_chars"), F.lit(1500.0).alias("image_tokens"), F.when(F.col("deck_id") % 3 == 0, 812.5).alias("avg_chunk"), (F.col("deck_id") % 5 == 0).alias("figures"))
    return E.project_notes(decks, E.seconds_per_section(E.section_seconds(_runs(spark, sf_dir)))).select("deck_id", "backend", "n", "prefix", "cache_read", "retrieval", "images", "section_text", "output", F.round("seconds", 6).alias("seconds"), "seconds_source", "cost", "no_cache_cost")


def project_practice(spark: SparkSession, sf_dir: str) -> DataFrame:
    decks = _decks(spark, sf_dir).select("*", (F.col("deck_id") % 3 * 5).alias("count"), F.lit(700).alias("system_tokens"), (F.col("deck_id") * 300).alias("exam_chars"), F.when(F.col("deck_id") % 3 == 0, 812.5).alias("avg_chunk"), (F.col("deck_id") % 5 == 0).alias("figures"))
    return E.project_practice(decks, E.section_seconds(_runs(spark, sf_dir))).select("deck_id", "backend", "questions", "input", "output", F.round("seconds", 6).alias("seconds"), "seconds_source", "cost")


def request_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir).withColumn("is_divider", F.col("number") % 4 == 3)
    titles = rows.where("number = 1").select("deck_id", F.concat(F.lit("Deck "), F.col("deck_id").cast("string")).alias("title"))
    return R.lecture_context(rows, S.build_sections(rows), titles)


def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slides(spark, sf_dir)
    failed = F.when(F.col("number") % 3 == 0, "RuntimeError: no answer")
    markdown = F.concat(F.lit("## "), "title", F.lit("\n[B: Part, p. "), F.col("number").cast("string"), F.lit("] [S: 1, "), F.col("number").cast("string"), F.lit("]\n[BOOKFIGURE: 1."), F.col("number").cast("string"), F.lit(".]"))
    return rows.select(F.col("deck_id").alias("document_id"), F.col("number").alias("section_index"), "title", markdown.alias("markdown"), F.col("number").alias("slide_first"), F.col("number").alias("slide_last"), failed.alias("error"))


def notes_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    docs = sections.select("document_id").distinct().withColumn("title", F.concat(F.lit("Deck "), F.col("document_id").cast("string")))
    return X.notes_markdown(docs, sections)


def citation_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = _sections(spark, sf_dir).select("document_id", "section_index", T.citation_refs(F.col("markdown")).alias("c"), T.figure_refs(F.col("markdown")).alias("figures"))
    return refs.select("document_id", "section_index", F.array_join("c.book", "|").alias("labels"), F.array_join(F.transform("c.slides", lambda n: n.cast("string")), ",").alias("slides"), F.array_join("figures", ",").alias("figures"))


def grounding_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    offered = sections.where("section_index % 2 = 0").select("document_id", "section_index", F.concat(F.lit("Part, p. "), F.col("section_index").cast("string")).alias("citation"))
    figures = sections.where("section_index <= 3").select("document_id", F.concat(F.lit("1."), F.col("section_index").cast("string")).alias("number"))
    return X.grounding_audit(sections, offered, figures)


def retry_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    sections = _sections(spark, sf_dir)
    again = sections.where("error is not null").withColumn("markdown", F.lit("## again")).withColumn("error", F.when(F.col("document_id") % 2 == 0, F.col("error")))
    return X.merge_retry(sections, again).select("document_id", "section_index", "markdown", "error")


def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = X.document_facts(_sections(spark, sf_dir))
    return facts.select("document_id", "ok_sections", "first_slide", "last_slide", F.array_join(F.transform("failed", lambda n: n.cast("string")), ",").alias("failed"))


def questions_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation gives an exam of one question for each turn; some have a bad slide list, no number, or a blank prompt."""
    t = slides(spark, sf_dir)
    prompt = F.when(F.col("number") % 5 == 0, F.lit("  ")).otherwise(F.concat(F.lit("Q"), F.col("number").cast("string")))
    item = F.concat(
        F.lit('{"prompt":"'), prompt, F.lit('","points":"'), F.col("number").cast("string"), F.lit('",'), F.when(F.col("number") % 3 == 0, F.lit('"slides":"x"')).otherwise(F.concat(F.lit('"slides":['), F.col("number").cast("string"), F.lit("]"))),
        F.when(F.col("number") % 7 == 0, F.lit("}")).otherwise(F.lit(',"number":4}')),
    )
    parts = t.groupBy("deck_id").agg(F.array_sort(F.collect_list(F.struct("number", item.alias("item")))).alias("p"))
    raw = parts.select(F.col("deck_id").alias("exam_id"), F.concat(F.lit('Here it is: {"questions":['), F.array_join(F.transform("p", lambda x: x["item"]), ","), F.lit("]} done")).alias("json"))
    return X.coerce_questions(raw).select("exam_id", "number", "points", "prompt", F.array_join(F.transform("slides", lambda n: n.cast("string")), ",").alias("slides"))


QUERIES = {
    "recent_median": recent_median, "token_cost": token_cost, "project_notes": project_notes, "project_practice": project_practice, "request_assembly": request_assembly, "notes_markdown": notes_markdown,
    "citation_refs": citation_refs, "grounding_audit": grounding_audit, "retry_merge": retry_merge, "document_facts": document_facts, "questions_coerce": questions_coerce,
}

_RUNS = """runs as (
    select event_id as id, case event_type when 'view' then 'api' when 'click' then 'cli' when 'signup' then 'codex' when 'purchase' then 'demo' when 'error' then 'none' end as backend,
        case when event_id % 3 = 0 then 'practice' else 'note' end as kind, value as duration, event_id % 7 as sections, ts as created_at from events
), latest as (select *, duration / sections as seconds, row_number() over (partition by backend, kind order by created_at desc, id desc) as n from runs where duration > 0 and sections > 0),
known as (select * from (values ('api', 30.0, 75.0), ('cli', 190.0, 260.0), ('codex', 190.0, 260.0), ('demo', 1.0, 2.0)) t(backend, fallback, practice)),
med as (select backend, kind, median(seconds) as m from latest where n <= 10 group by backend, kind),
timing as (select k.backend, coalesce(m, cast(fallback as double)) as seconds, case when m is not null then 'history' else 'estimate' end as source from known k left join med on med.backend = k.backend and med.kind = 'note')"""

_DECKS = """decks as (
    select deck_id, count(*) as sections, cast(sum(floor(length(text) / 3.5)) as bigint) as section_tokens, cast(sum(floor(length(text) / 3.5) + floor(length(title) / 3.5)) as bigint) as slide_tokens,
        count(*) filter (where is_visual) as visual_slides, case deck_id % 4 when 0 then 'api' when 1 then 'cli' when 2 then 'codex' else 'demo' end as backend from slides group by deck_id)"""

_SECTIONS = """sec as (
    select deck_id as document_id, number as section_index, title, '## ' || title || chr(10) || '[B: Part, p. ' || number || '] [S: 1, ' || number || ']' || chr(10) || '[BOOKFIGURE: 1.' || number || '.]' as markdown,
        case when number % 3 = 0 then 'RuntimeError: no answer' end as error from slides)"""

ORACLE_SQL = {
    "recent_median": f"with {_RUNS} select backend, round(seconds, 6) as seconds, source from timing",
    "token_cost": """
with u as (select conv_id, case conv_id % 3 when 0 then 'small' when 1 then 'large' else 'other' end as model, cast(sum(length(coalesce(text, ''))) as bigint) as n, count(*) as calls from conversations group by conv_id),
p as (select *, case model when 'small' then 1.0 when 'large' then 3.0 else 0.0 end as i, case model when 'small' then 5.0 when 'large' then 15.0 else 0.0 end as o from u)
select conv_id, model, n * 4 as input_tokens, n as output_tokens, calls, round(cast(n * 4 * i + n * 2 * i * 1.25 + n * 8 * i * 0.1 + n * o as double) / 1e6, 9) as cost from p
""",
    "project_notes": f"""
with {SLIDES_SQL}, {_RUNS}, {_DECKS},
a as (select d.*, t.seconds as per, t.source, greatest(1, least(sections, case when deck_id % 2 = 0 then 3 else sections end)) as n, slide_tokens + 100 as ctx, case when deck_id % 3 = 0 then 812.5 end as avg_chunk from decks d left join timing t on t.backend = d.backend),
b as (select *, ctx + 500 + cast(floor(least(deck_id * 300, 20000) / 3.5) as bigint) as prefix, cast(6 * coalesce(avg_chunk, 900.0) * n as double) as retrieval, cast(visual_slides * 1500.0 as double) as images, cast(n * 3000 as double) as output from a),
c as (select *, (prefix * 1.25 * 3.0 + prefix * (n - 1) * 0.1 * 3.0 + (images + retrieval + section_tokens) * 3.0 + output * 15.0 + (ctx + 8000) * 1.0 + 4000 * 5.0) / 1e6 as cost0, ((prefix * n + images + retrieval + section_tokens) * 3.0 + output * 15.0) / 1e6 as plain0 from b)
select deck_id, backend, n, prefix, cast(prefix * (n - 1) as double) as cache_read, retrieval, images, cast(section_tokens as double) as section_text, output,
    round(per * n + case when avg_chunk is not null then 0.0 else 25.0 + case when deck_id % 5 = 0 then 95.0 else 0.0 end end, 6) as seconds, source as seconds_source,
    cast(case when backend in ('cli', 'codex', 'demo') then 0.0 else round(cast(cost0 as double), 3) end as double) as cost, cast(case when backend = 'demo' then 0.0 else round(cast(plain0 as double), 3) end as double) as no_cache_cost from c
""",
    "project_practice": f"""
with {SLIDES_SQL}, {_RUNS}, {_DECKS},
a as (select d.*, m.m, k.practice, case when deck_id % 3 * 5 > 0 then deck_id % 3 * 5 else 8 end as questions, case when deck_id % 3 = 0 then 812.5 end as avg_chunk from decks d left join med m on m.backend = d.backend and m.kind = 'practice' left join known k on k.backend = d.backend),
b as (select *, cast(700 + slide_tokens + floor(least(deck_id * 300, 20000) / 3.5) + least(2 * sections, 24) * coalesce(avg_chunk, 900.0) as double) as input, cast(questions * 420 as double) as output from a)
select deck_id, backend, questions, input, output, round(cast(coalesce(m * questions, practice, 75.0) as double) + case when avg_chunk is not null then 0.0 else 25.0 + case when deck_id % 5 = 0 then 95.0 else 0.0 end end, 6) as seconds,
    case when m is not null then 'history' else 'estimate' end as seconds_source, cast(case when backend in ('cli', 'codex', 'demo') then 0.0 else round((input * 3.0 + output * 15.0 + (slide_tokens + 8000) * 1.0 + 4000 * 5.0) / 1e6, 3) end as double) as cost from b
""",
    "request_assembly": f"""
with {SLIDES_SQL}, g as (select *, number % 4 = 3 as is_divider, sum(case when number % 4 = 3 then 1 else 0 end) over (partition by deck_id order by number) as gap from slides),
c as (select deck_id, count(*) as slides, count(distinct case when not is_divider then gap end) as sections,
    string_agg('### Slide ' || number || ': ' || title || case when is_divider then ' [AGENDA]' else '' end || case when text <> '' then chr(10) || text else '' end || chr(10), chr(10) order by number) as body from g group by deck_id)
select deck_id, '# COURSE: Deck ' || deck_id || chr(10) || slides || ' slides, ' || sections || ' sections.' || chr(10) || chr(10) || '## Lecture' || chr(10) || chr(10) || body as context from c
""",
    "notes_markdown": f"""
with {SLIDES_SQL}, {_SECTIONS}
select document_id, '# Deck ' || document_id || chr(10) || chr(10) || string_agg(case when error is not null then '## ' || title || chr(10) || '> ⚠️ This section could not be generated (' || error || '). Slides ' || section_index || '-' || section_index || '.' || chr(10)
    else markdown || chr(10) end, chr(10) order by section_index) as markdown from sec group by document_id
""",
    "citation_refs": f"with {SLIDES_SQL} select deck_id as document_id, number as section_index, 'Part, p. ' || number as labels, '1,' || number as slides, '1.' || number as figures from slides",
    "grounding_audit": f"""
with {SLIDES_SQL}
select deck_id as document_id, number as section_index, 'citation not offered' as problem, 'Part, p. ' || number as value from slides where number % 2 = 1
union all select deck_id, number, 'unknown figure', '1.' || number from slides where number > 3
""",
    "retry_merge": f"with {SLIDES_SQL}, {_SECTIONS} select document_id, section_index, case when error is not null and document_id % 2 <> 0 then '## again' else markdown end as markdown, case when document_id % 2 = 0 then error end as error from sec",
    "document_facts": f"""
with {SLIDES_SQL}, {_SECTIONS} select document_id, count(*) filter (where error is null) as ok_sections, min(section_index) as first_slide, max(section_index) as last_slide,
    coalesce(string_agg(case when error is not null then cast(section_index as varchar) end, ',' order by section_index), '') as failed from sec group by document_id
""",
    "questions_coerce": f"""
with {SLIDES_SQL} select deck_id as exam_id, cast(row_number() over (partition by deck_id order by number) as integer) as number, number as points, 'Q' || number as prompt, cast(number as varchar) as slides
from slides where number % 5 <> 0 and number % 3 <> 0 and number % 7 <> 0
""",
}
