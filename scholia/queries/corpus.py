"""Text functions over whole documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import chunks as C

from .roles import NORMALIZED, PAGES_SQL, SCRUBBED, pages, table


def normalize_scrub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clean = T.scrub_artifacts(T.normalize_text(F.coalesce("text", F.lit(""))))
    return docs.select("doc_id", clean.alias("clean")).select("doc_id", F.md5(F.col("clean").cast("binary")).alias("digest"), F.length("clean").alias("n_chars"), T.estimate_tokens(F.col("clean")).alias("tokens"))


def query_terms_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.query_terms_or(F.coalesce("text", F.lit("")))).alias("at", "term"))
    return rows.select("doc_id", (F.col("at") + 1).alias("position"), "term")


def query_terms_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.query_terms_and_prefix(F.coalesce("text", F.lit("")))).alias("at", "t"))
    return rows.select("doc_id", (F.col("at") + 1).alias("position"), "t.term", "t.is_prefix")


def clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", T.clean_lines(F.coalesce("text", F.lit(""))).alias("lines"))
    return lines.select("doc_id", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n").cast("binary")).alias("digest"), F.round(T.fragment_ratio(F.col("lines")), 9).alias("fragments"))


def looks_scanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.looks_scanned(pages(spark, sf_dir).select("book_id", "page_no", "text"), least=2000.0)


def content_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.substring_index(F.coalesce("text", F.lit("")), "\n", 1)
    docs = table(spark, sf_dir, "documents").select("doc_id", first.alias("title"), T.citation_label(F.col("source"), F.col("doc_id"), F.col("doc_id") + F.col("n_chars") % 3).alias("citation"))
    return docs.select("doc_id", T.is_content_section(F.col("title")).alias("is_content"), T.is_agenda_title(F.col("title")).alias("is_agenda"), "citation", T.html_escape(F.col("title")).alias("escaped"))


QUERIES = {
    "normalize_scrub": normalize_scrub, "query_terms_or": query_terms_or, "query_terms_and": query_terms_and, "clean_lines": clean_lines,
    "looks_scanned": looks_scanned, "content_headings": content_headings,
}

_WORDS = r"list_filter(string_split_regex(regexp_replace(coalesce(text, ''), '[^\p{L}\p{N}\p{M}_\s]', ' ', 'g'), '\s+'), lambda w: w <> '')"

ORACLE_SQL = {
    # the glued-mark step needs a lookbehind, which RE2 lacks: no document has three such marks, and a unit test covers the step
    "normalize_scrub": f"""
with n as (select doc_id, {NORMALIZED.format("coalesce(text, '')")} as t from documents),
s as (select doc_id, {SCRUBBED.format("t")} as clean from n)
select doc_id, md5(clean) as digest, cast(length(clean) as integer) as n_chars, cast(floor(length(clean) / 3.5) as integer) as tokens from s
""",
    "query_terms_or": f"""
with w as (select doc_id, list_transform(list_filter({_WORDS}, lambda w: length(w) > 1), lambda w: lower(w)) as words from documents),
u as (select doc_id, unnest(words) as term, generate_subscripts(words, 1) as i from w),
f as (select doc_id, term, min(i) as i from u group by doc_id, term),
r as (select doc_id, term, cast(row_number() over (partition by doc_id order by i) as integer) as position from f)
select doc_id, position, term from r where position <= 24
""",
    "query_terms_and": f"""
with w as (select doc_id, list_filter(list_transform({_WORDS}, lambda w: lower(w)), lambda w: length(w) > 1) as words from documents),
u as (select doc_id, unnest(words) as term, generate_subscripts(words, 1) as i from w),
f as (select doc_id, term, min(i) as i from u group by doc_id, term),
r as (select doc_id, term, cast(row_number() over (partition by doc_id order by i) as integer) as position from f)
select doc_id, position, term, position = max(position) over (partition by doc_id) as is_prefix from r where position <= 12
""",
    "clean_lines": r"""
with l as (
    select doc_id, list_filter(list_transform(string_split(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13))),
        lambda x: x <> '' and not regexp_matches(lower(x), '^(carnegie mellon|bryant and o.?hallaron|computer systems:.*|\d{1,3})$')) as lines from documents
)
select doc_id, cast(len(lines) as integer) as n_lines, md5(array_to_string(lines, chr(10))) as digest,
    round(case when len(lines) = 0 then 0.0 else cast(len(list_filter(lines, lambda x: length(x) <= 6)) as double) / len(lines) end, 9) as fragments from l
""",
    "looks_scanned": f"""
with {PAGES_SQL}, c as (select book_id, max(page_no) as n from pages group by book_id),
s as (select p.book_id, p.page_no, length(p.text) as size, greatest(1, n // 40) as step from pages p join c on p.book_id = c.book_id)
select book_id, avg(size) < 2000.0 as scanned from s where (page_no - 1) % step = 0 and (page_no - 1) // step < 40 group by book_id
""",
    "content_headings": r"""
with t as (select doc_id, source, n_chars, split_part(coalesce(text, ''), chr(10), 1) as title from documents)
select doc_id, not regexp_matches(lower(title), '^\s*(contents|index|bibliography|preface|about the authors?|copyright|title page|cover|dedication|acknowledg\w*|list of (figures|tables)|references)\b') as is_content,
    regexp_matches(lower(title), '^\s*(today|outline|agenda|roadmap|plan|bugün|i̇çerik)[:\s]') as is_agenda,
    source || ', p. ' || case when n_chars % 3 = 0 then cast(doc_id as varchar) else cast(doc_id as varchar) || '-' || cast(doc_id + n_chars % 3 as varchar) end as citation,
    replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') as escaped from t
""",
}
