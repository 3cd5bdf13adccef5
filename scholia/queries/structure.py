"""Sections, runs, chunks and decks over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.operators import chunks as C
from scholia.operators import layout as L
from scholia.operators import sections as S
from scholia.plans import requests as R

from .roles import NORMALIZED, OUTLINE_SQL, PAGES_SQL, SCRUBBED, SLIDES_SQL, long_slides, outline, page_counts, pages, slides, table


def outline_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir).drop("text")
    return S.outline_ranges(outline(p), page_counts(p)).select("book_id", F.col("ordinal").cast("int").alias("ordinal"), "title", "level", "page_start", "page_end")


def page_section_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.page_section_map(outline_ranges(spark, sf_dir))


def section_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.section_runs(pages(spark, sf_dir), page_section_map(spark, sf_dir)).select("book_id", "page_no", "section_title", "run_id")


def chunk_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.chunk_pages(pages(spark, sf_dir).select("book_id", "page_no", "text"), outline_ranges(spark, sf_dir))


def toc_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.toc_outline(outline_ranges(spark, sf_dir), max_level=1, limit=5)


def mark_dividers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.mark_dividers(slides(spark, sf_dir)).select("deck_id", "number", "is_divider")


def build_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.build_sections(S.mark_dividers(long_slides(spark, sf_dir)))
    return built.select("deck_id", "section_index", "number", F.length("agenda_context").alias("agenda_chars"))


def merge_tiny(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.merge_tiny(S.build_sections(S.mark_dividers(long_slides(spark, sf_dir))), min_slides=5)
    return built.select("deck_id", "section_index", "number", F.length("agenda_context").alias("agenda_chars"))


def split_large(spark: SparkSession, sf_dir: str) -> DataFrame:
    built = S.split_large(S.build_sections(S.mark_dividers(long_slides(spark, sf_dir))), 3)
    return built.select("deck_id", "section_index", "number")


def fallback_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fallback_sections(S.mark_dividers(slides(spark, sf_dir)), 3).select("deck_id", "section_index", "number")


def section_decks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = S.deck_sections(S.section_deck(long_slides(spark, sf_dir)))
    return rows.select("deck_id", "section_index", "first_slide", "last_slide", F.size("slides").alias("n_slides"), F.length("raw_text").alias("raw_chars"), F.size("titles").alias("n_titles"))


def gap_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of a user's events: an event lasts ``value`` minutes, and a new burst begins after six hours of silence."""
    events = table(spark, sf_dir, "events").where("user_id is not null and ts is not null").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("begun"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 + 60 * F.coalesce("value", F.lit(0.0))).alias("ended"))
    clusters = L.gap_cluster(events, ["user_id"], "begun", "ended", gap=21600.0, min_objects=2, ties=("event_id",))
    return clusters.groupBy("user_id", "cluster_id").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event"))


QUERIES = {
    "outline_ranges": outline_ranges, "page_section_map": page_section_map, "section_runs": section_runs, "chunk_pages": chunk_pages, "toc_outline": toc_outline, "mark_dividers": mark_dividers,
    "build_sections": build_sections, "merge_tiny": merge_tiny, "split_large": split_large, "fallback_sections": fallback_sections, "section_decks": section_decks, "gap_cluster": gap_cluster,
}

_MAP = "covered as (select book_id, unnest(generate_series(page_start, page_end)) as page_no, title, level, ordinal from ranges where page_end >= page_start), pmap as (select book_id, page_no, title from (select *, row_number() over (partition by book_id, page_no order by level desc, ordinal desc) as n from covered) where n = 1)"

_LONG = r"""slides as (
    select book_id as deck_id, page_no as number, case when page_no % 9 = 5 then 'Today: next' else split_part(text, chr(10), 1) end as title, text from pages)"""

_DIVIDERS = r"""bodies as (select *, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body from slides),
marked as (select deck_id, number, title, text, regexp_matches(lower(title), '^\s*(today|outline|agenda|roadmap|plan|bugün|i̇çerik)[:\s]') or (length(body) > 40 and count(*) over (partition by deck_id, body) >= 2) as is_divider from bodies)"""

_BUILT = """gapped as (
    select *, sum(case when is_divider then 1 else 0 end) over (partition by deck_id order by number) as gap from marked
), agendas as (select deck_id, gap, text as agenda from gapped where is_divider),
built as (
    select g.deck_id, g.number, coalesce(a.agenda, '') as agenda, dense_rank() over (partition by g.deck_id order by g.gap) - 1 as section_index
    from gapped g left join agendas a on g.deck_id = a.deck_id and g.gap = a.gap where not g.is_divider)"""


def _long(rest: str) -> str:
    return f"with {PAGES_SQL}, {_LONG}, {_DIVIDERS}, {_BUILT} {rest}"


#: Chunks of all books: a recursive walk over each run's pages, in which the row of a page holds the open text after it and the chunk that it closed.
CHUNKS_SQL = rf"""{OUTLINE_SQL}, {_MAP},
normal as (select book_id, page_no, {NORMALIZED.format("text")} as t from pages),
clean as (select book_id, page_no, {SCRUBBED.format("t")} as text from normal),
j as (select p.book_id, p.page_no, p.text, m.title, f.title as first_title from clean p left join pmap m on p.book_id = m.book_id and p.page_no = m.page_no left join pmap f on p.book_id = f.book_id and f.page_no = 1 where p.text <> ''),
g as (select *, count(title) over (partition by book_id order by page_no) as grp from j),
s as (select book_id, page_no, text, coalesce(max(title) over (partition by book_id, grp), first_title, '') as section_title from g),
l as (select *, lag(section_title) over (partition by book_id order by page_no) as before from s),
r as (select *, sum(case when before is not null and before <> section_title then 1 else 0 end) over (partition by book_id order by page_no) as run_id from l),
n as (select *, row_number() over (partition by book_id, run_id order by page_no) as k, count(*) over (partition by book_id, run_id) as of from r),
e as (select book_id, run_id, min(section_title) as section_title, lead(min(page_no)) over (partition by book_id order by run_id) - 1 as ends from n group by book_id, run_id),
walk as (
    select book_id, run_id, cast(0 as bigint) as k, cast(null as varchar) as open, cast(0 as bigint) as size, cast(0 as integer) as since, cast(null as varchar) as made, cast(0 as integer) as made_from, cast(0 as integer) as made_to
    from e where not regexp_matches(lower(section_title), '^\s*(contents|index|bibliography|preface|about the authors?|copyright|title page|cover|dedication|acknowledg\w*|list of (figures|tables)|references)\b')
    union all
    select book_id, run_id, k, case when not full_now then longer when length(tidy) < 200 then null else right(tidy, 472) end, case when not full_now then size when length(tidy) < 200 then 0 else least(472, length(tidy)) end,
        case when full_now then page_no else since end, case when full_now and length(tidy) >= 200 then tidy end, since, page_no
    from (
        select *, size >= 3150 as full_now, {NORMALIZED.format("longer")} as tidy from (
            select n.book_id, n.run_id, n.k, n.page_no, concat_ws(chr(10), w.open, n.text) as longer, w.size + length(n.text) as size, case when w.open is null then n.page_no else w.since end as since
            from walk w join n on n.book_id = w.book_id and n.run_id = w.run_id and n.k = w.k + 1
        )
    )
), last as (select walk.*, {NORMALIZED.format("walk.open")} as tidy from walk where open is not null and k = (select max(of) from n where n.book_id = walk.book_id and n.run_id = walk.run_id)),
made as (
    select book_id, run_id, k as seq, made as text, made_from as page_start, made_to as page_end from walk where made is not null
    union all
    select t.book_id, t.run_id, t.k + 1, t.tidy, t.since, coalesce(e.ends, c.page_count) from last t join e on e.book_id = t.book_id and e.run_id = t.run_id join counts c on c.book_id = t.book_id where length(t.tidy) >= 200
), numbered as (select m.*, e.section_title, cast(row_number() over (partition by m.book_id order by m.run_id, m.seq) - 1 as integer) as chunk_no from made m join e on e.book_id = m.book_id and e.run_id = m.run_id),
chunks as (select book_id, 'c' || lpad(cast(chunk_no as varchar), 5, '0') as chunk_id, chunk_no, text, section_title, cast(page_start as integer) as page_start, cast(page_end as integer) as page_end, cast(floor(length(text) / 3.5) as integer) as token_estimate,
    section_title || ', p. ' || case when page_start = page_end then cast(page_start as varchar) else page_start || '-' || page_end end as citation from numbered)"""


ORACLE_SQL = {
    "outline_ranges": f"with {OUTLINE_SQL} select book_id, ordinal, title, level, page_start, page_end from ranges",
    "page_section_map": f"with {OUTLINE_SQL}, {_MAP} select book_id, cast(page_no as integer) as page_no, title from pmap",
    "section_runs": f"""
with {OUTLINE_SQL}, {_MAP},
j as (select p.book_id, p.page_no, m.title, f.title as first_title from pages p left join pmap m on p.book_id = m.book_id and p.page_no = m.page_no left join pmap f on p.book_id = f.book_id and f.page_no = 1 where p.text <> ''),
g as (select *, count(title) over (partition by book_id order by page_no) as grp from j),
s as (select book_id, page_no, coalesce(max(title) over (partition by book_id, grp), first_title, '') as section_title from g),
l as (select *, lag(section_title) over (partition by book_id order by page_no) as before from s)
select book_id, page_no, section_title, cast(sum(case when before is not null and before <> section_title then 1 else 0 end) over (partition by book_id order by page_no) as integer) as run_id from l
""",
    "chunk_pages": f"with recursive {CHUNKS_SQL} select * from chunks",
    "toc_outline": f"""
with {OUTLINE_SQL}, n as (select *, row_number() over (partition by book_id order by ordinal) as k from ranges where level <= 1)
select book_id, string_agg(repeat('  ', level) || title || '  (s. ' || page_start || '-' || page_end || ')', chr(10) order by k) as outline from n where k <= 5 group by book_id
""",
    "mark_dividers": f"with {SLIDES_SQL}, {_DIVIDERS} select deck_id, number, is_divider from marked",
    "build_sections": _long("select deck_id, cast(section_index as integer) as section_index, number, cast(length(agenda) as integer) as agenda_chars from built"),
    "merge_tiny": _long("""
, sizes as (select deck_id, section_index, count(*) as n, min(agenda) as agenda from built group by deck_id, section_index),
f as (select *, first_value(n) over (partition by deck_id order by section_index) as n0 from sizes),
o as (select *, section_index = 0 or (n >= 5 and not (section_index = 1 and n0 < 5)) as opens from f),
g as (select *, sum(case when opens then 1 else 0 end) over (partition by deck_id order by section_index) - 1 as grp from o),
a as (
    select deck_id, grp, arg_min(agenda, section_index) as lead_agenda, max(case when section_index = 1 and n >= 5 then agenda end) as second_agenda, min(n0) as n0 from g group by deck_id, grp
)
select b.deck_id, cast(g.grp as integer) as section_index, b.number, cast(length(case when g.grp = 0 and a.n0 < 5 and a.lead_agenda = '' and a.second_agenda is not null then a.second_agenda else a.lead_agenda end) as integer) as agenda_chars
from built b join g on b.deck_id = g.deck_id and b.section_index = g.section_index join a on g.deck_id = a.deck_id and g.grp = a.grp
"""),
    "split_large": _long("""
, p as (select deck_id, number, section_index, count(*) over (partition by deck_id, section_index) as n, row_number() over (partition by deck_id, section_index order by number) - 1 as pos from built),
q as (select *, floor(pos / ceil(n / ceil(n / 3.0))) as part from p)
select deck_id, cast(dense_rank() over (partition by deck_id order by section_index, part) - 1 as integer) as section_index, number from q
"""),
    "section_decks": _long("""
, tot as (select deck_id, count(*) as n from marked group by deck_id), cnt as (select deck_id, max(section_index) + 1 as k from built group by deck_id),
flat as (select tot.deck_id from tot left join cnt on cnt.deck_id = tot.deck_id where tot.n > 10 and coalesce(k, 0) <= 1),
chosen as (
    select deck_id, number, section_index from built where deck_id not in (select deck_id from flat)
    union all select deck_id, number, (row_number() over (partition by deck_id order by number) - 1) // 6 from marked where not is_divider and deck_id in (select deck_id from flat)
), sizes as (select deck_id, section_index, count(*) as n from chosen group by deck_id, section_index),
f as (select *, first_value(n) over (partition by deck_id order by section_index) as n0, row_number() over (partition by deck_id order by section_index) as place from sizes),
o as (select *, place = 1 or (n >= 2 and not (place = 2 and n0 < 2)) as opens from f),
g as (select *, sum(case when opens then 1 else 0 end) over (partition by deck_id order by section_index) as grp from o),
merged as (select c.deck_id, c.number, g.grp from chosen c join g on g.deck_id = c.deck_id and g.section_index = c.section_index),
p as (select *, count(*) over (partition by deck_id, grp) as n, row_number() over (partition by deck_id, grp order by number) - 1 as pos from merged),
q as (select *, floor(pos / ceil(n / ceil(n / 8.0))) as part from p),
d as (select deck_id, number, dense_rank() over (partition by deck_id order by grp, part) - 1 as section_index from q)
select d.deck_id, cast(d.section_index as integer) as section_index, min(d.number) as first_slide, max(d.number) as last_slide, cast(count(*) as integer) as n_slides,
    cast(sum(length('--- Slide ' || d.number || case when m.title <> '' then ': ' || m.title else '' end || ' ---' || chr(10) || m.text)) + 2 * (count(*) - 1) as integer) as raw_chars, cast(count(*) filter (where m.title <> '') as integer) as n_titles
from d join marked m on m.deck_id = d.deck_id and m.number = d.number group by d.deck_id, d.section_index
"""),
    "fallback_sections": f"with {SLIDES_SQL}, {_DIVIDERS} select deck_id, cast((row_number() over (partition by deck_id order by number) - 1) // 3 as integer) as section_index, number from marked where not is_divider",
    "gap_cluster": """
with e as (select user_id, event_id, epoch_us(ts) / 1e6 as begun, epoch_us(ts) / 1e6 + 60 * coalesce(value, 0.0) as ended from events where user_id is not null and ts is not null),
r as (select *, max(ended) over (partition by user_id order by begun, ended, event_id rows between unbounded preceding and 1 preceding) as reach from e),
c as (select *, sum(case when begun - reach > 21600.0 then 1 else 0 end) over (partition by user_id order by begun, ended, event_id) as cluster_id from r)
select user_id, cast(cluster_id as integer) as cluster_id, count(*) as n, min(event_id) as first_event, max(event_id) as last_event from c group by user_id, cluster_id having count(*) >= 2
""",
}
