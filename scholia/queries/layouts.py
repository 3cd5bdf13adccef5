"""Page layout over driver tables: words of documents as words on pages, line items as drawing objects and figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import scalars as N
from scholia.operators import layout as L
from scholia.operators import search as S

from .roles import table


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with their words: a document is a page with nine words to a line; tops waver inside a line, and the first two lines are larger."""
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    split = F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: w != "")

    def word(text: F.Column, i: F.Column) -> F.Column:
        line = F.floor(i / 9).cast("int")
        top, x0 = 100.0 + 12.0 * line + 0.5 * (i % 3), 50.0 * (i % 9)
        size = F.when(line == 0, 14.0).when(line == 1, F.when(F.col("doc_id") % 2 == 0, 13.5).otherwise(12.0)).otherwise(9.0)
        return F.struct(x0.alias("x0"), (x0 + 40).alias("x1"), top.alias("top"), (top + 9).alias("bottom"), size.alias("size"), text.alias("text"))

    return docs.select("doc_id", F.lit(0).alias("page_no"), F.transform(split, word).alias("words"))


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    kind = F.element_at(F.array(*map(F.lit, ("rect", "line", "curve", "image", "char", "rect", "line"))), F.col("l_linenumber").cast("int"))
    top, x0 = (F.col("l_orderkey") % 700).cast("double"), (F.col("l_partkey") % 400).cast("double")
    return items.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 5).cast("int").alias("page_no"), kind.alias("kind"), x0.alias("x0"), (x0 + F.col("l_quantity")).alias("x1"), top.alias("top"), (top + F.col("l_linenumber")).alias("bottom"))


def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a drawing on a supplier's page; its order is its cluster."""
    items = table(spark, sf_dir, "lineitem")
    top, x0 = (F.col("l_orderkey") % 600).cast("double"), (F.col("l_partkey") % 300).cast("double")
    box = F.struct(x0.alias("x0"), top.alias("top"), (x0 + F.col("l_quantity") * 4).alias("x1"), (top + F.col("l_linenumber") * 25.0).alias("bottom"))
    caption = F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.concat(F.lit("Item "), F.col("l_orderkey").cast("string")))
    return items.select(F.col("l_suppkey").alias("doc_id"), (F.col("l_partkey") % 40).cast("int").alias("page_no"), F.concat(F.lit("1."), F.col("l_linenumber").cast("string")).alias("number"), F.col("l_orderkey").alias("cluster_id"), caption.alias("caption"), box.alias("bbox"))


def _flat(figures: DataFrame, *columns: str) -> DataFrame:
    return figures.select(*columns, *[F.round(F.col("bbox")[c], 4).alias(c) for c in ("x0", "top", "x1", "bottom")])


def layout_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = L.assemble_lines(_words(spark, sf_dir))
    return lines.select("doc_id", "row", F.md5("text").alias("digest"), "top", "bottom", "x0", "x1", F.size("words").alias("n_words"))


def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.extract_title(_words(spark, sf_dir)).select("doc_id", "title")


def shape_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.count_shapes(_objects(spark, sf_dir))


def drawing_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.drawing_clusters(_objects(spark, sf_dir), gap=5.0, min_objects=3)


def merged_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flat(L.merge_same_number(_figures(spark, sf_dir)), "doc_id", "page_no", "number", "caption")


def latest_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _figures(spark, sf_dir).groupBy("doc_id", "page_no", "number").agg(F.max_by(F.struct("caption", "bbox"), "cluster_id").alias("f"))
    rows = one.select(F.col("doc_id").alias("book_id"), "number", "f.caption", F.col("page_no").alias("page"), "f.bbox")
    return _flat(L.latest_figures(rows), "book_id", "number", "caption", "page")


def captioned_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole figure search: a document is a page with a drawing of ten strokes, its whole text as the caption, and a small label above the drawing. Every seventh has no caption.

    Captions stand below the drawing in two lines, or, in every third document, beside it in one that runs into the drawing; what lies left of it is the caption. Long ones leave the page.
    """
    docs = table(spark, sf_dir, "documents").where("doc_id is not null").select("doc_id", (F.col("doc_id") % 3 == 1).alias("beside"), F.filter(F.split(F.coalesce("text", F.lit("")), r"[ \t\n\r]+"), lambda w: w != "").alias("w"))
    page = F.lit(0).alias("page_no")
    head = F.when(F.col("doc_id") % 7 == 0, F.lit("Table")).otherwise(F.lit("Figure"))
    number = F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("."), (F.col("doc_id") % 50).cast("string"))
    half = F.ceil(F.size("w") / 2).cast("int")

    def words(texts: F.Column, top: float, size: float, x0: float) -> F.Column:
        return F.transform(texts, lambda t, i: F.struct((x0 + 40.0 * i).alias("x0"), (x0 + 35.0 + 40.0 * i).alias("x1"), F.lit(top).alias("top"), F.lit(top + 8).alias("bottom"), F.lit(size).alias("size"), t.alias("text")))

    named, label = F.array(head, number), F.array(F.lit("label"))
    below = F.concat(words(F.concat(named, F.slice("w", 1, half)), 330.0, 8.0, 100.0), words(F.slice("w", half + 1, F.size("w")), 342.0, 8.0, 100.0), words(label, 185.0, 7.0, 60.0))
    beside = F.concat(words(F.concat(named, "w"), 230.0, 8.0, 20.0), words(label, 185.0, 7.0, 310.0))
    all_words = docs.select("doc_id", page, F.concat(F.when(F.col("beside"), beside).otherwise(below), words(F.array(F.lit("running"), F.lit("text")), 500.0, 11.0, 100.0)).alias("words"))
    strokes = docs.select("doc_id", F.when(F.col("beside"), 210.0).otherwise(0.0).alias("shift"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    objects = strokes.select("doc_id", page, F.lit("line").alias("kind"), (90.0 + F.col("shift") + F.col("k")).alias("x0"), (200.0 + F.col("shift") + F.col("doc_id") % 100 + F.col("k")).alias("x1"), (200.0 + 10.0 * F.col("k")).alias("top"), (205.0 + 10.0 * F.col("k")).alias("bottom"))
    boxes = docs.select("doc_id", page, F.lit(10.0).alias("x0"), F.lit(20.0).alias("y0"), F.lit(610.0).alias("x1"), F.lit(820.0).alias("y1"))
    return _flat(L.find_figures(all_words, objects, boxes), "doc_id", "number", "caption")


def figures_of_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest figures on the pages of each order's hits: an order is a query, a line item a hit in a supplier's book."""
    figures = L.latest_figures(_figures(spark, sf_dir).groupBy("doc_id", "page_no", "number").agg(F.max_by(F.struct("caption", "bbox"), "cluster_id").alias("f")).select(F.col("doc_id").alias("book_id"), "number", "f.caption", F.col("page_no").alias("page"), "f.bbox"))
    start = (F.col("l_partkey") % 37).cast("int")
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("query_id"), F.col("l_suppkey").alias("book_id"), F.col("l_linenumber").cast("int").alias("rank"), start.alias("page_start"), (start + 3).alias("page_end"))
    return S.retrieve_figures(figures, hits, limit=3).select("query_id", "book_id", "number", "page", F.round("area", 3).alias("area"), "figure_rank")


def figure_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Render and crop arithmetic for every order's page size and every line item's box."""
    items = table(spark, sf_dir, "lineitem")
    width, height = 400 + F.col("l_quantity") * 10, 300 + F.col("l_linenumber") * 130.0
    box = F.struct((F.col("l_partkey") % 50).cast("double").alias("x0"), (F.col("l_suppkey") % 40).cast("double").alias("top"), (100 + F.col("l_quantity")).alias("x1"), (F.col("l_linenumber") * 40.0 + 60).alias("bottom"))
    crop = N.crop_box(box, N.crop_scale(width, height), width, height)
    return items.select("l_orderkey", "l_linenumber", F.round(N.figure_area(box), 4).alias("area"), N.image_tokens(width, height).alias("tokens"), F.round(N.render_scale(width, height), 6).alias("render"), F.round(N.crop_scale(width, height), 6).alias("crop"), *[crop[c].alias(f"px_{c}") for c in ("x0", "top", "x1", "bottom")], N.figure_label(F.concat(F.lit("1."), F.col("l_linenumber").cast("string"))).alias("label"))


QUERIES = {
    "layout_lines": layout_lines, "page_titles": page_titles, "shape_counts": shape_counts, "drawing_clusters": drawing_clusters, "merged_figures": merged_figures,
    "latest_figures": latest_figures, "captioned_figures": captioned_figures, "figures_of_hits": figures_of_hits, "figure_geometry": figure_geometry,
}

_WORDS = r"""d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') as w from documents where doc_id is not null),
w as (select doc_id, unnest(w) as text, generate_subscripts(w, 1) - 1 as i from d),
words as (
    select doc_id, i, i // 9 as line, text, 50.0::double * (i % 9) as x0, 50.0::double * (i % 9) + 40 as x1, 100.0::double + 12 * (i // 9) + 0.5::double * (i % 3) as top,
        case when i // 9 = 0 then 14.0 when i // 9 = 1 then case when doc_id % 2 = 0 then 13.5 else 12.0 end else 9.0 end as size from w)"""

_OBJECTS = """o as (
    select l_suppkey as doc_id, cast(l_partkey % 5 as integer) as page_no, ['rect', 'line', 'curve', 'image', 'char', 'rect', 'line'][l_linenumber] as kind,
        cast(l_partkey % 400 as double) as x0, l_partkey % 400 + l_quantity as x1, cast(l_orderkey % 700 as double) as top, cast(l_orderkey % 700 as double) + l_linenumber as bottom from lineitem)"""

_FIGURES = """f as (
    select l_suppkey as doc_id, cast(l_partkey % 40 as integer) as page_no, '1.' || l_linenumber as number, l_orderkey as cluster_id, case when l_orderkey % 3 = 0 then '' else 'Item ' || l_orderkey end as caption,
        cast(l_partkey % 300 as double) as x0, cast(l_orderkey % 600 as double) as top, l_partkey % 300 + l_quantity * 4 as x1, cast(l_orderkey % 600 as double) + l_linenumber * 25.0::double as bottom
    from lineitem)"""

_LATEST = "p as (select *, row_number() over (partition by doc_id, page_no, number order by cluster_id desc) as n from f), l as (select *, row_number() over (partition by doc_id, number order by page_no desc) as m from p where n = 1)"

ORACLE_SQL = {
    "layout_lines": f"""
with {_WORDS}, r as (select *, cast(round_even(top / 3, 0) as integer) as row from words)
select doc_id, row, md5(string_agg(text, ' ' order by x0, x1, top, size, text)) as digest, min(top) as top, max(top + 9) as bottom, min(x0) as x0, max(x1) as x1, cast(count(*) as integer) as n_words from r group by doc_id, row
""",
    # lines are twelve points apart and waver by one, so a word's line is its number
    "page_titles": rf"""
with {_WORDS}, l as (select doc_id, line, string_agg(text, ' ' order by top, x0) as text, max(size) as size from words group by doc_id, line),
k as (select *, max(size) over (partition by doc_id) as largest from l where not regexp_matches(lower(text), '^(carnegie mellon|bryant and o.?hallaron|computer systems:.*|\d{{1,3}})$')),
b as (select doc_id, line, text, largest, lag(line) over (partition by doc_id order by line) as before from k where size >= largest - 0.6),
c as (select *, max(case when 12 * (line - before) > 2 * largest then 1 else 0 end) over (partition by doc_id order by line) as apart from b),
t as (select doc_id, trim(left(string_agg(text, ' ' order by line), 120)) as title from c where coalesce(apart, 0) = 0 group by doc_id)
select p.doc_id, coalesce(t.title, '') as title from (select distinct doc_id from words) p left join t on t.doc_id = p.doc_id
""",
    "shape_counts": f"with {_OBJECTS} select doc_id, page_no, count(*) filter (where kind in ('rect', 'line', 'curve')) as shape_count, count(*) filter (where kind = 'image') as image_count from o group by doc_id, page_no",
    "drawing_clusters": f"""
with {_OBJECTS}, s as (select * from o where kind in ('rect', 'line', 'curve')),
r as (select *, max(bottom) over (partition by doc_id, page_no order by top, bottom, x0, x1 rows between unbounded preceding and 1 preceding) as reach from s),
c as (select *, sum(case when top - reach > 5 then 1 else 0 end) over (partition by doc_id, page_no order by top, bottom, x0, x1 rows unbounded preceding) as cluster_id from r)
select doc_id, page_no, cast(cluster_id as integer) as cluster_id, min(top) as c_top, max(bottom) as c_bottom, min(x0) as c_x0, max(x1) as c_x1, count(*) as n from c group by doc_id, page_no, cluster_id having count(*) >= 3
""",
    "merged_figures": f"""
with recursive {_FIGURES}, n as (select *, row_number() over (partition by doc_id, page_no, number order by cluster_id, caption, x0, top, x1, bottom) as k from f),
m as (
    select doc_id, page_no, number, k, caption, x0, top, x1, bottom from n where k = 1
    union all
    select m.doc_id, m.page_no, m.number, n.k,
        case when greatest(m.top, n.top) - least(m.bottom, n.bottom) <= 120 then case when m.caption <> '' then m.caption else n.caption end when (n.x1 - n.x0) * (n.bottom - n.top) > (m.x1 - m.x0) * (m.bottom - m.top) then n.caption else m.caption end,
        case when greatest(m.top, n.top) - least(m.bottom, n.bottom) <= 120 then least(m.x0, n.x0) when (n.x1 - n.x0) * (n.bottom - n.top) > (m.x1 - m.x0) * (m.bottom - m.top) then n.x0 else m.x0 end,
        case when greatest(m.top, n.top) - least(m.bottom, n.bottom) <= 120 then least(m.top, n.top) when (n.x1 - n.x0) * (n.bottom - n.top) > (m.x1 - m.x0) * (m.bottom - m.top) then n.top else m.top end,
        case when greatest(m.top, n.top) - least(m.bottom, n.bottom) <= 120 then greatest(m.x1, n.x1) when (n.x1 - n.x0) * (n.bottom - n.top) > (m.x1 - m.x0) * (m.bottom - m.top) then n.x1 else m.x1 end,
        case when greatest(m.top, n.top) - least(m.bottom, n.bottom) <= 120 then greatest(m.bottom, n.bottom) when (n.x1 - n.x0) * (n.bottom - n.top) > (m.x1 - m.x0) * (m.bottom - m.top) then n.bottom else m.bottom end
    from m join n on n.doc_id = m.doc_id and n.page_no = m.page_no and n.number = m.number and n.k = m.k + 1
), e as (select *, row_number() over (partition by doc_id, page_no, number order by k desc) as z from m)
select doc_id, page_no, number, caption, round(x0, 4) as x0, round(top, 4) as top, round(x1, 4) as x1, round(bottom, 4) as bottom from e where z = 1
""",
    "latest_figures": f"with {_FIGURES}, {_LATEST} select doc_id as book_id, number, caption, page_no as page, round(x0, 4) as x0, round(top, 4) as top, round(x1, 4) as x1, round(bottom, 4) as bottom from l where m = 1",
    # drawings span 200 to 295; boxes are the drawing, its caption and the label above, padded by 10 and cut to the page of 600
    "captioned_figures": r"""
with d as (select doc_id, doc_id % 3 = 1 as beside, list_filter(string_split_regex(coalesce(text, ''), '[ \t\n\r]+'), lambda w: w <> '') as w from documents where doc_id is not null), n as (select *, len(w) as n from d)
select doc_id, (doc_id % 9 + 1) || '.' || (doc_id % 50) as number, trim(array_to_string(case when beside then w[1:5] else w end, ' '), ' .') as caption,
    case when beside then 0.0::double else 40.0::double end as x0, 155.0::double as top,
    least(600.0::double, case when beside then greatest(419 + doc_id % 100, 55 + 40 * (n + 1)) else greatest(209 + doc_id % 100, 135 + 40 * (cast(ceil(n / 2) as bigint) + 1)) end::double) as x1,
    case when beside then 285.0::double when n > 1 then 340.0::double else 328.0::double end as bottom
from n where doc_id % 7 <> 0
""",
    "figures_of_hits": f"""
with {_FIGURES}, {_LATEST}, g as (select * from l where m = 1),
h as (select l_orderkey as query_id, l_suppkey as book_id, cast(l_linenumber as integer) as rank, cast(l_partkey % 37 as integer) as page_start from lineitem),
s as (select h.query_id, h.book_id, g.number, g.page_no as page, (g.x1 - g.x0) * (g.bottom - g.top) as area, row_number() over (partition by h.query_id, h.book_id, g.number order by h.rank, g.page_no) as first, h.rank
    from h join g on g.doc_id = h.book_id and g.page_no between h.page_start and h.page_start + 3),
r as (select *, row_number() over (partition by query_id order by area desc, rank, page, number, book_id) as figure_rank from s where first = 1)
select query_id, book_id, number, page, round(area, 3) as area, cast(figure_rank as integer) as figure_rank from r where figure_rank <= 3
""",
    "figure_geometry": """
with g as (
    select l_orderkey, l_linenumber, 400 + l_quantity * 10 as w, 300 + l_linenumber * 130.0::double as h, cast(l_partkey % 50 as double) as x0, cast(l_suppkey % 40 as double) as top, 100 + l_quantity as x1, l_linenumber * 40.0::double + 60 as bottom from lineitem
), s as (select *, least(4.0::double, greatest(1.0::double, 900 / greatest(w, h))) as crop from g)
select l_orderkey, l_linenumber, round((x1 - x0) * (bottom - top), 4) as area, cast(floor(w * h / 750) as integer) as tokens, round(least(1100 / greatest(w, h), 3.0::double), 6) as render, round(crop, 6) as crop,
    cast(greatest(0, least(round_even(x0 * crop, 0), round_even(w * crop, 0))) as integer) as px_x0, cast(greatest(0, least(round_even(top * crop, 0), round_even(h * crop, 0))) as integer) as px_top,
    cast(greatest(0, least(round_even(x1 * crop, 0), round_even(w * crop, 0))) as integer) as px_x1, cast(greatest(0, least(round_even(bottom * crop, 0), round_even(h * crop, 0))) as integer) as px_bottom, 'Figure 1.' || l_linenumber as label from s
""",
}
