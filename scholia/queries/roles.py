"""Driver tables in the roles of the library's inputs, and the same roles in SQL.

A book is a source's documents of a thousand consecutive ids, so that books stay bounded however large a source is. A deck is a conversation, a slide a turn.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("doc_id is not null and source is not null")
    book = F.concat("source", F.lit("-"), F.expr("doc_id div 1000").cast("string"))
    placed = docs.select(book.alias("book_id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return placed.select("book_id", F.row_number().over(Window.partitionBy("book_id").orderBy("doc_id")).alias("page_no"), "doc_id", "text")


def outline(book_pages: DataFrame) -> DataFrame:
    """Every seventh page opens a section; every fourteenth a deeper one; a book's first section is its preface where it has eight pages or more."""
    opens = book_pages.where("(page_no - 1) % 7 = 0").withColumn("ordinal", F.expr("cast((page_no - 1) / 7 as int)"))
    return opens.select("book_id", "ordinal", F.when(F.col("ordinal") == 0, "Preface").otherwise(F.concat(F.lit("Part "), F.col("ordinal").cast("string"))).alias("title"), (F.col("ordinal") % 2).alias("level"), (F.col("page_no") - 1).alias("page_idx"))


def page_counts(book_pages: DataFrame) -> DataFrame:
    return book_pages.groupBy("book_id").agg(F.max("page_no").alias("page_count"))


def slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").withColumn("t", F.coalesce("text", F.lit("")))
    body = F.regexp_replace("t", r"^[^\n]*\n?", "")
    return turns.select(F.col("conv_id").alias("deck_id"), (F.col("turn") + 1).cast("int").alias("number"), F.substring_index("t", "\n", 1).alias("title"), body.alias("text"), (F.length("t") % 5 == 0).alias("is_visual"))


def long_slides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books as decks: pages are slides with their whole text, every ninth opens with an agenda title."""
    p = pages(spark, sf_dir)
    title = F.when(F.col("page_no") % 9 == 5, F.lit("Today: next")).otherwise(F.substring_index("text", "\n", 1))
    return p.select(F.col("book_id").alias("deck_id"), F.col("page_no").alias("number"), title.alias("title"), "text", (F.length("text") % 5 == 0).alias("is_visual"))


PAGES_SQL = """pages as (
    select source || '-' || cast(doc_id // 1000 as varchar) as book_id, doc_id, coalesce(text, '') as text,
        cast(row_number() over (partition by source || '-' || cast(doc_id // 1000 as varchar) order by doc_id) as integer) as page_no
    from documents where doc_id is not null and source is not null)"""

OUTLINE_SQL = f"""{PAGES_SQL}, outline as (
    select book_id, (page_no - 1) // 7 as ordinal, case when page_no = 1 then 'Preface' else 'Part ' || cast((page_no - 1) // 7 as varchar) end as title,
        ((page_no - 1) // 7) % 2 as level, page_no - 1 as page_idx
    from pages where (page_no - 1) % 7 = 0
), counts as (select book_id, max(page_no) as page_count from pages group by book_id),
ranges as (
    select o.book_id, cast(row_number() over (partition by o.book_id order by page_idx) - 1 as integer) as ordinal, title, cast(level as integer) as level, cast(page_idx + 1 as integer) as page_start,
        cast(greatest(page_idx + 1, coalesce(lead(page_idx) over (partition by o.book_id order by page_idx), page_count - 1)) as integer) as page_end
    from outline o join counts c on o.book_id = c.book_id)"""

SLIDES_SQL = r"""slides as (
    select conv_id as deck_id, cast(turn + 1 as integer) as number, split_part(coalesce(text, ''), chr(10), 1) as title,
        regexp_replace(coalesce(text, ''), '^[^\n]*\n?', '') as text, length(coalesce(text, '')) % 5 = 0 as is_visual
    from conversations where conv_id is not null and turn is not null)"""

TOKENS = r"regexp_extract_all(strip_accents(lower({})), '[\p{{L}}\p{{N}}]+')"

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12)"
#: Normalised and scrubbed text in SQL, of the expression that stands for {}.
NORMALIZED = rf"trim(regexp_replace(regexp_replace(replace({{}}, chr(13), ''), '[ \t]+', ' ', 'g'), '\n{{{{3,}}}}', chr(10) || chr(10), 'g'), {_BLANK})"
SCRUBBED = (
    r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '(?:\d{{1,2}}\.\d{{1,2}}[ ]\S[^\n]{{2,90}}?[ ]\d{{2,4}}\s+){{4,}}', ' ', 'g'),"
    rf" '(?:\b\d{{{{1,3}}}}\b[ ]+){{{{11,}}}}\b\d{{{{1,3}}}}\b', ' ', 'g'), '(?:\bSP\b[ ]*){{{{2,}}}}', ' ', 'g'), '[ \t]+', ' ', 'g'), {_BLANK})"
)
