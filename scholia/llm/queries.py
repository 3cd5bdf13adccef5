"""The registered queries of the corpus operators: each applies one operator to its whole table and returns its full result."""

from __future__ import annotations

import json
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .conversations import damaged, repair_report
from .embed_dedup import embedding_duplicates
from .forest import nearest_neighbours
from .html import extract_main_text
from .langid import identify_languages
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack_documents
from .quality import grade_documents
from .secrets import scan_secrets
from .topk import top_inner_products
from .urlfilter import filter_urls, host
from .whitening import whiten_embeddings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.9)


def mixing_parameters(spark: SparkSession) -> dict:
    """The mixture that the query and the pipeline aim at: four domains of sources, and English as two other languages."""
    domain = F.concat(F.lit("d"), F.pmod(F.regexp_extract("source", r"(\d+)$", 1).cast("int"), F.lit(4)).cast("string"))
    targets = [("d0", 4.0), ("d1", 3.0), ("d2", 2.0), ("d3", 1.0), *[(f"d{d}/en", 2.0) for d in range(4)]]
    return {
        "levels": {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}, "tokens": F.ceil(F.octet_length("text") / 4),
        "weights": spark.createDataFrame(targets, "path string, weight double"), "budget_share": 0.5, "max_epochs": 2,
    }


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents"), **mixing_parameters(spark))


def op3_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5, scale=256)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(_table(spark, sf_dir, "documents"), F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1)


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"), words=3, percent=85)


def packing_parameters() -> dict:
    """The vocabulary's rank file, which gives the ids of its JSON file four times as fast, and the strings that the JSON file adds as tokens."""
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as described:
        special = {token["content"]: token["id"] for token in json.load(described)["added_tokens"]}
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": special, "length": 2048, "end": 0}


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), **packing_parameters())


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no fetch times and there is no list table, so both are derived from pages: a day of 2024 by page_id, and lists of hosts and paths by their first and last page."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url").withColumn("fetched_at", F.expr("date_add(date'2024-01-01', cast(page_id * 37 % 366 as int))"))
    hosts = pages.groupBy(host(F.col("url")).alias("host")).agg(F.min("page_id").alias("a"), F.max("page_id").alias("z")).where("host != ''")
    dated = {
        "select 'hosts' as list, host as key, true as listed, cast(a % 150 as int) as day from {hosts} where a % 3 < 2",
        "select 'hosts', host, false, cast(a % 150 + 60 + z % 60 as int) from {hosts} where z % 2 = 0",
        "select 'hosts', host, true, cast(300 + a % 30 as int) from {hosts} where z % 5 = 0",
        "select 'paths', concat(host, '/en'), true, cast(z % 366 as int) from {hosts} where z % 2 = 1",
        "select distinct 'domains', regexp_extract(host, '([^.]+[.][^.]+)$', 1), true, 330 from {hosts} where z % 7 = 0",
    }
    entries = spark.sql(" union all ".join(sorted(dated)), hosts=hosts).select("list", "key", "listed", F.expr("date_add(date'2024-01-01', day)").alias("at"))
    found = filter_urls(pages, entries)
    return found.select("page_id", "url", "fetched_at", F.array_join("lists", ",").alias("lists"), "matched_key", "kept")


def ratings(labels: DataFrame) -> DataFrame:
    """Grades from labels: 0 toxic, 1 poor, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))


def op8_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    graded = grade_documents(_table(spark, sf_dir, "documents"), ratings(_table(spark, sf_dir, "labels")))
    return graded.withColumn("kept", F.col("tail_probability") >= 0.5)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(_table(spark, sf_dir, "documents"))

    def joined(spans: F.Column) -> F.Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    counts = [F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}") for kind in ("assign", "access", "hex")]
    base = F.filter("secrets", lambda s: s["kind"] != "random")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = _table(spark, sf_dir, "conversations")
    return repair_report(conversations, damaged(conversations))


def op12_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(_table(spark, sf_dir, "embeddings"), components=32).withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_exact_topk": op3_exact_topk,
    "op4_language_id": op4_language_id,
    "op5_minhash_dedup": op5_minhash_dedup,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_quality_grade": op8_quality_grade,
    "op9_secret_scan": op9_secret_scan,
    "op10_html_extraction": op10_html_extraction,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_forest_neighbours": op12_forest_neighbours,
    "op13_embedding_whitening": op13_embedding_whitening,
}

#: DuckDB SQL for the queries that SQL can express; the others are held against brute force in tests/llm.
ORACLE_SQL: dict[str, str] = {
    "op7_url_filter": """
with p as (
    select page_id, url, date '2024-01-01' + cast(page_id * 37 % 366 as integer) as fetched_at,
        lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) as host,
        rtrim(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), '/+', '/', 'g'), '/') as path
    from pages
), h as (select host, min(page_id) as a, max(page_id) as z from p where host <> '' group by host),
e as (
    select 'hosts' as list, host as key, true as listed, a % 150 as day from h where a % 3 < 2
    union all select 'hosts', host, false, a % 150 + 60 + z % 60 from h where z % 2 = 0
    union all select 'hosts', host, true, 300 + a % 30 from h where z % 5 = 0
    union all select 'paths', host || '/en', true, z % 366 from h where z % 2 = 1
    union all select distinct 'domains', regexp_extract(host, '([^.]+[.][^.]+)$', 1), true, 330 from h where z % 7 = 0
), d as (select list, key, date '2024-01-01' + cast(day as integer) as since, bool_and(listed) as listed from e group by list, key, day),
c as (select *, coalesce(lag(listed) over (partition by list, key order by since), false) as before from d),
v as (select *, lead(since) over (partition by list, key order by since) as until from c where listed <> before),
m as (
    select distinct p.page_id, v.list, v.key from p join v on v.listed and v.since <= p.fetched_at and (v.until is null or p.fetched_at < v.until)
        and (p.host = v.key or ends_with(p.host, '.' || v.key) or p.host || p.path = v.key or starts_with(p.host || p.path, v.key || '/'))
    where p.host <> ''
), g as (select page_id, string_agg(distinct list, ',' order by list) as lists from m group by page_id),
k as (select page_id, key from (select page_id, key, row_number() over (partition by page_id order by length(key) desc, key) as n from m) where n = 1)
select p.page_id, p.url, p.fetched_at, coalesce(g.lists, '') as lists, k.key as matched_key, g.lists is null as kept
from p left join g on p.page_id = g.page_id left join k on p.page_id = k.page_id
""",
    # crc32 bit by bit; then the cheapest and least repair up to each row by state, (cost, edits, lines), with insertions after every step
    "op11_conversation_repair": r"""
with recursive bytes as (
    select distinct coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as key from conversations
), crc as (
    select key, list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(key, ''), lambda c: cast(ascii(c) as bigint))), lambda a, b:
        list_reduce([xor(a, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: case when x % 2 = 1 then xor(x // 2, 3988292384) else x // 2 end)) as c from bytes
), kinds as (select key, xor(c, 4294967295) % 20 as kind from crc),
damaged as (
    select conv_id, turn, case when kind = 4 then 'user' else coalesce(role, ' ') end as role,
        case when kind = 1 then '' when kind = 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text, unnest(case when kind = 3 then [0, 1] else [0] end) as copy
    from conversations join kinds on key = coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') where kind <> 0
), placed as (
    select *, row_number() over (partition by conv_id order by turn nulls first, role, hash(text), text, copy) as n, count(*) over (partition by conv_id) as total,
        regexp_replace(text, '[\x20\x09-\x0D]+$', '') as bare from damaged
), faults as (
    select *, case when bare = '' then 'blank' when row_number() over (partition by conv_id, role, text order by n) > 1 then 'duplicate' when right(bare, 1) not in ('.', '!', '?') then 'truncated' else '' end as fault,
        substring(role, 1, 1) as i, lag(substring(role, 1, 1)) over (partition by conv_id order by n) as before from placed
), rows as (
    select conv_id, n, total, role, text, i, fault in ('blank', 'duplicate') as must, case when fault = 'truncated' then 3 else 0 end as extra from faults
), start as (
    -- states: 0 nothing yet, 1 after the system row, 2 after a user, 3 after an assistant; each the cheapest and then least (cost, edits, lines)
    select distinct conv_id, 0 as n, total, {'c': 0, 'a': '', 't': ''} as s0, {'c': 1000000, 'a': '', 't': ''} as s1, {'c': 3, 'a': 'I', 't': chr(10) || 'user:'} as s2, {'c': 6, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'} as s3 from rows
), walk as (
    select * from start
    union all
    select conv_id, n, total, d0, d1, least(d2, {'c': least(d0, d1, d3).c + 3, 'a': least(d0, d1, d3).a || 'I', 't': least(d0, d1, d3).t || chr(10) || 'user:'}) as s2,
        least(d3, {'c': least(d2, {'c': least(d0, d1, d3).c + 3, 'a': least(d0, d1, d3).a || 'I', 't': least(d0, d1, d3).t || chr(10) || 'user:'}).c + 3, 'a': least(d2, {'c': least(d0, d1, d3).c + 3, 'a': least(d0, d1, d3).a || 'I', 't': least(d0, d1, d3).t || chr(10) || 'user:'}).a || 'I', 't': least(d2, {'c': least(d0, d1, d3).c + 3, 'a': least(d0, d1, d3).a || 'I', 't': least(d0, d1, d3).t || chr(10) || 'user:'}).t || chr(10) || 'assistant:'}) as s3
    from (
        select w.conv_id, r.n, w.total, {'c': s0.c + 4, 'a': s0.a || 'D', 't': s0.t} as d0,
            least({'c': s1.c + 4, 'a': s1.a || 'D', 't': s1.t}, case when i = 's' and not must then {'c': s0.c + extra, 'a': s0.a || 'K', 't': s0.t || chr(10) || role || ':' || text} else {'c': 1000000, 'a': '', 't': ''} end) as d1,
            least({'c': s2.c + 4, 'a': s2.a || 'D', 't': s2.t}, case when must then {'c': 1000000, 'a': '', 't': ''} else least({'c': s0.c + extra + case when i = 'u' then 0 else 3 end, 'a': s0.a || case when i = 'u' then 'K' else 'R' end, 't': s0.t || chr(10) || case when i = 'u' then role else 'user' end || ':' || text},
                {'c': s1.c + extra + case when i = 'u' then 0 else 3 end, 'a': s1.a || case when i = 'u' then 'K' else 'R' end, 't': s1.t || chr(10) || case when i = 'u' then role else 'user' end || ':' || text},
                {'c': s3.c + extra + case when i = 'u' then 0 else 3 end, 'a': s3.a || case when i = 'u' then 'K' else 'R' end, 't': s3.t || chr(10) || case when i = 'u' then role else 'user' end || ':' || text}) end) as d2,
            least({'c': s3.c + 4, 'a': s3.a || 'D', 't': s3.t}, case when must then {'c': 1000000, 'a': '', 't': ''} else {'c': s2.c + extra + case when i = 'a' then 0 else 3 end, 'a': s2.a || case when i = 'a' then 'K' else 'R' end, 't': s2.t || chr(10) || case when i = 'a' then role else 'assistant' end || ':' || text} end) as d3
        from walk w join rows r on r.conv_id is not distinct from w.conv_id and r.n = w.n + 1
    )
), ended as (select conv_id, least(s0, s3) as best from walk where n = total),
summed as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
        count(*) filter (where before is not null and before || i not in ('su', 'ua', 'au')) as illegal from faults group by conv_id
)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.c, 0) as bigint) as cost, coalesce(best.a, '') as audit, sha256(coalesce(substring(best.t, 2), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join summed s on s.conv_id is not distinct from o.conv_id left join ended e on e.conv_id is not distinct from o.conv_id
""",
    "op3_exact_topk": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
    from embeddings where vec_id is not null and embedding is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
    select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.v as double[]), cast(c.v as double[])) as bigint) as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id
), ranked as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
""",
}
