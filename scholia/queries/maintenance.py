"""Library maintenance over the star tables: customers as courses, orders as materials and documents, line items as uses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scholia.operators import library as L
from scholia.sources import library_copy as C
from scholia.sources import tables as S

from .roles import table


def _courses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def _materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("lecture"), F.lit("book"), F.lit("exam")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course_id"), kind.alias("kind"), F.md5((F.col("o_orderkey") % 5000).cast("string").cast("binary")).alias("sha"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("course_id"), F.when(F.col("o_orderstatus") == "F", "practice").otherwise("note").alias("kind"), F.round("o_totalprice", 2).alias("price"),
        (F.col("o_orderkey") % 3 == 0).alias("is_public"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") + 1).alias("lecture_id"), (F.col("o_orderkey") + 3).alias("book_id"), (F.col("o_orderkey") + 5).alias("exam_id"),
    )


def course_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.course_counts(_courses(spark, sf_dir), _materials(spark, sf_dir), _documents(spark, sf_dir))


def material_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select(F.col("source").alias("course_id"), F.when(F.col("lang") == "en", "book").when(F.col("lang") == "de", "lecture").otherwise("exam").alias("kind"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id")
    old = m.where("doc_id % 2 = 0").groupBy("course_id", "kind", "sha").agg(F.min("doc_id").alias("doc_id"))
    return L.add_materials(old, m.where("doc_id % 2 = 1")).select("course_id", "kind", "sha")


def blob_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _materials(spark, sf_dir)
    return L.unreferenced_blobs(L.blobs(m.where("course_id % 2 = 0")), m.where("course_id % 2 = 1"))


def upsert_preserve_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("id", "kind", "price", "is_public", "created_at")
    incoming = d.where("id % 5 < 2").withColumn("price", F.col("price") + 1).withColumn("is_public", ~F.col("is_public"))
    return L.upsert_documents(d.where("id % 5 != 1"), incoming).select("id", "kind", F.round("price", 2).alias("price"), "is_public")


def replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    fresh = items.where("l_orderkey % 4 = 0 and l_linenumber <= 2").withColumn("l_quantity", F.col("l_quantity") + 100)
    return L.replace_by_key(items, fresh, "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, d = _materials(spark, sf_dir), _documents(spark, sf_dir)
    tables = {"courses": _courses(spark, sf_dir), "materials": m, "documents": d, "doc_sections": d.select(F.col("id").alias("document_id"), "course_id")}
    kept, gone = L.delete_courses(tables, tables["courses"].where("id % 10 < 4").select("id"))
    counts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, t in kept.items()] + [gone.agg(F.lit("blobs removed").alias("name"), F.count("*").alias("n"))]
    out = counts[0]
    for c in counts[1:]:
        out = out.union(c)
    return out


def _filed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with files, materials, files): paths of any depth, some missing from the listing, some empty, sizes by line items."""
    n = F.col("o_orderkey")
    path = lambda folder, ending: F.concat(F.lit(folder), (n % 4000).cast("string"), F.lit(ending))
    d = table(spark, sf_dir, "orders").select(n.alias("id"), F.col("o_custkey").alias("course_id"), path("out/", ".pdf").alias("pdf_path"), F.when(n % 3 == 0, path("", ".md")).alias("md_path"), F.when(n % 4 == 0, path("a\\b/", ".json")).otherwise("").alias("doc_path"), F.lit(None).cast("string").alias("html_path"))
    m = _materials(spark, sf_dir).where("id % 4 = 0")
    listed = d.select(F.explode(F.array("pdf_path", "md_path", "doc_path")).alias("name")).where("name != ''").union(m.select(F.concat(F.substring("sha", 1, 16), F.lit(".pdf")))).distinct()
    return d, m, listed.where("not name like '%77.md'").select("name", (F.length("name") * 100_000).alias("size"))


def rekeyed_library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a library copy under their new keys."""
    d, m, _ = _filed(spark, sf_dir)
    return C.rekeyed(d, m, "copy")[0]


def library_preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a copy of the library would move, and what stands against it."""
    d, m, files = _filed(spark, sf_dir)
    found = C.preflight(C.rekeyed(d, m, "copy")[1], files, 1_100_000)
    rows = S.library_report({"documents": d, "materials": m}, files, {"documents": "md_path"}, 900_000)
    return found.unionByName(rows.withColumn("fact", F.concat(F.lit("md "), "fact"))).select("fact", F.round("value", 4).alias("value"))


def set_null_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, d = _materials(spark, sf_dir), _documents(spark, sf_dir)
    _, cleared, _ = L.delete_materials(m, d, m.where("id % 6 = 1").select("id"))
    return cleared.select("id", "lecture_id", "book_id", "exam_id")


def material_usage_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = table(spark, sf_dir, "lineitem").select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_partkey").alias("lecture_id"), F.col("l_suppkey").alias("book_id"))
    return L.material_usage(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), uses)


def public_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).withColumn("pdf_path", F.when(F.col("id") % 2 == 0, F.concat(F.col("id").cast("string"), F.lit(".pdf"))))
    return L.public_documents(d, _courses(spark, sf_dir)).select("id", "course_id", "course_name", "pdf_path")


def course_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the customers are known courses; the rest arrive, some with blank names; then names and notes are patched."""
    c = _courses(spark, sf_dir).withColumn("note", F.lit("n"))
    arriving = c.where("id % 2 = 1").withColumn("name", F.when(F.col("id") % 7 == 0, " ").otherwise(F.concat(F.lit("  "), "name", F.lit(" "))))
    kept, rejected = L.append_courses(c.where("id % 2 = 0"), arriving)
    patches = c.where("id % 3 = 0").select("id", F.when(F.col("id") % 6 == 0, "renamed").alias("name"), F.lit("patched").alias("note"))
    return L.patch_courses(kept, patches).withColumn("error", F.lit("")).unionByName(rejected.select("id", "name", "note", "error"))


def public_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _documents(spark, sf_dir).select("id", "is_public")
    flags = d.where("id % 5 = 0").select("id", F.lit(True).alias("is_public")).union(d.where("id % 1000 = 1").select(-F.col("id"), F.lit(True)))
    patched, unknown = L.patch_flags(d, flags)
    return patched.withColumn("known", F.lit(True)).unionByName(unknown.select("id", F.lit(None).cast("boolean").alias("is_public"), F.lit(False).alias("known")))


def newest_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 25 newest documents, and in each course its newest one."""
    d = _documents(spark, sf_dir).select("id", "course_id", "created_at")
    top = L.listed(d, 25).select("id", F.lit("recent").alias("list"))
    return top.union(L.newest(d, ["course_id"], "created_at", "id").select("id", F.lit("of its course")))


def document_deletion(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("id").cast("string")
    d = _documents(spark, sf_dir).select("id", F.concat(text, F.lit(".pdf")).alias("pdf_path"), F.when(F.col("id") % 2 == 0, F.concat(text, F.lit(".md"))).alias("md_path"), F.lit(None).cast("string").alias("doc_path"), F.when(F.col("id") % 3 == 0, F.concat(text, F.lit(".html"))).alias("html_path"))
    sections = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber")
    kept, rows, paths = L.delete_documents(d, sections, d.where("id % 4 = 1").select("id"))
    return kept.select(F.lit("document").alias("what"), F.col("id").cast("string").alias("value")).union(rows.groupBy("document_id").count().select(F.lit("search rows"), F.concat_ws(":", F.col("document_id").cast("string"), F.col("count").cast("string")))).union(paths.select(F.lit("path"), "path"))


def evolved_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old rows without the later columns, brought to the schema twice."""
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("duration", T.DoubleType()), T.StructField("is_public", T.BooleanType())])
    old = _documents(spark, sf_dir).select(F.col("id").cast("string").alias("id"), "is_public", "price")
    defaults = {"kind": "note", "duration": 0.0}
    return L.evolve_schema(L.evolve_schema(old, schema, defaults), schema, defaults)


def request_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests for materials and options."""
    m = _materials(spark, sf_dir)
    wanted = m.select((F.col("id") * 10).alias("request_id"), F.when(F.col("id") % 5 == 0, F.col("course_id") + 1).otherwise(F.col("course_id")).alias("course_id"), F.when(F.col("id") % 7 == 0, "exam").otherwise(F.col("kind")).alias("kind"), F.when(F.col("id") % 11 == 0, -F.col("id")).otherwise(F.col("id")).alias("material_id"))
    owned = L.ownership_errors(wanted, m, m.where("sha < 'e'").select("sha"))
    i = F.col("request_id") / 10
    asked = owned.select(
        "request_id", "error", F.when(i % 4 == 0, "other").otherwise("api").alias("backend"), F.when(i % 3 == 0, "deepest").otherwise("deep").alias("depth"), F.when(i % 5 == 0, F.array(F.lit("quiz"), F.lit("song"))).otherwise(F.array(F.lit("quiz"))).alias("extras"), (i % 50).cast("int").alias("count")
    )
    return L.option_errors(asked, ("api", "cli"), ("summary", "deep"), ("quiz",)).select("request_id", F.coalesce("error", F.lit("")).alias("error"), F.array_join("errors", "; ").alias("errors"))


QUERIES = {
    "course_counts": course_counts, "material_dedup": material_dedup, "blob_gc": blob_gc, "upsert_preserve_flag": upsert_preserve_flag, "replace_by_key": replace_by_key,
    "cascade_delete": cascade_delete, "set_null_delete": set_null_delete, "material_usage_or": material_usage_or, "public_documents": public_documents,
    "course_changes": course_changes, "public_flags": public_flags, "newest_documents": newest_documents, "document_deletion": document_deletion, "evolved_documents": evolved_documents, "request_errors": request_errors,
}

_M = "m as (select o_orderkey as id, o_custkey as course_id, case o_orderkey % 3 when 0 then 'lecture' when 1 then 'book' else 'exam' end as kind, md5(cast(o_orderkey % 5000 as varchar)) as sha from orders)"
_D = "d as (select o_orderkey as id, o_custkey as course_id, case when o_orderstatus = 'F' then 'practice' else 'note' end as kind, round(o_totalprice, 2) as price, o_orderkey % 3 = 0 as is_public from orders)"

QUERIES |= {"rekeyed_library": rekeyed_library, "library_preflight": library_preflight}

_FILED = r"""d as (
    select o_orderkey as id, o_custkey as course_id, 'out/' || o_orderkey % 4000 || '.pdf' as pdf_path, case when o_orderkey % 3 = 0 then o_orderkey % 4000 || '.md' end as md_path, case when o_orderkey % 4 = 0 then 'a\b/' || o_orderkey % 4000 || '.json' else '' end as doc_path from orders
), k as (
    select *, 'documents/' || id || '/' || substring(sha256('copy' || chr(0) || id), 1, 32) || '/' as root from d
), m as (select o_orderkey as id, md5(cast(o_orderkey % 5000 as varchar)) as sha from orders where o_orderkey % 4 = 0),
u as (
    select root || o_pdf as key, pdf_path as source from (select *, id % 4000 || '.pdf' as o_pdf from k) union all select root || md_path, md_path from k where md_path is not null
    union all select root || id % 4000 || '.json', doc_path from k where doc_path <> '' union all select distinct 'materials/' || sha || '.pdf', substring(sha, 1, 16) || '.pdf' from m
), f as (select distinct source as name, length(source) * 100000 as size from u where source not like '%77.md')"""

ORACLE_SQL = {
    "rekeyed_library": f"""
with {_FILED}
select id, course_id, root || id % 4000 || '.pdf' as pdf_path, case when md_path is not null then root || md_path end as md_path, case when doc_path <> '' then root || id % 4000 || '.json' else '' end as doc_path, cast(null as varchar) as html_path from k
""",
    "library_preflight": f"""
with {_FILED}, j as (select u.*, f.size from u left join f on f.name = u.source)
select 'files' as fact, cast(count(distinct key) as double) as value from j union all select 'missing', count(*) filter (where size is null) from j union all select 'oversized', count(*) filter (where size > 1100000) from j
union all select 'megabytes', round(sum(size) / 1e6, 4) from j union all select 'clashes', count(*) from (select key from u group by key having count(distinct source) > 1)
union all select 'md rows:documents', count(*) from d union all select 'md rows:materials', count(*) from m
union all select 'md missing files', count(*) from (select distinct md_path from d where md_path is not null and md_path not in (select name from f))
union all select 'md oversized files', count(*) from f where name in (select md_path from d) and size > 900000 union all select 'md megabytes', round(sum(size) / 1e6, 4) from f where name in (select md_path from d)
""",
    "course_counts": f"""
with {_M}, {_D}
select c_custkey as id, c_name as name, (select count(*) from m where course_id = c_custkey and kind = 'lecture') as lectures, (select count(*) from m where course_id = c_custkey and kind = 'book') as books,
    (select count(*) from d where course_id = c_custkey) as documents, (select count(*) from d where course_id = c_custkey and kind = 'note') as notes, (select count(*) from d where course_id = c_custkey and kind = 'practice') as practices
from customer
""",
    "material_dedup": "select distinct source as course_id, case when lang = 'en' then 'book' when lang = 'de' then 'lecture' else 'exam' end as kind, sha256(coalesce(text, '')) as sha from documents",
    "blob_gc": f"with {_M} select distinct sha from m where course_id % 2 = 0 and sha not in (select sha from m where course_id % 2 = 1)",
    "upsert_preserve_flag": f"with {_D} select id, kind, round(case when id % 5 < 2 then price + 1 else price end, 2) as price, case when id % 5 = 1 then not is_public else is_public end as is_public from d",
    "replace_by_key": """
select l_orderkey, case when l_orderkey % 4 = 0 then count(*) filter (where l_linenumber <= 2) else count(*) end as n,
    round(case when l_orderkey % 4 = 0 then sum(l_quantity + 100) filter (where l_linenumber <= 2) else sum(l_quantity) end, 2) as quantity
from lineitem group by l_orderkey having l_orderkey % 4 <> 0 or count(*) filter (where l_linenumber <= 2) > 0
union all select l_orderkey, count(*), round(sum(l_quantity), 2) from lineitem group by l_orderkey having l_orderkey % 4 = 0 and count(*) filter (where l_linenumber <= 2) = 0
""",
    "cascade_delete": f"""
with {_M}, g as (select c_custkey as id from customer where c_custkey % 10 < 4)
select 'courses' as name, count(*) as n from customer where c_custkey % 10 >= 4
union all select 'materials', count(*) from m where course_id not in (select id from g)
union all select 'documents', count(*) from orders where o_custkey not in (select id from g)
union all select 'doc_sections', count(*) from orders where o_custkey not in (select id from g)
union all select 'blobs removed', count(distinct sha) from m where course_id in (select id from g) and sha not in (select sha from m where course_id not in (select id from g))
""",
    "set_null_delete": """
with g as (select o_orderkey as id from orders where o_orderkey % 6 = 1)
select o_orderkey as id, case when o_orderkey + 1 in (select id from g) then null else o_orderkey + 1 end as lecture_id, case when o_orderkey + 3 in (select id from g) then null else o_orderkey + 3 end as book_id,
    case when o_orderkey + 5 in (select id from g) then null else o_orderkey + 5 end as exam_id from orders
""",
    "material_usage_or": """
with u as (select l_partkey as k from lineitem union all select l_suppkey from lineitem where l_suppkey <> l_partkey), c as (select k, count(*) as n from u group by k)
select p_partkey as id, coalesce(n, 0) as uses from part left join c on p_partkey = k
""",
    "public_documents": f"with {_D} select d.id, d.course_id, c_name as course_name, cast(d.id as varchar) || '.pdf' as pdf_path from d join customer on c_custkey = course_id where is_public and d.id % 2 = 0",
    "course_changes": """
with c as (select c_custkey as id, case when c_custkey % 2 = 1 and c_custkey % 7 = 0 then '' else c_name end as name, c_custkey % 2 = 1 and c_custkey % 7 = 0 as bad from customer)
select id, case when not bad and id % 6 = 0 then 'renamed' else name end as name, case when not bad and id % 3 = 0 then 'patched' else 'n' end as note, case when bad then 'empty name' else '' end as error from c
""",
    "public_flags": f"with {_D} select id, is_public or id % 5 = 0 as is_public, true as known from d union all select -id, null, false from d where id % 1000 = 1",
    "newest_documents": """
select id, 'recent' as list from (select o_orderkey as id from orders order by o_orderdate desc, o_orderkey limit 25)
union all select id, 'of its course' from (select o_orderkey as id, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1
""",
    "document_deletion": """
select 'document' as what, cast(o_orderkey as varchar) as value from orders where o_orderkey % 4 <> 1
union all select 'search rows', l_orderkey || ':' || count(*) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 4 = 1) group by l_orderkey
union all select 'path', o_orderkey || '.pdf' from orders where o_orderkey % 4 = 1 union all select 'path', o_orderkey || '.md' from orders where o_orderkey % 4 = 1 and o_orderkey % 2 = 0 union all select 'path', o_orderkey || '.html' from orders where o_orderkey % 4 = 1 and o_orderkey % 3 = 0
""",
    "evolved_documents": f"with {_D} select id, 'note' as kind, cast(0 as double) as duration, is_public from d",
    "request_errors": f"""
with {_M}, w as (select id, course_id, kind, sha, case when id % 5 = 0 then course_id + 1 else course_id end as wanted_course, case when id % 7 = 0 then 'exam' else kind end as wanted_kind from m)
select id * 10 as request_id, case when id % 11 = 0 and id > 0 then 'unknown material' when wanted_kind <> kind then 'wrong kind' when wanted_course <> course_id then 'other course' when sha >= 'e' then 'file missing' else '' end as error,
    concat_ws('; ', case when id % 4 = 0 then 'backend other' end, case when id % 3 = 0 then 'depth deepest' end, case when id % 50 > 40 then 'count ' || id % 50 end, case when id % 5 = 0 then 'extra song' end) as errors from w
""",
}
