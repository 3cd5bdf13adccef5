"""Library maintenance as set operations on whole tables: every function takes tables and returns the new ones. A write goes to a new revision and is swapped in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.functions.scalars import short_hash
from scholia.sources.materialise import few

#: A task brings together this many rows on average at most, so that what it sorts and counts doesn't grow with the table.
TASK_ROWS = 2_000_000
MATERIAL_KINDS = ("lecture", "book", "exam")
DOCUMENT_KINDS = ("note", "practice")


def newest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of every key in the given order."""
    place = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("_n", F.row_number().over(place)).where("_n = 1").drop("_n")


def course_counts(courses: DataFrame, materials: DataFrame, documents: DataFrame) -> DataFrame:
    """``courses`` with lectures, books, documents, notes, practices: two conditional aggregations, each pre-aggregated before it meets the courses."""
    m = materials.groupBy("course_id").agg(F.count_if(F.col("kind") == "lecture").alias("lectures"), F.count_if(F.col("kind") == "book").alias("books"))
    d = documents.groupBy("course_id").agg(F.count("*").alias("documents"), F.count_if(F.col("kind") == "note").alias("notes"), F.count_if(F.col("kind") == "practice").alias("practices"))
    joined = courses.join(m.withColumnRenamed("course_id", "id"), "id", "left").join(d.withColumnRenamed("course_id", "id"), "id", "left")
    return joined.na.fill(0, ["lectures", "books", "documents", "notes", "practices"])


def append_courses(courses: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(courses with the valid incoming ones, rejected): names are trimmed and must not be empty."""
    named = incoming.withColumn("name", F.trim("name"))
    bad = F.coalesce("name", F.lit("")) == ""
    return courses.unionByName(named.where(~bad), allowMissingColumns=True), named.where(bad).withColumn("error", F.lit("empty name"))


def patch_courses(courses: DataFrame, patches: DataFrame) -> DataFrame:
    """Set the fields that a patch gives; null leaves the old value."""
    fields = [c for c in patches.columns if c != "id"]
    renamed = patches.select("id", *[F.col(c).alias(f"_{c}") for c in fields])
    return courses.join(renamed, "id", "left").select(*[F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in courses.columns])


def patch_flags(documents: DataFrame, flags: DataFrame, flag: str = "is_public") -> tuple[DataFrame, DataFrame]:
    """(documents with flags set, ids that don't exist)."""
    renamed = flags.select("id", F.col(flag).alias("_flag"))
    patched = documents.join(renamed, "id", "left").select(*[F.coalesce("_flag", flag).alias(flag) if c == flag else F.col(c) for c in documents.columns])
    return patched, flags.join(documents.select("id"), "id", "left_anti").select("id")


def add_materials(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """``existing`` with the incoming materials of a known kind that are new to their course: the same (course, kind, sha) keeps the row it has."""
    key = ["course_id", "kind", "sha"]
    fresh = incoming.where(F.col("kind").isin(*MATERIAL_KINDS)).dropDuplicates(key).join(existing.select(*key), key, "left_anti")
    return existing.unionByName(fresh.select(*existing.columns))


def material_id(course: str = "course_id", kind: str = "kind", sha: str = "sha") -> F.Column:
    return short_hash(F.col(course), F.col(kind), F.col(sha))


def blobs(materials: DataFrame) -> DataFrame:
    """Each content once, however many courses hold it."""
    return materials.select("sha").distinct()


def unreferenced_blobs(stored: DataFrame, materials: DataFrame) -> DataFrame:
    return stored.select("sha").distinct().join(materials.select("sha"), "sha", "left_anti")


def material_usage(materials: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents that use a material as lecture or as book, each document once; exams don't count."""
    uses = documents.select("id", F.explode(F.array_distinct(F.array("lecture_id", "book_id"))).alias("material_id")).where("material_id is not null")
    counts = uses.groupBy("material_id").agg(F.count("*").alias("uses"))
    return materials.join(counts.withColumnRenamed("material_id", "id"), "id", "left").na.fill(0, ["uses"])


def delete_courses(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the courses (id) and all that hangs on them, and the blobs that nothing else holds. tables: courses, materials, documents, doc_sections."""
    gone = ids.select(F.col("id").alias("course_id"))
    kept = {
        "courses": tables["courses"].join(ids.select("id"), "id", "left_anti"),
        **{name: tables[name].join(gone, "course_id", "left_anti") for name in ("materials", "documents", "doc_sections")},
    }
    candidates = tables["materials"].join(gone, "course_id", "left_semi").select("sha").distinct()
    return kept, unreferenced_blobs(candidates, kept["materials"])


def delete_materials(materials: DataFrame, documents: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(materials, documents, blobs to remove): documents stay, their references to deleted materials become null."""
    kept = materials.join(ids.select("id"), "id", "left_anti")
    cleared = documents
    for column in ("lecture_id", "book_id", "exam_id"):
        hit = ids.select(F.col("id").alias(column), F.lit(True).alias("_hit"))
        cleared = cleared.join(hit, column, "left").withColumn(column, F.when(F.col("_hit").isNull(), F.col(column))).drop("_hit")
    gone = materials.join(ids.select("id"), "id", "left_semi").select("sha").distinct()
    return kept, cleared.select(*documents.columns), unreferenced_blobs(gone, kept)


def upsert_documents(existing: DataFrame, incoming: DataFrame, order: str = "created_at", keep: str = "is_public") -> DataFrame:
    """Insert or replace by id. All columns come from the new row but ``keep``, which survives; the last row of an id within the batch wins."""
    last = newest(incoming.where(F.col("kind").isin(*DOCUMENT_KINDS)), ["id"], order)
    old = existing.select("id", F.col(keep).alias("_kept"))
    replaced = last.join(old, "id", "left").withColumn(keep, F.coalesce("_kept", keep)).drop("_kept").select(*existing.columns)
    return existing.join(last.select("id"), "id", "left_anti").unionByName(replaced)


def replace_by_key(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that occur in ``incoming`` are replaced by its rows."""
    return existing.join(incoming.select(key).distinct(), key, "left_anti").unionByName(incoming.select(*existing.columns))


def task_partitions(*tables: DataFrame) -> int:
    """The session's number of shuffle partitions, or as many as leave a task TASK_ROWS rows of the largest table; 0 where one task can take them all."""
    most = max(t.count() for t in tables)
    return 0 if most <= TASK_ROWS else max(int(tables[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-most // TASK_ROWS))


def delete_documents(documents: DataFrame, doc_sections: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, search rows, output paths to remove).

    Search rows of large tables come dealt by document into partitions whose number follows the rows: Spark merges partitions by their compressed bytes, and bare ids
    compress so well that a task would get tens of millions of them.
    """
    listed, parts = ids.select("id"), task_partitions(documents, doc_sections)
    if parts:
        small = few(listed)
        listed = small if small is not listed else listed.repartition(parts, "id").hint("merge")
    gone = documents.join(listed, "id", "left_semi")
    paths = gone.select(F.explode(F.array_compact(F.array("pdf_path", "md_path", "doc_path", "html_path"))).alias("path"))
    rows = doc_sections.join(listed.withColumnRenamed("id", "document_id"), "document_id", "left_anti")
    return documents.join(listed, "id", "left_anti"), rows.repartition(parts, "document_id") if parts else rows, paths


def evolve_schema(df: DataFrame, schema: StructType, defaults: dict[str, object] | None = None) -> DataFrame:
    """Columns of ``schema`` in its order; missing ones are added with their default. The data decides what is missing, so a second call changes nothing."""
    defaults = defaults or {}
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema.fields])


def public_documents(documents: DataFrame, courses: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Public documents that have a PDF (present among ``files``, if given) with their course's name, newest first."""
    rows = documents.where("is_public and pdf_path is not null")
    if files is not None:
        rows = rows.join(files.select(F.col("name").alias("pdf_path")), "pdf_path", "left_semi")
    named = rows.join(courses.select(F.col("id").alias("course_id"), F.col("name").alias("course_name")), "course_id")
    return named.orderBy(F.col("created_at").desc(), "id")


def listed(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest first; a limited list is a top-k, not a whole sort."""
    ordered = rows.orderBy(F.col("created_at").desc(), "id")
    return ordered if limit is None else ordered.limit(limit)


def ownership_errors(wanted: DataFrame, materials: DataFrame, files: DataFrame) -> DataFrame:
    """``wanted`` (request_id, course_id, kind, material_id) with the reason why its material can't be used, or null."""
    held = materials.select(F.col("id").alias("material_id"), F.col("course_id").alias("_course"), F.col("kind").alias("_kind"), "sha")
    found = wanted.join(held, "material_id", "left").join(files.select("sha", F.lit(True).alias("_present")).distinct(), "sha", "left")
    reason = F.when(F.col("_kind").isNull(), "unknown material").when(F.col("_kind") != F.col("kind"), "wrong kind").when(F.col("_course") != F.col("course_id"), "other course").when(F.col("_present").isNull(), "file missing")
    return found.withColumn("error", reason).drop("_course", "_kind", "_present", "sha")


def option_errors(requests: DataFrame, backends: tuple[str, ...], depths: tuple[str, ...], extras: tuple[str, ...], most: int = 40) -> DataFrame:
    """Requests (backend, depth, extras, count) with the list of their bad options."""
    bad = F.array_compact(
        F.concat(
            F.array(F.when(~F.col("backend").isin(*backends), F.concat(F.lit("backend "), "backend")), F.when(~F.col("depth").isin(*depths), F.concat(F.lit("depth "), "depth")), F.when(~F.col("count").between(0, most), F.concat(F.lit("count "), F.col("count").cast("string")))),
            F.transform(F.array_except("extras", F.array(*map(F.lit, extras))), lambda e: F.concat(F.lit("extra "), e)),
        )
    )
    return requests.withColumn("errors", bad)
