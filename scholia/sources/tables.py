"""Sources and sinks.

An index is a folder of Parquet tables in ranges of (book, chunk), each write in its own revision, and a manifest that names the revision: the manifest row is written
last, so a build that fails half-way is never read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from scholia.functions import text as T
from scholia.functions.scalars import safe_key
from scholia.operators.index import build_bm25_index, corpus_stats, term_df

from .materialise import materialised

#: Version of the index contents; another version means a rebuild.
INDEX_VERSION = "4"
EXAM_CHARS = 20_000
MAX_FILES, MAX_MEGABYTES = 20, 200
#: Files beyond this size are hashed as streams.
STREAM_FROM = 64 << 20
MANIFEST = "book_id string, index_version string, complete boolean, revision string, book_json string, built_at timestamp"


def read_pages(table: DataFrame, book: str = "book_id", page: str = "page_no", text: str = "text") -> DataFrame:
    """A page table (book_id, page_no, text); missing text becomes empty."""
    return table.select(F.col(book).alias("book_id"), F.col(page).cast("int").alias("page_no"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def number_pages(documents: DataFrame, book: str = "source", order: str = "doc_id") -> DataFrame:
    """Pages from rows that have an order but no page numbers."""
    place = F.row_number().over(Window.partitionBy(book).orderBy(order))
    return documents.select(F.col(book).alias("book_id"), place.alias("page_no"), F.coalesce("text", F.lit("")).alias("text"))


def _hashed(batches: Iterator[pd.DataFrame], block: int) -> Iterator[pd.DataFrame]:
    """SHA-256 of files, a block in memory at a time."""
    for batch in batches:
        out = []
        for path in batch["path"]:
            local = path.startswith(("file:", "/"))
            store, name = (fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")) if local else fs.FileSystem.from_uri(quote(path, safe=":/@"))
            digest = hashlib.sha256()
            with store.open_input_stream(name) as f:
                while part := f.read(block):
                    digest.update(part)
            out.append(digest.hexdigest())
        yield batch.assign(sha=out)


def read_blobs(spark: SparkSession, path: str, stream_from: int = STREAM_FROM, block: int = 8 << 20) -> DataFrame:
    """(name, size, sha, short_key) of files, by content.

    The listing reads no contents. Files of up to ``stream_from`` bytes are read as rows by Spark; larger ones, which needn't fit a row, are streamed by tasks in blocks, through a file system that Arrow knows. Spark's listing leaves out
    files without a byte, which the library doesn't take either.
    """
    files = spark.read.format("binaryFile").load(path)
    small = files.where(F.col("length") <= stream_from).select("path", "length", F.sha2("content", 256).alias("sha"))
    listed = files.where(F.col("length") > stream_from).select("path", "length")
    large = listed.repartition("path").mapInPandas(lambda batches: _hashed(batches, block), "path string, length long, sha string")
    return small.unionByName(large).select(T.safe_name(F.col("path")).alias("name"), F.col("length").alias("size"), "sha", F.substring("sha", 1, 16).alias("short_key"))


def load_exam_text(pages: DataFrame, exams: DataFrame) -> DataFrame:
    """(exam_id, exam_text) for every row of ``exams``: non-blank pages trimmed and joined by blank lines, cut to 20 000 characters; none gives an empty text."""
    trimmed = pages.select("exam_id", "page_no", T.py_strip(F.col("text")).alias("text")).where("text != ''")
    joined = trimmed.groupBy("exam_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text"))).alias("p"))
    text = F.substring(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"), 1, EXAM_CHARS)
    return exams.select("exam_id").join(joined, "exam_id", "left").select("exam_id", F.coalesce(text, F.lit("")).alias("exam_text"))


def read_outline(books: DataFrame, column: str = "outline") -> DataFrame:
    """(book_id, ordinal, title, level, page_idx): nested outline JSON flattened depth first, however deep it is.

    Children stay JSON text until their level is opened, so the number of passes is the depth of the deepest outline. Nodes without a title or page aren't
    returned, but their children are.
    """
    nodes = books.select("book_id", F.col(column).alias("json"), F.array().cast("array<int>").alias("path"))
    flat = None
    level = 0
    while True:
        # a list of nodes is read as texts, each node by its own fields
        opened = materialised(nodes.select("book_id", "path", F.posexplode(F.from_json("json", "array<string>")).alias("at", "node")).select("book_id", F.concat("path", F.array("at")).alias("path"), "node"))
        if opened.isEmpty():
            break
        fields = F.from_json("node", "title string, page_idx int")
        shown = opened.select("book_id", "path", fields.alias("n")).select("book_id", "path", "n.title", F.lit(level).alias("level"), "n.page_idx")
        flat = shown if flat is None else flat.union(shown)
        nodes = opened.select("book_id", F.get_json_object("node", "$.children").alias("json"), "path").where("json is not null")
        level += 1
    if flat is None:
        return books.select("book_id", F.lit(0).alias("ordinal"), F.lit("").alias("title"), F.lit(0).alias("level"), F.lit(0).alias("page_idx")).limit(0)
    ordinal = F.row_number().over(Window.partitionBy("book_id").orderBy("path")) - 1
    return flat.withColumn("ordinal", ordinal).where("trim(title) != '' and page_idx is not null").select("book_id", "ordinal", "title", "level", "page_idx")


def book_metadata(books: DataFrame, pages: DataFrame) -> DataFrame:
    """(book_id, title, page_count): the metadata's title, or the file's stem. ``books`` has book_id, path, meta_title."""
    counts = pages.groupBy("book_id").agg(F.count("*").cast("int").alias("page_count"))
    title = F.coalesce(F.nullif(F.trim("meta_title"), F.lit("")), T.stem(F.col("path")))
    return books.select("book_id", title.alias("title")).join(counts, "book_id", "left").na.fill(0, ["page_count"])


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def children(spark: SparkSession, path: str) -> list[str]:
    """Folders and files right under a folder; none if it isn't there."""
    if not _exists(spark, path):
        return []
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(s.getPath().toString() for s in target.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(target))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Newest manifest row of every book; empty if nothing has been built."""
    if not _exists(spark, f"{path}/manifest"):
        return spark.createDataFrame([], MANIFEST)
    rows = spark.read.schema(MANIFEST).parquet(f"{path}/manifest")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("book_id").orderBy(F.col("built_at").desc(), "revision"))).where("_n = 1").drop("_n")


def write_index(chunks: DataFrame, path: str, books: DataFrame | None = None, figures: DataFrame | None = None, version: str = INDEX_VERSION) -> str:
    """Build and write the index of ``chunks`` and return its revision. Tables first, manifest last.

    Each table is made from tables that are written already, so pages are cleaned and chunked once and texts are tokenised twice (for postings and lengths). Files hold ranges of
    books and chunks: a book's rows lie together, and one large book is many files. Chunks are written as they come, books apart, since finding ranges would read them twice.
    """
    revision = uuid.uuid4().hex
    spark = chunks.sparkSession
    keys = ["book_id", "chunk_id"]

    def write(name: str, table: DataFrame, order: list[str], ranges: bool = True) -> DataFrame:
        target = f"{path}/{name}/revision={revision}"
        placed = table.repartitionByRange(*order) if ranges else table
        placed.sortWithinPartitions(*order).write.parquet(target)
        return spark.read.schema(table.schema).parquet(target)

    chunks = write("chunks", chunks, keys, ranges=False)
    index = build_bm25_index(chunks)
    postings = write("postings", index["postings"], ["book_id", "term", "chunk_id"])
    write("term_df", term_df(postings, ["book_id"]), ["book_id", "term"])
    lengths = write("doc_len", index["doc_len"], keys)
    write("corpus_stats", corpus_stats(lengths, ["book_id"]), ["book_id"])
    if figures is not None:
        write("figures", figures, ["book_id"])
    info = F.to_json(F.struct(*[c for c in (books.columns if books is not None else ["book_id"])]))
    rows = chunks.select("book_id").distinct()
    rows = rows.join(books, "book_id", "left") if books is not None else rows
    entries = rows.select(F.col("book_id").cast("string"), F.lit(version).alias("index_version"), F.lit(True).alias("complete"), F.lit(revision).alias("revision"), info.alias("book_json"), F.current_timestamp().alias("built_at"))
    entries.write.mode("append").parquet(f"{path}/manifest")
    return revision


def pending_books(incoming: DataFrame, known: DataFrame, version: str = INDEX_VERSION) -> DataFrame:
    """Incoming books without a complete index of this version."""
    return incoming.join(known.where(F.col("complete") & (F.col("index_version") == version)).select("book_id"), "book_id", "left_anti")


def read_index(spark: SparkSession, path: str, version: str = INDEX_VERSION) -> dict[str, DataFrame]:
    """Tables of all complete books of this version, each book from the revision its manifest row names."""
    current = manifest(spark, path).where(F.col("complete") & (F.col("index_version") == version)).select("book_id", "revision")
    names = [n for n in ("chunks", "postings", "doc_len", "term_df", "corpus_stats", "figures") if _exists(spark, f"{path}/{n}")]
    tables = {}
    for name in names:
        rows = spark.read.option("basePath", f"{path}/{name}").option("mergeSchema", "true").parquet(f"{path}/{name}")
        tables[name] = rows.withColumn("book_id", F.col("book_id").cast("string")).join(current, ["book_id", "revision"], "left_semi").drop("revision")
    return tables


def orphan_revisions(tables: DataFrame, known: DataFrame) -> DataFrame:
    """Written (book_id, revision) pairs that no manifest row names: what a swap has left behind."""
    return tables.select("book_id", "revision").distinct().join(known.select("book_id", "revision"), ["book_id", "revision"], "left_anti")


def load_or_build(spark: SparkSession, path: str, pages: DataFrame, sections: DataFrame, version: str = INDEX_VERSION) -> dict[str, DataFrame]:
    """The index of all ``pages``: books that are complete are read, only missing or stale ones are chunked and built."""
    from scholia.operators.chunks import chunk_pages

    fresh = pending_books(pages.select("book_id").distinct(), manifest(spark, path), version)
    if not fresh.isEmpty():
        write_index(chunk_pages(pages.join(fresh, "book_id", "left_semi"), sections.join(fresh, "book_id", "left_semi")), path, version=version)
    return read_index(spark, path, version)


def files_signature(rows: DataFrame) -> str:
    """What tells whether the files behind a table have changed: their paths, sizes and times, as one number."""
    files = rows.select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    return "{:016x}".format((files.agg(F.bit_xor(F.xxhash64("*"))).first()[0] or 0) & (1 << 64) - 1)


def load_or_build_search(rows: DataFrame, path: str, keys: list[str], fields: list[str], keep: list[str] | None = None) -> dict[str, DataFrame]:
    """The stored search index of ``rows`` under ``path``, built if it isn't there. A build is visible by its last table alone, and one that was broken off is built under a new name."""
    from scholia.operators.blockmax import read_search_index, write_search_index

    spark = rows.sparkSession
    if not _exists(spark, f"{path}/complete"):
        revision = f"{path}/{uuid.uuid4().hex}"
        write_search_index(rows, revision, keys, fields, keep)
        spark.createDataFrame([(revision,)], "revision string").write.mode("overwrite").parquet(f"{path}/complete")
    return read_search_index(spark, spark.read.parquet(f"{path}/complete").first()["revision"])


def book_lookup(index: dict[str, DataFrame], book_id: str, chunk_id: str | None = None, number: str | None = None) -> DataFrame:
    """Chunks of a book, one chunk, or one figure, by key."""
    if number is not None:
        return index["figures"].where((F.col("book_id") == book_id) & (F.col("number") == number))
    rows = index["chunks"].where(F.col("book_id") == book_id)
    return rows if chunk_id is None else rows.where(F.col("chunk_id") == chunk_id)


def documents_to_json(documents: DataFrame, key: str = "document_id") -> DataFrame:
    return documents.select(key, F.to_json(F.struct("*")).alias("json"))


def documents_from_json(rows: DataFrame, schema: StructType | str) -> tuple[DataFrame, DataFrame]:
    """(documents, rejected) from rows with a json column: a row that is null, isn't JSON or doesn't fit the schema is rejected, whole and with all its columns."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = rows.withColumn("_document", F.from_json("json", f"{ddl}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    good = F.col("_document").isNotNull() & F.col("_document._corrupt").isNull()
    return parsed.where(good).select(F.col("_document").dropFields("_corrupt").alias("_document")).select("_document.*"), parsed.where(~good).drop("_document")


def write_markdown(documents: DataFrame, path: str) -> None:
    """Markdown of all ``documents`` (document_id, markdown) as one Parquet table in ranges of ids: no folder or file for each of them."""
    documents.select("document_id", "markdown").repartitionByRange("document_id").write.parquet(path)


def read_markdown(spark: SparkSession, path: str, document_ids: list[str] | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if document_ids is None else rows.where(F.col("document_id").isin(document_ids))


def reject_reason(kind: Column, name: Column, content: Column, size: Column, kinds: list[str], max_bytes: int) -> Column:
    """Why an uploaded material can't be taken, or null."""
    return (
        F.when(~kind.isin(*kinds), "unknown kind").when(~F.lower(name).endswith(".pdf"), "not a .pdf name").when(F.coalesce(size, F.lit(0)) == 0, "empty file")
        .when(size > max_bytes, "too large").when(F.substring(content, 1, 5) != F.lit("%PDF-").cast("binary"), "not a PDF")
    )


def validate_manifest(files: DataFrame, max_files: int = MAX_FILES, max_megabytes: int = MAX_MEGABYTES) -> tuple[DataFrame, DataFrame]:
    """(validated, rejected) of an upload batch (batch_id, name, size): caps on files and total size, and a safe key, each with its reason."""
    batch = Window.partitionBy("batch_id")
    checked = files.withColumn("_n", F.count("*").over(batch)).withColumn("_mb", F.sum("size").over(batch) / 1e6)
    reason = F.when(F.col("_n") > max_files, "too many files").when(F.col("_mb") > max_megabytes, "batch too large").when(~safe_key(F.col("name")), "unsafe name").when(F.coalesce("size", F.lit(0)) <= 0, "empty file")
    marked = checked.withColumn("error", reason).drop("_n", "_mb")
    return marked.where("error is null").drop("error"), marked.where("error is not null")


def library_report(tables: dict[str, DataFrame], files: DataFrame, references: dict[str, str], max_bytes: int) -> DataFrame:
    """Preflight of a library copy: rows per table, referenced files that are missing, files over the cap, and megabytes."""
    spark = files.sparkSession
    refs = None
    for table, column in references.items():
        one = tables[table].select(F.col(column).alias("ref")).where("ref is not null")
        refs = one if refs is None else refs.union(one)
    refs = refs.distinct() if refs is not None else spark.createDataFrame([], "ref string")
    missing = refs.join(files, refs.ref == files.name, "left_anti")
    used = files.join(refs, refs.ref == files.name, "left_semi")
    facts = [t.agg(F.lit(f"rows:{n}").alias("fact"), F.count("*").cast("double").alias("value")) for n, t in sorted(tables.items())]
    facts += [missing.agg(F.lit("missing files").alias("fact"), F.count("*").cast("double").alias("value")), used.agg(F.lit("oversized files").alias("fact"), F.coalesce(F.count_if(F.col("size") > max_bytes), F.lit(0)).cast("double").alias("value"))]
    facts.append(used.agg(F.lit("megabytes").alias("fact"), F.coalesce(F.sum("size") / 1e6, F.lit(0.0)).alias("value")))
    out = facts[0]
    for f in facts[1:]:
        out = out.union(f)
    return out
