"""Copy of a library to an empty target: every file under a new key, tables visible at once or not at all.

A copy has an id. Files are given keys under their document and a revision of that copy, tables are rewritten to those keys and written beside the target's other copies, and one marker row, written last, says
which copy is the library. What fails before the marker leaves the target as empty as it was, and the copy can be started again under the same id or another.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.scalars import short_hash

from .tables import _exists

FILE_COLUMNS = ("pdf_path", "md_path", "doc_path", "html_path")
#: Bytes that a copying task holds at a time.
BLOCK = 8 << 20


def rekeyed(documents: DataFrame, materials: DataFrame, copy_id: str, columns: tuple[str, ...] = FILE_COLUMNS) -> tuple[DataFrame, DataFrame]:
    """(documents with new keys, uploads): every file reference of a document becomes ``documents/<id>/<revision>/<name>``; a material's file is ``materials/<sha>.pdf``.

    ``uploads`` has key, source, owner and column, once for each key. Empty references stay as they are.
    """
    revision = short_hash(F.lit(copy_id), F.col("id").cast("string"), length=32)
    held = [c for c in columns if c in documents.columns]

    def key(column: str) -> F.Column:
        return F.when(F.coalesce(F.col(column), F.lit("")) != "", F.concat(F.lit("documents/"), F.col("id").cast("string"), F.lit("/"), revision, F.lit("/"), T.safe_name(F.col(column))))

    each = F.array(*[F.struct(key(c).alias("key"), F.col(c).alias("source"), F.lit(c).alias("column")) for c in held])
    of_documents = documents.select(F.col("id").cast("string").alias("owner"), F.explode(each).alias("u")).where("u.key is not null").select("u.key", "u.source", "owner", "u.column")
    sha = F.col("sha")
    of_materials = materials.groupBy("sha").agg(F.min(F.col("id").cast("string")).alias("owner")).select(F.concat(F.lit("materials/"), sha, F.lit(".pdf")).alias("key"), F.concat(F.substring(sha, 1, 16), F.lit(".pdf")).alias("source"), "owner", F.lit("sha").alias("column"))
    return documents.withColumns({c: F.coalesce(key(c), F.col(c)) for c in held}), of_documents.unionByName(of_materials)


def preflight(uploads: DataFrame, files: DataFrame, max_bytes: int) -> DataFrame:
    """(fact, value): files to copy, those that are missing or over the cap, megabytes, and keys that two sources want. ``files`` has name (a source) and size."""
    met = uploads.join(files.select(F.col("name").alias("source"), "size"), "source", "left")
    clashes = uploads.groupBy("key").agg(F.count_distinct("source").alias("n")).where("n > 1").agg(F.count("*").alias("clashes"))
    facts = met.agg(
        F.count_distinct("key").alias("files"), F.count_if(F.col("size").isNull()).alias("missing"), F.count_if(F.col("size") > max_bytes).alias("oversized"), F.coalesce(F.sum("size") / 1e6, F.lit(0.0)).alias("megabytes"),
    ).crossJoin(clashes)  # one row each
    names = ("files", "missing", "oversized", "megabytes", "clashes")
    return facts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("fact"), F.col(n).cast("double").alias("value")) for n in names])))


def _copied(batches: Iterator[pd.DataFrame], source: str, target: str) -> Iterator[pd.DataFrame]:
    there, root = fs.FileSystem.from_uri(source)
    here, base = fs.FileSystem.from_uri(target)
    for batch in batches:
        out = []
        for key, name in zip(batch["key"], batch["source"]):
            here.create_dir(f"{base}/{key}".rsplit("/", 1)[0], recursive=True)
            digest, size = hashlib.sha256(), 0
            with there.open_input_stream(f"{root}/{name}") as f, here.open_output_stream(f"{base}/{key}") as to:
                while block := f.read(BLOCK):
                    digest.update(block)
                    to.write(block)
                    size += len(block)
            out.append((key, size, digest.hexdigest()))
        yield pd.DataFrame(out, columns=["key", "size", "sha"])


def current_copy(spark: SparkSession, target: str) -> str | None:
    """The id of the copy that is the target's library, or None if the target is empty."""
    return spark.read.parquet(f"{target}/current").first()["copy_id"] if _exists(spark, f"{target}/current") else None


def read_copy(spark: SparkSession, target: str) -> dict[str, DataFrame]:
    copy_id = current_copy(spark, target)
    if copy_id is None:
        return {}
    names = [r["name"] for r in spark.read.parquet(f"{target}/current").select(F.explode("tables").alias("name")).collect()]
    return {name: spark.read.parquet(f"{target}/copies/{copy_id}/{name}") for name in names}


def copy_library(tables: dict[str, DataFrame], files: DataFrame, source: str, target: str, copy_id: str, max_bytes: int, apply: bool = False) -> DataFrame:
    """The preflight's report; with ``apply`` also the copy. ``tables`` has documents and materials among others, ``source`` and ``target`` are URIs that Arrow and Spark can open.

    The target must be empty before files are copied and again when the marker is written. Raises without a marker if it isn't, if the preflight objects, or if a copied material doesn't have its own hash.
    """
    spark = files.sparkSession
    documents, uploads = rekeyed(tables["documents"], tables["materials"], copy_id)
    report = preflight(uploads, files, max_bytes)
    if not apply:
        return report
    facts = {r["fact"]: r["value"] for r in report.collect()}
    if facts["missing"] or facts["oversized"] or facts["clashes"]:
        raise ValueError(f"library can't be copied: {facts}")
    if current_copy(spark, target) is not None:
        raise ValueError("target has a library")
    base = f"{target}/copies/{copy_id}"
    dealt = uploads.select("key", "source").distinct().repartition("key")
    dealt.mapInPandas(lambda batches: _copied(batches, source, f"{target}/files"), "key string, size long, sha string").write.mode("overwrite").parquet(f"{base}/_files")
    written = spark.read.parquet(f"{base}/_files")
    wrong = written.where("key like 'materials/%'").where(F.col("key") != F.concat(F.lit("materials/"), "sha", F.lit(".pdf"))).limit(1).collect()
    if wrong:
        raise ValueError(f"{wrong[0]['key']} has other contents")
    for name, table in (tables | {"documents": documents}).items():
        table.write.mode("overwrite").parquet(f"{base}/{name}")
    if current_copy(spark, target) is not None:
        raise ValueError("target has a library")
    marker = spark.createDataFrame([(copy_id, sorted(tables))], "copy_id string, tables array<string>")
    marker.coalesce(1).write.mode("errorifexists").parquet(f"{target}/current")
    return report
