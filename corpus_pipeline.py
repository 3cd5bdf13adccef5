"""Corpus pipeline over ``documents``: each stage calls one corpus operator and works on all that the stage before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scholia.llm.common import BROADCAST_BYTES, cut, shared_folder
from scholia.llm.minhash import near_duplicates
from scholia.llm.mixing import mix_sources
from scholia.llm.packing import pack_documents
from scholia.llm.quality import grade_documents
from scholia.llm.queries import mixing_parameters, packing_parameters, ratings
from scholia.llm.secrets import redact, scan_secrets

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose best grade is the likelier outcome stay, unchanged. A null text is graded as an empty one; rows that repeat are graded alike."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return grade_documents(docs, ratings(labels), keep=COLUMNS).where("tail_probability >= 0.5").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one of smallest id. Null and empty texts are nobody's copies and stay, as do rows without id.

    Of rows that repeat an id one stays: the smallest by text, then by language, source and length, nulls first.
    """
    found = cut(near_duplicates(docs).groupBy("doc_id").agg(F.min("kept").alias("kept"), F.count("*").alias("rows")).where("doc_id is not null and (not kept or rows > 1)"))
    listed = F.broadcast(found) if found.count() * 24 <= BROADCAST_BYTES else found
    marked = docs.join(listed, "doc_id", "left")
    rest = [c for c in COLUMNS if c != "doc_id"]
    repeated = marked.where("kept and rows > 1").groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("least")).select("doc_id", "least.*")
    return marked.where("kept is null").select(*COLUMNS).union(repeated)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are cut out of the texts; all documents stay. A null text stays null, and n_chars follows what is cut."""
    found = scan_secrets(docs, keep=COLUMNS).withColumn("text", redact(F.col("text"), F.col("secrets")))
    return found.select("doc_id", "text", "lang", "source", F.when(F.size("secrets") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mixture; one that is taken in several epochs is a row for each. A null text has no tokens; a null language or source is a leaf of its own."""
    mixed = mix_sources(docs, keep=COLUMNS, **mixing_parameters(spark))
    return mixed.select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences. A null or empty text is the end token alone; repeated rows are packed like any other."""
    return pack_documents(docs, **packing_parameters())


#: (name, function of (spark, docs, sf_dir)); the result of each is written as Parquet and reread as the next one's docs.
STAGES = [("quality", quality), ("near_dedup", near_dedup), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: Models and Python functions decide here, which SQL can't express; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``, with a Parquet table in the shared checkpoint folder after each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
