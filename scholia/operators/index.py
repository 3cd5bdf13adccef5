"""BM25 inverted index over chunks, many books at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scholia.functions import text as T

#: Tables of an index, all keyed by book_id.
TABLES = ("chunks", "postings", "doc_len", "term_df", "corpus_stats", "figures")
#: Tokens that a task groups at a time (one row more at most).
GROUPED_TOKENS = 1 << 20


def column_tokens(*indexed: str) -> Column:
    """Tokens of columns one after another, with a null between two columns."""
    each = [T.tokenize(F.coalesce(c, F.lit(""))) for c in indexed]
    gap = F.array(F.lit(None).cast("string"))
    return F.flatten(F.array(*[part for tokens in each for part in (tokens, gap)][:-1]))


def _row_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Terms of each row with their places; ``tokens`` is the last column of a batch, and a bounded number of tokens is sorted at a time."""
    for batch in batches:
        size = np.cumsum(np.r_[0, batch.column("tokens").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
        begin = 0
        while begin < len(batch):
            end = max(begin + 1, int(np.searchsorted(size, size[begin] + GROUPED_TOKENS, side="right")) - 1)
            part = batch.slice(begin, end - begin)
            begin = end
            tokens = part.column("tokens")
            lengths = tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            terms = tokens.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(part)), lengths)
            pos = np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            held = terms.is_valid().to_numpy(zero_copy_only=False)
            row, pos = row[held], pos[held].astype(np.int32)
            key = row * max(1, len(terms.dictionary)) + terms.indices.drop_null().to_numpy().astype(np.int64)
            order = np.argsort(key, kind="stable")  # places stay in order
            key = key[order]
            first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
            of, term = np.divmod(key[first], max(1, len(terms.dictionary)))
            ends = np.r_[first, len(key)].astype(np.int32)
            columns = [*(part.column(i).take(pa.array(of)) for i in range(part.num_columns - 1)), terms.dictionary.take(pa.array(term)), pa.array(np.diff(ends)), pa.ListArray.from_arrays(pa.array(ends), pa.array(pos[order]))]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:-1], "term", "tf", "positions"])


def postings_of(rows: DataFrame, keys: list[str], *indexed: str, terms: DataFrame | None = None) -> DataFrame:
    """(keys, term, tf, positions): every term of the indexed columns taken together, with its places in that token sequence. No two columns' tokens are adjacent.

    The keys name one row each, so a row's tokens are grouped where it is read, and no token is shuffled. ``terms`` (term) restricts an index that is built for one set of queries to the terms they name.
    """
    kinds = ", ".join(f"`{k}` {rows.schema[k].dataType.simpleString()}" for k in keys)
    postings = rows.select(*keys, column_tokens(*indexed).alias("tokens")).mapInArrow(_row_postings, f"{kinds}, term string, tf int, positions array<int>")
    return postings if terms is None else postings.join(terms.select("term").distinct(), "term", "left_semi").select(*postings.columns)


def document_lengths(rows: DataFrame, keys: list[str], *indexed: str) -> DataFrame:
    """(keys, len): tokens of the indexed columns, in a map-only pass."""
    total = sum((F.size(T.tokenize(F.coalesce(c, F.lit("")))) for c in indexed), F.lit(0))
    return rows.select(*keys, total.alias("len"))


def term_df(postings: DataFrame, scope: list[str]) -> DataFrame:
    return postings.groupBy(*scope, "term").agg(F.count("*").alias("df"))


def corpus_stats(lengths: DataFrame, scope: list[str]) -> DataFrame:
    return lengths.groupBy(*scope).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))


def build_bm25_index(chunks: DataFrame, terms: DataFrame | None = None) -> dict[str, DataFrame]:
    """Tables of the index of ``chunks`` (book_id, chunk_id, text, section_title): statistics run over each whole book and over both columns.

    With ``terms`` the postings hold those terms alone; scores of queries over them don't change.
    """
    keys = ["book_id", "chunk_id"]
    postings = postings_of(chunks, keys, "text", "section_title", terms=terms)
    lengths = document_lengths(chunks, keys, "text", "section_title")
    return {"chunks": chunks, "postings": postings, "doc_len": lengths, "term_df": term_df(postings, ["book_id"]), "corpus_stats": corpus_stats(lengths, ["book_id"])}
