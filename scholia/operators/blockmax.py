"""A stored search index: a sorted term dictionary and postings in blocks that know their best score.

Rows (chunks of books, sections of documents) are numbered in order of their keys; a block is a run of those numbers. For every term and block the index holds the postings, places included, and the
largest share of a score that any of them can give. A top-k search adds those bounds up, scores the most promising blocks of each query, and from then on joins only blocks whose bound reaches the query's k-th
score so far. Prefixes are looked up in the dictionary, by equality on a term's first characters and a range behind it; no search passes over texts or tokens again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.sources.materialise import BROADCAST_ROWS, few, materialised

from .index import column_tokens
from .search import K1, B, idf, usable_range

#: Rows of a block, characters of a term that a prefix look-up starts from, and blocks of a query that are scored first.
BLOCK_ROWS, HEAD, SEEDS = 128, 2, 4
TABLES = ("rows", "stats", "dictionary", "blocks")
#: Up to so many wanted terms are given to the scan as a filter, so that it skips what lies between them.
PUSHED_TERMS = 2000
#: Tokens that a task groups into blocks at a time (one block more at most).
GROUPED_TOKENS = 1 << 20
_BLOCKS = "term string, block long, top double, n long, p array<struct<ord:bigint,tf:int,impact:double>>, places array<array<int>>"


def _impact(tf: Column, length: Column, avg_len: Column) -> Column:
    """What a posting gives to a score, but for the term's idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def _grouped(rows: pa.Table) -> pa.RecordBatch:
    """Postings of whole blocks: ``rows`` (scope, ord, len, avg_len, tokens) in order of ord."""
    tokens = rows["tokens"].combine_chunks()
    flat, lengths = tokens.flatten(), tokens.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(tokens)), lengths)
    pos = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms, scopes = flat.dictionary_encode(), rows["scope"].combine_chunks().dictionary_encode()
    held = flat.is_valid().to_numpy(zero_copy_only=False)
    row, pos = row[held], pos[held].astype(np.int32)
    term = terms.indices.drop_null().to_numpy().astype(np.int64)
    ords = rows["ord"].to_numpy()
    first = ords[0] // BLOCK_ROWS if len(ords) else 0
    key = ((ords // BLOCK_ROWS - first)[row] * len(scopes.dictionary) + scopes.indices.to_numpy()[row]) * max(1, len(terms.dictionary)) + term
    order = np.argsort(key, kind="stable")  # rows and places stay in order
    key, row, pos, term = key[order], row[order], pos[order], term[order]
    posting = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (row[1:] != row[:-1])][: len(key)])
    tf = np.diff(np.r_[posting, len(key)])
    of, block_key = row[posting], key[posting]
    block = np.flatnonzero(np.r_[True, block_key[1:] != block_key[:-1]][: len(block_key)])
    impact = _impact(tf, rows["len"].to_numpy()[of], rows["avg_len"].to_numpy()[of])
    ends = pa.array(np.r_[block, len(of)].astype(np.int32))
    listed = pa.StructArray.from_arrays([pa.array(ords[of]), pa.array(tf.astype(np.int32)), pa.array(impact)], ["ord", "tf", "impact"])
    places = pa.ListArray.from_arrays(pa.array(np.r_[posting, len(key)].astype(np.int32)), pa.array(pos))
    lead = of[block]
    return pa.RecordBatch.from_arrays(
        [
            scopes.dictionary.take(pa.array(scopes.indices.to_numpy()[lead])), terms.dictionary.take(pa.array(term[posting[block]])), pa.array(ords[lead] // BLOCK_ROWS),
            pa.array(np.maximum.reduceat(impact, block) if len(block) else np.zeros(0)), pa.array(np.diff(np.r_[block, len(of)]).astype(np.int64)), pa.ListArray.from_arrays(ends, listed), pa.ListArray.from_arrays(ends, places),
        ],
        ["scope", "term", "block", "top", "n", "p", "places"],
    )


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of a task's rows, a bounded number of tokens at a time; a block that isn't complete waits for the next batch."""
    waiting = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = rows if waiting is None else pa.concat_tables([waiting, rows])
        block = rows["ord"].to_numpy() // BLOCK_ROWS
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]][: len(block)])
        size = np.cumsum(np.r_[0, rows["tokens"].combine_chunks().value_lengths().fill_null(0).to_numpy(zero_copy_only=False)])
        begin = 0
        for end in starts[1:]:
            if size[end] - size[begin] >= GROUPED_TOKENS or end == starts[-1]:
                yield _grouped(rows.slice(begin, end - begin))
                begin = end
        waiting = rows.slice(begin)
    if waiting is not None and len(waiting):
        yield _grouped(waiting)


def write_search_index(rows: DataFrame, path: str, keys: list[str], fields: list[str], keep: list[str] | None = None) -> None:
    """Build the index of ``rows`` (scope, the keys, the text fields, columns to keep) under ``path``. Statistics and terms belong to a scope: a book, or a library as a whole.

    Texts are tokenised once. The tokens are written in order of their rows; lengths, postings and the dictionary are made from what is written. Rows of a block lie in one file, so postings are grouped where
    they are read and never shuffled. Numbers of rows rise with their keys; a file begins with a new block, so some numbers stay unused.
    """
    spark = rows.sparkSession
    order = ["scope", *keys]
    # tokens are made behind the exchange: finding its ranges runs what stands before it twice
    ranged = rows.select(*order, *(keep or []), *fields).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranged.select(*order, *(keep or []), "at", column_tokens(*fields).alias("tokens")).withColumn("len", F.size(F.array_compact("tokens"))).write.parquet(f"{path}/tokens")
    placed = spark.read.parquet(f"{path}/tokens")
    part, index = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    held = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg((F.max(index) + 1).alias("n")).collect()}  # a row for each partition
    starts, total = [], 0
    for p in range(max(held, default=0) + 1):
        starts.append(total)
        total += -(-held.get(p, 0) // BLOCK_ROWS) * BLOCK_ROWS
    numbered = placed.withColumn("ord", F.element_at(F.array(*map(F.lit, starts)), (part + 1).cast("int")).cast("long") + index)
    numbered.select("ord", *order, *(keep or []), "len").write.parquet(f"{path}/rows")
    sizes = spark.read.parquet(f"{path}/rows")
    sizes.groupBy("scope").agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len")).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats")
    scored = numbered.join(few(stats.select("scope", "avg_len")), "scope").select("scope", F.col("ord").cast("long").alias("ord"), F.col("len").cast("long").alias("len"), "avg_len", "tokens")
    # a file that is read by several tasks may cut a block in two: both parts count, and the bounds of both are added
    blocks = scored.mapInArrow(_in_blocks, f"scope {scored.schema['scope'].dataType.simpleString()}, {_BLOCKS}")
    # places are a column of their own: only phrases read them
    # every file is sorted by term, so a scan for some terms skips most of each; scopes are few and tell little, so terms come first
    blocks.sortWithinPartitions("term", "scope", "block").write.parquet(f"{path}/blocks")
    terms = spark.read.parquet(f"{path}/blocks").groupBy("scope", "term").agg(F.sum("n").alias("df"))
    terms.withColumn("head", F.substring("term", 1, HEAD)).repartitionByRange("scope", "term").sortWithinPartitions("scope", "term").write.parquet(f"{path}/dictionary")


def read_search_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{path}/{name}") for name in TABLES}


def terms_of_prefixes(dictionary: DataFrame, prefixes: DataFrame) -> DataFrame:
    """``prefixes`` (scope, prefix and other columns) with every term that begins so, and its df.

    A prefix of ``HEAD`` characters or more meets the terms of its head, a shorter one those of its only character, by equality; within these the wanted terms are one range of the sorted dictionary.
    """
    low, high = F.col("prefix"), F.concat("prefix", F.lit(chr(0x10FFFF)))
    long = few(prefixes.where(F.length("prefix") >= HEAD).withColumn("head", F.substring("prefix", 1, HEAD)))
    found = dictionary.join(long, ["scope", "head"]).where((F.col("term") >= low) & (F.col("term") < high)).drop("head")
    for size in range(1, HEAD):
        short = few(prefixes.where(F.length("prefix") == size))
        begun = dictionary.withColumn("prefix", F.substring("term", 1, size)).where(F.length("term") >= size).drop("head")
        found = found.unionByName(begun.join(short, ["scope", "prefix"]).select(*found.columns))
    return found


def _of_terms(blocks: DataFrame, terms: DataFrame) -> DataFrame:
    """Blocks of the wanted terms. A bounded list of terms goes to the scan, which skips row groups by it."""
    names = [r["term"] for r in terms.select("term").distinct().limit(PUSHED_TERMS + 1).collect()]
    return blocks.where(F.col("term").isin(names)) if len(names) <= PUSHED_TERMS else blocks


def _of_prefixes(blocks: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Blocks of the terms that begin with ``prefixes`` (scope, prefix and other columns). The prefixes go to the blocks, not the terms they stand for: those grow with the vocabulary."""
    return terms_of_prefixes(blocks.withColumn("head", F.substring("term", 1, HEAD)), prefixes)


def _phrases(met: DataFrame) -> DataFrame:
    """(query_id, slot, ord, tf) of phrases: ``met`` has query_id, slot, parts, at, p, places, the blocks of each token of a phrase (of several terms where its last token is a prefix)."""
    each = met.select("query_id", "slot", "parts", "at", F.explode(F.arrays_zip("p", "places")).alias("x"))
    # every token votes for the place where its phrase would begin; a place holds one token, so a place with all votes is an occurrence
    votes = each.select("query_id", "slot", "parts", F.col("x.p.ord").alias("ord"), F.transform("x.places", lambda pos: pos - F.col("at")).alias("starts"))
    cast = votes.groupBy("query_id", "slot", "parts", "ord").agg(F.sort_array(F.flatten(F.collect_list("starts"))).alias("s")).where("size(s) >= parts")
    whole = F.expr("size(filter(s, (x, i) -> i + parts <= size(s) and get(s, i + parts - 1) = x))")
    return cast.select("query_id", "slot", "ord", whole.alias("tf")).where("tf > 0")


def _within(met: DataFrame, pairs: DataFrame) -> DataFrame:
    """``met`` in these (query_id, block) if so few that they can be broadcast, else all of it: postings never move to meet pairs. Whatever is read beyond them is left out afterwards."""
    return met.join(F.broadcast(pairs), ["query_id", "block"]) if _is_few(pairs) else met


def _is_few(rows: DataFrame) -> bool:
    return rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS


def _slots(queries: DataFrame, terms: Column) -> DataFrame:
    """(query_id, scope, slot, tokens, is_prefix): a row for each term of a query that has tokens. A term with an underscore has several, which must be adjacent."""
    each = queries.select("query_id", "scope", F.posexplode(terms).alias("slot", "t"))
    return each.select("query_id", "scope", "slot", T.tokenize(F.col("t.term")).alias("tokens"), "t.is_prefix").where("size(tokens) > 0")


def _weighted(index: dict[str, DataFrame], hits: DataFrame, of_slot: DataFrame) -> DataFrame:
    """Pseudo-postings (query_id, slot, ord, tf) with their share of a score; the df of a slot is the number of its rows."""
    df = hits.groupBy("query_id", "slot").agg(F.count("*").alias("df"))
    scoped = hits.join(few(df), ["query_id", "slot"]).join(few(of_slot), ["query_id", "slot"]).join(few(index["stats"]), "scope")
    return scoped.join(index["rows"].select("ord", "len"), "ord").select("query_id", "slot", "ord", (idf(F.col("n_docs"), F.col("df")) * _impact(F.col("tf"), F.col("len"), F.col("avg_len"))).alias("s"))


class BlockSearch:
    """A batch of queries (query_id, scope, text) against an index: rows that hold any of a query's terms, best first."""

    def __init__(self, index: dict[str, DataFrame], queries: DataFrame, max_terms: int = 24):
        self.index = index
        plain = F.transform(T.query_terms_or(F.coalesce("text", F.lit("")), max_terms), lambda t: F.struct(t.alias("term"), F.lit(False).alias("is_prefix")))
        slots = materialised(_slots(queries, plain))
        single = slots.where("size(tokens) = 1").select("query_id", "scope", "slot", F.col("tokens")[0].alias("term"))
        known = _of_terms(index["dictionary"], single).join(few(single), ["scope", "term"]).join(few(index["stats"]), "scope")
        # terms of the queries with their weights: a row for each query and term
        self.terms = materialised(known.select("query_id", "scope", "term", idf(F.col("n_docs"), F.col("df")).alias("weight")))
        several = slots.where("size(tokens) > 1").select("query_id", "scope", "slot", F.size("tokens").alias("parts"), F.posexplode("tokens").alias("at", "term"))
        self.extra = None
        if several.limit(1).count():
            of_slot = several.select("query_id", "scope", "slot").distinct()
            met = _of_terms(index["blocks"], several).join(few(several), ["scope", "term"])
            self.extra = materialised(_weighted(index, _phrases(met), of_slot).withColumn("block", F.expr(f"ord div {BLOCK_ROWS}")))
        self.blocks = _of_terms(index["blocks"], self.terms)
        bounds = self.blocks.select("scope", "term", "block", "top").join(few(self.terms), ["scope", "term"]).select("query_id", "block", (F.col("weight") * F.col("top")).alias("most"))
        if self.extra is not None:
            bounds = bounds.unionByName(self.extra.groupBy("query_id", "slot", "block").agg(F.max("s").alias("most")).select("query_id", "block", "most"))
        #: (query_id, block, bound): no row of the block can score more than bound
        self.bounds = materialised(bounds.groupBy("query_id", "block").agg(F.sum("most").alias("bound")))

    def scores(self, pairs: DataFrame | None = None) -> DataFrame:
        """(query_id, ord, score) of all rows in these (query_id, block), or in all, that hold a term. A file's terms of a row are added before anything is shuffled."""
        met, extra = self.blocks.select("scope", "term", "block", "p").join(few(self.terms), ["scope", "term"]), self.extra
        if pairs is not None:
            met, extra = met.join(few(pairs), ["query_id", "block"]), extra if extra is None else extra.join(few(pairs), ["query_id", "block"])
        parts = met.select("query_id", "weight", F.explode("p").alias("x")).select("query_id", "x.ord", (F.col("weight") * F.col("x.impact")).alias("s"))
        if extra is not None:
            parts = parts.unionByName(extra.select("query_id", "ord", "s"))
        return parts.groupBy("query_id", "ord").agg(F.sum("s").alias("score"))

    def top(self, limit: int, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """((query_id, ord, score, rank) of each query's best rows, (query_id, blocks, read)): scores are compared to six decimals and ties go to the smaller row.

        ``ranges`` (query_id, lo, hi) leaves rows whose pages overlap, of the queries that it names. ``read`` of a query's ``blocks`` were joined to postings.
        """
        bounds = self.bounds
        if ranges is not None:
            spans = self.index["rows"].groupBy(F.expr(f"ord div {BLOCK_ROWS}").alias("block")).agg(F.min("page_start").alias("first"), F.max("page_end").alias("last"))
            bounds = bounds.join(few(ranges), "query_id").join(spans, "block").where("last >= lo and first <= hi").select("query_id", "block", "bound")

        def in_ranges(found: DataFrame) -> DataFrame:
            if ranges is None:
                return found
            pages = self.index["rows"].select("ord", "page_start", "page_end")
            return found.join(few(ranges), "query_id").join(pages, "ord").where("page_end >= lo and page_start <= hi").select("query_id", "ord", "score")

        best = Window.partitionBy("query_id").orderBy(F.col("bound").desc(), "block")
        first = materialised(bounds.withColumn("n", F.row_number().over(best)).where(F.col("n") <= SEEDS).select("query_id", "block", "bound"))
        seeds = materialised(in_ranges(self.scores(first.select("query_id", "block"))))
        order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "ord")
        reached = seeds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == limit).select("query_id", F.col("score").alias("least"))
        # a score that rounds to the same six decimals may still win by its smaller row
        left = bounds.join(first.select("query_id", "block"), ["query_id", "block"], "left_anti").join(few(reached), "query_id", "left").where("least is null or bound >= least - 0.000002")
        rest = materialised(left.select("query_id", "block"))
        if _is_few(rest):
            more = self.scores(rest)
        else:
            # so many blocks aren't sent to the postings, nor postings to them: all are scored, and rows that are seeds or stay below the k-th score so far fall away
            rest = bounds.select("query_id", "block").join(first.select("query_id", "block"), ["query_id", "block"], "left_anti")
            scored = self.scores().join(few(reached), "query_id", "left").where("least is null or score >= least - 0.000002")
            more = scored.withColumn("block", F.expr(f"ord div {BLOCK_ROWS}")).join(few(first.select("query_id", "block")), ["query_id", "block"], "left_anti").select("query_id", "ord", "score")
        found = seeds.unionByName(in_ranges(more)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        joined = first.select("query_id", "block").unionByName(rest).groupBy("query_id").agg(F.count("*").alias("read"))
        return found, bounds.groupBy("query_id").agg(F.count("*").alias("blocks")).join(joined, "query_id")


def bm25_top(index: dict[str, DataFrame], queries: DataFrame, limit: int = 20) -> DataFrame:
    """The best rows of every query (query_id, scope, text) with their keys: what ``score_queries`` and ``top_hits`` give over an index in memory."""
    found, _ = BlockSearch(index, queries).top(limit)
    return found.join(index["rows"], "ord")


def retrieve_ranged(index: dict[str, DataFrame], cards: DataFrame, alignments: DataFrame, limit: int = 6) -> DataFrame:
    """Rows for every card (query_id, scope, text), inside the aligned range (query_id, page_start, page_end, confidence) if anything is found there, else from the whole scope; as ``search.retrieve``."""
    search = BlockSearch(index, cards)
    ranges = alignments.where(usable_range(F.col("page_start"), F.col("page_end"), F.col("confidence"))).select("query_id", F.col("page_start").alias("lo"), F.col("page_end").alias("hi"))
    inside = materialised(search.top(limit, ranges)[0].withColumn("in_range", F.lit(True)))
    outside = search.top(limit)[0].join(inside.select("query_id").distinct(), "query_id", "left_anti").withColumn("in_range", F.lit(False))
    return inside.unionByName(outside).join(index["rows"], "ord")


def all_terms_top(index: dict[str, DataFrame], queries: DataFrame, limit: int = 20) -> DataFrame:
    """Rows of a query's course in which all its terms occur, phrases as adjacent tokens, the last term as a prefix: query_id, rank, score and the row's columns. ``queries`` has query_id, course_id, scope, text.

    The rows of the prefix are found first; the other terms are read only in the blocks of those that belong to the course. Statistics are of the whole scope.
    """
    last = F.max("slot").over(Window.partitionBy("query_id"))
    leads = F.col("is_prefix") | (F.size("tokens") > 1) | (F.col("slot") == last)
    slots = _slots(queries, T.query_terms_and_prefix(F.coalesce("text", F.lit("")))).withColumn("leads", leads).withColumn("key", F.concat_ws(" ", "scope", F.col("is_prefix").cast("string"), F.array_join("tokens", " ")))
    slots = materialised(slots.join(few(queries.select("query_id", "course_id")), "query_id"))
    need = slots.groupBy("query_id").agg(F.count("*").alias("needed"))
    # prefixes and phrases lead: their rows are made from postings, since no df is stored for them. A query without any is led by its last term. Queries share what is the same in them
    leading = materialised(slots.where("leads").select(F.col("key").alias("query_id"), "scope", F.lit(0).alias("slot"), "tokens", "is_prefix").distinct())
    each = leading.select("query_id", "scope", "slot", F.size("tokens").alias("parts"), "is_prefix", F.posexplode("tokens").alias("at", "token"))
    begun = each.where("is_prefix and at = parts - 1").withColumnRenamed("token", "prefix")
    whole = each.where("not (is_prefix and at = parts - 1)").select("query_id", "scope", "slot", "parts", "at", F.col("token").alias("term"))

    def met(columns: list[str], parts: str) -> DataFrame:
        shown = index["blocks"].select("scope", "term", "block", *columns)
        named = _of_terms(shown, whole.where(parts)).join(few(whole.where(parts)), ["scope", "term"])
        return _of_prefixes(shown, begun.where(parts)).select("query_id", "slot", "parts", "at", *columns).unionByName(named.select("query_id", "slot", "parts", "at", *columns))

    hits = met(["p"], "parts = 1").select("query_id", "slot", F.explode("p").alias("x")).groupBy("query_id", "slot", "x.ord").agg(F.sum("x.tf").cast("int").alias("tf"))
    if leading.where("size(tokens) > 1").limit(1).count():
        hits = hits.unionByName(_phrases(met(["p", "places"], "parts > 1")))
    led = slots.where("leads").select("query_id", "slot", "key", "course_id")
    course = index["rows"].select("ord", F.col("course_id").alias("of_course"))
    scored = _weighted(index, materialised(hits), leading.select("query_id", "scope", "slot")).select(F.col("query_id").alias("key"), "ord", "s").join(course, "ord")
    weighed = materialised(scored.join(few(led), "key").where("course_id = of_course").select("query_id", "slot", "ord", "s"))
    exact = slots.where("not leads").select("query_id", "scope", "slot", F.col("tokens")[0].alias("term"))
    known = _of_terms(index["dictionary"], exact).join(few(exact), ["scope", "term"]).join(few(index["stats"]), "scope").select("query_id", "slot", "scope", "term", idf(F.col("n_docs"), F.col("df")).alias("weight"))
    known = materialised(known)
    rows = weighed.select("query_id", "ord").distinct()
    pairs = rows.select("query_id", F.expr(f"ord div {BLOCK_ROWS}").alias("block")).distinct()
    met = _within(_of_terms(index["blocks"], known).select("scope", "term", "block", "p").join(few(known), ["scope", "term"]), materialised(pairs)).select("query_id", "slot", "weight", F.explode("p").alias("x"))
    others = met.select("query_id", "slot", "x.ord", (F.col("weight") * F.col("x.impact")).alias("s")).join(rows, ["query_id", "ord"], "left_semi")
    summed = weighed.unionByName(others.select("query_id", "slot", "ord", "s")).groupBy("query_id", "ord").agg(F.sum("s").alias("score"), F.count("*").alias("found"))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 6).desc(), "ord")
    best = summed.join(few(need), "query_id").where("found = needed").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return best.select("query_id", "rank", "score", "ord").join(index["rows"], "ord")
