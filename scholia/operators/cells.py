"""Very many queries against a stored search index.

``blockmax`` keeps a bound for every query and block, which grows with queries times rows. Here a cell is a run of rows: its postings and all queries of its scope meet in one task, as arrays, and what leaves
the task are the best rows of each query. A cell's postings are bounded; queries pass them as a stream. The work is that of scoring every posting of a query's terms once, the shuffle that of the index once and of the
queries once for each cell.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.sources.materialise import few, materialised

from .blockmax import BLOCK_ROWS, _is_few, _of_terms, _phrases, _slots, _weighted
from .search import idf, usable_range

#: Postings of a cell, on average.
CELL_POSTINGS = 4_000_000
#: A score that rounds to the same six decimals may still win by its smaller row.
NEAR = 2e-6
#: Postings of a cell that are summed up by section at a time.
SUMMED = 1 << 19
#: What leaves a cell: (q, ord, score) of a query's best rows, and (no, term, title, score, first, last), the sums of sections.
MADE = pa.schema([("q", pa.int64()), ("ord", pa.int64()), ("score", pa.float64()), ("no", pa.int64()), ("term", pa.string()), ("title", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
#: Rows of a run that stand for their best one.
RUN = 32
_ROWS, _POSTINGS, _QUERIES, KINDS = 0, 1, 2, 3


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    """(number of the scope, kind, rows) of runs of equal rows. A partition is a cell."""
    for batch in batches:
        at = batch.column("at").to_numpy()
        begins = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
        for begin, end in zip(begins, [*begins[1:], len(batch)]):
            yield int(at[begin]) // KINDS, int(at[begin]) % KINDS, batch.slice(begin, end - begin)


class _Cell:
    """A cell's postings by term, and the pages and sections of its rows where they are asked for."""

    def __init__(self):
        self.rows, self.postings, self.ready = [], [], False

    def build(self) -> None:
        """Postings lie together by term, and rows count from the cell's first."""
        if self.ready:
            return
        self.ready = True
        table = pa.Table.from_batches(self.postings, self.postings[0].schema).combine_chunks() if self.postings else None
        self.postings = None
        if table is None or not len(table):
            self.terms, self.begin, self.end, self.n = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
            return
        terms, sizes, ords, impacts = (table[c].combine_chunks().flatten() for c in ("terms", "sizes", "ords", "impacts"))
        coded = terms.dictionary_encode()
        self.terms, code = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        size, flat = sizes.to_numpy().astype(np.int64), ords.to_numpy()
        begins = np.cumsum(size) - size
        order = np.argsort(code, kind="stable")
        sized = size[order]
        at = np.repeat(begins[order] - (np.cumsum(sized) - sized), sized) + np.arange(sized.sum())
        self.base = int(flat.min())
        self.n = int(flat.max()) - self.base + 1
        self.ords, self.impacts = (flat[at] - self.base).astype(np.intp), impacts.to_numpy()[at]
        held = np.bincount(code, weights=size, minlength=len(self.terms)).astype(np.int64)
        self.end = np.cumsum(held)
        self.begin = self.end - held
        if self.rows:
            rows = pa.Table.from_batches(self.rows, self.rows[0].schema).combine_chunks()
            place = rows["id"].to_numpy() - self.base
            known = (place >= 0) & (place < self.n)
            self.first, self.last, self.section = np.full(self.n, np.iinfo(np.int64).max), np.full(self.n, np.iinfo(np.int64).min), np.zeros(self.n, np.int64)
            title = rows["title"].combine_chunks().dictionary_encode(null_encoding="encode")
            self.titles = title.dictionary
            # a row without pages overlaps no range
            for kept, column, none in ((self.first, "lo", np.iinfo(np.int64).max), (self.last, "hi", np.iinfo(np.int64).min)):
                kept[place[known]] = pc.fill_null(rows[column], none).to_numpy()[known]
            self.section[place[known]] = title.indices.to_numpy()[known]
            self.rows = None

    def _least(self, score: np.ndarray, limit: int) -> float:
        """What the best ``limit`` scores reach at least: runs of rows stand for their best one, where they are enough."""
        runs = self.n // RUN
        if runs >= 2 * limit:
            score = score[: runs * RUN].reshape(runs, RUN).max(axis=1)
        return float(np.partition(score, len(score) - limit)[-limit]) if len(score) > limit else 0.0

    def best(self, code: np.ndarray, weight: np.ndarray, limit: int, outside: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best rows: by six decimals, then the smaller row. Terms are added in the order of the query, so equal rows have equal scores in any cell."""
        spans = [slice(b, e) for b, e in zip(self.begin[code].tolist(), self.end[code].tolist())]
        value = np.concatenate([self.impacts[s] for s in spans])
        value *= np.repeat(weight, self.end[code] - self.begin[code])
        score = np.bincount(np.concatenate([self.ords[s] for s in spans]), weights=value, minlength=self.n)
        if outside is not None:
            score[outside] = 0.0
        at = np.flatnonzero((score >= self._least(score, limit) - NEAR) & (score > 0))
        at = at[np.lexsort((at, -np.floor(score[at] * 1e6 + 0.5)))[:limit]]
        return at, score[at]

    def search(self, queries: pa.RecordBatch, limit: int) -> pa.RecordBatch:
        """(id, ord, score) of the best rows of each query, in its range if it has one."""
        self.build()
        listed = queries.column("terms")
        code = pc.fill_null(pc.index_in(listed.flatten(), value_set=self.terms), -1).to_numpy().astype(np.int64)
        weight = queries.column("impacts").flatten().to_numpy()
        end = np.cumsum(listed.value_lengths().to_numpy())
        lo, hi = queries.column("lo"), queries.column("hi")
        ranged = (lo.is_valid().to_numpy(zero_copy_only=False)) & (hi.is_valid().to_numpy(zero_copy_only=False))
        lo, hi = pc.fill_null(lo, 0).to_numpy(), pc.fill_null(hi, 0).to_numpy()
        which, places, scores = [], [], []
        for i, stop in enumerate(end):
            known = slice(end[i - 1] if i else 0, stop)
            held = code[known] >= 0
            if not held.any():
                continue
            at, score = self.best(code[known][held], weight[known][held], limit, (self.last < lo[i]) | (self.first > hi[i]) if ranged[i] else None)
            which.append(np.full(len(at), i))
            places.append(at)
            scores.append(score)
        taken = np.concatenate(which) if which else np.zeros(0, np.int64)
        ords = np.concatenate(places) + self.base if which else taken
        return _made(q=queries.column("id").take(pa.array(taken)), ord=pa.array(ords.astype(np.int64)), score=pa.array(np.concatenate(scores) if which else np.zeros(0)))

    def sections(self, scope: int) -> Iterator[pa.RecordBatch]:
        """(no, term, title, score, first, last): what a term's postings give to each section, and their pages; a bounded number of postings at a time."""
        self.build()
        none = np.iinfo(np.int64)
        begin = 0
        while begin < len(self.terms):
            stop = max(begin + 1, int(np.searchsorted(self.end, self.begin[begin] + SUMMED, side="right")))
            held = slice(self.begin[begin], self.end[stop - 1])
            key = np.repeat(np.arange(begin, stop), (self.end - self.begin)[begin:stop]) * len(self.titles) + self.section[self.ords[held]]
            order = np.argsort(key, kind="stable")
            key, ords = key[order], self.ords[held][order]
            runs = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            term, title = np.divmod(key[runs], len(self.titles))
            first, last = np.minimum.reduceat(self.first[ords], runs), np.maximum.reduceat(self.last[ords], runs)
            yield _made(no=pa.array(np.full(len(runs), scope)), term=self.terms.take(pa.array(term)), title=self.titles.take(pa.array(title)), score=pa.array(np.add.reduceat(self.impacts[held][order], runs)), first=pa.array(first, mask=first == none.max), last=pa.array(last, mask=last == none.min))
            begin = stop


def _made(**columns: pa.Array) -> pa.RecordBatch:
    """A batch of what leaves a cell; columns that aren't given are null."""
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)).cast(f.type) for f in MADE], schema=MADE)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings (cell, at, term, ords, impacts) of a batch as a row for each cell and scope: few long rows are moved, not many short ones."""
    for batch in batches:
        if not len(batch):
            continue
        cell, at, size = batch.column("cell").to_numpy(), batch.column("at").to_numpy(), batch.column("ords").value_lengths().to_numpy()
        order = np.lexsort((at, cell))
        rows = batch.take(pa.array(order))
        cell, at, size = cell[order], at[order], size[order]
        runs = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (at[1:] != at[:-1])])
        ends, placed = np.r_[runs, len(cell)].astype(np.int32), np.r_[0, np.cumsum(size)]
        listed = pa.array(placed[ends].astype(np.int32))
        columns = [pa.array(cell[runs]), pa.array(at[runs]), pa.ListArray.from_arrays(pa.array(ends), rows.column("term")), pa.ListArray.from_arrays(pa.array(ends), pa.array(size.astype(np.int32)))]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.ListArray.from_arrays(listed, rows.column(c).flatten()) for c in ("ords", "impacts"))], ["cell", "at", "terms", "sizes", "ords", "impacts"])


def _met(limit: int, summed: bool):
    """What leaves the cells of a partition: the best rows of its queries, and the sums of sections if wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, cell = None, None
        for here, kind, rows in _parts(batches):
            if here != at:
                if cell is not None and summed:
                    yield from cell.sections(at)
                at, cell = here, _Cell()
            if kind == _QUERIES:
                yield cell.search(rows, limit)
            else:
                (cell.rows if kind == _ROWS else cell.postings).append(rows)
        if cell is not None and summed:
            yield from cell.sections(at)

    return run


class CellSearch:
    """Many queries (query_id, scope, text) against an index: their best rows, and what their terms give to each section."""

    def __init__(self, index: dict[str, DataFrame], queries: DataFrame, max_terms: int = 24):
        self.index = index
        plain = F.transform(T.query_terms_or(F.coalesce("text", F.lit("")), max_terms), lambda t: F.struct(t.alias("term"), F.lit(False).alias("is_prefix")))
        slots = materialised(_slots(queries, plain))
        single = slots.where("size(tokens) = 1").select("query_id", "scope", "slot", F.col("tokens")[0].alias("term"))
        stats = few(index["stats"])
        # weights belong to terms: the dictionary meets each different term once
        different = single.select("scope", "term").distinct()
        weighed = index["dictionary"].join(few(different), ["scope", "term"]).join(stats, "scope").select("scope", "term", idf(F.col("n_docs"), F.col("df")).alias("weight"))
        named = single.join(few(materialised(weighed)), ["scope", "term"]).select("query_id", "scope", "slot", "term", "weight")
        self.phrases = None
        several = slots.where("size(tokens) > 1").select("query_id", "scope", "slot", "tokens", F.array_join("tokens", "_").alias("term"))
        if several.limit(1).count():
            # a phrase is a term of its own, made once for all queries that name it; no token holds an underscore
            made = materialised(several.select("scope", "tokens", "term").distinct().withColumn("query_id", F.monotonically_increasing_id()).withColumn("slot", F.lit(0)))
            each = made.select("query_id", "scope", "slot", F.size("tokens").alias("parts"), F.posexplode("tokens").alias("at", "term"))
            hits = materialised(_phrases(_of_terms(index["blocks"], each).join(few(each), ["scope", "term"])))
            met = _weighted(index, hits, made.select("query_id", "scope", "slot")).join(few(made.select("query_id", "scope", "term")), "query_id")
            listed = F.collect_list(F.struct("ord", F.col("s").alias("impact")))
            self.phrases = materialised(met.groupBy("scope", "term", F.expr(f"ord div {BLOCK_ROWS}").alias("block")).agg(listed.alias("p")))
            named = named.unionByName(several.select("query_id", "scope", "slot", "term", F.lit(1.0).alias("weight")))
        #: (query_id, scope, slot, term, weight): a row for each term of a query that the index knows
        self.terms = materialised(named)
        #: scopes have numbers, so that what lies in a cell is ordered by one number
        self.scopes = materialised(index["stats"].select("scope").withColumn("no", F.monotonically_increasing_id()))
        size = index["dictionary"].agg(F.sum("df").alias("postings")).crossJoin(index["rows"].agg(F.max("ord").alias("last"))).first()
        rows, parallel = (size["last"] if size["last"] is not None else -1) + 1, index["rows"].sparkSession.sparkContext.defaultParallelism
        #: Rows of a cell, in whole blocks, and cells.
        self.span = max(1, -(-rows // max(1, -(-(size["postings"] or 0) // CELL_POSTINGS), 2 * parallel) // BLOCK_ROWS)) * BLOCK_ROWS
        self.cells = max(1, -(-rows // self.span))

    def _cell(self, ord: str = "ord") -> F.Column:
        return F.expr(f"cast({ord} div {self.span} as int)").alias("cell")

    def _laid(self, parts: list[tuple[int, DataFrame]]) -> DataFrame:
        """Rows, postings and queries of each scope in a cell, in this order; a cell is a partition."""
        columns = {"id": "long", "title": "string", "lo": "long", "hi": "long", "terms": "array<string>", "sizes": "array<int>", "ords": "array<long>", "impacts": "array<double>"}
        whole, scopes = None, few(self.scopes)
        for kind, part in parts:
            part = part.join(scopes, "scope").withColumn("at", F.col("no") * KINDS + kind)
            if kind == _POSTINGS:
                part = part.select("cell", "at", "term", "ords", "impacts").mapInArrow(_packed, "cell int, at long, terms array<string>, sizes array<int>, ords array<long>, impacts array<double>")
            shaped = part.select("cell", "at", *[(F.col(c) if c in part.columns else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])
            whole = shaped if whole is None else whole.unionByName(shaped)
        return whole.repartitionById(self.cells, "cell").drop("cell").sortWithinPartitions("at")

    def _postings(self) -> DataFrame:
        """Postings of the named terms; where these are too many to broadcast, of all terms: postings don't move to meet them."""
        terms = self.terms.select("scope", "term").distinct()
        blocks = self.index["blocks"].select("scope", "term", "block", F.col("p.ord").alias("ords"), F.col("p.impact").alias("impacts"))
        blocks = blocks.join(F.broadcast(terms), ["scope", "term"], "left_semi") if _is_few(terms) else blocks
        if self.phrases is not None:
            blocks = blocks.unionByName(self.phrases.select("scope", "term", "block", F.col("p.ord").alias("ords"), F.col("p.impact").alias("impacts")))
        return blocks.select("scope", self._cell(f"(block * {BLOCK_ROWS})"), "term", "ords", "impacts")

    def _rows(self, titled: bool) -> DataFrame:
        return self.index["rows"].select("scope", self._cell(), F.col("ord").alias("id"), *(["section_title"] if titled else []), F.col("page_start").alias("lo"), F.col("page_end").alias("hi")).withColumnsRenamed({"section_title": "title"})

    def _met(self, limit: int, ranges: DataFrame | None = None, summed: bool = False) -> tuple[DataFrame, DataFrame]:
        """(best rows, sums of sections) from one pass over the cells."""
        term = F.array_sort(F.collect_list(F.struct("slot", "term", "weight")))
        asked = self.terms.groupBy("query_id", "scope").agg(term.alias("t")).select("query_id", "scope", F.col("t.term").alias("terms"), F.col("t.weight").alias("impacts"))
        asked = asked.join(few(ranges.select("query_id", "lo", "hi")), "query_id") if ranges is not None else asked.withColumns({"lo": F.lit(None).cast("long"), "hi": F.lit(None).cast("long")})
        asked = materialised(asked.withColumn("id", F.monotonically_increasing_id()))
        places = self.index["rows"].select("scope", self._cell()).distinct()
        queries = asked.join(few(materialised(places)), "scope")
        rows = [(_ROWS, self._rows(summed))] if summed or ranges is not None else []
        made = self._laid([*rows, (_POSTINGS, self._postings()), (_QUERIES, queries)]).mapInArrow(_met(limit, summed), ", ".join(f"{f.name} {'string' if f.type == pa.string() else 'double' if f.type == pa.float64() else 'long'}" for f in MADE))
        made = materialised(made) if summed else made
        order = Window.partitionBy("q").orderBy(F.round("score", 6).desc(), "ord")
        best = made.where("q is not null").select("q", "ord", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
        return best.join(asked.select(F.col("id").alias("q"), "query_id"), "q").select("query_id", "ord", "score", "rank"), made.where("q is null").join(few(self.scopes), "no")

    def top(self, limit: int, ranges: DataFrame | None = None) -> DataFrame:
        """(query_id, ord, score, rank) of each query's best rows: scores are compared to six decimals and ties go to the smaller row. ``ranges`` (query_id, lo, hi) asks for the queries that it names alone, in rows whose pages overlap."""
        return self._met(limit, ranges)[0]

    def top_and_sections(self, limit: int) -> tuple[DataFrame, DataFrame]:
        """(as ``top``, (query_id, section_title, score, page_start, page_end)): the best rows and, for each section, the sum of a query's scores and the pages of its rows, from one pass over the postings.

        Terms are summed up by section once, and queries add the sums of their terms.
        """
        best, made = self._met(limit, summed=True)
        pages = {c: self.index["rows"].schema[c].dataType.simpleString() for c in ("page_start", "page_end")}
        around = [F.min("first").alias("first"), F.max("last").alias("last")]
        of_term = made.groupBy("scope", "term", "title").agg(F.sum("score").alias("impact"), *around)
        summed = self.terms.join(of_term, ["scope", "term"]).groupBy("query_id", "title").agg(F.sum(F.col("weight") * F.col("impact")).alias("score"), *around)
        return best, summed.select("query_id", F.col("title").alias("section_title"), "score", F.col("first").cast(pages["page_start"]).alias("page_start"), F.col("last").cast(pages["page_end"]).alias("page_end"))

    def retrieve(self, alignments: DataFrame, limit: int = 6, whole: DataFrame | None = None) -> DataFrame:
        """Rows for every query, inside the aligned range (query_id, page_start, page_end, confidence) if anything is found there, else from the whole scope; as ``search.retrieve``.

        The best rows of the ``whole`` scope (as ``top``) are those of the range where all of them lie in it; only queries of which one lies outside are asked again.
        """
        ranges = alignments.where(usable_range(F.col("page_start"), F.col("page_end"), F.col("confidence"))).select("query_id", F.col("page_start").alias("lo"), F.col("page_end").alias("hi"))
        whole = whole if whole is not None else self.top(limit)
        pages = self.index["rows"].select("ord", "page_start", "page_end")
        inside = F.coalesce((F.col("page_end") >= F.col("lo")) & (F.col("page_start") <= F.col("hi")), F.lit(False))
        placed = materialised(whole.join(ranges, "query_id", "left").join(pages, "ord").select(*whole.columns, "lo", "hi", inside.alias("in_range")))
        outside = materialised(placed.where("lo is not null and not in_range").select("query_id", "lo", "hi").distinct())
        if not outside.isEmpty():
            again = materialised(self.top(limit, outside).withColumn("in_range", F.lit(True)))
            kept = placed.join(again.select("query_id").distinct(), "query_id", "left_anti").join(outside.select("query_id", F.lit(False).alias("_all")), "query_id", "left")
            placed = kept.withColumn("in_range", F.col("in_range") & F.coalesce("_all", F.lit(True))).select(*whole.columns, "in_range").unionByName(again)
        return placed.select(*whole.columns, "in_range").join(self.index["rows"], "ord")
