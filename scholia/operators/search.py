"""Retrieval: BM25 over whole-book statistics, ranges with fallback, prefix search with snippets, figures of hits.

A query only touches the terms it names: query terms are joined to postings before anything is scored, and the term statistics are taken for the named
terms alone. Statistics always come from the whole book or library, filters act on scored rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.functions.scalars import figure_area
from scholia.sources.materialise import few


K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def idf(n_docs: Column, df: Column) -> Column:
    value = F.log((n_docs - df + 0.5) / (df + 0.5))
    return F.when(value > 0, value).otherwise(F.lit(IDF_FLOOR))


def term_score(idf_value: Column, tf: Column, length: Column, avg_len: Column) -> Column:
    return idf_value * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / avg_len))


def phrase_hits(postings: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """(query_id, term, keys, tf) of query terms that tokenise to one token or to a phrase of adjacent ones (an underscore separates tokens)."""
    parts = terms.withColumn("tokens", T.tokenize(F.col("term"))).where("size(tokens) > 0")
    single = parts.where("size(tokens) = 1").select("query_id", "book_id", F.col("term").alias("phrase"), F.col("tokens")[0].alias("term"))
    found = postings.join(few(single), ["book_id", "term"]).select("query_id", "phrase", *keys, "tf")
    phrases = parts.where("size(tokens) > 1").select("query_id", "book_id", F.col("term").alias("phrase"), F.size("tokens").alias("_n"), F.posexplode("tokens").alias("_at", "term"))
    # every token votes for the place where the phrase would begin; a place with all votes is an occurrence
    starts = postings.join(few(phrases), ["book_id", "term"]).select("query_id", "phrase", *keys, "_n", "_at", F.explode("positions").alias("_pos")).withColumn("_start", F.col("_pos") - F.col("_at"))
    whole = starts.groupBy("query_id", "phrase", *keys, "_n", "_start").agg(F.count_distinct("_at").alias("_votes")).where("_votes = _n")
    return found.unionByName(whole.groupBy("query_id", "phrase", *keys).agg(F.count("*").cast("int").alias("tf")))


def score_queries(index: dict[str, DataFrame], queries: DataFrame, max_terms: int = 24) -> DataFrame:
    """(query_id, book_id, chunk_id, score) of every chunk that holds any term of a query. ``queries`` has query_id, book_id, text."""
    terms = queries.select("query_id", "book_id", F.explode(T.query_terms_or(F.coalesce("text", F.lit("")), max_terms)).alias("term"))
    hits = phrase_hits(index["postings"], terms, ["book_id", "chunk_id"])
    per_phrase = hits.groupBy("query_id", "book_id", "phrase").agg(F.count("*").alias("df"))
    scored = (
        hits.join(per_phrase, ["query_id", "book_id", "phrase"]).join(few(index["corpus_stats"]), "book_id").join(index["doc_len"], ["book_id", "chunk_id"])
        .withColumn("s", term_score(idf(F.col("n_docs"), F.col("df")), F.col("tf"), F.col("len"), F.col("avg_len")))
    )
    return scored.groupBy("query_id", "book_id", "chunk_id").agg(F.sum("s").alias("score"))


def top_hits(scored: DataFrame, limit: int, scope: list[str] | None = None) -> DataFrame:
    """Best ``limit`` rows of every query with their rank; scores are compared to six decimals and ties go to the smaller chunk id."""
    order = Window.partitionBy(*(scope or ["query_id"])).orderBy(F.round("score", 6).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def bm25_search(index: dict[str, DataFrame], queries: DataFrame, limit: int = 20, page_ranges: DataFrame | None = None) -> DataFrame:
    """Top chunks of every query: query_id, book_id, chunk_id, score, rank and the chunk's columns. A query without terms has no rows.

    ``page_ranges`` (query_id, lo, hi) restricts hits to chunks whose pages overlap; it never changes the statistics.
    """
    scored = score_queries(index, queries)
    chunks = index["chunks"]
    if page_ranges is not None:
        pages = chunks.select("book_id", "chunk_id", "page_start", "page_end")
        scored = scored.join(page_ranges, "query_id").join(pages, ["book_id", "chunk_id"]).where("page_end >= lo and page_start <= hi").select("query_id", "book_id", "chunk_id", "score")
    return top_hits(scored, limit).join(chunks, ["book_id", "chunk_id"])


def usable_range(page_start: Column, page_end: Column, confidence: Column) -> Column:
    """Whether an alignment's range restricts retrieval: both ends set and not 0, and the confidence not low."""
    return F.coalesce((page_start != 0) & (page_end != 0) & (confidence != "low"), F.lit(False))


def retrieve(index: dict[str, DataFrame], cards: DataFrame, alignments: DataFrame, limit: int = 6) -> DataFrame:
    """Chunks for every card (query_id, book_id, text), inside the aligned range (query_id, page_start, page_end, confidence) if anything is found there, else from the whole book.

    Scored once: rows are flagged by range, and a query with any flagged row keeps those alone.
    """
    scored = score_queries(index, cards)
    ranges = alignments.where(usable_range(F.col("page_start"), F.col("page_end"), F.col("confidence"))).select("query_id", F.col("page_start").alias("lo"), F.col("page_end").alias("hi"))
    placed = scored.join(index["chunks"].select("book_id", "chunk_id", "page_start", "page_end"), ["book_id", "chunk_id"]).join(ranges, "query_id", "left")
    inside = F.coalesce((F.col("page_end") >= F.col("lo")) & (F.col("page_start") <= F.col("hi")), F.lit(False))
    flagged = placed.withColumn("in_range", inside)
    # rows inside the range sort first; a query that has one never shows others, because its best row tells
    order = Window.partitionBy("query_id").orderBy(F.col("in_range").desc(), F.round("score", 6).desc(), "chunk_id")
    best = flagged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    restricted = F.first("in_range").over(Window.partitionBy("query_id").orderBy("rank"))
    kept = best.withColumn("_restricted", restricted).where(~F.col("_restricted") | F.col("in_range"))
    return kept.select("query_id", "book_id", "chunk_id", "score", "rank", "in_range").join(index["chunks"], ["book_id", "chunk_id"])


def figures_for_pages(figures: DataFrame, hits: DataFrame) -> DataFrame:
    """Figures on the pages of every hit (book_id, page_start, page_end, ...), by an equi-join on pages."""
    pages = hits.where("page_end >= page_start").withColumn("page", F.explode(F.sequence("page_start", "page_end")))
    return pages.join(figures, ["book_id", "page"])


def retrieve_figures(figures: DataFrame, hits: DataFrame, limit: int = 6) -> DataFrame:
    """Per query, the largest figures on its hits' pages, each number once; of equal areas the first seen."""
    found = figures_for_pages(figures.select("book_id", "number", "caption", "page", "bbox"), hits.select("query_id", "book_id", "rank", "page_start", "page_end"))
    first = found.groupBy("query_id", "book_id", "number").agg(F.min_by(F.struct("caption", "page", "bbox"), F.struct("rank", "page")).alias("f"), F.min(F.struct("rank", "page")).alias("seen"))
    sized = first.withColumn("area", figure_area(F.col("f.bbox")))
    order = Window.partitionBy("query_id").orderBy(F.col("area").desc(), "seen", "number", "book_id")
    return sized.withColumn("figure_rank", F.row_number().over(order)).where(F.col("figure_rank") <= limit).select("query_id", "book_id", "number", "f.caption", "f.page", "f.bbox", "area", "figure_rank")


def first_chunks(hits: DataFrame, cap: int = 24) -> DataFrame:
    """(deck_id, book_id, chunk_id, position) of hits (deck_id, section_index, rank, book_id, chunk_id): each chunk of a deck once, the first ``cap`` in section order."""
    first = hits.groupBy("deck_id", "book_id", "chunk_id").agg(F.min(F.struct("section_index", "rank")).alias("seen"))
    order = Window.partitionBy("deck_id").orderBy("seen", "book_id", "chunk_id")
    return first.withColumn("position", F.row_number().over(order)).where(F.col("position") <= cap).drop("seen")


def collect_chunks(index: dict[str, DataFrame], cards: DataFrame, per_section: int = 2, cap: int = 24) -> DataFrame:
    """Chunks for a whole deck: the best ``per_section`` of every section (deck_id, section_index, book_id, text), each once, the first ``cap`` in section order."""
    keyed = cards.withColumn("query_id", F.concat_ws("/", "deck_id", "section_index"))
    hits = top_hits(score_queries(index, keyed), per_section).join(keyed.select("query_id", "deck_id", "section_index"), "query_id")
    return first_chunks(hits, cap).join(index["chunks"], ["book_id", "chunk_id"])


def search_books(index: dict[str, DataFrame], queries: DataFrame, limit: int = 5) -> DataFrame:
    hits = bm25_search(index, queries, limit)
    label = T.citation_label(F.col("section_title"), F.col("page_start"), F.col("page_end"))
    return hits.select("query_id", "rank", "score", label.alias("citation"), F.substring("text", 1, 600).alias("preview"))


def snippet(body: Column, terms: Column, width: int = 18) -> Column:
    """A window of ``width`` words around the most distinct terms, earliest first, with hits in <mark> and an ellipsis where text is cut off.

    ``terms`` is array<struct<term, is_prefix>>. Windows begin two words before a hit, but not before the text and not so late that it ends inside them. Every word is tokenised once; one pass over the words
    keeps the last place of each term, from which the distinct terms of the window that ends there are counted.
    """

    def holds(word: Column, wanted: Column) -> Column:
        """Whether each term is in a word: array<boolean>."""

        def of(tokens: Column) -> Column:
            def meets(t: Column) -> Column:
                begins = F.exists(tokens, lambda x: F.coalesce(x.startswith(F.get(t["tokens"], F.size(t["tokens"]) - 1)), F.lit(False)))
                return F.coalesce(F.arrays_overlap(tokens, t["tokens"]) | (t["is_prefix"] & begins), F.lit(False))

            return F.transform(wanted, meets)

        return F.get(F.transform(F.array(T.tokenize(word)), of), F.lit(0))

    def built(m: Column) -> Column:
        n = F.size(m)
        hit = lambda at: F.coalesce(F.exists(F.get(m, at)["holds"], lambda h: h), F.lit(False))
        # a window may begin two words before a hit; the first and the last window stand for all that would begin outside
        latest = F.greatest(F.lit(0), n - width)

        def step(acc: Column, x: Column) -> Column:
            i, begin = acc["i"], F.greatest(F.lit(0), acc["i"] - width + 1)
            last = F.zip_with(acc["last"], x["holds"], lambda at, h: F.when(h, i).otherwise(at))
            distinct = F.size(F.filter(last, lambda at: at >= begin))
            early = (begin == 0) & (hit(F.lit(0)) | hit(F.lit(1)) | hit(F.lit(2)))
            late = (begin == latest) & F.exists(F.slice(m, F.greatest(F.lit(1), n - width + 3), F.lit(width)), lambda y: F.exists(y["holds"], lambda h: h))
            counts = ((i == width - 1) | (i > width - 1) | (i == n - 1)) & (hit(begin + 2) | early | late) & (distinct > acc["most"])
            return F.struct((i + 1).alias("i"), last.alias("last"), F.when(counts, distinct).otherwise(acc["most"]).alias("most"), F.when(counts, begin).otherwise(acc["start"]).alias("start"))

        none = F.transform(terms, lambda t: F.lit(-1))
        start = F.aggregate(m, F.struct(F.lit(0).alias("i"), none.alias("last"), F.lit(0).alias("most"), F.lit(0).alias("start")), step, lambda acc: acc["start"])

        def shown(s: Column) -> Column:
            window = F.transform(F.slice(m, s + 1, F.lit(width)), lambda x: F.when(F.exists(x["holds"], lambda h: h), F.concat(F.lit("<mark>"), x["word"], F.lit("</mark>"))).otherwise(x["word"]))
            return F.concat(F.when(s > 0, "…").otherwise(""), F.array_join(window, " "), F.when(s + width < n, "…").otherwise(""))

        return F.get(F.transform(F.array(start), shown), F.lit(0))

    words = F.filter(F.split(body, r"(?U)\s+"), lambda w: w != "")

    def whole(wanted: Column) -> Column:
        marked = F.transform(words, lambda w: F.struct(w.alias("word"), holds(w, wanted).alias("holds")))
        return F.get(F.transform(F.array(marked), built), F.lit(0))

    tokenised = F.transform(terms, lambda t: F.struct(T.tokenize(t["term"]).alias("tokens"), t["is_prefix"].alias("is_prefix")))
    return F.get(F.transform(F.array(tokenised), whole), F.lit(0))


def titled(found: DataFrame, documents: DataFrame) -> DataFrame:
    """Rows found (document_id, ...) with the title and kind of their document (id, title, kind)."""
    return found.join(documents.select(F.col("id").alias("document_id"), F.col("title").alias("document_title"), F.col("kind").alias("document_kind")), "document_id")


def with_snippets(found: DataFrame, sections: DataFrame, queries: DataFrame) -> DataFrame:
    """Rows found (query_id, document_id, section, ...) with heading and snippet: only here are texts read again."""
    keys = ["document_id", "section"]
    shown = found.join(sections.select(*keys, "heading", "body"), keys).join(queries.select("query_id", T.query_terms_and_prefix(F.coalesce("text", F.lit(""))).alias("terms")), "query_id")
    return shown.withColumn("snippet", snippet(F.col("body"), F.col("terms"))).drop("body", "terms")


def search_sections(index: dict[str, DataFrame], sections: DataFrame, documents: DataFrame, queries: DataFrame, limit: int = 20) -> DataFrame:
    """Sections of a course in which all terms of a query occur, a phrase as adjacent tokens, the last term as a prefix, ranked by BM25 over the whole library, with snippets.

    ``index`` is the stored index of ``sections`` (document_id, course_id, section, heading, body) over heading and body; ``documents`` has id, title, kind; ``queries`` query_id, course_id, text. The prefix
    counts every token that begins with it.
    """
    from .blockmax import all_terms_top

    found = all_terms_top(index, queries.withColumn("scope", F.lit("")), limit).drop("course_id", "scope", "len", "ord")
    named = titled(with_snippets(found, sections, queries), documents)
    return named.select("query_id", "rank", "score", "document_id", "document_title", "document_kind", "section", "heading", "snippet")
