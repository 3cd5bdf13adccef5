"""The stored index against exhaustive scoring, prefixes against plain filters, snippets against windows taken one by one."""

import random
import re

import pytest
from pyspark.sql import functions as F

from scholia.functions import text as T
from scholia.operators import blockmax as X
from scholia.operators import index as I
from scholia.operators import search as S
from scholia.sources.tables import files_signature, load_or_build_search

WORDS = [f"w{i}" for i in range(40)] + ["alpha", "alphabet", "al", "beta", "bet", "x_y", "gamma", "é", "éclair"]


@pytest.fixture(scope="module")
def library(spark, tmp_path_factory):
    rng = random.Random(7)
    rows = [(f"b{i % 3}", i, " ".join(rng.choices(WORDS, weights=[1 / (n + 1) for n in range(len(WORDS))], k=rng.randrange(0, 40))), f"title {i % 5}", i, i + i % 2) for i in range(1500)]
    rows += [("b0", 2000 + i, "gamma gamma tie", "", 2000 + i, 2000 + i) for i in range(20)]
    chunks = spark.createDataFrame(rows, "book_id string, chunk_id long, text string, section_title string, page_start long, page_end long").cache()
    path = str(tmp_path_factory.mktemp("index"))
    X.write_search_index(chunks.withColumnRenamed("book_id", "scope"), path, ["chunk_id"], ["text", "section_title"], ["page_start", "page_end"])
    return chunks, X.read_search_index(spark, path)


def cards(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.sample(WORDS, rng.randrange(1, 6))) for _ in range(40)] + ["gamma tie", "x_y w1", "w0", "nothing here", "", "w1_w0 gamma"]
    return spark.createDataFrame([(i, f"b{i % 3}", t) for i, t in enumerate(texts)], "query_id long, book_id string, text string")


def test_top_equals_exhaustive_scoring(spark, library):
    chunks, index = library
    want = S.top_hits(S.score_queries(I.build_bm25_index(chunks), cards(spark)), 6)
    got = X.bm25_top(index, cards(spark).withColumnRenamed("book_id", "scope"), 6)
    same = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    assert same(got) == same(want) and got.count() > 150


def test_ranges_equal_exhaustive_scoring(spark, library):
    chunks, index = library
    q = cards(spark)
    ranges = q.select("query_id", (F.col("query_id") * 30).alias("page_start"), (F.col("query_id") * 30 + 200).alias("page_end"), F.when(F.col("query_id") % 5 == 0, "low").otherwise("high").alias("confidence"))
    want = S.retrieve(I.build_bm25_index(chunks), q, ranges)
    got = X.retrieve_ranged(index, q.withColumnRenamed("book_id", "scope"), ranges)
    same = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], r["in_range"], round(r["score"], 5)) for r in df.collect())
    assert same(got) == same(want) and {r["in_range"] for r in got.collect()} == {True, False}


def test_blocks_below_the_threshold_are_not_read(spark, tmp_path):
    rows = [(1, i, "common " * (1 + i % 3) + ("rare " * 3 if i == 777 else "") + "filler " * (i % 50)) for i in range(X.BLOCK_ROWS * 20)]
    chunks = spark.createDataFrame(rows, "scope long, chunk_id long, text string").withColumn("scope", F.lit("b"))
    X.write_search_index(chunks, str(tmp_path / "i"), ["chunk_id"], ["text"])
    search = X.BlockSearch(X.read_search_index(spark, str(tmp_path / "i")), spark.createDataFrame([(1, "b", "rare common")], "query_id long, scope string, text string"))
    found, read = search.top(1)
    assert found.first()["ord"] == 777 and tuple(read.first()) == (1, 20, X.SEEDS)


@pytest.mark.parametrize("prefix", ["a", "al", "alpha", "alphabets", "é", "w1", "zz"])
def test_prefix_terms(spark, library, prefix):
    _, index = library
    wanted = spark.createDataFrame([("b0", prefix, 1), ("b1", prefix, 2)], "scope string, prefix string, n int")
    got = sorted((r["scope"], r["term"], r["df"], r["n"]) for r in X.terms_of_prefixes(index["dictionary"], wanted).collect())
    folded = [tuple(r) for r in index["dictionary"].select("scope", "term", "df").collect()]
    assert got == sorted((s, t, df, {"b0": 1, "b1": 2}[s]) for s, t, df in folded if t.startswith(prefix) and s in ("b0", "b1"))


def test_an_index_is_built_once(spark, tmp_path):
    spark.createDataFrame([("s", 1, "one two")], "scope string, chunk_id long, text string").write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    first = files_signature(rows)
    assert files_signature(spark.read.parquet(str(tmp_path / "rows"))) == first
    load_or_build_search(rows, str(tmp_path / "index"), ["chunk_id"], ["text"])
    built = sorted(p.name for p in (tmp_path / "index").iterdir())
    again = load_or_build_search(rows, str(tmp_path / "index"), ["chunk_id"], ["text"])
    assert sorted(p.name for p in (tmp_path / "index").iterdir()) == built and again["dictionary"].count() == 2
    rows.write.mode("append").parquet(str(tmp_path / "rows"))
    assert files_signature(spark.read.parquet(str(tmp_path / "rows"))) != first


def plain_snippet(body, terms, width):
    words = [w for w in re.split(r"\s+", body) if w]
    tokens = lambda w: re.findall(r"[^\W_]+", w.lower())
    holds = [{t for t, p in terms if any(x in tokens(t) or (p and x.startswith(tokens(t)[-1])) for x in tokens(w))} for w in words]
    starts = sorted({max(0, min(i - 2, len(words) - width)) for i, h in enumerate(holds) if h}) or [0]
    start = min(starts, key=lambda s: (-len(set().union(*holds[s : s + width])), s))
    shown = [f"<mark>{w}</mark>" if h else w for w, h in list(zip(words, holds))[start : start + width]]
    return ("…" if start > 0 else "") + " ".join(shown) + ("…" if start + width < len(words) else "")


def test_snippets_equal_windows(spark):
    rng = random.Random(9)
    terms = [("alpha", False), ("w1", False), ("bet", True), ("x_y", False)]
    bodies = [" ".join(rng.choices(WORDS, k=n)) for n in [*range(0, 30), 60, 100, 400] for _ in range(2)]
    bodies += ["filler " * 50 + "alpha", "alpha " + "filler " * 50, "  alpha\n\tw1  ", "none at all " * 9, "q " * 17 + "alpha", "q " * 16 + "alpha q", "alpha " * 40 + "w1 betting", "Alpha, (w1)! bets"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    listed = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(p).alias("is_prefix")) for t, p in terms])
    for width in (18, 4):
        got = {r["i"]: r["s"] for r in rows.select("i", S.snippet(F.col("body"), listed, width).alias("s")).collect()}
        assert got == {i: plain_snippet(b, terms, width) for i, b in enumerate(bodies)}


def test_many_blocks_are_scored_without_meeting_pairs(spark, library, monkeypatch):
    """Where too many blocks are left to broadcast, all postings are scored where they are; results stay."""
    chunks, index = library
    q = cards(spark).withColumnRenamed("book_id", "scope")
    same = lambda df: sorted((r["query_id"], r["rank"], r["chunk_id"], round(r["score"], 5)) for r in df.collect())
    want = same(X.bm25_top(index, q, 2))
    monkeypatch.setattr(X, "SEEDS", 1)
    monkeypatch.setattr(X, "BROADCAST_ROWS", 0)
    assert same(X.bm25_top(index, q, 2)) == want


def test_a_block_is_grouped_where_it_is_read(spark, library):
    """All postings of a block lie in one file, so they were never dealt out by term."""
    _, index = library
    files = index["blocks"].select("block", F.input_file_name().alias("file")).groupBy("block").agg(F.count_distinct("file").alias("n"))
    assert files.where("n > 1").count() == 0 and files.count() > 5


def test_grouping_goes_on_over_batches():
    import pyarrow as pa

    rows = [("s", i, 3, 3.0, ["a", None, "b", "a"]) for i in range(X.BLOCK_ROWS + 5)]
    table = pa.table({n: pa.array(c) for n, c in zip(("scope", "ord", "len", "avg_len", "tokens"), zip(*rows))})
    made = [r for b in X._in_blocks(iter(table.to_batches(max_chunksize=50))) for r in b.to_pylist()]
    assert sorted((r["term"], r["block"], r["n"]) for r in made) == [("a", 0, X.BLOCK_ROWS), ("a", 1, 5), ("b", 0, X.BLOCK_ROWS), ("b", 1, 5)]
    first = next(r for r in made if r["term"] == "a" and r["block"] == 1)
    assert [p["ord"] for p in first["p"]] == list(range(X.BLOCK_ROWS, X.BLOCK_ROWS + 5)) and first["p"][0]["tf"] == 2 and first["places"][0] == [0, 3]
