"""Exact top-k, source mixing, packing, URL filters against brute force."""

import datetime as d
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm import topk
from scholia.llm.mixing import mix_sources
from scholia.llm.packing import best_fit_plan, pack_documents
from scholia.llm.queries import mixing_parameters, packing_parameters
from scholia.llm.topk import top_inner_products
from scholia.llm.urlfilter import filter_urls


def plain_top(rows, k):
    v = {i: np.floor(256 * np.array(x, np.float64)).astype(np.int64) for i, x in rows}
    out = {}
    for q in v:
        if q % 5 == 0:
            scored = sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:k]
            out[q] = [(c, -s) for s, c in scored]
    return out


@pytest.mark.parametrize("cell,block,buckets", [(8192, 1024, 256), (16, 4, 256), (4, 3, 5)])
def test_top_products_equal_brute_force(spark, monkeypatch, cell, block, buckets):
    monkeypatch.setattr(topk, "CELL", cell)
    monkeypatch.setattr(topk, "QUERIES", block)
    monkeypatch.setattr(topk, "BUCKETS", buckets)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * rng.choice([0.1, 1.0, 5.0])]) for i in range(120)] + [(200 + i, [1.0] * 8) for i in range(8)] + [(300, [0.0] * 8), (305, [0.0] * 8)]
    got = defaultdict(list)
    for r in top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == plain_top(rows, 5)


def test_many_buckets_are_one_small_plan(spark, monkeypatch):
    monkeypatch.setattr(topk, "CELL", 2)
    monkeypatch.setattr(topk, "QUERIES", 40)
    monkeypatch.setattr(topk, "BUCKETS", 2000)
    rng = np.random.default_rng(4)
    lengths = np.exp(rng.normal(size=4000) * 1.5)
    rows = [(i, [float(x) for x in v / np.linalg.norm(v) * n]) for i, (v, n) in enumerate(zip(rng.normal(size=(4000, 4)), lengths))]
    asked = F.col("vec_id") % 100 == 0
    got = defaultdict(list)
    for r in top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    v = np.floor(256 * np.array([x for _, x in rows])).astype(np.int64)
    for q in range(0, 4000, 100):
        scores = v @ v[q]
        order = [c for c in np.lexsort((np.arange(4000), -scores)).tolist() if c != q][:5]
        assert got[q] == [(c, int(scores[c])) for c in order]


def test_mixed_lengths_raise(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(ValueError, match="1 and 2 components"):
        top_inner_products(rows, F.col("vec_id") % 5 == 0)


def test_odd_vectors_and_large_integers(spark):
    nan = float("nan")
    rows = [(0, [1.0, 2.0], "a"), (1, [None, 1.0], "a"), (2, [nan, 1.0], "a"), (3, None, "a"), (5, [8e6, 8e6], "a"), (6, [8e6, -8e6], None), (None, [9.0, 9.0], "a")]
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string"), F.col("vec_id") % 5 == 0).orderBy("query_id", "rank").collect()]
    big = 8_000_000 * 256
    assert got == [(0, 1, 5, 256 * big + 512 * big), (0, 2, 6, 256 * big - 512 * big), (5, 1, 0, 768 * big), (5, 2, 6, 0)]
    assert top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank string").limit(0), F.col("vec_id") % 5 == 0).count() == 0


def fill(budget, nodes):
    """{name: (weight, capacity)} -> quotas, by repeated sharing among those that aren't full."""
    out, open_ = dict.fromkeys(nodes, 0.0), {n for n, (w, _) in nodes.items() if w > 0}
    while open_ and budget > 1e-9:
        weight = sum(nodes[n][0] for n in open_)
        full = {n for n in open_ if nodes[n][1] <= budget * nodes[n][0] / weight}
        if not full:
            return out | {n: budget * nodes[n][0] / weight for n in open_}
        for n in full:
            out[n] = nodes[n][1]
        budget -= sum(nodes[n][1] for n in full)
        open_ -= full
    return out


def test_mixture_follows_the_tree(spark, documents):
    got = mix_sources(documents, **mixing_parameters(spark)).collect()
    size = {r["doc_id"]: -(-len(r["text"].encode()) // 4) for r in documents.collect()}
    place = {r["doc_id"]: (f"d{int(r['source'][3:]) % 4}", r["lang"], r["source"]) for r in documents.collect()}
    tokens = Counter()
    for i, p in place.items():
        tokens[p] += size[i]
    weights = {"d0": 4.0, "d1": 3.0, "d2": 2.0, "d3": 1.0} | {f"d{i}/en": 2.0 for i in range(4)}

    def under(prefix):
        names = {p[: len(prefix) + 1] for p in tokens if p[: len(prefix)] == prefix}
        return {n: (weights.get("/".join(n), 1.0), 2.0 * sum(t for p, t in tokens.items() if p[: len(n)] == n)) for n in names}

    level = {(): sum(tokens.values()) * 0.5}
    for _ in range(3):
        level = {n: q for prefix, budget in level.items() for n, q in fill(budget, under(prefix)).items()}
    taken, times, largest = Counter(), Counter(), {}
    for r in got:
        leaf = place[r["doc_id"]]
        assert (r["domain"], r["lang"], r["source"]) == leaf and r["n_tokens"] == size[r["doc_id"]]
        taken[leaf] += r["n_tokens"]
        times[r["doc_id"], r["epoch"]] += 1
        largest[leaf] = max(largest.get(leaf, 0), r["n_tokens"])
    assert max(times.values()) == 1
    for leaf, quota in level.items():
        assert abs(taken[leaf] - round(quota)) < largest.get(leaf, 1) + 1 and taken[leaf] >= round(quota)


def test_prefixes_are_the_same_however_they_are_cut(spark, documents, monkeypatch):
    from scholia.llm import mixing

    parameters = mixing_parameters(spark) | {"levels": {"all": F.lit("x")}, "weights": None, "max_epochs": 3, "budget_share": 1.4}
    monkeypatch.setattr(mixing, "BUCKET", 16)
    monkeypatch.setattr(mixing, "SMALL_TABLE", 0)
    small = mix_sources(documents, **parameters)
    total = documents.select(F.sum(F.ceil(F.octet_length("text") / 4))).first()[0]
    taken = small.agg(F.sum("n_tokens")).first()[0]
    assert 0 <= taken - round(total * 1.4) < documents.select(F.max(F.ceil(F.octet_length("text") / 4))).first()[0]
    assert small.where("epoch = 0").count() == documents.count() and small.where("epoch = 2").count() == 0


def test_mixing_odd_rows(spark, odd_documents):
    got = mix_sources(odd_documents, **mixing_parameters(spark) | {"budget_share": 2.0})
    # documents 1 and 2 are alone in leaves without tokens
    assert got.count() == 2 * (odd_documents.count() - 2)
    assert mix_sources(odd_documents, **mixing_parameters(spark) | {"budget_share": 0.0}).count() == 0
    assert mix_sources(odd_documents.limit(0), **mixing_parameters(spark)).count() == 0


def piece_by_piece(lengths, capacity):
    """How full all bins are by best-fit decreasing, one piece at a time. Of equally full bins either may take a piece."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(capacity - sum(b), i) for i, b in enumerate(bins) if capacity - sum(b) >= n]
        if fits:
            bins[min(fits)[1]].append(n)
        else:
            bins.append([n])
    return Counter(map(sum, bins))


def planned(lengths, capacity):
    counts = np.bincount(lengths, minlength=capacity + 1)
    plan = best_fit_plan(counts, capacity)
    bins = defaultdict(dict)
    for i, row in enumerate(plan):
        same = i + 1 < len(plan) and plan[i + 1]["length"] == row["length"]
        for k in range((plan[i + 1]["rank"] if same else counts[row["length"]]) - row["rank"]):
            held = bins[row["first"] + k // row["each"]]
            held[row["offset"] + k % row["each"] * row["length"]] = row["length"]
    for held in bins.values():  # gapless
        assert sorted(held) == [sum(held[o] for o in held if o < at) for at in sorted(held)]
    return Counter(int(sum(held.values())) for held in bins.values())


def test_the_plan_is_best_fit_piece_by_piece():
    rng = np.random.default_rng(7)
    for capacity in (1, 5, 16, 64, 300):
        for size in (1, 7, 60, 300):
            for top in (capacity, max(1, capacity // 3)):
                lengths = rng.integers(1, top + 1, size)
                assert planned(lengths, capacity) == piece_by_piece(lengths.tolist(), capacity)
    assert len(best_fit_plan(np.zeros(9, np.int64), 8)) == 0


def test_the_plan_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(8)
    few = np.append(0, rng.integers(0, 50, 2047))
    many = np.append(few * 1000, 0)
    assert len(best_fit_plan(many, 2048)) < 2 * len(best_fit_plan(np.append(few, 0), 2048)) + 2048


def check_packing(rows, texts, length):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        pieces[r["doc_id"]].append((r["piece"], r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in ids.items():
        at = 0
        for n, (piece, start, size) in enumerate(sorted(pieces[i])):
            assert piece == n and start == at and (size == length or (n == 0 and size == (len(whole) % length or length)))
            at += size
        assert at == len(whole)
    for parts in sequences.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(sequences), -(-sum(map(len, ids.values())) // length)


def test_packing_round_trip(documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    used, least = check_packing(pack_documents(documents, **packing_parameters()).collect(), texts, 2048)
    assert used <= least + 2
    small = packing_parameters() | {"length": 64}
    check_packing(pack_documents(documents, **small).collect(), texts, 64)


def test_packing_takes_special_strings_and_ranks_in_buckets(spark, documents, monkeypatch):
    from scholia.llm import packing

    monkeypatch.setattr(packing, "BUCKET", 50)
    texts = [(-1, "hello <|endoftext|> world"), (-2, "<|endoftext|>"), (-3, "a<|endoftext|><|endoftext|>b <|endoftext"), *[(r["doc_id"], r["text"]) for r in documents.collect()]]
    rows = pack_documents(spark.createDataFrame(texts, "doc_id long, text string"), **packing_parameters()).collect()
    check_packing(rows, texts, 2048)
    assert {r["doc_id"]: r["length"] for r in rows}[-1] == 5
    held = defaultdict(list)
    for r in rows:
        held[r["sequence_id"]].append(r["length"])
    assert len(held) == sum(piece_by_piece([r["length"] for r in rows], 2048).values())


def test_packing_odd_rows_and_ids(odd_documents):
    got = pack_documents(odd_documents, **packing_parameters(), with_ids=True).collect()
    assert Counter(r["doc_id"] for r in got)[5] == 2 and all(len(r["ids"]) == r["length"] for r in got)
    assert [r["ids"] for r in got if r["doc_id"] in (1, 2)] == [[0], [0]]
    assert pack_documents(odd_documents.limit(0), **packing_parameters()).count() == 0


def test_url_lists_hold_from_their_entry_to_their_removal(spark):
    day = lambda n: d.date(2024, 1, n)
    entries = spark.createDataFrame(
        [("ads", "Bad.example.org", True, day(5)), ("ads", "bad.example.org", True, day(6)), ("ads", "bad.example.org", False, day(10)), ("ads", "bad.example.org", True, day(20)), ("paths", "ok.example.org/a/b", True, day(1)), ("ads", "example.net", True, day(1)), ("x", None, True, day(1)), ("both", "same.org", True, day(3)), ("both", "same.org", False, day(3))],
        "list string, key string, listed boolean, at date",
    )
    cases = [
        ("http://bad.example.org/x", 4, []), ("http://bad.example.org/x", 5, ["ads"]), ("http://sub.bad.example.org", 9, ["ads"]), ("http://bad.example.org/", 10, []), ("https://u@BAD.example.org:8080/?q#f", 25, ["ads"]), ("http://notbad.example.org", 25, []),
        ("http://ok.example.org/a/b/c?x", 2, ["paths"]), ("http://ok.example.org/a//b", 2, ["paths"]), ("http://ok.example.org/a/bc", 2, []), ("http://deep.er.example.net/q", 2, ["ads"]), (None, 2, []), ("not a url", 2, []), ("http://same.org", 4, []), ("http://bad.example.org/x", None, []),
    ]
    captures = spark.createDataFrame([(i, u, None if n is None else day(n), "k") for i, (u, n, _) in enumerate(cases)] + [(1, cases[1][0], day(5), "k")], "page_id long, url string, fetched_at date, key string")
    got = filter_urls(captures, entries).collect()
    assert len(got) == len(cases) + 1
    for r in got:
        assert r["lists"] == cases[r["page_id"]][2] and r["kept"] == (not r["lists"]), r
    assert filter_urls(captures.limit(0), entries).count() == 0 and filter_urls(captures, entries.limit(0)).where("kept").count() == len(got)


def test_a_leaf_takes_the_prefix_of_its_seeded_order(spark, documents, monkeypatch):
    from scholia.llm import mixing

    monkeypatch.setattr(mixing, "BUCKET", 16)
    parameters = mixing_parameters(spark) | {"budget_share": 0.7, "seed": 11}
    mixed = mix_sources(documents, **parameters).collect()
    levels = parameters["levels"]
    key = F.xxhash64("doc_id", F.lit(11))
    rows = documents.select("doc_id", parameters["tokens"].cast("long").alias("n"), *[c.cast("string").alias(n) for n, c in levels.items()], *[F.xxhash64(key, F.lit(e), F.lit(11)).alias(f"order{e}") for e in (0, 1)]).collect()
    leaves, taken, quota = defaultdict(list), defaultdict(list), {}
    for r in rows:
        leaves[tuple(r[n] for n in levels)].append(r)
    for r in mixed:
        leaf = tuple(r[n] for n in levels)
        quota[leaf] = r["leaf_quota"]
        taken[leaf].append((r["epoch"], r["doc_id"]))
    for leaf, members in leaves.items():
        total, want, left = sum(r["n"] or 0 for r in members), [], quota.get(leaf, 0)
        buckets = -(-len(members) // 16)
        for epoch in (0, 1):
            before = 0
            for r in sorted(members, key=lambda r: (((r[f"order{epoch}"] % (1 << 64)) >> 40) % buckets, r[f"order{epoch}"])):
                if before < left:
                    want.append((epoch, r["doc_id"]))
                before += r["n"] or 0
            left -= total
        assert sorted(taken[leaf]) == sorted(want)


def test_mixing_keeps_columns_of_any_name(spark, documents):
    odd = documents.select("doc_id", "text", "lang", "source", *[F.lit(i).alias(n) for i, n in enumerate(["n_tokens", "epoch", "quota", "bucket", "order", "_key", "leaf_quota"])])
    got = mix_sources(odd, **mixing_parameters(spark), keep=tuple(odd.columns))
    assert got.select("n_tokens", "epoch", "quota", "bucket", "order", "_key", "leaf_quota").distinct().collect() == [(0, 1, 2, 3, 4, 5, 6)]
    assert {"taken_n_tokens", "taken_epoch", "taken_leaf_quota", "lang_level"} <= set(got.columns)
