"""MinHash and embedding near-dedup against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from scholia.llm import minhash as M
from scholia.llm.embed_dedup import embedding_duplicates
from scholia.llm.graph import connected_components
from scholia.llm.minhash import near_duplicates, required_overlap, shingle_hashes


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text, words):
    tokens = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return frozenset(tuple(tokens[i : i + words]) for i in range(max(1, len(tokens) - words + 1))) if tokens else frozenset()


def plain_near(texts, words, percent):
    sets = {i: shingles(t, words) for i, t in texts}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return sets, components(sets, links)


def near_texts(seed=1):
    """Groups of near copies around the threshold, one large; a passage that most documents share."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(60)]
    texts = []
    for size in (1, 2, 3, 40, 80):
        base = [word() for _ in range(rng.randint(20, 200))] + passage
        for _ in range(size):
            copy = list(base)
            for _ in range(rng.randint(0, 9)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
    texts += [" ".join([word() for _ in range(rng.randint(1, 30))] + passage) for _ in range(60)] + [" ".join(passage[:n]) for n in (1, 2, 3, 50, 55, 60)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("words,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, words, percent):
    texts = near_texts()
    sets, want = plain_near(texts, words, percent)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), words, percent).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_on_the_table(documents):
    texts = [(r["doc_id"], r["text"]) for r in documents.collect()]
    _, want = plain_near(texts, 3, 85)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(documents, 3, 85).collect()} == want


def test_near_duplicates_of_odd_rows(spark, odd_documents):
    got = near_duplicates(odd_documents)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"] and got.count() == odd_documents.count()
    rows = {r["doc_id"]: r for r in got.collect()}
    assert rows[1]["n_shingles"] == rows[2]["n_shingles"] == rows[6]["n_shingles"] == 0 and rows[1]["kept"] and rows[2]["kept"]
    assert rows[4]["component_id"] == 3 and rows[8]["component_id"] == 5 and rows[None]["component_id"] is None and rows[None]["kept"]
    assert near_duplicates(odd_documents.limit(0)).count() == 0


def test_case_and_separators():
    assert (shingle_hashes("A b\tC\x0bd", 3) == shingle_hashes("a  b c D", 3)).all()
    assert len(shingle_hashes("É b c", 3)) == 1 and (shingle_hashes("É b c", 3) != shingle_hashes("é b c", 3)).all()
    assert len(shingle_hashes("a b c", 3)) == 1 and (shingle_hashes("one two", 3) == shingle_hashes("one  two", 5)).all()


def test_overlap_bound_is_safe():
    rng = np.random.default_rng(5)
    assert required_overlap(48, 0.85) <= min(rng.binomial(48, 0.85, 200_000))


def vectors(seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(30, 16))
    rows = [c + rng.normal(size=16) * s for c in centres for s in (0.05, 0.12, 0.2, 0.3)] + list(rng.normal(size=(80, 16)))
    rows += [rows[0]] * 5
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rows)]


def plain_cosine(rows, least):
    x = np.array([v for _, v in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    hit = u @ u.T >= least
    ids = [i for i, _ in rows]
    links = [(ids[a], ids[b]) for a, b in zip(*np.nonzero(hit)) if a < b]
    return dict(zip(ids, hit.sum(axis=1) - 1)), components(ids, links)


@pytest.mark.parametrize("per_cell", [10_000, 20])
def test_embedding_links_equal_brute_force(spark, per_cell):
    rows = vectors()
    counts, want = plain_cosine(rows, 0.9)
    got = embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 0.9, vectors_per_cell=per_cell).collect()
    assert {r["vec_id"]: r["n_links"] for r in got} == counts
    assert {r["vec_id"]: r["component_id"] for r in got} == want


def test_odd_vectors_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 7), (2, [2.0, 0.0], 7), (3, None, 7), (4, [0.0, 0.0], 7), (5, [nan, 1.0], 7), (6, [inf, 1.0], 7), (7, [None, 1.0], 7), (8, [], 7), (None, [1.0, 0.0], 7), (9, [1.0, 0.01], None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, copies int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(df).collect()}
    assert got[1] == (2, 1, True) and got[2] == (2, 1, False) and got[9] == (2, 1, False) and got[None] == (0, None, True)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7, 8))
    assert embedding_duplicates(df.limit(0)).count() == 0


def test_repeated_ids_with_other_vectors(spark, monkeypatch):
    from scholia.llm import embed_dedup

    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, a), (2, a), (3, a), (1, b), (4, b), (5, b), (5, b), (6, c), (1, None)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in embedding_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect())
    assert got == sorted([(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (1, 3, 1, True), (4, 3, 1, False), (5, 3, 1, False), (5, 3, 1, False), (6, 0, 6, True), (1, 0, 1, True)])
    with pytest.raises(ValueError, match="2 and 3 components"):
        embedding_duplicates(spark.createDataFrame([(1, a), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))
    monkeypatch.setattr(embed_dedup, "CHUNK_BYTES", 8 * 16 * 8)  # chunks of the least size
    huge = [(1, [1e200, 1e199]), (2, [1e200, 1.1e199]), (3, [1e-200, 1e-201]), (4, [1e-200, -1e-200])]
    found = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_duplicates(spark.createDataFrame(huge, "vec_id long, embedding array<double>")).collect()}
    assert found == {1: (2, 1), 2: (2, 1), 3: (2, 1), 4: (0, 4)}


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(150)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3), (7, None)]
    real = [(a, b) for a, b in edges if a is not None and b is not None]
    want = components({x for e in real for x in e}, real)
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert all(got.get(n, n) == c for n, c in want.items())
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def shared_passage(copies=0, documents=3000, seed=4):
    """Texts of 200 words, three in five of them one passage, and near copies of one of them."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=5))
    passage = [word() for _ in range(120)]
    texts = [[word() for _ in range(80)] + passage for _ in range(documents)]
    for _ in range(copies):
        copy = list(texts[0])
        for _ in range(rng.randint(0, 4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(copy)
    return [(i, " ".join(t)) for i, t in enumerate(texts)]


def test_a_shared_passage_makes_no_candidates(spark, monkeypatch):
    seen = []
    real = M.connected_components
    monkeypatch.setattr(M, "connected_components", lambda edges, a, b: seen.append(real(edges, a, b)) or seen[-1])
    got = near_duplicates(spark.createDataFrame(shared_passage(), "doc_id long, text string"))
    assert got.where("doc_id != component_id").count() == 0
    assert seen[0].count() == 0  # candidate groups


@pytest.mark.parametrize("block", [16, 512])
def test_large_groups_beside_a_shared_passage(spark, monkeypatch, block):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "SKETCH_BLOCK", block)
    texts = shared_passage(copies=120, documents=150)
    _, want = plain_near(texts, 5, 80)
    got = near_duplicates(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_estimates_of_unions():
    rng = np.random.default_rng(6)
    for same in (30, 60, 90):
        pool = rng.choice(1 << 40, 200, replace=False)
        a, b = np.sort(pool[:100]), np.sort(np.concatenate([pool[:same], pool[100 : 200 - same]]))
        union = np.union1d(a, b)[:64]
        shared = len(np.intersect1d(np.intersect1d(a[:64], b[:64]), union))
        for overlap in (shared, shared + 1):
            assert M._estimated([a[:64]], [b[:64]], 64, overlap)[0] == (shared >= overlap)
