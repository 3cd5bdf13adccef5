"""Near-dedup where blocks are few and chunks many."""

import pyarrow as pa

from scholia.llm import minhash as M
from tests.llm.test_dedup import near_texts, plain_near


def test_groups_of_fewer_classes_than_chunks(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_VALUES", 16)
    texts = near_texts(3)
    _, want = plain_near(texts, 3, 85)
    got = M.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), 3, 85).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_the_union_of_sketches_is_cut_in_the_order_of_the_sketches():
    a, b = (" ".join(f"w{i}" for i in range(low, low + 72)) for low in (0, 5))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([a, b, " ".join(f"w{i}" for i in range(77))])], ["doc_id", "text"])
    first, second, union = next(M._sketches([batch], words=3, k=48)).column("sketch").to_pylist()
    assert first == sorted(first) and sorted({*first, *second})[:48] == union
