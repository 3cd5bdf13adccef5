import random

import pytest


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and extra columns whose names operators use inside."""
    rng = random.Random(3)
    long = " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) + str(rng.randrange(300)) for _ in range(30_000))
    rows = [(1, None, "en", "src0"), (2, "", "en", None), (3, long, None, "src1"), (4, long, "en", "src1"), (None, "a text without an id", "de", "src2"), (5, "short", "en", "src3"), (5, "short", "en", "src3"), (6, "  \n\t ", "fr", "src0"), (7, "Ünïcode 𝒳 é \u0000   text", "de", "src0"), (8, "short", "en", "src3")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "x", 9, 1.5, [1], "k") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, rank string, component_id int, score double, spans array<int>, grp string")
