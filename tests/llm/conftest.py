import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").collect()


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names operators use themselves."""
    rng = random.Random(5)
    long = " ".join(rng.choice(["alpha", "beta", "gam\u00e9", "delta,", "x"]) for _ in range(30_000))
    rows = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "one two"), (6, "A b  c\n d"), (6, "A b  c\n d"), (6, "other text here"), (None, "null id"), (None, None), (7, long), (8, long + " tail"), (9, "same words here"), (10, "same words here"), (11, "<|endoftext|> 12 it's  \u00a0 fine"), (12, "a" * 5000)]
    rows = [(d, t, "en", "s", 1, "x", "y", 3, 4) for d, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, shard int, length int")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
