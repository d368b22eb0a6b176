import pytest

ODD = [
    None, "", " ", "\n\t", "a", "A a A", "one two three", "The quick brown fox jumps over the lazy dog and runs away from it all",
    "the quick brown fox jumps over the lazy dog and runs away from it all", "é" * 50 + " ñandú", "x " * 3000, "日本語 のテキスト 😀", "<|endoftext|> tail <|endoftext|>",
    "\x00 nul \x07 bell", "pass" * 2000, "ba" * 40,
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts, ties and repeated rows, null ids, and extra columns whose names clash with those used inside."""
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, ODD[7]), (100, ODD[7]), (None, "a"), (None, None), (7, ODD[7])]
    rows = [(i, t, "en", "s", len(t or ""), 0.5, "k", 1, "x") for i, t in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node int, _id string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
