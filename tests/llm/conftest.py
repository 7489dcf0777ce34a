import pytest

SF = "/root/testdata/sf0.001"

#: Nulls, empty and wordless texts, ties, repeated rows, other scripts and a long text.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (1, "The quick brown fox jumps over the lazy dog near the river bank today"),
    (2, None),
    (3, ""),
    (4, " \t\n "),
    (5, "Released under the MIT License. See cc by-nc too; under the mit license"),
    (6, "word " * 3000),
    (7, "日本語の文章です。\U0001f600 été ÉTÉ İ K 12³ <|endoftext|> a"),
    (None, "The quick brown fox jumps over the lazy dog near the river bank today!"),
    (8, "#$%& | <> *** ###"),
    (9, "line one is here\nline one is here\n\nline two"),
]


@pytest.fixture(scope="session")
def texts():
    return TEXTS


@pytest.fixture(scope="session")
def odd(spark):
    """A documents table with odd rows and extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame(TEXTS, "doc_id long, text string")
    return d.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "fp": F.lit("x"), "words": F.lit(1), "chunk": F.lit("c"), "score": F.lit(0), "n": F.lit(0), "length": F.lit("l"), "key": F.lit("k")})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
