import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, score double, epoch int, size long, n int, shard int, pieces string"


def rows_of(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[i % len(sources)], len(t or ""), False, 9.0, 1, 2, 3, 4, "x") for i, t in enumerate(texts)]


EDGES = [
    None, "", " \n\t ", "one", "a  b\tc\n", "a b c ", "a b c ", "A B C", "Grüße, Œuvre ñandú 漢字 😀 é É", "▁▁ <s> </s> \x00 <|endoftext|> x", "word " * 60_000 + "end", "the quick brown fox " * 40, "the quick brown fox " * 40 + "jumps",
    "Released under the MIT License. MIT   license", "GENERAL public\nLicense general public license", "Licensed under the Apache License, Version 2.0.", "it's we'll ΑΣ ΟΔΟΣ İ", "x" * 5000,
]


@pytest.fixture(scope="session")
def edges(spark):
    rows = rows_of(EDGES)
    return spark.createDataFrame([*rows, rows[5], (None, "a b c ", None, None, None, None, None, None, None, None, None, None)], DDL)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DDL)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
