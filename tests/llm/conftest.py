import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
LINE = "This line is in the footer of many documents"


@pytest.fixture(scope="session")
def docs(spark):
    return table(spark, SMALL, "documents")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    rows = [
        (1, None, "en", None, None), (2, "", None, "a", 0), (3, " \t\n ", "en", "a", 3), (4, f"{LINE}\nshort\n{LINE.upper()} ", "en", "b", 1),
        (5, f"  {LINE}\nown words here", "en", "b", 1), (6, f"{LINE}", "en", "b", 1), (6, f"{LINE}", "en", "b", 1), (7, f"{LINE}\r\n{LINE}\n", "en", None, 1),
        (8, "word " * 30000, "en", "c", 150000), (9, "x" * 50000, "en", "c", 50000), (10, "one two", "en", "a", 7), (11, "One  TWO", "en", "a", 8),
        (None, f"{LINE}\nno id", "en", "c", 9), (12, "é ß İ ẞ words of another kind <|endoftext|> 12", "de", "d", 9), (12, "other text, same id", "de", "d", 9),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "h", "slice", "size", "target", "doc", "fp", "words", "pos", "text_key", "block", "grp", "taken", "score", "one", "kept"):
        df = df.withColumn(name, F.lit(f"own {name}"))
    return df


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
