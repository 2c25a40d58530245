import random

import pytest
from pyspark.sql import functions as F

# names that the operators use for columns of their own
CLASHING = ("size", "rank", "bucket", "key", "node", "shard", "part", "guest", "unit", "rep", "n",
            "row", "line", "first", "copies", "host", "path", "keep", "ids", "_size", "_row", "_id")
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8))) for _ in range(120)]
    text = []
    for k in range(words):
        text.append(rng.choice(vocabulary))
        if k % 12 == 11:
            text.append("\n")
    return " ".join(text).replace(" \n ", "\n")


def rows_of_trouble() -> list[tuple]:
    """NULLs in every column, empty and blank texts, repeated rows, ties, marks, one very long text."""
    plain = [(k, prose(k, 40 + 7 * k), "en", f"s{k % 3}", 100) for k in range(12)]
    return plain + [
        (20, None, "en", "s0", None),
        (21, "", "en", "s0", 0),
        (22, " \t\n\r ", None, "s1", 5),
        (23, "word", "de", None, 4),
        (24, "ein Wort", "de", None, 8),
        (25, "漢字 ▁ é́ \x0b😀 ÄÖ  x", "", "", 14),
        (None, "a row without an id", "en", "s2", 19),
        (None, None, None, None, None),
        (30, prose(3, 61), "en", "s0", 100),
        (31, prose(3, 61), "en", "s0", 100),
        (31, prose(3, 61), "en", "s0", 100),
        (31, prose(3, 61), "en", "s0", 100),
        (40, prose(40, 20_000), "en", "s0", 120_000),
    ]


@pytest.fixture(scope="module")
def trouble(spark):
    docs = spark.createDataFrame(rows_of_trouble(), DOCUMENTS)
    return docs.select("*", *[F.lit(7).alias(c) for c in CLASHING]).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCUMENTS)
