from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def hostile(spark):
    """Nulls in any column, empty and odd texts, repeated rows, and further columns named like working ones."""
    base = "The quick brown fox jumps over the lazy dog and runs away from the big bad wolf. " * 9
    rows = [
        (1, base, "en", "a", 1),
        (1, base, "en", "a", 1),
        (2, base + "end", "en", "a", None),
        (3, None, "en", "a", 0),
        (4, "", "de", None, 0),
        (None, "Der schnelle braune Fuchs springt über den faulen Hund. " * 12, "de", "b", 3),
        (6, "12 34 !! ## ..", None, "b", 4),
        (7, " \t\n\x0b\f\r ", "fr", "c", 5),
        (8, "a" * 5000, None, None, None),
        (9, "ß é 日本語 🙂 \u00a0 <|endoftext|> x\n\nx\n", "fr", "c", 6),
        (10, None, None, None, None),
        (11, ("All rights reserved. " + base)[:900], "en", "a", 7),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({"_row": F.lit(1), "kept": F.lit("k"), "_fp": F.lit(2), "_text": F.lit("t"), "range": F.lit(0), "n_words": F.lit(9), "a`b.c": F.lit(4), "block": F.lit(1), "c0": F.lit(5), "held_out": F.lit("h"), "weight": F.lit(1.0)})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def some(spark, smallest):
    return spark.read.parquet(f"{smallest}/documents.parquet")
