import pytest
from pyspark.sql import types as T

NASTY = ("row", "text2", "fingerprint", "component", "component_id", "key", "mark", "size", "hash", "rank", "known", "_range", "body", "id")


@pytest.fixture(scope="session")
def documents(spark):
    """Documents with nulls, empty and very long texts, repeated rows, ties and columns whose names
    the operators might use themselves."""
    long = " ".join(f"w{i % 700}x" for i in range(30_000))
    words = "the quick brown fox jumps over the lazy dog and runs away from all the noise in town today"
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (2, words, "en", "a"), (3, words + " again", "en", None), (4, None, None, None),
        (5, "", "de", "b"), (6, "  \n\t ", "de", "b"), (None, words, "en", "a"), (None, None, "en", "c"), (7, long, "fr", "c"),
        (8, "mail me: Joe.Doe@mail1.example.com or +1 (234) 555-9876, card 4111 1111 1111 1111, host 10.1.2.3", "en", "a"),
        (9, "MAIL JOE.DOE@MAIL1.EXAMPLE.COM AT 10.1.2.3", "en", "d"), (10, "one", "en", "a"), (11, "ONE", "en", "a"),
        (20, "noise in town and the lazy dog", "en", "e"), (40, None, "en", "e"),
    ]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
         T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in NASTY]
    )
    full = [(*r, len(r[1] or ""), *[f"{c}-{i}" for c in NASTY]) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, schema)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
