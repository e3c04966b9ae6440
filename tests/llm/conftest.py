import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def rows(seed: int = 3) -> list[tuple]:
    """Nulls in every column, empty, blank and long texts, ties, copies, repeated rows and non-ASCII words."""
    r = random.Random(seed)
    vocab = [a + b for a in ("th", "er", "on", "é", "ß", "an", "LI") for b in ("a", "ing", "ou", "x.", "-", "Zu")]
    text = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    long = text(6000)
    base = text(80)
    out = [(None, text(30), "en", "src1", 5), (1, None, "en", "src1", 0), (2, "", None, None, 0), (3, " \t\n ", "en", "src2", 4), (4, long, "en", "src0", None), (5, long, "en", "src0", 1), (5, long, "en", "src0", 1), (6, "one two", "en", "b", 7), (7, "One TWO", "en", "B", 7), (8, "one two three four", "en", "b", 7), (9, "a b c\x1cd  e", "fr", "é", 9)]
    for i in range(10, 40):
        words = base.split()
        for _ in range(i % 5):
            words[r.randrange(80)] = "new" + str(r.randrange(9))
        out.append((i, " ".join(words), "en", "src0", 1))
    for i in range(40, 90):
        out.append((i, text(r.randrange(1, 200)) + r.choice(["", "\nline one here\nline one here", " | * #", "\r\n"]), "de", f"src{r.randrange(4)}", 1))
    out += [(90 + k, "same line of words here now " * 12, "en", "src3", 1) for k in range(6)]
    return out


@pytest.fixture(scope="session")
def docs(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows(), SCHEMA).repartition(5)
    # names that operators could use for columns of their own
    return df.withColumns({k: F.lit("x") for k in ("id", "size", "kept", "n", "score", "target", "__size", "keep_id")}).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
