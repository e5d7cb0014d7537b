import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents from (doc_id, text, source) tuples."""

    def make(rows, extra=()):
        frame = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCUMENTS)
        for name in extra:  # columns whose names clash with those that operators make
            from pyspark.sql import functions as F

            frame = frame.withColumn(name, F.lit("x"))
        return frame

    return make


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty, short and long texts, exact copies, near copies, shared passages and repeated rows."""
    import random

    rng = random.Random(5)
    base = [words(rng, rng.randrange(60, 200)) for _ in range(30)]
    passage = words(rng, 110, 5000)
    rows = [(i, t, f"s{i % 4}") for i, t in enumerate(base)]
    for i in range(6):
        rows.append((100 + i, base[0], "s0"))
    for i in range(8):
        parts = base[1].split()
        parts[10 * i] = f"edit{i}"
        rows.append((200 + i, " ".join(parts), "s1"))
    for i in range(5):
        rows.append((300 + i, base[10 + i] + "\n" + passage + "\n" + words(rng, 40), "s2"))
    rows += [(400, None, "s0"), (401, "", None), (402, "   \n\t ", "s3"), (403, "one", "s3"), (404, "two words", None), (None, base[2], "s1"), (None, words(rng, 80), None)]
    rows += [(405, words(rng, 9000), "s1"), (406, "é" * 900 + " ü" * 500, "s2"), (407, "aaaa " * 300, "s2")]
    rows += [(3, base[3], "s3"), (3, base[3], "s3")]
    return rows
