import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # A name that operators might use themselves.
        T.StructField("score", T.StringType()),
        T.StructField("keep_id", T.LongType()),
    ]
)


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) or (doc_id, text, source) rows."""

    def make(*rows):
        full = []
        for row in rows:
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, len(text) if text is not None else None, "x", 5))
        return spark.createDataFrame(full, DOCS)

    return make


def words(n, seed=0):
    """n different-looking words, the same for the same seed."""
    import random

    r = random.Random(seed)
    return ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 9))) for _ in range(n)]
