import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def sentence(rng: random.Random, n: int, syllables: str) -> str:
    parts = syllables.split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from (doc_id, text) or (doc_id, text, lang) rows, with extra columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F

    def make(rows, clash=True):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src0", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            for c in ("id", "key", "hash", "score", "kept", "row", "n", "keep", "_hash", "pos", "node", "label", "sketch"):
                df = df.withColumn(c, F.lit("x"))
        return df

    return make
