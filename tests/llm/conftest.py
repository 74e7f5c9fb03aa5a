import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                     T.StructField("found", T.StringType())])


def words(rng, n):
    part = "th er on an re he in ed nd ha at en es of or nt ea ti to it".split()
    return ["".join(rng.choice(part) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """Ordinary, repeated, null, empty, blank, tiny, very long, odd texts."""
    rng = random.Random(5)
    out = [" ".join(words(rng, rng.randint(1, 120))) for _ in range(60)]
    out += [None, "", "   ", "\n\t", "x", "A", "Zwei Wörter", "ÀÉ ß İ Σς", "#### $$$ !!!", "<|endoftext|> a <|startoftext|>b", "don't we'll 's 're 12½3",
            "a b\u0085c d", "你好 😀 ok", "line\nline\nline", "é combining"]
    out += [out[3]] * 5 + [out[3] + " extra"]
    out.append(" ".join(words(rng, 30_000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with extra columns of clashing names, a null id and a repeated row."""
    rows = [(i, t, ["en", "de", None][i % 3], "s", len(t or ""), "x", "y") for i, t in enumerate(texts)]
    rows += [rows[0], (None, "no id here", None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
