import pytest
from pyspark.sql import types as T

WORDY = " ".join(f"word{i % 97} und{i % 31} été{i % 13}" for i in range(400))
TOXIC = "you are an idiot and a moron"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls in every column, empty, long and odd texts, repeated rows, repeated ids, and columns of clashing names."""
    schema = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text", T.StringType()),
            T.StructField("lang", T.StringType()),
            T.StructField("source", T.StringType()),
            T.StructField("n_chars", T.LongType()),
            *[T.StructField(n, T.StringType()) for n in ("key", "words", "root", "gram", "bucket", "node", "start", "chunk")],
        ]
    )
    texts = [
        (1, WORDY), (2, WORDY), (2, WORDY), (2, WORDY + " one more"), (3, None), (4, ""), (4, ""), (5, "   \n\t "),
        (6, "!!! ??? ---"), (7, "a"), (8, "two words"), (None, WORDY), (None, None), (9, "x" * 70_000), (10, "ab " * 30_000),
        (11, "é" * 60 + "日本語テスト" * 20), (12, "日本語テスト" * 30), (13, "<|endoftext|> it's <|turn|> 👍🏽"), (-5, WORDY.upper()),
        (14, TOXIC), (15, "\u0000 zero \x7f \u0085 next"),
    ]
    rows = [(i, t, None, None, None, "k", "w", None, "g", "b", "n", "s", "c") for i, t in texts]
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
