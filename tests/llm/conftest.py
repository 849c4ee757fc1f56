import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

HEX = "0123456789abcdef" * 3
PASSAGE = " ".join(f"w{i}" for i in range(60))
EDGE_TEXTS = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "Two words"), (6, PASSAGE), (7, PASSAGE), (8, "x " + PASSAGE + " y"),
    (9, "a" * 3000 + " é\U0001f600 " + "b c " * 800), (10, f"password = {HEX} token: short AKIA{'A1' * 10} <|endoftext|>"),
    (11, PASSAGE.upper()), (None, PASSAGE), (None, None), (12, "same row here"), (12, "same row here"), (12, "other text"),
    (13, "it's 12 'll   \r\n  x y \x1c z"), (14, "Key=abcdefghij secret: token: abcdefghijk"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns whose names operators use too."""
    rows = [(d, t, "en", None, len(t or "")) for d, t in EDGE_TEXTS]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("kept", "fp", "key", "label_", "n_words", "spans_", "hits_", "row", "chunk", "doc", "uid", "stats_"):
        df = df.withColumn(name, F.lit("taken"))
    return df.repartition(3)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="session")
def benchmark_table(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")
