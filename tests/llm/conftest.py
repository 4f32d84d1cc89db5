import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").config("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


#: Nulls, empties, blanks, ties, repeats, exotic blanks, a very long text.
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. It was the best of times, it was the worst."),
    (2, "The quick brown fox jumps over the lazy dog. It was the best of times, it was the worst."),
    (2, "The quick brown fox jumps over the lazy dog. It was the best of times, it was the worst."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, "É é ß İ 日本語 text  with odd blanks \x1c and\r\nlines <|endoftext|> isn't it's"),
    (None, "a row without an id has words too"),
    (7, "one"),
    (8, " ".join(f"w{k * k % 977}" for k in range(30_000))),
    (9, " ".join(f"w{k * k % 977}" for k in range(200, 600))),
    (10, "x" * 70_000 + " y"),
]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", "s", len(t) if t else 0, "clash") for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string")
