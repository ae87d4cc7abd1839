import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, size string, fp string, _hash binary, _junk int, _kept string, _size int, _row int, row int, m map<string,int>"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names that operators use."""
    rows = [
        (1, "Alpha beta gamma delta epsilon. " * 30, "en", "a", 5, "x", "y", "z"),
        (2, "alpha BETA gamma delta epsilon. " * 30, "en", "a", 5, None, None, None),
        (2, "alpha BETA gamma delta epsilon. " * 30, "en", "a", 5, None, None, None),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", None, 0, "x", None, None),
        (5, " \n\t ", "en", "b", 4, None, None, None),
        (None, "alpha beta gamma delta epsilon. " * 30, "en", "b", 5, None, None, None),
        (None, None, None, "b", None, None, None, None),
        (6, "Été 中文 \U0001f600 word", "fr", "c", 9, None, None, None),
        (7, "w" * 70_000 + " tail", "en", "c", 70_005, None, None, None),
        (8, "one two three four five six " * 6_000, "en", "a", 1, None, None, None),
    ]
    return spark.createDataFrame([(*r, b"h", 7, "k", k, k, k, {"a": k}) for k, r in enumerate(rows)], DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
