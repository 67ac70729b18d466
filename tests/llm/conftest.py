import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
if ROOT not in sys.path:
    sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


SF = "/root/testdata/sf0.001"

#: Nulls, empty and blank texts, ties and repeats, a very long text, odd characters; columns whose names clash with the operators' own.
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog by the river bank today\nshared line", "x"),
    (2, "the quick brown fox jumps over the lazy dog by the river bank today\nshared line", None),
    (3, None, "x"),
    (4, "", "x"),
    (5, " \t\n ", "x"),
    (6, "word " * 9000 + "end", "x"),
    (7, "naïve café — 日本語 \u0000 'tis 12² don't  two  spaces\r\n\ttab", "x"),
    (8, "single", "x"),
    (9, "single", "x"),
    (9, "single", "x"),
    (None, "the quick brown fox jumps over the lazy dog by the river bank today\nshared line", "x"),
    (11, "<|endoftext|> in a text", "x"),
]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, component string").selectExpr("*", "1 as h", "2 as i", "3 as part", "4 as n", "'y' as k")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
