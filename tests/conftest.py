import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def staging(spark):
    from labelweave.session import Staging

    return Staging(spark)


@pytest.fixture(scope="session")
def make_documents(spark):
    """Documents from lists of pages, numbered in order, with labels if given."""

    def make(pages, labels=None):
        if labels is None:
            return spark.createDataFrame(list(enumerate(pages)), "doc_id long, pages array<string>")
        rows = [(i, p, label) for i, (p, label) in enumerate(zip(pages, labels, strict=True))]
        return spark.createDataFrame(rows, "doc_id long, pages array<string>, label_id string")

    return make


WORDS = ["ant", "bee", "cat", "dog", "elk", "fox", "gnu", "hen", "jay", "koi"]
LABEL_3, LABEL_8 = "03" * 12, "08" * 12


@pytest.fixture(scope="session")
def animals(spark):
    """Ten documents of two classes, each with a word of its own."""
    rows = [
        (i, word, [f"{'apple' if i < 5 else 'orange'} {word}"], LABEL_3 if i < 5 else LABEL_8)
        for i, word in enumerate(WORDS)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, name string, pages array<string>, label_id string"
    )


@pytest.fixture(scope="session")
def fruit(make_documents):
    pages = [["apple fruit sweet"]] * 5 + [["orange citrus sour"]] * 5
    return make_documents(pages, [LABEL_3] * 5 + [LABEL_8] * 5)
