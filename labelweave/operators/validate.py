"""Checks of input data.  Each raises ``InvalidInput`` or returns the offending rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import MAX_PAGES, InvalidInput, SplitSettings


def class_counts(documents: DataFrame) -> DataFrame:
    """``label_id, n``: documents of every class, empty documents included."""
    return documents.groupBy("label_id").agg(F.count(F.lit(1)).alias("n"))


def train_size(n, ratio: float):
    """Truncated train share in 32-bit arithmetic; both operands must be floats for that."""
    return F.floor(n.cast("float") * F.lit(ratio).cast("float")).cast("bigint")


def class_table(documents: DataFrame) -> DataFrame:
    """``label_id, class_ix, n``: the classes in label order, numbered from 0.

    Corpus-sized tables carry the short number in place of the label.  The window sees one row per
    class.
    """
    return class_counts(documents).selectExpr(
        "label_id",
        "CAST(row_number() OVER (ORDER BY label_id) - 1 AS INT) AS class_ix",
        "n",
    )


def training_summary(classes: DataFrame, settings: SplitSettings) -> DataFrame:
    """One row of all that decides whether a data set can be trained on, from its class table."""
    summary = classes.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("documents"),
        F.count(F.lit(1)).alias("classes"),
        F.coalesce(F.min("n"), F.lit(0)).cast("bigint").alias("smallest_class"),
        F.coalesce(F.max("n"), F.lit(0)).cast("bigint").alias("largest_class"),
        F.count_if(F.col("label_id").isNull()).alias("unlabelled"),
        F.coalesce(F.sum(F.octet_length(F.col("label_id").cast("string"))), F.lit(0))
        .cast("bigint")
        .alias("label_bytes"),
    )
    return summary.withColumn("train_size", train_size(F.col("documents"), settings.ratio))


def check_classes(classes: DataFrame, settings: SplitSettings) -> Row:
    """Reject settings and data no evaluated run can use; returns the summary row."""
    settings.check_trainable()
    summary = training_summary(classes, settings).first()
    if summary["documents"] == 0:
        raise InvalidInput("there are no documents to train on")
    if summary["unlabelled"]:
        raise InvalidInput("every training document needs a label")
    if summary["smallest_class"] < 2:
        raise InvalidInput("a class has a single document; two are the least")
    if settings.sampling == "random" and not 0 < summary["train_size"] < summary["documents"]:
        raise InvalidInput("this ratio leaves the training or the test part empty")
    return summary


def check_training_documents(documents: DataFrame, settings: SplitSettings) -> Row:
    return check_classes(class_counts(documents), settings)


def repeated_ids(documents: DataFrame) -> DataFrame:
    """Document ids that occur more than once or are null."""
    counts = documents.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.filter((F.col("n") > 1) | F.col("doc_id").isNull())


def check_document_ids(documents: DataFrame) -> None:
    """Rows are matched by id throughout, so ids must be unique."""
    if repeated_ids(documents).limit(1).count():
        raise InvalidInput("document ids must be unique and not null")


def oversized_documents(documents: DataFrame, limit: int = MAX_PAGES) -> DataFrame:
    """Documents of more pages than allowed."""
    if "page_count" not in documents.columns:
        documents = documents.withColumn("page_count", F.size("pages"))
    pages = F.col("page_count").cast("bigint").alias("page_count")
    return documents.select("doc_id", pages).filter(F.col("page_count") > limit)


def check_page_counts(documents: DataFrame, limit: int = MAX_PAGES) -> None:
    if oversized_documents(documents, limit).limit(1).count():
        raise InvalidInput("a document has more pages than allowed")


def unknown_label_ids(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct label ids of documents that the label table lacks."""
    known = labels.select(F.col("label_id").cast("string").alias("label_id"))
    return documents.select("label_id").distinct().join(known, "label_id", "left_anti")


def check_label_ids(documents: DataFrame, labels: DataFrame) -> None:
    if unknown_label_ids(documents, labels).limit(1).count():
        raise InvalidInput("a document refers to a label that the label table lacks")


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))


def non_finite_rows(features: DataFrame) -> DataFrame:
    """Feature rows whose weight is null, NaN or infinite."""
    return features.filter(~is_finite(F.col("weight")))


def unmatched_predictions(expected: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with a true label but no prediction, or the reverse."""
    left = expected.select(*keys, F.lit(True).alias("has_label"))
    right = predicted.select(*keys, F.lit(True).alias("has_prediction"))
    both = left.join(right, keys, "full")
    return both.filter(F.col("has_label").isNull() | F.col("has_prediction").isNull())
