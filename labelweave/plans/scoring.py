"""Scoring new documents with a trained or stored model."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.centroid import NearestCentroidModel, score_tokens
from ..operators.term_join import join_terms
from ..operators.terms import counted_documents
from ..operators.tfidf import TfIdfModel, check_same_space, exploded
from ..session import Staging
from .states import LearnedModel


def model_scoring_table(tf_idf: TfIdfModel, model: NearestCentroidModel) -> DataFrame:
    """``term, class_id, docs, dot_0, own_0`` of one fitted pair, in one pass over each table."""
    # A vocabulary-sized join; a term whose means are all zero still adds to a document's norm.
    idf = tf_idf.idf.select("term", "idf").filter("idf <> 0")
    joined = idf.join(model.centroids.select("term", "label_id", "mean", "docs"), "term")
    return joined.selectExpr(
        "term", "label_id AS class_id", "docs", "coalesce(idf * mean, 0D) AS dot_0",
        "CASE WHEN row_number() OVER (PARTITION BY term ORDER BY label_id) = 1"
        " THEN idf * idf ELSE 0D END AS own_0",
    )


def score(
    documents: DataFrame,
    tf_idf: TfIdfModel,
    model: NearestCentroidModel | LearnedModel,
    staging: Staging | None = None,
    table: DataFrame | None = None,
) -> DataFrame:
    """``doc_id, predicted, dist`` for every document, also those of no known word.

    A model of a learner has no distance; ``dist`` is null then.

    Weighting and distance are one pass over the documents, unless the model is too large to be
    broadcast; the features are never written out.  ``table`` is the model's staged scoring table,
    for callers that score again and again.
    """
    check_same_space(tf_idf.space, model.space)
    staging = staging or Staging(documents.sparkSession)
    if isinstance(model, LearnedModel):
        found = model.predict(tf_idf.transform(documents, staging))
        return found.select("doc_id", "predicted", F.lit(None).cast("double").alias("dist"))
    table = table or staging.write(model_scoring_table(tf_idf, model), "scoring")
    counted = counted_documents(documents.select("doc_id", "pages"), staging, "scored_counts")
    tokens = exploded(counted.select("doc_id", "terms", "total", "mx"), tf_idf.settings)
    found = score_tokens(
        tokens.withColumn("tf", F.coalesce("tf", F.lit(0.0))),
        documents.select("doc_id"),
        ["doc_id"],
        table,
        [0],
        model.norms(),
        lambda left, right: join_terms(left, right, tf_idf.budget, counted=False, staging=staging),
    )
    return found.drop("split_index")


def named(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``label_name`` from the label table; null where a label was deleted since."""
    names = labels.select(
        F.col("label_id").cast("string").alias("predicted"), F.col("name").alias("label_name")
    )
    return scored.join(names, "predicted", "left")
