"""TF-IDF: fitting a vocabulary with its weights, and weighting documents with it."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InvalidInput, TfIdfSettings
from ..functions.weights import idf_weight, tf_weight
from ..session import BROADCAST_BYTES, Staging
from .metrics import union_all
from .term_join import join_terms
from .terms import counted_documents, maximum_frequency, term_index


@dataclass(frozen=True)
class Features:
    """A sparse document-term matrix in long form.

    ``rows`` holds ``doc_id, term, weight`` without zeros; ``documents`` has one row per document,
    so that those without any weight are not lost; ``space`` names the vocabulary the columns
    belong to, and ``columns`` is its size.
    """

    rows: DataFrame
    documents: DataFrame
    space: str
    columns: int
    #: ``term, docs`` of the space, where it is known
    vocabulary: DataFrame | None = None
    #: most a join of these rows with a table of terms may broadcast
    budget: int = BROADCAST_BYTES
    #: whether the vocabulary was fitted on these documents, so that its ``docs`` are theirs
    fitted_here: bool = False

    def vectors(self, indexed_terms: DataFrame, budget: int = BROADCAST_BYTES) -> DataFrame:
        """``doc_id, indices, weights`` by column order, one row per document.

        ``indexed_terms`` is the ``term, docs, term_index`` table of this feature space.
        """
        terms = indexed_terms.select("term", "docs", "term_index")
        placed = join_terms(self.rows, terms, min(budget, self.budget), counted=self.fitted_here)
        rows = placed.groupBy("doc_id").agg(
            F.array_sort(F.collect_list(F.struct("term_index", "weight"))).alias("row")
        )
        empty = F.array().cast("array<struct<term_index:bigint,weight:double>>")
        every = self.documents.select("doc_id").join(rows, "doc_id", "left")
        row = F.coalesce("row", empty)
        return every.select(
            "doc_id",
            F.transform(row, lambda e: e["term_index"]).alias("indices"),
            F.transform(row, lambda e: e["weight"]).alias("weights"),
        )


def check_same_space(features_space: str, model_space: str) -> None:
    if features_space != model_space:
        raise InvalidInput("these features were made with another vocabulary than the model was trained on")


def exploded(counted: DataFrame, settings: TfIdfSettings) -> DataFrame:
    """One row per document and term with its TF weight ``tf``; other columns are kept."""
    rest = [c for c in counted.columns if c not in ("terms", "total", "mx")]
    rows = counted.select(*rest, "total", "mx", F.inline("terms"))
    weight = tf_weight(settings, F.col("cnt"), F.col("total"), F.col("mx"))
    return rows.select(*rest, "term", weight.alias("tf"))


@dataclass(frozen=True)
class TfIdfModel:
    """Fitted state: ``idf`` holds ``term, docs, df, idf`` and is a staged or saved table."""

    settings: TfIdfSettings
    idf: DataFrame
    documents: int
    columns: int
    space: str = field(default_factory=lambda: uuid.uuid4().hex)
    budget: int = BROADCAST_BYTES

    def vocabulary(self) -> DataFrame:
        return self.idf.select("term").orderBy("term")

    def idf_weights(self) -> DataFrame:
        """``term, idf`` in vocabulary order."""
        return self.idf.select("term", "idf").orderBy("term")

    def document_frequency(self) -> DataFrame:
        return self.idf.select("term", "df")

    def indexed_terms(self, staging: Staging) -> DataFrame:
        return term_index(self.idf.select("term", "docs", "df", "idf"), staging)

    def transform(self, documents: DataFrame, staging: Staging | None = None) -> Features:
        """Weights of new documents; terms outside the vocabulary have no column.

        Terms are counted once, into a staged table: the join may read them more than once.
        """
        staging = staging or Staging(documents.sparkSession)
        counted = counted_documents(
            documents.select("doc_id", "pages"), staging, "transformed_counts"
        )
        return self.weigh(counted, documents)

    def weigh(
        self, counted: DataFrame, documents: DataFrame, fitted_here: bool = False
    ) -> Features:
        """Weights of documents whose terms are counted; ``fitted_here`` if this fitted on them."""
        # A weight of exactly zero is left out; its term stays in the vocabulary.
        tokens = exploded(counted.select("doc_id", "terms", "total", "mx"), self.settings)
        table = self.idf.select("term", "docs", "idf")
        weighed = join_terms(tokens, table, self.budget, counted=fitted_here)
        rows = weighed.select("doc_id", "term", (F.col("tf") * F.col("idf")).alias("weight"))
        keep = [c for c in ("doc_id", "name", "label_id") if c in documents.columns]
        return Features(
            rows.filter("weight != 0"),
            documents.select(*keep),
            self.space,
            self.columns,
            self.idf.select("term", "docs"),
            self.budget,
            fitted_here,
        )


def weigh_together(
    models: list[TfIdfModel], counted: DataFrame, keys: list[str], staging: Staging
) -> DataFrame:
    """``<keys>, term, w_0 ..``: weights of documents in the spaces of several models, side by side.

    The models weigh term frequencies alike, and their ``docs`` are those of these counted documents.
    All terms are met in one pass, whatever the number of models, with all of their budgets; a space
    without a term has no weight for it.
    """
    every = [f"idf_{i}" for i in range(len(models))]
    tables = [
        model.idf.select("term", "docs", *[
            (F.col("idf") if i == at else F.lit(None).cast("double")).alias(name)
            for i, name in enumerate(every)
        ])
        for at, model in enumerate(models)
    ]
    table = union_all(tables).groupBy("term").agg(
        F.max("docs").alias("docs"), *[F.max(name).alias(name) for name in every]
    )
    table = staging.write(table, "idf_together")
    tokens = exploded(counted.select(*keys, "terms", "total", "mx"), models[0].settings)
    weighed = join_terms(tokens, table, sum(model.budget for model in models), staging=staging)
    weights = [(F.col("tf") * F.col(name)).alias(f"w_{i}") for i, name in enumerate(every)]
    return weighed.select(*keys, "term", *weights)


class TfIdf:
    """Estimator.  Fitted state lives in the model it returns, never in the estimator."""

    def __init__(self, settings: TfIdfSettings | None = None, budget: int = BROADCAST_BYTES):
        self.settings = settings or TfIdfSettings()
        self.budget = budget

    def fit(self, documents: DataFrame, staging: Staging | None = None) -> TfIdfModel:
        staging = staging or Staging(documents.sparkSession)
        counted = counted_documents(documents.select("doc_id", "pages"), staging, "term_counts")
        return self.fit_counted(counted, counted.count(), staging)

    def fit_transform(
        self, documents: DataFrame, staging: Staging | None = None
    ) -> tuple[TfIdfModel, Features]:
        """Fit and weigh the same documents, counting their terms once."""
        staging = staging or Staging(documents.sparkSession)
        counted = counted_documents(documents.select("doc_id", "pages"), staging, "term_counts")
        model = self.fit_counted(counted, counted.count(), staging)
        return model, model.weigh(counted, documents, fitted_here=True)

    def fit_counted(self, counted: DataFrame, documents: int, staging: Staging) -> TfIdfModel:
        """Fit on so many documents whose terms are counted already."""
        terms = counted.select(F.explode("terms.term").alias("term"))
        frequency = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
        frequency = staging.write(frequency, "document_frequency")
        size, max_df = frequency.count(), maximum_frequency(frequency).first()["max_df"]
        weight = idf_weight(
            self.settings, F.lit(documents).cast("bigint"), F.col("df"), F.lit(max_df)
        )
        idf = frequency.select("term", F.col("df").alias("docs"), "df", weight.alias("idf"))
        return TfIdfModel(self.settings, idf, documents, size, budget=self.budget)
