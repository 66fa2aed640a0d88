"""Nearest-centroid classification.

The squared distance of a document x to a class mean c is ``|x|^2 - 2 x.c + |c|^2``.  Of the classes
a document shares no word with, for which x.c is 0, only the one of least norm can be nearest.  So a
document is compared with the classes it meets through a word and with that one class, which is the
same for all documents; rows of documents and classes that share nothing are not formed.

This holds as long as no product of a weight and a mean is negative, which is so for TF-IDF: both
carry the same IDF.  Where a word's weights and means have both signs, a document that meets m
classes is compared with them and with the first of the m + 1 classes of least norm it does not meet.

Weights whose squares do not fit a double are summed by magnitude, see ``wide``.

A scoring table, ``term, class_id, docs, dot_i.., own_i..``, holds the sums' factors for several
splits side by side: ``dot_i`` per class and ``own_i``, which adds to ``|x|^2``, on one class of
each term.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import InvalidInput
from ..session import BROADCAST_BYTES, Staging, broadcast_if_small
from . import wide
from .term_join import join_terms
from .tfidf import Features, check_same_space
from .validate import class_counts, is_finite

#: The term every document has while documents are counted.  Words are never empty.
CONSTANT = ""
#: Squared distances closer than this share, as a power of two, of their own size count as equal.
TIE_BITS = 40
#: Most sums that a row of a document holds side by side, for which the generated code stays small
#: enough for the JIT compiler.
WIDE_SUMS = 48

NO_TRAINING_DATA = "nothing to learn from: rows, features and a label for every row are needed"


class Classifier(Protocol):
    """What a model has to offer to be trained, judged and selected."""

    def predict(self, features: Features) -> DataFrame:
        """``doc_id, predicted`` with one row per row of ``features.documents``."""

    def labels(self) -> DataFrame:
        """Distinct learned ``label_id`` values in order."""


def _half_distance(dot: str, norm2: str) -> str:
    """``(d^2 - |x|^2) / 2``, which orders the classes of one document by distance."""
    return f"({norm2} / 2D - ({dot}))"


def _tie_key(half: str, norm2: str) -> str:
    """``half`` without the digits that rounding errors reach.

    The step is a power of two below the magnitude of the numbers this class alone brings, so a far
    class never blurs the order of the near ones.
    """
    size = f"greatest({norm2}, abs({half}))"
    step = f"power(2D, floor(log2({size})) - {TIE_BITS})"
    return f"CASE WHEN {size} > 0D THEN rint({half} / {step}) * {step} ELSE 0D END"


def least_norms(class_stats: DataFrame, splits: list[int]) -> dict[int, tuple[object, float]]:
    """By split the class of least norm and that norm, from ``class_id, n_i, norm2_i``.

    One row; of equally short means the lowest label's.
    """
    row = class_stats.agg(
        *[
            F.expr(
                f"min(CASE WHEN n_{i} > 0 THEN struct({_tie_key(f'norm2_{i} / 2D', f'norm2_{i}')}"
                f" AS tie, class_id, norm2_{i} AS norm2) END) AS least_{i}"
            )
            for i in splits
        ]
    ).first()
    return {i: (row[f"least_{i}"]["class_id"], row[f"least_{i}"]["norm2"]) for i in splits}


@dataclass(frozen=True)
class ClassNorms:
    """``table`` holds ``class_id, n_i, norm2_i``, hinted for a join; ``least`` see above."""

    table: DataFrame
    least: dict[int, tuple[object, float]]


def nearest_class(
    sums: DataFrame, keys: list[str], splits: list[int], norms: ClassNorms
) -> DataFrame:
    """``split_index, <keys>, predicted, dist`` from partial sums per document and class.

    Every document must have a row; its ``class_id`` is null if it meets no class.  The smallest
    distance wins, of equal ones the lowest label.
    """
    per_class = sums.groupBy(*keys, "class_id").agg(
        *[F.expr(f"sum(dot_{i}) AS dot_{i}") for i in splits],
        *[F.expr(f"sum(own_{i}) AS own_{i}") for i in splits],
    )
    table = norms.table.select("class_id", *[f"n_{i}" for i in splits],
                               *[f"norm2_{i}" for i in splits])
    halves = per_class.join(table, "class_id", "left").selectExpr(
        *keys,
        "class_id",
        *[f"own_{i}" for i in splits],
        *[f"norm2_{i}" for i in splits],
        *[
            f"CASE WHEN n_{i} > 0 THEN {_half_distance(f'dot_{i}', f'norm2_{i}')} END AS half_{i}"
            for i in splits
        ],
    )
    per_document = halves.groupBy(*keys).agg(
        *[
            F.expr(
                f"min(CASE WHEN half_{i} IS NOT NULL THEN struct("
                f"{_tie_key(f'half_{i}', f'norm2_{i}')} AS tie, class_id, half_{i} AS half) END)"
                f" AS met_{i}"
            )
            for i in splits
        ],
        *[F.expr(f"sum(own_{i}) AS own_{i}") for i in splits],
    )
    kind = halves.schema["class_id"].dataType
    found = []
    for i in splits:
        label, norm2 = norms.least[i]
        half = repr(norm2 / 2)
        unmet = F.struct(
            F.expr(_tie_key(f"CAST('{half}' AS DOUBLE)", f"CAST('{norm2!r}' AS DOUBLE)"))
            .alias("tie"),
            F.lit(label).cast(kind).alias("class_id"),
            F.lit(norm2 / 2).alias("half"),
        )
        best = F.least(F.col(f"met_{i}"), unmet)
        # Rounding may leave a squared distance of zero slightly negative.
        square = F.greatest(F.lit(0.0), F.col(f"own_{i}") + 2 * best["half"])
        found.append(
            F.struct(
                F.lit(i).alias("split_index"),
                best["class_id"].alias("predicted"),
                F.sqrt(square).alias("dist"),
            )
        )
    rows = per_document.select(*keys, F.inline(F.array(*found)))
    return rows.select("split_index", *keys, "predicted", "dist")


def score_tokens(
    tokens: DataFrame,
    every: DataFrame,
    keys: list[str],
    table: DataFrame,
    splits: list[int],
    norms: ClassNorms,
    join: Callable[[DataFrame, DataFrame], DataFrame],
) -> DataFrame:
    """Nearest class of documents given as ``<keys>, term, tf`` rows, none negative.

    ``every`` holds the keys of all documents, also those without a known word; ``table`` holds
    ``term, class_id, docs, dot_i.., own_i..``; ``join`` brings tokens and table together.
    """
    return score_sums(met_sums(join(tokens, table), keys, splits), every, keys, splits, norms)


def met_sums(joined: DataFrame, keys: list[str], splits: list[int]) -> DataFrame:
    """``<keys>, class_id, dot_i.., own_i..`` of each word and class, from tokens joined with a table."""
    return joined.selectExpr(
        *keys,
        "class_id",
        *[f"tf * dot_{i} AS dot_{i}" for i in splits],
        *[f"tf * tf * own_{i} AS own_{i}" for i in splits],
    )


def score_sums(
    sums: DataFrame, every: DataFrame, keys: list[str], splits: list[int], norms: ClassNorms
) -> DataFrame:
    """Nearest class of the documents of ``every`` from the sums of those that hold a known word."""
    kind = sums.schema["class_id"].dataType.simpleString()
    bare = every.selectExpr(
        *keys,
        f"CAST(NULL AS {kind}) AS class_id",
        *[f"0D AS dot_{i}" for i in splits],
        *[f"0D AS own_{i}" for i in splits],
    )
    return nearest_class(sums.unionByName(bare), keys, splits, norms)


def side_by_side(table: DataFrame, classes: int, splits: list[int]) -> DataFrame:
    """``term, dot_i_c.., own_i..``: one row per term of a table whose classes are numbered."""
    return table.groupBy("term").agg(
        *[
            F.expr(f"sum(CASE WHEN class_id = {c} THEN dot_{i} ELSE 0D END) AS dot_{i}_{c}")
            for i in splits
            for c in range(classes)
        ],
        *[F.expr(f"sum(own_{i}) AS own_{i}") for i in splits],
    )


def wide_sums(
    tokens: DataFrame, wide: DataFrame, keys: list[str], table: DataFrame, classes: int, splits: list[int]
) -> DataFrame:
    """As ``met_sums``, added up by document, from a broadcast of terms with all classes in a row.

    A word then is one row and not one for each class.  A class of which a document has no word gets
    a row whose ``dot_i`` are 0, as they are by definition.
    """
    sums = tokens.join(F.broadcast(wide), "term").groupBy(*keys).agg(
        *[
            F.expr(f"sum(tf * dot_{i}_{c}) AS dot_{i}_{c}")
            for i in splits
            for c in range(classes)
        ],
        *[F.expr(f"sum(tf * tf * own_{i}) AS own_{i}") for i in splits],
    )
    kind = table.schema["class_id"].dataType.simpleString()
    rows = ", ".join(
        f"struct(CAST({c} AS {kind}) AS class_id, "
        + ", ".join(f"dot_{i}_{c} AS dot_{i}" for i in splits)
        + ", "
        + ", ".join(f"{'0D' if c else f'own_{i}'} AS own_{i}" for i in splits)
        + ")"
        for c in range(classes)
    )
    return sums.selectExpr(*keys, f"inline(array({rows}))")


@dataclass(frozen=True)
class NearestCentroidModel:
    """Fitted means: ``centroids`` holds ``term, label_id, docs, mean``, without zeros;
    ``class_stats`` holds ``label_id, n, norm2``.  Both are staged or saved tables."""

    centroids: DataFrame
    class_stats: DataFrame
    space: str
    budget: int = BROADCAST_BYTES

    def labels(self) -> DataFrame:
        return self.class_stats.select("label_id").orderBy("label_id")

    def predict(self, features: Features) -> DataFrame:
        return self.distances(features).select("doc_id", "predicted")

    def norms(self) -> ClassNorms:
        """Norms of the classes; a table too large to be broadcast is left to the planner."""
        table = self.class_stats.selectExpr("label_id AS class_id", "n AS n_0", "norm2 AS norm2_0")
        small = broadcast_if_small(table, "class_id", self.budget)
        return ClassNorms(small, least_norms(table, [0]))

    def distances(self, features: Features, staging: Staging | None = None) -> DataFrame:
        """``doc_id, predicted, dist`` for every document, with or without features."""
        check_same_space(features.space, self.space)
        means = self.centroids.selectExpr("term", "label_id AS class_id", "docs", "mean AS dot_0")
        # Checked as the rows pass by, which spares a pass of its own over the features.
        weight = F.when(is_finite(F.col("weight")), F.col("weight")).otherwise(
            F.raise_error(F.lit("a feature is not a finite number")).cast("double")
        )
        # Features are a join of the corpus with its vocabulary, made once for the passes below.
        staging = staging or Staging(features.documents.sparkSession)
        # Its name is its own, as frames of an earlier call may still read theirs.
        name = f"judged_features-{uuid.uuid4().hex}"
        weights = staging.write(features.rows.select("doc_id", "term", "weight"), name)
        rows = weights.select("doc_id", "term", weight.alias("tf"))
        every = features.documents.select("doc_id")
        budget = min(self.budget, features.budget)
        # Documents the vocabulary was fitted on are not counted again.
        met = join_terms(rows, means, budget, counted=features.fitted_here)
        found = self._magnitudes(weights)
        mixed = found.negative and self._mixed_signs(weights)
        if found.safe:
            return self._plain(rows, every, met, mixed, staging)
        return self._wide(rows, every, met, mixed, staging)

    def _plain(self, rows, every, met, mixed, staging) -> DataFrame:
        norms = self.norms()
        kind = self.centroids.schema["label_id"].dataType.simpleString()
        # A document's own norm counts all its terms, also those no class has.
        own = rows.selectExpr(
            "doc_id", f"CAST(NULL AS {kind}) AS class_id", "0D AS dot_0", "tf * tf AS own_0"
        )
        dots = met.selectExpr("doc_id", "class_id", "tf * dot_0 AS dot_0", "0D AS own_0")
        if mixed:
            staging = staging or Staging(every.sparkSession)
            dots = dots.groupBy("doc_id", "class_id").agg(F.sum("dot_0").alias("dot_0"))
            dots = staging.write(dots.withColumn("own_0", F.lit(0.0)), "met")
            order = [F.expr(_tie_key("norm2_0 / 2D", "norm2_0")), F.col("class_id")]
            bare = _first_unmet(every, dots, norms.table.filter("n_0 > 0").orderBy(*order))
            # The least of those that are not met is there already, for every document its own.
            norms = ClassNorms(norms.table, {0: (None, math.inf)})
        else:
            bare = every.selectExpr("doc_id", f"CAST(NULL AS {kind}) AS class_id")
        bare = bare.selectExpr("doc_id", "class_id", "0D AS dot_0", "0D AS own_0")
        sums = dots.unionByName(own).unionByName(bare)
        return nearest_class(sums, ["doc_id"], [0], norms).drop("split_index")

    def _wide(self, rows, every, met, mixed, staging) -> DataFrame:
        """Distances from sums by magnitude: as fine as those of ordinary weights, and never lost."""
        staging = staging or Staging(every.sparkSession)
        of_classes = self.centroids.groupBy(F.col("label_id").alias("class_id")).agg(
            *wide.product_sums("mean", "mean", "n")
        )
        classes = self.class_stats.select(F.col("label_id").alias("class_id"))
        norms = classes.join(of_classes, "class_id", "left")
        norms = staging.write(norms.na.fill(0.0, wide.names("n")), "wide_norms")
        dots = met.groupBy("doc_id", "class_id").agg(*wide.product_sums("tf", "dot_0", "d"))
        dots = staging.write(dots, "wide_dots")

        level, half = wide.combined("{n} / 2D - {d}", "n", "d")
        _, norm2 = wide.combined("{n} + 0D * {d}", "n", "d")
        size = F.greatest(norm2, F.abs(half))
        key = wide.order_key(level, wide.rounded(half, size, TIE_BITS)).alias("key")
        nearest_bare = norms.select("*", *wide.zeros("d")).select("class_id", key)
        nearest_bare = nearest_bare.orderBy("key", "class_id")
        if mixed:
            bare = _first_unmet(every, dots, nearest_bare)
        else:
            label = nearest_bare.first()["class_id"]
            kind = self.centroids.schema["label_id"].dataType
            bare = every.select("doc_id", F.lit(label).cast(kind).alias("class_id"))
            bare = bare.join(dots.select("doc_id", "class_id"), ["doc_id", "class_id"], "left_anti")
        pairs = dots.unionByName(bare.select("doc_id", "class_id", *wide.zeros("d")))
        small = broadcast_if_small(norms, "class_id", self.budget)
        best = pairs.join(small, "class_id").groupBy("doc_id").agg(
            F.min(F.struct(key, "class_id", *wide.names("n"), *wide.names("d")))
            .alias("best")
        )
        own = rows.groupBy("doc_id").agg(*wide.product_sums("tf", "tf", "o"))
        joined = best.select(
            "doc_id", F.col("best.class_id").alias("predicted"),
            *[f"best.{c}" for c in wide.names("n") + wide.names("d")],
        ).join(own, "doc_id", "left").na.fill(0.0, wide.names("o"))
        square = wide.combined("{o} - 2D * {d} + {n}", "o", "d", "n")
        return joined.select("doc_id", "predicted", wide.root(*square).alias("dist"))

    def _magnitudes(self, rows: DataFrame) -> _Magnitudes:
        """Signs and sizes of weights and means, in a pass over each."""
        sizes = []
        for table, value in ((rows, "weight"), (self.centroids, "mean")):
            size = F.abs(F.col(value))
            sizes.append(
                table.agg(
                    F.min(value).alias("least"),
                    F.max(size).alias("most"),
                    F.min(F.when(size > 0, size)).alias("finest"),
                ).first()
            )
        known = [s for s in sizes if s["most"] is not None]
        return _Magnitudes(
            any(s["least"] < 0 for s in known),
            all(
                not math.isfinite(s["most"])  # which is an error, told when the row passes by
                or s["most"] <= 2.0**wide.SAFE_POWER
                and (s["finest"] or 1.0) >= 2.0**-wide.SAFE_POWER
                for s in known
            ),
        )

    def _mixed_signs(self, rows: DataFrame) -> bool:
        """Whether a weight and a mean of one word differ in sign, so that sharing it adds distance."""

        def signs(table: DataFrame, value: str, name: str) -> DataFrame:
            return table.groupBy("term").agg(
                (F.min(value) < 0).alias(f"{name}_below"), (F.max(value) > 0).alias(f"{name}_above")
            )

        both = signs(rows, "weight", "x").join(signs(self.centroids, "mean", "c"), "term")
        return not both.filter("x_below AND c_above OR x_above AND c_below").isEmpty()


@dataclass(frozen=True)
class _Magnitudes:
    negative: bool
    safe: bool


def _first_unmet(every: DataFrame, met: DataFrame, by_norm: DataFrame) -> DataFrame:
    """``doc_id, class_id``: of the classes a document does not meet, the first of an order.

    A document that meets m classes finds it among the first m + 1, so only as many are looked at
    as the most any document meets, and one more.
    """
    classes = met.groupBy("doc_id").agg(F.collect_set("class_id").alias("met"))
    most = classes.agg(F.max(F.size("met"))).first()[0] or 0
    first = [r["class_id"] for r in by_norm.limit(most + 1).select("class_id").collect()]
    kind = by_norm.schema["class_id"].dataType
    order = F.array(*[F.lit(c).cast(kind) for c in first])
    none = F.array().cast(f"array<{kind.simpleString()}>")
    unmet = F.filter(order, lambda c: ~F.array_contains(F.coalesce("met", none), c))
    found = every.join(classes, "doc_id", "left").select("doc_id", F.get(unmet, 0).alias("class_id"))
    return found.filter("class_id IS NOT NULL")


class NearestCentroid:
    """Estimator: the mean weight of every term over the documents of a class."""

    def __init__(self, budget: int = BROADCAST_BYTES) -> None:
        self.budget = budget

    def fit(self, features: Features, staging: Staging | None = None) -> NearestCentroidModel:
        documents = features.documents
        staging = staging or Staging(documents.sparkSession)
        if features.columns <= 0 or "label_id" not in documents.columns:
            raise InvalidInput(NO_TRAINING_DATA)
        # Documents are counted, not feature rows: one without features still lowers the mean.
        counts = staging.write(class_counts(documents.select("label_id")), "class_counts")
        rows, unlabelled = counts.agg(
            F.count(F.lit(1)), F.count_if(F.col("label_id").isNull())
        ).first()
        if not rows or unlabelled:
            raise InvalidInput(NO_TRAINING_DATA)
        labelled = features.rows.join(documents.select("doc_id", "label_id"), "doc_id")
        # Weights near the end of a double's range are summed apart, as their sum may be beyond it.
        large = f"abs(weight) >= power(2D, {wide.WIDTH})"
        sums = labelled.groupBy("term", "label_id").agg(
            F.expr(f"sum(CASE WHEN {large} THEN 0D ELSE weight END) AS total"),
            F.expr(f"sum(CASE WHEN {large} THEN weight * power(2D, -{wide.WIDTH}) ELSE 0D END) AS far"),
            F.count(F.lit(1)).alias("held"),
        )
        means = sums.join(counts, "label_id").select(
            "term",
            "label_id",
            F.sum("held").over(Window.partitionBy("term")).alias("docs"),
            F.expr(f"total / n + far / n * power(2D, {wide.WIDTH}) AS mean"),
        )
        centroids = staging.write(means.filter("mean != 0"), "centroids")
        norms = centroids.groupBy("label_id").agg(
            F.sum(F.col("mean") * F.col("mean")).alias("norm2")
        )
        stats = counts.join(norms, "label_id", "left").select(
            "label_id", "n", F.coalesce("norm2", F.lit(0.0)).alias("norm2")
        )
        stats = staging.write(stats, "class_stats")
        # A weight that is not finite makes the mean so too.
        if centroids.filter(~is_finite(F.col("mean"))).limit(1).count():
            raise InvalidInput("a training feature is not a finite number")
        return NearestCentroidModel(centroids, stats, features.space, self.budget)
