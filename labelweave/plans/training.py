"""Training: all splits of a data set are fitted, judged and compared in one job.

The text is tokenised once, whatever the number of splits, and a TF weight does not depend on the
split either.  So one pass over the counted documents sums, per term and class and for all splits
side by side, how many training documents hold the term and the TF weights they give it.  From that
table, whose size is that of the vocabulary, follow document frequencies, IDF weights and class
means of every split.  A second pass scores every document against the means of all splits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..config import METRICS, InvalidInput, TfIdfSettings, TrainingConfig
from ..functions.weights import idf_weight
from ..operators import metrics
from ..operators.centroid import (
    CONSTANT,
    NO_TRAINING_DATA,
    WIDE_SUMS,
    Classifier,
    ClassNorms,
    NearestCentroidModel,
    least_norms,
    met_sums,
    score_sums,
    side_by_side,
    wide_sums,
)
from ..operators.splits import assign_sides, assignment, split_cuts
from ..operators.term_join import broadcast_floor, join_above, join_below, term_bands
from ..operators.terms import counted_documents, numbered
from ..operators.tfidf import Features, TfIdf, TfIdfModel, exploded
from ..operators.validate import (
    check_classes,
    check_document_ids,
    check_page_counts,
    class_table,
)
from ..session import BROADCAST_BYTES, ROW_OVERHEAD, ClassTableSize, Staging
from .states import LearnedModel, Learner, PackedDocuments, gathered_documents, learned, predictions

#: Splits fitted side by side in one pass; each takes a few columns of the tables.
SPLITS_PER_PASS = 8

#: Tables of terms that a job of a user's model may broadcast side by side: features and models bring
#: the frequent terms and a list of them each, all of which the driver holds twice while it makes them.
TABLES_PER_JOB = 8

#: A user's model factory: gets the features of the training documents, whose ``documents`` carry
#: ids, names and labels, and returns a model.  It never sees a test document.
ModelFactory = Callable[[Features], Classifier]


@dataclass
class TrainingOutcome:
    """The selected model with its own TF-IDF, and how all splits did."""

    config: TrainingConfig
    model: Classifier
    tf_idf: TfIdfModel
    evaluations: DataFrame
    selected_split: int
    staging: Staging
    #: ``split_index, doc_id, label_id, is_train``
    assigned: DataFrame
    #: of the built-in classifier: all predictions, and the fitted tables of all splits
    run: FittedRun | None = None

    def report(self) -> DataFrame:
        return metrics.report(self.evaluations, self.config.evaluation_strategy, self.config.seed)

    def metric_summary(self) -> DataFrame:
        return metrics.metric_summary(self.evaluations)

    def release(self) -> None:
        """Delete the run's tables; save the outcome first."""
        self.staging.drop()


def count_documents(
    documents: DataFrame,
    config: TrainingConfig,
    classes: DataFrame,
    size: ClassTableSize,
    largest_group: int,
    staging: Staging,
) -> DataFrame:
    """``doc_id, class_ix, in_train, page_count, terms, total, mx``: split sides and term counts.

    The terms include the constant one, which is not part of ``total`` and ``mx``.  Only ids and
    labels are read to find the cuts of the splits; then one pass over the text tokenises every
    document and works out its sides.  The text itself is not shuffled.
    """
    ids = documents.select("doc_id", "label_id")
    cuts = split_cuts(
        ids, config.split, config.seed, largest_group=largest_group, classes=size
    )
    kept = documents.select("doc_id", "label_id", F.size("pages").alias("page_count"), "pages")
    numbered = kept.join(size.hint(classes.select("label_id", "class_ix"), 1), "label_id")
    sided = assign_sides(numbered, cuts, config.split, config.seed, size)
    return with_constant(counted_documents(sided.drop("label_id"), staging))


def with_constant(counted: DataFrame) -> DataFrame:
    """Give every document the constant term, by which documents and classes are counted."""
    return counted.withColumn(
        "terms", F.expr(f"array_append(terms, struct('{CONSTANT}' AS term, 1L AS cnt))")
    )


def _side_bits(splits: list[int]) -> str:
    """The sides of a pass's splits as the bits of a number, which is short and quick to test."""
    bits = [f"CASE WHEN in_train[{i}] THEN {1 << bit} ELSE 0 END" for bit, i in enumerate(splits)]
    return f"CAST({' + '.join(bits)} AS INT) AS sides"


def _in_train(splits: list[int], split: int) -> str:
    return f"(sides & {1 << splits.index(split)}) <> 0"


def corpus_tokens(
    counted: DataFrame, keys: list[str], settings: TfIdfSettings, splits: list[int]
) -> DataFrame:
    """``<keys>, sides, term, tf``: all terms of all documents, the constant one weighing 1."""
    tokens = exploded(
        counted.selectExpr(*keys, _side_bits(splits), "total", "mx", "terms"), settings
    )
    return weigh_constant(tokens)


def weigh_constant(tokens: DataFrame) -> DataFrame:
    """Let the constant term weigh 1 whatever the scheme.  No weight is null, and Spark is told."""
    weight = f"CASE WHEN term = '{CONSTANT}' THEN 1D ELSE coalesce(tf, 0D) END AS tf"
    return tokens.selectExpr(*[c for c in tokens.columns if c != "tf"], weight)


def term_sums(counted: DataFrame, settings: TfIdfSettings, splits: list[int]) -> DataFrame:
    """``term, class_ix, docs, head, df_i, sum_i``.

    ``docs`` and ``df_i`` are those of the term, repeated for its classes: documents and training
    documents that hold it.  ``sum_i`` adds the class's TF weights, and ``head`` marks one row per
    term.  The rows of the constant term count documents: ``df_i`` all of a split, ``sum_i`` those
    of a class.  Rows are combined before they are shuffled, so a common word costs one row per
    task and class.
    """
    tokens = corpus_tokens(counted, ["class_ix"], settings, splits)
    sums = tokens.groupBy("term", "class_ix").agg(
        F.expr("count(1) AS docs"),
        *[F.expr(f"count_if({_in_train(splits, i)}) AS df_{i}") for i in splits],
        *[
            F.expr(f"sum(CASE WHEN {_in_train(splits, i)} THEN tf ELSE 0D END) AS sum_{i}")
            for i in splits
        ],
    )
    # At most one row per class in a window.
    return sums.selectExpr(
        "term",
        "class_ix",
        "sum(docs) OVER (PARTITION BY term) AS docs",
        "row_number() OVER (PARTITION BY term ORDER BY class_ix) = 1 AS head",
        *[f"sum(df_{i}) OVER (PARTITION BY term) AS df_{i}" for i in splits],
        *[f"sum_{i}" for i in splits],
    )


@dataclass(frozen=True)
class FittedSplits:
    """Tables of a set of splits fitted side by side."""

    splits: list[int]
    #: ``term, class_ix, docs, head, df_i, idf_i, mean_i``
    terms: DataFrame
    #: ``class_ix, n_i, norm2_i``
    class_stats: DataFrame
    #: by split the training documents and the size of the vocabulary
    documents: dict[int, int]
    columns: dict[int, int]
    #: frequency bands of ``terms``
    bands: list[Row]


def fit_splits(
    counted: DataFrame,
    config: TrainingConfig,
    splits: list[int],
    size: ClassTableSize,
    staging: Staging,
) -> FittedSplits:
    """Vocabulary, IDF weights and class means of several splits, from training documents only."""
    sums = staging.write(
        term_sums(counted, config.tf_idf, splits), f"term_sums_{splits[0]}_{splits[-1]}"
    )
    word = f"term <> '{CONSTANT}'"
    bands = term_bands(
        sums,
        *[F.expr(f"max(CASE WHEN {word} THEN 0 ELSE df_{i} END) AS n_{i}") for i in splits],
        *[F.expr(f"max(CASE WHEN {word} THEN df_{i} ELSE 0 END) AS max_{i}") for i in splits],
        *[F.expr(f"count_if(head AND {word} AND df_{i} > 0) AS v_{i}") for i in splits],
        F.count_if("head").alias("terms"),
        F.sum(F.when(F.col("head"), F.octet_length("term")).otherwise(0)).alias("terms_text"),
    )
    documents = {i: max(band[f"n_{i}"] for band in bands) for i in splits}
    columns = {i: sum(band[f"v_{i}"] for band in bands) for i in splits}
    if not all(documents.values()) or not all(columns.values()):
        raise InvalidInput(NO_TRAINING_DATA)

    def idf(i: int) -> Column:
        max_df = max(band[f"max_{i}"] for band in bands)
        weight = idf_weight(
            config.tf_idf, F.lit(documents[i]).cast("bigint"), F.col(f"df_{i}"), F.lit(max_df)
        )
        # A term only test documents hold is not in this split's vocabulary.
        return F.when(F.col(f"df_{i}") > 0, weight).alias(f"idf_{i}")

    sizes = sums.filter(F.col("term") == CONSTANT).selectExpr(
        "class_ix", *[f"CAST(sum_{i} AS BIGINT) AS n_{i}" for i in splits]
    )
    weighed = sums.filter(word).select("*", *[idf(i) for i in splits])
    # Weights made of counts are finite, so the features need no check here.
    terms = weighed.join(size.hint(sizes, len(splits)), "class_ix").selectExpr(
        "term",
        "class_ix",
        "docs",
        "head",
        *[f"df_{i}" for i in splits],
        *[f"idf_{i}" for i in splits],
        *[f"CASE WHEN n_{i} > 0 THEN idf_{i} * sum_{i} / n_{i} END AS mean_{i}" for i in splits],
    )
    norms = terms.groupBy("class_ix").agg(
        *[F.expr(f"sum(mean_{i} * mean_{i}) AS norm2_{i}") for i in splits]
    )
    stats = sizes.join(size.hint(norms, len(splits)), "class_ix", "left").selectExpr(
        "class_ix",
        *[f"n_{i}" for i in splits],
        *[f"coalesce(norm2_{i}, 0D) AS norm2_{i}" for i in splits],
    )
    return FittedSplits(splits, terms, stats, documents, columns, bands)


def scoring_table(fitted: FittedSplits, splits: list[int] | None = None) -> DataFrame:
    """Factors that turn the TF weights of a document into distances, for the fitted splits."""
    splits = splits or fitted.splits
    # Words of all documents often weigh nothing; a class without a word needs no row for it.
    weighs = " OR ".join(f"idf_{i} <> 0" for i in splits)
    held = " OR ".join(f"mean_{i} <> 0" for i in splits)
    return fitted.terms.filter(f"({weighs}) AND (head OR {held})").selectExpr(
        "term",
        "class_ix AS class_id",
        "docs",
        *[f"coalesce(idf_{i} * mean_{i}, 0D) AS dot_{i}" for i in splits],
        *[f"CASE WHEN head THEN coalesce(idf_{i} * idf_{i}, 0D) ELSE 0D END AS own_{i}"
          for i in splits],
    )


def _wide_floor(bands: list[Row], columns: int, budget: int) -> int | None:
    """As ``broadcast_floor``, for a table of one row per term and the list of its terms beside it."""
    terms = [
        {"rows": band["terms"], "text": 2 * band["terms_text"], "lowest": band["lowest"]}
        for band in bands
    ]
    return broadcast_floor(terms, columns + ROW_OVERHEAD // 8, budget)


def _met(
    tokens: DataFrame,
    table: DataFrame,
    keys: list[str],
    fitted: FittedSplits,
    classes: int,
    budget: int,
) -> DataFrame:
    """Sums of documents and the classes they meet.

    Frequent words have their few classes side by side, which spares a row for every word and class;
    those of many classes, and rare words, have a row for each.
    """
    splits = fitted.splits
    columns = (classes + 1) * len(splits)
    floor = _wide_floor(fitted.bands, columns, budget) if columns <= WIDE_SUMS else None
    if floor is None:
        floor = broadcast_floor(fitted.bands, len(table.columns), budget)
        return met_sums(join_above(tokens, table, floor, fitted.bands), keys, splits)
    wide = side_by_side(table.filter(F.col("docs") >= floor), classes, splits)
    found = wide_sums(tokens, wide, keys, table, classes, splits)
    if floor == 0:
        return found
    rest = join_below(tokens, table, floor, fitted.bands)
    return found.unionByName(met_sums(rest, keys, splits))


def predict_splits(
    counted: DataFrame,
    config: TrainingConfig,
    fitted: FittedSplits,
    size: ClassTableSize,
    budget: int,
) -> DataFrame:
    """``split_index, doc_id, class_ix, is_train, predicted, dist`` for every document and split.

    Classes, also the predicted ones, are given by number.
    """
    splits = fitted.splits
    keys = ["doc_id", "class_ix"]
    tokens = corpus_tokens(counted, keys, config.tf_idf, splits).filter(f"term <> '{CONSTANT}'")
    table = scoring_table(fitted)
    stats = fitted.class_stats.withColumnRenamed("class_ix", "class_id")
    norms = ClassNorms(size.hint(stats, 2 * len(splits)), least_norms(stats, splits))
    met = _met(tokens, table, [*keys, "sides"], fitted, size.classes, budget)
    every = counted.selectExpr(*keys, _side_bits(splits))
    found = score_sums(met, every, [*keys, "sides"], splits, norms)
    return found.selectExpr(
        "split_index",
        "doc_id",
        "class_ix",
        f"(shiftright(sides, split_index - {splits[0]}) & 1) <> 0 AS is_train",
        "predicted",
        "dist",
    )


@dataclass(frozen=True)
class FittedRun:
    """Everything a run of the built-in classifier worked out, as frames over its staged tables."""

    fits: list[FittedSplits]
    classes: DataFrame
    size: ClassTableSize
    numbered: DataFrame
    #: the terms of all documents, with their classes and sides; see ``count_documents``
    counted: DataFrame

    def _label(self, number: str, label: str) -> DataFrame:
        names = self.classes.selectExpr(f"class_ix AS {number}", f"label_id AS {label}")
        return self.size.hint(names, 1)

    def labelled(self, table: DataFrame, number: str = "class_ix", label: str = "label_id"):
        """Replace class numbers by label ids."""
        columns = [label if name == number else name for name in table.columns]
        return table.join(self._label(number, label), number).select(*columns)

    def predictions(self) -> DataFrame:
        """``split_index, doc_id, label_id, is_train, predicted, dist``."""
        named = self.labelled(self.numbered.withColumnRenamed("predicted", "found"))
        return self.labelled(named, "found", "predicted")

    def idf(self) -> DataFrame:
        """``split_index, term, df, idf``."""
        return metrics.union_all([
            fit.terms.filter("head").selectExpr(
                _per_split(fit.splits, "term", "df_{i} AS df", "idf_{i} AS idf")
            )
            for fit in self.fits
        ]).filter("df > 0")

    def centroids(self) -> DataFrame:
        """``split_index, label_id, term, mean`` without zeros."""
        return self.labelled(metrics.union_all([
            fit.terms.selectExpr(_per_split(fit.splits, "class_ix", "term", "mean_{i} AS mean"))
            for fit in self.fits
        ]).filter("mean <> 0"))

    def class_stats(self) -> DataFrame:
        """``split_index, label_id, n, norm2`` of the classes each split was trained on."""
        return self.labelled(metrics.union_all([
            fit.class_stats.selectExpr(
                _per_split(fit.splits, "class_ix", "n_{i} AS n", "norm2_{i} AS norm2")
            )
            for fit in self.fits
        ]).filter("n > 0"))

    def selected(
        self, split: int, config: TrainingConfig, space: str, budget: int
    ) -> tuple[TfIdfModel, NearestCentroidModel]:
        """The TF-IDF and classifier of one split as fitted, without its test documents."""
        fit = next(f for f in self.fits if split in f.splits)
        idf = fit.terms.filter(f"head AND df_{split} > 0").selectExpr(
            "term", "docs", f"df_{split} AS df", f"idf_{split} AS idf"
        )
        centroids = fit.terms.filter(f"mean_{split} <> 0").selectExpr(
            "term", "class_ix", "docs", f"mean_{split} AS mean"
        )
        stats = fit.class_stats.filter(f"n_{split} > 0").selectExpr(
            "class_ix", f"n_{split} AS n", f"norm2_{split} AS norm2"
        )
        tf_idf = TfIdfModel(
            config.tf_idf, idf, fit.documents[split], fit.columns[split], space, budget
        )
        return tf_idf, NearestCentroidModel(
            self.labelled(centroids), self.labelled(stats), space, budget
        )


def _per_split(splits: list[int], *columns: str) -> str:
    """Turn columns held side by side for several splits into one row per split."""
    rows = ", ".join(
        f"struct({i} AS split_index, {', '.join(c.format(i=i) for c in columns)})" for i in splits
    )
    return f"inline(array({rows}))"


def train(
    documents: DataFrame,
    config: TrainingConfig | None = None,
    factory: ModelFactory | None = None,
    staging: Staging | None = None,
    budget: int = BROADCAST_BYTES,
    learner: Learner | None = None,
) -> TrainingOutcome:
    """Train on ``doc_id, pages, label_id`` (and ``name``), returning the best split's model.

    Without a factory or a learner the configured classifier is fitted for all splits at once.  So
    is a learner, a model of the caller's that is learned from parts.  A factory is called for one
    split after the other.  The first error of either fails the whole run.
    """
    config = (config or TrainingConfig()).with_seed()
    config.split.check_trainable()
    if factory is not None and learner is not None:
        raise InvalidInput("a run takes a factory or a learner, not both")
    staging = staging or Staging(documents.sparkSession)
    try:
        return _train(documents, config, factory, staging, budget, learner)
    except BaseException:
        staging.drop()
        raise


def _train(
    documents: DataFrame,
    config: TrainingConfig,
    factory: ModelFactory | None,
    staging: Staging,
    budget: int,
    learner: Learner | None = None,
) -> TrainingOutcome:
    classes = staging.write(class_table(documents), "classes")
    summary = check_classes(classes, config.split)
    # Rows are matched by id from here on.
    check_document_ids(documents)
    if factory is not None:
        return _train_with_factory(documents, config, factory, staging, budget)
    every = list(range(config.split.repetitions))
    passes = [every[at : at + SPLITS_PER_PASS] for at in range(0, len(every), SPLITS_PER_PASS)]
    # All passes end up in one job and share its budget for broadcasts: half of it for terms, the
    # other half for the class tables, of which a pass has about four.
    terms_budget = budget // (2 * len(passes))
    size = ClassTableSize(
        summary["classes"], summary["label_bytes"], budget // (8 * len(passes))
    )
    stratified = config.split.sampling == "stratified"
    largest = summary["largest_class" if stratified else "documents"]
    counted = count_documents(documents, config, classes, size, largest, staging)
    check_page_counts(counted)
    fits = [fit_splits(counted, config, splits, size, staging) for splits in passes]
    if learner is not None:
        return _train_learner(
            counted, config, fits, classes, size, learner, staging, terms_budget, budget
        )
    judged = metrics.union_all(
        [predict_splits(counted, config, fit, size, terms_budget) for fit in fits]
    )
    # Read once for the scores, and again by whoever looks at single predictions.
    judged = staging.write(judged, "predictions")
    # Scores do not depend on what classes are called.
    measured = metrics.evaluate(judged.withColumnRenamed("class_ix", "label_id"))
    evaluations = metrics.split_evaluations(measured).coalesce(1)
    evaluations = staging.write(evaluations, "evaluations")
    best = metrics.select_split(evaluations, config.evaluation_strategy).first()
    selected = best["split_index"]
    run = FittedRun(fits, classes, size, judged, counted)
    tf_idf, model = run.selected(selected, config, f"{staging.path}#{selected}", budget)
    assigned = assignment(
        run.labelled(counted.select("doc_id", "class_ix", "in_train"))
    )
    return TrainingOutcome(
        config, model, tf_idf, evaluations, selected, staging, assigned, run
    )


def feature_entries(
    counted: DataFrame, config: TrainingConfig, fitted: FittedSplits, table: DataFrame, budget: int
) -> PackedDocuments:
    """Every document's weights of all splits, by column, with ``doc_id, label_id, sides``.

    ``counted`` holds a ``label_id`` besides, and ``table`` ``term, docs, term_index, idf_i``.  A word outside a split's
    vocabulary has no weight in it.  Frequent words find their columns where their documents are; the constant term,
    which comes last, ends each document.
    """
    splits = fitted.splits
    keys = ["doc_id", "label_id", "sides"]
    tokens = corpus_tokens(counted, keys[:2], config.tf_idf, splits)
    weights = [(F.col("tf") * F.col(f"idf_{i}")).alias(f"w_{at}") for at, i in enumerate(splits)]
    floor = broadcast_floor(fitted.bands, len(table.columns), budget)
    frequent = table.filter(F.lit(False) if floor is None else F.col("docs") >= floor)
    ends = F.col("term") == CONSTANT
    placed = tokens.join(F.broadcast(frequent), "term", "left").filter(
        F.col("term_index").isNotNull() | ends
    )
    placed = placed.select(*[F.when(ends, F.col(k)).alias(k) for k in keys], "term_index", *weights)
    rare = None
    if floor != 0:
        words = tokens.filter(~ends)
        rare = (
            join_above(words, table, None, fitted.bands)
            if floor is None
            else join_below(words, table, floor, fitted.bands)
        ).select("doc_id", "term_index", *weights)
    # Bands hold frequencies within a sixteenth of a power of two.
    total = sum(band["terms"] * band["lowest"] for band in fitted.bands)
    return gathered_documents(placed, rare, keys, len(splits), total)


def _train_learner(
    counted: DataFrame,
    config: TrainingConfig,
    fits: list[FittedSplits],
    classes: DataFrame,
    size: ClassTableSize,
    learner: Learner,
    staging: Staging,
    terms_budget: int,
    budget: int,
) -> TrainingOutcome:
    """The run of a learner: the splits of a pass are learned and judged side by side."""
    run = FittedRun(fits, classes, size, counted, counted)
    labelled = run.labelled(counted).withColumn("label_id", F.col("label_id").cast("string"))
    found, models, columns = [], {}, {}
    for fit in fits:
        first = fit.splits[0]
        idf = fit.terms.filter("head").select("term", "docs", *[f"idf_{i}" for i in fit.splits])
        table = numbered(idf, ["term"], staging, f"order_{first}", "term_index")
        table = staging.write(table, f"columns_{first}")
        staging.remove(f"order_{first}")
        # Labels are joined to documents, before these have a row for every word.
        entries = feature_entries(labelled, config, fit, table, terms_budget)
        entries = entries.staged(staging, f"entries_{first}")
        learned_models = learned(entries, learner, len(fit.splits), staging, f"states_{first}")
        predicted = predictions(entries, learned_models, learner, ["doc_id", "label_id", "sides"])
        found.append(
            predicted.selectExpr(
                f"split + {first} AS split_index",
                "doc_id",
                "label_id",
                "(shiftright(sides, split) & 1) <> 0 AS is_train",
                "predicted",
            )
        )
        for at, split in enumerate(fit.splits):
            models[split] = learned_models.filter(F.col("split") == at)
            columns[split] = table.filter(F.col(f"idf_{split}").isNotNull())
    judged = staging.write(metrics.union_all(found), "predictions")
    for fit in fits:
        staging.remove(f"entries_{fit.splits[0]}")
    evaluations = metrics.split_evaluations(metrics.evaluate(judged)).coalesce(1)
    evaluations = staging.write(evaluations, "evaluations")
    best = metrics.select_split(evaluations, config.evaluation_strategy).first()["split_index"]
    tf_idf, _ = run.selected(best, config, f"{staging.path}#{best}", budget)
    terms = columns[best].select("term", "docs", "term_index")
    model = LearnedModel(learner, models[best], terms, tf_idf.space, budget)
    assigned = assignment(run.labelled(counted.select("doc_id", "class_ix", "in_train")))
    return TrainingOutcome(config, model, tf_idf, evaluations, best, staging, assigned)


def missing_factory(_: Features) -> Classifier:
    """The factory of a run that was given none of its own and no built-in classifier."""
    raise InvalidInput("no factory was given to make a model")


def _train_with_factory(
    documents: DataFrame,
    config: TrainingConfig,
    factory: ModelFactory,
    staging: Staging,
    budget: int,
) -> TrainingOutcome:
    check_page_counts(documents)
    ids = documents.select("doc_id", "label_id")
    cuts = staging.write(split_cuts(ids, config.split, config.seed), "cuts")
    # Counted once for all splits.
    counted = counted_documents(assign_sides(documents, cuts, config.split, config.seed), staging)
    estimator = TfIdf(config.tf_idf, budget // TABLES_PER_JOB)
    candidates, measured = [], []
    for i in range(config.split.repetitions):
        # A user's code runs per split; its own work and ours around it stay distributed.
        own = Staging(documents.sparkSession)
        own.path = f"{staging.path}/split_{i}"
        train_part = counted.filter(f"in_train[{i}]")
        test_part = counted.filter(f"NOT in_train[{i}]")
        tf_idf = estimator.fit_counted(train_part, train_part.count(), own)
        train_features = tf_idf.weigh(train_part, train_part, fitted_here=True)
        model = factory(train_features)
        judged = []
        for part, features in (
            ("train", train_features),
            ("test", tf_idf.weigh(test_part, test_part)),
        ):
            found = own.write(model.predict(features), f"predicted_{part}")
            scores = metrics.calculate(features.documents, found)
            judged.append(
                scores.select(
                    F.lit(i).alias("split_index"), F.lit(part).alias("part"), "samples", *METRICS
                )
            )
        measured.append(own.write(metrics.union_all(judged), "measured"))
        candidates.append((model, tf_idf))
    evaluations = metrics.split_evaluations(metrics.union_all(measured))
    evaluations = staging.write(evaluations.coalesce(1), "evaluations")
    best = metrics.select_split(evaluations, config.evaluation_strategy).first()["split_index"]
    model, tf_idf = candidates[best]
    return TrainingOutcome(
        config,
        model,
        tf_idf,
        evaluations,
        best,
        staging,
        assignment(counted.select("doc_id", "label_id", "in_train")),
    )
