"""Queries about fitting, predicting, judging, selecting, storing and scoring."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.classification import NaiveBayes
from pyspark.sql import functions as F

from labelweave.config import METRICS, SplitSettings, TfIdfSettings, TrainingConfig
from labelweave.operators import metrics as ops
from labelweave.operators.centroid import NearestCentroid
from labelweave.operators.learners import CentroidLearner
from labelweave.operators.tfidf import TfIdf, weigh_together
from labelweave.operators.vectors import VectorClassifier
from labelweave.plans.jobs import run_training
from labelweave.plans.scoring import named, score
from labelweave.plans.training import train
from labelweave.session import BROADCAST_BYTES
from labelweave.sources.models import ModelStore, model_metadata

from . import sql
from .registry import query
from .tables import (
    CONFIG,
    SEED,
    conversations,
    corpus,
    judged_corpus,
    language_labels,
    new_documents,
    settings,
    staging,
    table,
    trained,
)
from .terms import applied, r6

RUN = sql.run()
JUDGED = "(SELECT d.doc_id, d.text, l.quality FROM documents d JOIN labels l USING (doc_id))"


def rounded(names: list[str], digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def rounded_columns(names: list[str], digits: int = 6):
    return [F.round(F.col(n), digits).alias(n) for n in names]


EVALUATED = [f"{part}_{m}" for part in ("train", "test", "gap") for m in METRICS]
EV_SQL = f"SELECT split_index, train_samples, test_samples, {rounded(EVALUATED)} FROM ev"


def evaluated(outcome):
    return outcome.evaluations.select(
        "split_index", "train_samples", "test_samples", *rounded_columns(EVALUATED)
    )


@query(
    "split_idf",
    sql.with_ctes(RUN, "SELECT split_index, term, df, round(idf, 6) AS idf FROM idf"),
)
def split_idf(spark, d):
    return trained(spark, d).run.idf().select("split_index", "term", "df", r6("idf"))


@query(
    "features",
    sql.with_ctes(RUN, "SELECT split_index, label_id, is_train, count(*) AS stored, "
                       "round(sum(weight), 2) AS weight_sum FROM feat GROUP BY ALL"),
)
def features(spark, d):
    """Stored weights of each split, class and side, weighted with the split's own vocabulary."""
    outcome = trained(spark, d)
    run, splits = outcome.run, range(outcome.config.split.repetitions)
    # One job has the frequent terms of every split and a list of them, which the driver holds
    # twice while it makes them.
    budget = BROADCAST_BYTES // (4 * len(splits))
    models = [run.selected(i, outcome.config, f"split {i}", budget)[0] for i in splits]
    # The run has counted the terms of its documents, and each comes with its class and sides.
    keys = ["class_ix", "in_train"]
    rows = weigh_together(models, run.counted, keys, staging(spark))
    sums = rows.groupBy(*keys).agg(
        *[F.expr(f"count_if(w_{i} <> 0) AS stored_{i}") for i in splits],
        *[F.sum(f"w_{i}").alias(f"sum_{i}") for i in splits],
    )
    each = ", ".join(
        f"struct({i} AS split_index, label_id, in_train[{i}] AS is_train, stored_{i} AS stored, "
        f"sum_{i} AS weight_sum)" for i in splits
    )
    found = run.labelled(sums).selectExpr(f"inline(array({each}))").filter("stored > 0")
    return found.groupBy("label_id", "is_train", "split_index").agg(
        F.sum("stored").alias("stored"), F.round(F.sum("weight_sum"), 2).alias("weight_sum")
    ).select("label_id", "is_train", "stored", "weight_sum", "split_index")


@query(
    "centroids",
    sql.with_ctes(RUN, "SELECT split_index, label_id, term, round(mean, 6) AS mean FROM cent"),
)
def centroids(spark, d):
    return trained(spark, d).run.centroids().select("split_index", "label_id", "term", r6("mean"))


@query(
    "class_stats",
    sql.with_ctes(RUN, "SELECT split_index, label_id, n, round(c2, 4) AS norm2 FROM classes"),
)
def class_stats(spark, d):
    return trained(spark, d).run.class_stats().select(
        "split_index", "label_id", "n", F.round("norm2", 4).alias("norm2")
    )


@query(
    "predictions",
    sql.with_ctes(RUN, "SELECT split_index, doc_id, label_id, is_train, predicted FROM pred"),
)
def predictions(spark, d):
    return trained(spark, d).run.predictions().drop("dist")


@query(
    "centroid_distance",
    sql.with_ctes(RUN, "SELECT split_index, doc_id, round(dist, 5) AS dist FROM pred"),
)
def centroid_distance(spark, d):
    return trained(spark, d).run.predictions().select(
        "split_index", "doc_id", F.round("dist", 5).alias("dist")
    )


SOURCES = sql.run(label="source", tf="normalization", idf="smooth", reps=2, seed=5)
SOURCES_CONFIG = TrainingConfig(
    split=SplitSettings(repetitions=2), tf_idf=settings("normalization", "smooth"), seed=5
)


@query(
    "predictions_many_classes",
    sql.with_ctes(SOURCES, "SELECT split_index, doc_id, label_id, is_train, predicted FROM pred"),
)
def predictions_many_classes(spark, d):
    return trained(spark, d, SOURCES_CONFIG, "source").run.predictions().drop("dist")


@query(
    "predictions_random_split",
    sql.with_ctes(
        sql.run(label="source", tf="binary", idf="probabilistic", reps=2, seed=6, ratio=0.1,
                sampling="random"),
        "SELECT split_index, doc_id, label_id, is_train, predicted FROM pred",
    ),
)
def predictions_random_split(spark, d):
    """Unstratified sampling, with classes that a split may lack altogether."""
    config = TrainingConfig(
        split=SplitSettings(0.1, 2, "random"), tf_idf=settings("binary", "probabilistic"), seed=6
    )
    return train(corpus(spark, d, "source"), config).run.predictions().drop("dist")


def _fit_on_all() -> list[tuple[str, str]]:
    """Classifier fitted on all documents, applied to the same ones, as a single split."""
    return [
        *sql.fit_all(idf="smooth"),
        ("asg", "SELECT 0 AS split_index, doc_id, label_id, true AS is_train FROM docs"),
        ("feat", "SELECT 0 AS split_index, t.doc_id, d.label_id, true AS is_train, t.term, "
                 "tfw * idf AS weight FROM tw t JOIN idf USING (term) JOIN docs d "
                 "ON d.doc_id = t.doc_id WHERE tfw * idf <> 0"),
        *sql.classified(),
    ]


@query(
    "nearest_centroid",
    sql.with_ctes(_fit_on_all(),
                  "SELECT doc_id, predicted, round(dist, 5) AS dist FROM pred"),
)
def nearest_centroid(spark, d):
    """The classifier on its own, fitted on one feature matrix and applied to it."""
    own = staging(spark)
    _, matrix = TfIdf(settings(idf="smooth")).fit_transform(corpus(spark, d), own)
    model = NearestCentroid().fit(matrix, own)
    return model.distances(matrix).select("doc_id", "predicted", F.round("dist", 5).alias("dist"))


@query(
    "nearest_centroid_wide",
    sql.with_ctes(_fit_on_all(),
                  "SELECT doc_id, predicted, round(dist, 5) AS dist FROM pred"),
)
def nearest_centroid_wide(spark, d):
    """The same with weights whose squares no double holds; distances are as many times longer."""
    own = staging(spark)
    _, matrix = TfIdf(settings(idf="smooth")).fit_transform(corpus(spark, d), own)
    matrix = replace(matrix, rows=matrix.rows.withColumn("weight", F.col("weight") * 2.0**700))
    found = NearestCentroid().fit(matrix, own).distances(matrix, own)
    return found.select("doc_id", "predicted", F.round(F.col("dist") / 2.0**700, 5).alias("dist"))


@query("model_labels", "SELECT DISTINCT lang AS label_id FROM documents")
def model_labels(spark, d):
    return trained(spark, d).model.labels()


@query(
    "confusion_counts",
    sql.with_ctes(RUN, "SELECT split_index, part, label_id, predicted, n FROM conf"),
)
def confusion_counts(spark, d):
    return ops.confusion_counts(trained(spark, d).run.predictions())


@query(
    "confusion_marginals",
    sql.with_ctes(RUN, "SELECT split_index, part, class, actual, predicted, correct FROM marg"),
)
def confusion_marginals(spark, d):
    return ops.confusion_marginals(ops.confusion_counts(trained(spark, d).run.predictions()))


def _register_metric(name: str, metric: str) -> None:
    oracle = sql.with_ctes(
        RUN, f"SELECT split_index, part, samples, round({metric}, 9) AS {metric} FROM met"
    )

    @query(name, oracle)
    def measured(spark, d):
        scores = ops.evaluate(trained(spark, d).run.predictions())
        return scores.select("split_index", "part", "samples", F.round(metric, 9).alias(metric))


_register_metric("macro_f1", "macro_f1")
_register_metric("balanced_accuracy", "balanced_accuracy")
_register_metric("matthews", "matthews_correlation")


@query(
    "calculate_metrics",
    sql.with_ctes(
        _fit_on_all()
        + [x for x in sql.judged() if x[0] in ("conf", "marg", "sums", "met")],
        f"SELECT samples, {rounded(list(METRICS), 9)} FROM met",
    ),
)
def calculate_metrics(spark, d):
    """Scores of one list of predictions against one list of labels."""
    own = staging(spark)
    documents = corpus(spark, d)
    _, matrix = TfIdf(settings(idf="smooth")).fit_transform(documents, own)
    found = own.write(NearestCentroid().fit(matrix, own).predict(matrix), "found")
    return ops.calculate(documents.select("doc_id", "label_id"), found).select(
        "samples", *rounded_columns(list(METRICS), 9)
    )


@query(
    "score_by_metric",
    sql.with_ctes(RUN, " UNION ALL ".join(
        f"SELECT split_index, '{m}' AS strategy, round(test_{m}, 9) AS score FROM ev"
        for m in METRICS
    )),
)
def score_by_metric(spark, d):
    ev = trained(spark, d).evaluations
    return ops.union_all([
        ops.score(ev, m, "test_").select(
            "split_index", F.lit(m).alias("strategy"), F.round("score", 9).alias("score")
        )
        for m in METRICS
    ])


@query("split_evaluation", sql.with_ctes(RUN, EV_SQL))
def split_evaluation(spark, d):
    return evaluated(trained(spark, d))


@query(
    "metric_summary",
    sql.with_ctes(RUN, " UNION ALL ".join(
        f"SELECT '{part}' AS part, '{m}' AS metric, round(avg({part}_{m}), 9) AS mean, "
        f"round(stddev_pop({part}_{m}), 9) AS standard_deviation FROM ev"
        for part in ("train", "test", "gap") for m in METRICS
    )),
)
def metric_summary(spark, d):
    return trained(spark, d).metric_summary().select(
        "part", "metric", *rounded_columns(["mean", "standard_deviation"], 9)
    )


@query(
    "select_split",
    sql.with_ctes(
        [
            *RUN,
            *[(f"best_{m}", sql.selected(m)[0][1]) for m in METRICS],
        ],
        " UNION ALL ".join(
            f"SELECT '{m}' AS strategy, split_index FROM best_{m}" for m in METRICS
        ),
    ),
)
def select_split(spark, d):
    ev = trained(spark, d).evaluations
    return ops.union_all([
        ops.select_split(ev, m).select(F.lit(m).alias("strategy"), "split_index") for m in METRICS
    ])


@query(
    "train_report",
    sql.with_ctes(RUN, f"""SELECT 'macro_f1' AS strategy, '{SEED}' AS seed,
        'held-out selection scores' AS score_usage, (SELECT split_index FROM best)
        AS selected_split, split_index, train_samples, test_samples, {rounded(EVALUATED, 9)},
        (SELECT round(avg(test_macro_f1), 9) FROM ev) AS mean_test_macro_f1,
        (SELECT round(stddev_pop(gap_macro_f1), 9) FROM ev) AS deviation_gap_macro_f1 FROM ev"""),
)
def train_report(spark, d):
    """The whole report, one row per split."""
    report = trained(spark, d).report()
    rows = report.select(
        "strategy", "seed", "score_usage", "selected_split",
        F.round("test_summary.mean.macro_f1", 9).alias("mean_test_macro_f1"),
        F.round("gap_summary.standard_deviation.macro_f1", 9).alias("deviation_gap_macro_f1"),
        F.inline("splits"),
    )
    return rows.select(
        *[c for c in rows.columns if c not in ("train", "test", "gap")],
        *[F.round(F.col(f"{p}.{m}"), 9).alias(f"{p}_{m}")
          for p in ("train", "test", "gap") for m in METRICS],
    )


def _register_training(name: str, sql_options: dict, config: TrainingConfig, load) -> None:
    @query(name, sql.with_ctes(sql.run(**sql_options), EV_SQL))
    def run(spark, d):
        return evaluated(train(load(spark, d), config))


_register_training(
    "train_quality",
    {"label": "quality", "table": JUDGED, "tf": "double_normalization_half", "idf": "smooth",
     "strategy": "matthews_correlation", "ratio": 0.6, "reps": 2, "seed": 2**63 + 11},
    TrainingConfig(
        split=SplitSettings(0.6, 2),
        tf_idf=settings("double_normalization_half", "smooth"),
        evaluation_strategy="matthews_correlation",
        seed=2**63 + 11,
    ),
    judged_corpus,
)
_register_training(
    "train_maximum",
    {"tf": "double_normalization_variable", "idf": "maximum", "reps": 5, "seed": 1, "k": 0.25},
    TrainingConfig(
        tf_idf=TfIdfSettings("double_normalization_variable", "maximum", 0.25), seed=1
    ),
    corpus,
)
_register_training(
    "train_random_sampling",
    {"tf": "binary", "idf": "probabilistic", "reps": 3, "seed": 2, "sampling": "random",
     "ratio": 0.7},
    TrainingConfig(
        split=SplitSettings(0.7, 3, "random"), tf_idf=settings("binary", "probabilistic"), seed=2
    ),
    corpus,
)


@query(
    "train_user_model",
    sql.with_ctes(sql.run(reps=2, seed=8), EV_SQL),
)
def train_user_model(spark, d):
    """Training through a model factory of the caller, here one that makes the same classifier."""
    config = TrainingConfig(split=SplitSettings(repetitions=2), seed=8)
    return evaluated(train(corpus(spark, d), config, factory=NearestCentroid().fit))


@query(
    "train_learner",
    sql.with_ctes(sql.run(reps=3, seed=9), EV_SQL),
)
def train_learner(spark, d):
    """Training with a model that is learned from parts, all splits in one job."""
    config = TrainingConfig(split=SplitSettings(repetitions=3), seed=9)
    return evaluated(train(corpus(spark, d), config, learner=CentroidLearner()))


def _bayes() -> list[tuple[str, str]]:
    """Multinomial naive Bayes with smoothing by 1 in the place of the nearest class mean."""
    return [
        ("cn", "SELECT split_index, label_id, count(*) AS n FROM asg WHERE is_train GROUP BY ALL"),
        ("voc", "SELECT split_index, count(*) AS v FROM dfs GROUP BY ALL"),
        ("mass", "SELECT split_index, label_id, term, sum(weight) AS s FROM feat WHERE is_train "
                 "GROUP BY ALL"),
        ("full_mass", "SELECT split_index, label_id, sum(s) AS t FROM mass GROUP BY ALL"),
        ("prior", """SELECT split_index, label_id AS class_id, ln(n + 1.0::DOUBLE) - ln(
             sum(n) OVER (PARTITION BY split_index) + count(*) OVER (PARTITION BY split_index))
             AS lp, ln(coalesce(t, 0) + v) AS floor_w FROM cn JOIN voc USING (split_index)
             LEFT JOIN full_mass USING (split_index, label_id)"""),
        ("own", "SELECT split_index, doc_id, sum(weight) AS w FROM feat GROUP BY ALL"),
        ("dots", "SELECT f.split_index, f.doc_id, m.label_id AS class_id, "
                 "sum(f.weight * ln(m.s + 1)) AS dot FROM feat f JOIN mass m "
                 "ON f.split_index = m.split_index AND f.term = m.term GROUP BY ALL"),
        ("ranked", """SELECT a.*, p.class_id, row_number() OVER (
             PARTITION BY a.split_index, a.doc_id
             ORDER BY lp - coalesce(w, 0) * floor_w + coalesce(dot, 0) DESC, p.class_id) AS rn
             FROM asg a JOIN prior p ON a.split_index = p.split_index
             LEFT JOIN own o ON o.split_index = a.split_index AND o.doc_id = a.doc_id
             LEFT JOIN dots d ON d.split_index = a.split_index AND d.doc_id = a.doc_id
               AND d.class_id = p.class_id"""),
        ("pred", "SELECT split_index, doc_id, label_id, is_train, class_id AS predicted "
                 "FROM ranked WHERE rn = 1"),
    ]


@query(
    "train_vector_model",
    sql.with_ctes(
        [
            *sql.docs(),
            *sql.counts(),
            *sql.weighted(),
            *sql.stratified(0.8, 2, 8),
            *sql.fitted(),
            *_bayes(),
            *sql.judged(),
        ],
        EV_SQL,
    ),
)
def train_vector_model(spark, d):
    """Training with an estimator over sparse vectors, through the factory contract."""
    config = TrainingConfig(split=SplitSettings(repetitions=2), seed=8)
    factory = VectorClassifier(NaiveBayes(smoothing=1.0)).fit
    return evaluated(train(corpus(spark, d), config, factory=factory))


@query(
    "no_leakage",
    sql.with_ctes(
        RUN,
        """SELECT split_index, count(*) AS test_only_terms, 0::BIGINT AS leaked FROM
           (SELECT DISTINCT a.split_index, t.term FROM asg a JOIN tf t ON a.doc_id = t.doc_id
            WHERE NOT a.is_train) s WHERE NOT EXISTS (SELECT 1 FROM dfs f WHERE
            f.split_index = s.split_index AND f.term = s.term) GROUP BY split_index""",
    ),
)
def no_leakage(spark, d):
    """Terms that only test documents hold, and how many of them reached the vocabulary."""
    from labelweave.operators.terms import term_counts

    outcome = trained(spark, d)
    held = outcome.assigned.join(
        term_counts(corpus(spark, d)).select("doc_id", "term"), "doc_id"
    )
    sides = held.groupBy("split_index", "term").agg(F.bool_or("is_train").alias("trained"))
    vocabulary = outcome.run.idf().select("split_index", "term", F.lit(1).alias("known"))
    only_test = sides.filter(~F.col("trained")).join(vocabulary, ["split_index", "term"], "left")
    return only_test.groupBy("split_index").agg(
        F.count(F.lit(1)).alias("test_only_terms"), F.count("known").alias("leaked")
    )


@query(
    "selected_model",
    sql.with_ctes(RUN, "SELECT term, df, round(idf, 6) AS idf FROM idf JOIN best "
                       "USING (split_index)"),
)
def selected_model(spark, d):
    """Vocabulary and weights of the winning split, which were fitted on its training documents."""
    return trained(spark, d).tf_idf.idf.select("term", "df", r6("idf"))


@query(
    "feature_count",
    sql.with_ctes(RUN, "SELECT split_index, count(*) AS feature_count FROM idf GROUP BY ALL"),
)
def feature_count(spark, d):
    idf = trained(spark, d).run.idf()
    return idf.groupBy("split_index").agg(F.count(F.lit(1)).alias("feature_count"))


@query(
    "model_summary",
    sql.with_ctes(RUN, f"""SELECT 'nearest_centroid' AS classifier, '{SEED}' AS seed,
        (SELECT string_agg(label_id, ',' ORDER BY label_id) FROM
         (SELECT DISTINCT label_id FROM docs)) AS label_ids,
        (SELECT count(*) FROM idf JOIN best USING (split_index)) AS feature_count,
        0.8::DOUBLE AS ratio, 3 AS repetitions, 'stratified' AS sampling,
        'raw_count' AS tf_scheme, 'base' AS idf_scheme, 0.5::DOUBLE AS k,
        'macro_f1' AS evaluation_strategy, (SELECT split_index FROM best) AS selected_split,
        (SELECT round(avg(test_macro_f1), 9) FROM ev) AS mean_test_macro_f1"""),
)
def model_summary(spark, d):
    row = model_metadata(trained(spark, d), "model", "trainer")
    return row.select(
        "classifier", "seed", F.array_join("label_ids", ",").alias("label_ids"), "feature_count",
        F.round(F.col("split.ratio").cast("double"), 6).alias("ratio"),
        "split.repetitions", "split.sampling", "tf_idf.tf_scheme", "tf_idf.idf_scheme",
        F.col("tf_idf.double_normalization_k").alias("k"), "evaluation_strategy",
        "evaluation.selected_split",
        F.round("evaluation.test_summary.mean.macro_f1", 9).alias("mean_test_macro_f1"),
    )


# A run over every language, whose labels are rows of a label table.
LANG_ID = "substr(md5(lang), 1, 24)"
STORED = TrainingConfig(split=SplitSettings(repetitions=1), seed=3)


def _stored_documents(spark, d):
    """All documents, labelled by the row of the label table that names their language."""
    documents = corpus(spark, d).withColumnRenamed("label_id", "name")
    return documents.join(language_labels(spark, d), "name").select("doc_id", "pages", "label_id")


STORED_TABLE = f"(SELECT doc_id, text, {LANG_ID} AS label FROM documents)"


@query(
    "run_record",
    f"SELECT status, count(*) AS entries, max(n)::INTEGER AS labels, "
    "count(*) FILTER (status = 'completed') AS with_model, 0::BIGINT AS with_error FROM "
    f"(SELECT count(DISTINCT label) AS n FROM {STORED_TABLE}), "
    "(SELECT unnest(['created', 'completed']) AS status) GROUP BY status",
)
def run_record(spark, d):
    """The log of a run that was created, trained and stored."""
    store = ModelStore(spark, f"{staging(spark).path}/store")
    run_training(_stored_documents(spark, d), STORED, language_labels(spark, d), store)
    return store.runs().groupBy("status").agg(
        F.count(F.lit(1)).alias("entries"),
        F.max(F.size("label_ids")).alias("labels"),
        F.count("model_id").alias("with_model"),
        F.count("error").alias("with_error"),
    )


@query(
    "model_load",
    sql.with_ctes(
        sql.run(label="label", table=STORED_TABLE, reps=1, seed=3),
        "SELECT label_id, term, round(mean, 6) AS mean FROM cent",
    ),
)
def model_load(spark, d):
    """Class means of a stored model, fetched by its id."""
    store = ModelStore(spark, f"{staging(spark).path}/store")
    model_id = run_training(_stored_documents(spark, d), STORED, language_labels(spark, d), store)
    return store.find(model_id).model.centroids.select("label_id", "term", r6("mean"))


def _scored(new: str, key: str) -> str:
    """SQL that scores texts with the model of the best split."""
    pages = [("newdocs", f"SELECT {key} AS doc_id, text FROM {new}")]
    return sql.with_ctes(
        [
            *RUN,
            *pages,
            *sql.counts("newdocs", "w_"),
            *sql.weighted("raw_count", prefix="w_"),
            ("w_feat", "SELECT doc_id, term, tfw * idf AS weight FROM w_tw JOIN "
                       "(SELECT term, idf FROM idf JOIN best USING (split_index)) USING (term) "
                       "WHERE tfw * idf <> 0"),
            ("w_own", "SELECT doc_id, sum(weight * weight) AS x2 FROM w_feat GROUP BY ALL"),
            ("w_dots", "SELECT doc_id, label_id AS class_id, sum(weight * mean) AS dot FROM w_feat "
                       "JOIN (SELECT * FROM cent JOIN best USING (split_index)) USING (term) "
                       "GROUP BY ALL"),
            ("w_dist", """SELECT n.doc_id, c.label_id AS class_id, coalesce(x2, 0) AS x2,
               greatest(0.0, coalesce(x2, 0) - 2 * coalesce(dot, 0) + c2) AS d2
               FROM (SELECT DISTINCT doc_id FROM newdocs) n
               CROSS JOIN (SELECT * FROM classes JOIN best USING (split_index)) c
               LEFT JOIN w_dots w ON w.doc_id = n.doc_id AND w.class_id = c.label_id
               LEFT JOIN w_own o ON o.doc_id = n.doc_id"""),
            ("w_rank", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY d2, class_id) "
                       "AS rn FROM w_dist"),
        ],
        "SELECT doc_id, class_id AS predicted, round(sqrt(d2), 5) AS dist FROM w_rank "
        "WHERE rn = 1",
    )


@query("score_new_documents", _scored("benchmark", "item_id"))
def score_new_documents(spark, d):
    outcome = trained(spark, d)
    found = score(new_documents(spark, d), outcome.tf_idf, outcome.model)
    return found.select("doc_id", "predicted", F.round("dist", 5).alias("dist"))


@query("score_conversations", _scored("conversations", "conv_id"))
def score_conversations(spark, d):
    """Documents of many pages, scored with a model that was stored and fetched."""
    outcome = trained(spark, d)
    store = ModelStore(spark, f"{staging(spark).path}/store")
    saved = store.find(store.save(outcome))
    found = score(conversations(spark, d), saved.tf_idf, saved.model)
    return found.select("doc_id", "predicted", F.round("dist", 5).alias("dist"))


@query(
    "score_label_names",
    _scored("benchmark", "item_id").replace(
        "SELECT doc_id, class_id AS predicted, round(sqrt(d2), 5) AS dist FROM w_rank",
        "SELECT doc_id, 'language ' || class_id AS label_name FROM w_rank",
    ),
)
def score_label_names(spark, d):
    """Names of the labels predicted for new documents, looked up in a label table."""
    outcome = trained(spark, d)
    found = score(new_documents(spark, d), outcome.tf_idf, outcome.model)
    labels = table(spark, d, "documents").select(
        F.col("lang").alias("label_id"), F.concat(F.lit("language "), "lang").alias("name")
    )
    return named(found, labels.distinct()).select("doc_id", "label_name")


@query(
    "single_class",
    sql.with_ctes(
        [x for x in _fit_on_all() if x[0] in ("docs", "tok", "tf", "st", "tw", "nn", "dfs", "mdf", "idf")]
        + [("feat", "SELECT doc_id, term, tfw * idf AS weight FROM tw JOIN idf USING (term) "
                    "WHERE tfw * idf <> 0"),
           ("cent", "SELECT term, sum(weight) / (SELECT count(*) FROM docs) AS mean FROM feat "
                    "GROUP BY ALL"),
           ("own", "SELECT doc_id, sum(weight * weight) AS x2, sum(weight * mean) AS dot FROM feat "
                   "JOIN cent USING (term) GROUP BY ALL")],
        "SELECT doc_id, 'all' AS predicted, round(sqrt(greatest(0, coalesce(x2, 0) - "
        "2 * coalesce(dot, 0) + (SELECT sum(mean * mean) FROM cent))), 5) AS dist "
        "FROM docs LEFT JOIN own USING (doc_id)",
    ),
)
def single_class(spark, d):
    """A classifier of one class gives every row that class."""
    own = staging(spark)
    documents = corpus(spark, d).withColumn("label_id", F.lit("all"))
    _, matrix = TfIdf(settings(idf="smooth")).fit_transform(documents, own)
    found = NearestCentroid().fit(matrix, own).distances(matrix)
    return found.select("doc_id", "predicted", F.round("dist", 5).alias("dist"))
