"""A store of trained models and a log of training runs, as tables under one folder.

A model is written table by table and entered in the list of models last, so a job that dies half
way leaves no model behind that could be found.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import (
    InvalidInput,
    NotFound,
    SplitSettings,
    TfIdfSettings,
    TrainingConfig,
)
from ..operators.centroid import NearestCentroidModel
from ..operators.tfidf import TfIdfModel
from ..plans.states import LearnedModel, Learner
from ..plans.training import TrainingOutcome
from ..session import BROADCAST_BYTES, create_file, path_exists
from .batches import BatchTable
from .commits import CommitLog, Conflict

SETTINGS = [
    T.StructField("classifier", T.StringType(), False),
    # Seeds are unsigned 64-bit numbers, which no integer column holds.
    T.StructField("seed", T.StringType(), False),
    T.StructField("label_ids", T.ArrayType(T.StringType()), False),
    T.StructField(
        "split",
        T.StructType(
            [
                T.StructField("ratio", T.FloatType()),
                T.StructField("repetitions", T.IntegerType()),
                T.StructField("sampling", T.StringType()),
            ]
        ),
        False,
    ),
    T.StructField(
        "tf_idf",
        T.StructType(
            [
                T.StructField("tf_scheme", T.StringType()),
                T.StructField("idf_scheme", T.StringType()),
                T.StructField("double_normalization_k", T.DoubleType()),
            ]
        ),
        False,
    ),
    T.StructField("evaluation_strategy", T.StringType(), False),
]
RUN = T.StructType(
    [
        T.StructField("trainer_id", T.StringType(), False),
        *SETTINGS,
        T.StructField("status", T.StringType(), False),
        T.StructField("model_id", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)


def settings_values(config: TrainingConfig, label_ids: list[str]) -> tuple:
    split, tf_idf = config.split, config.tf_idf
    return (
        config.classifier,
        str(config.seed),
        label_ids,
        (split.ratio, split.repetitions, split.sampling),
        (tf_idf.tf_scheme, tf_idf.idf_scheme, float(tf_idf.double_normalization_k)),
        config.evaluation_strategy,
    )


def model_metadata(outcome: TrainingOutcome, model_id: str, trainer_id: str) -> DataFrame:
    """One row: ids, settings, label ids, feature count and the whole evaluation report."""
    spark = outcome.evaluations.sparkSession
    config = outcome.config
    schema = T.StructType([f for f in SETTINGS if f.name != "label_ids"])
    values = settings_values(config, [])
    row = spark.createDataFrame([values[:2] + values[3:]], schema)
    labels = outcome.model.labels().agg(
        F.array_sort(F.collect_list("label_id")).alias("label_ids")
    )
    report = outcome.report()
    # Three tables of one row each.
    keyed = [t.withColumn("_one", F.lit(1)) for t in (row, labels, report)]
    joined = keyed[0].join(F.broadcast(keyed[1]), "_one").join(F.broadcast(keyed[2].select(
        "_one", F.struct(*report.columns).alias("evaluation")
    )), "_one")
    model = outcome.model
    classifier = F.lit(model.name) if isinstance(model, LearnedModel) else F.col("classifier")
    return joined.select(
        F.lit(model_id).alias("model_id"),
        F.lit(trainer_id).alias("trainer_id"),
        classifier.alias("classifier"),
        "seed",
        "label_ids",
        F.lit(outcome.tf_idf.columns).cast("bigint").alias("feature_count"),
        "split",
        "tf_idf",
        "evaluation_strategy",
        "evaluation",
        F.lit(outcome.tf_idf.documents).cast("bigint").alias("documents"),
    )


@dataclass(frozen=True)
class SavedModel:
    """A stored classifier together with the feature space it was trained in."""

    model_id: str
    model: NearestCentroidModel | LearnedModel
    tf_idf: TfIdfModel
    metadata: Row


def fingerprint(table: DataFrame) -> str:
    """A digest of the rows of a table, whatever their order and partitions.

    Two independent 64-bit hashes of every row are added up, which Spark combines before anything
    is shuffled; together with the number of rows they tell tables apart.
    """
    row = F.struct(*table.columns)
    parts = [
        F.sum(F.xxhash64(*salt, row).cast("decimal(20,0)")) for salt in ([], [F.lit("second")])
    ]
    sums = [F.coalesce(part, F.lit(0)).cast("string") for part in parts]
    counted = F.count(F.lit(1)).cast("string")
    return table.agg(F.sha2(F.concat_ws(":", counted, *sums), 256)).first()[0]


class ModelStore:
    """Tables ``models`` and ``runs``, and one folder of tables for each model."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark = spark
        self.path = path.rstrip("/")

    def save(self, outcome: TrainingOutcome, trainer_id: str | None = None) -> str:
        """Store the selected model of a run and return its new id."""
        model = outcome.model
        if isinstance(model, NearestCentroidModel):
            tables = {"centroids": model.centroids, "class_stats": model.class_stats}
        elif isinstance(model, LearnedModel):
            tables = {"learned": model.table, "columns": model.terms}
        else:
            raise InvalidInput("only models of a built-in classifier or a learner can be stored")
        model_id = str(uuid.uuid4())
        folder = f"{self.path}/model/{model_id}"
        outcome.tf_idf.idf.write.parquet(f"{folder}/idf")
        for name, table in tables.items():
            table.write.parquet(f"{folder}/{name}")
        metadata = model_metadata(outcome, model_id, trainer_id or str(uuid.uuid4()))
        metadata = metadata.withColumn("fingerprint", F.lit(self._fingerprint(folder)))
        BatchTable(self.spark, f"{self.path}/models").append(metadata.coalesce(1), model_id)
        return model_id

    def _fingerprint(self, folder: str) -> str:
        return fingerprint(self.spark.read.parquet(f"{folder}/idf").select("term", "df", "idf"))

    def _table(self, name: str) -> DataFrame | None:
        return BatchTable(self.spark, f"{self.path}/{name}").read()

    def models(self) -> DataFrame | None:
        return self._table("models")

    def metadata(self, model_id: str) -> Row:
        models = self._table("models")
        row = models.filter(F.col("model_id") == model_id).first() if models else None
        if row is None:
            raise NotFound("unknown model")
        return row

    def find(
        self, model_id: str, budget: int = BROADCAST_BYTES, learner: Learner | None = None
    ) -> SavedModel | None:
        """The stored pair of classifier and TF-IDF; None for an unknown id.

        A model that was learned by a learner needs one of its kind to predict.  Such a model is
        unpickled by the tasks, so a store must be as trusted as code.
        """
        try:
            row = self.metadata(model_id)
        except NotFound:
            return None
        folder = f"{self.path}/model/{model_id}"
        if self._fingerprint(folder) != row["fingerprint"]:
            raise InvalidInput(f"the vocabulary of model {model_id} is not the one it was stored with")
        read = self.spark.read.parquet
        settings = TfIdfSettings(**row["tf_idf"].asDict())
        tf_idf = TfIdfModel(
            settings,
            read(f"{folder}/idf"),
            row["documents"],
            row["feature_count"],
            model_id,
            budget,
        )
        if path_exists(self.spark, f"{folder}/centroids"):
            model = NearestCentroidModel(
                read(f"{folder}/centroids"), read(f"{folder}/class_stats"), model_id, budget
            )
        elif learner is not None and type(learner).__name__ == row["classifier"]:
            model = LearnedModel(
                learner, read(f"{folder}/learned"), read(f"{folder}/columns"), model_id, budget
            )
        else:
            raise InvalidInput(f"this model needs its learner, {row['classifier']}")
        return SavedModel(model_id, model, tf_idf, row)

    def publish(self, model_id: str) -> None:
        """Make a stored model the one that streams score with from their next batch on."""
        self.metadata(model_id)
        log = CommitLog(self.spark, f"{self.path}/published")
        version = f"{int(max(log.entries(), default='0')) + 1:09d}"
        if not log.claim(version):
            raise Conflict("another model is being published")
        log.commit(version, model_id)

    def published(self) -> str | None:
        """Id of the model that was published last, None before the first."""
        entries = CommitLog(self.spark, f"{self.path}/published").entries()
        return entries[max(entries)] if entries else None

    def append_run(
        self,
        trainer_id: str,
        config: TrainingConfig,
        label_ids: list[str],
        status: str,
        model_id: str | None = None,
        error: str | None = None,
    ) -> None:
        values = (trainer_id, *settings_values(config, label_ids), status, model_id, error)
        rows = self.spark.createDataFrame([values], RUN)
        BatchTable(self.spark, f"{self.path}/runs").append(
            rows.coalesce(1), f"{trainer_id}-{status}"
        )

    def claim(self, trainer_id: str) -> bool:
        """Whether this caller is the first to start a run: only one can create its mark."""
        return create_file(self.spark, f"{self.path}/started/{trainer_id}")

    def runs(self) -> DataFrame | None:
        """All entries of the run log; a run that was started and ended has one of each."""
        return self._table("runs")

    def run(self, trainer_id: str) -> Row:
        """The latest state of a run: how it ended, or that it was created."""
        runs = self._table("runs")
        ended = F.when(F.col("status") == "created", 0).otherwise(1)
        row = (
            runs.filter(F.col("trainer_id") == trainer_id).orderBy(ended.desc()).first()
            if runs
            else None
        )
        if row is None:
            raise NotFound("unknown trainer")
        return row


def report_json(row: Row) -> str:
    """The report or metadata row as JSON text."""
    return json.dumps(row.asDict(recursive=True), ensure_ascii=False)


def config_of(row: Row) -> TrainingConfig:
    """Settings with which a stored run or model can be repeated."""
    split = row["split"]
    return TrainingConfig(
        row["classifier"],
        SplitSettings(split["ratio"], split["repetitions"], split["sampling"]),
        TfIdfSettings(**row["tf_idf"].asDict()),
        row["evaluation_strategy"],
        int(row["seed"]),
    )
