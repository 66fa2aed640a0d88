"""The test tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.config import SplitSettings, TfIdfSettings, TrainingConfig
from labelweave.plans.training import TrainingOutcome, train
from labelweave.session import Staging
from labelweave.sources.documents import documents_from_pages, to_documents

SEED = 42
SPLIT = SplitSettings(ratio=0.8, repetitions=3)
CONFIG = TrainingConfig(split=SPLIT, seed=SEED)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(table: DataFrame) -> DataFrame:
    """A table of fewer scan partitions than cores, as the single files of tests, dealt out."""
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table


def corpus(spark: SparkSession, sf_dir: str, label: str = "lang") -> DataFrame:
    """All documents with one of their own columns as the label."""
    return to_documents(dealt(table(spark, sf_dir, "documents")), "doc_id", "text", label=label)


def judged_corpus(spark: SparkSession, sf_dir: str, label: str = "quality") -> DataFrame:
    """The documents that were judged, with the judgement as the label."""
    documents = dealt(table(spark, sf_dir, "documents"))
    both = documents.join(table(spark, sf_dir, "labels"), "doc_id")
    return to_documents(both, "doc_id", "text", label=label)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as documents whose pages are the turns."""
    turns = table(spark, sf_dir, "conversations")
    return documents_from_pages(turns, "conv_id", "turn", "text")


def new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts without a label."""
    return to_documents(dealt(table(spark, sf_dir, "benchmark")), "item_id", "text")


def label_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every language and source, with an id made from its name."""
    name = F.concat_ws("/", "lang", "source").alias("name")
    names = table(spark, sf_dir, "documents").select(name).distinct()
    return names.select(F.substring(F.md5(F.col("name").cast("binary")), 1, 24).alias("label_id"),
                        "name")


def language_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label for every language, with an id made from its name."""
    names = table(spark, sf_dir, "documents").select(F.col("lang").alias("name")).distinct()
    label_id = F.substring(F.md5(F.col("name").cast("binary")), 1, 24).alias("label_id")
    return names.select(label_id, "name")


_trained: dict[tuple, TrainingOutcome] = {}


def trained(
    spark: SparkSession, sf_dir: str, config: TrainingConfig = CONFIG, label: str = "lang"
) -> TrainingOutcome:
    """A run on the corpus.  Queries about different parts of one run share it."""
    key = (spark.sparkContext.applicationId, sf_dir, config, label)
    if key not in _trained:
        _trained[key] = train(corpus(spark, sf_dir, label), config)
    return _trained[key]


def settings(tf: str = "raw_count", idf: str = "base", k: float = 0.5) -> TfIdfSettings:
    return TfIdfSettings(tf, idf, k)


def staging(spark: SparkSession) -> Staging:
    return Staging(spark)
