"""From raw documents to training sequences, stage by stage.

Every stage takes the documents its predecessor kept and returns those it keeps, with all their
columns; the last one returns the sequences.  Between stages the documents are a written table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelweave.llm import language, quality
from labelweave.llm.decontaminate import contaminated
from labelweave.llm.jaccard import jaccard_components
from labelweave.llm.packing import pack
from labelweave.session import Staging, broadcast_if_small

#: Documents that score less are rejected.
LEAST_QUALITY = 0.3

#: SQL has no classifier that is trained, no mixture inference, no SimHash and no tokenizer.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on all judgements, does not reject."""
    staging = Staging(spark)
    model, _ = quality.train(docs, _table(spark, sf_dir, "labels"), staging=staging)
    staging.drop()
    scored = quality.score_texts(docs, model)
    return scored.filter(F.col("score") >= LEAST_QUALITY).select("kept.*")


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; null texts and texts without letters go."""
    found = language.identify(docs, language.train(docs))
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).select("kept.*")


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least id, of every group of similar documents.

    A document is known by its id and text, so that repeated ids and rows are told apart; of
    repeated rows one stays.  Only the keys of documents that go are joined to the texts.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("digest"))
    staging = Staging(spark)
    found = staging.write(
        jaccard_components(docs.select(key.alias("key"), "text"), "key", staging=staging), "found"
    )
    gone = found.filter("key <> component_id").select(F.col("key").alias("gone")).distinct()
    again = found.groupBy(F.col("key").alias("again")).agg(F.count(F.lit(1)).alias("n"))
    again = again.filter("n > 1").select("again")
    gone, again = broadcast_if_small(gone, "gone"), broadcast_if_small(again, "again")
    stay = docs.join(gone, key == F.col("gone"), "left_anti")
    single = stay.join(again, key == F.col("again"), "left_anti")
    repeated = stay.join(again, key == F.col("again"), "left_semi")
    return single.unionByName(repeated.dropDuplicates(["doc_id", "text"]))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    A document is known by its id and text, so a row without an id is searched as well, and one that
    shares its id with a leaked one stays.
    """
    key = F.struct(F.col("doc_id"), F.xxhash64("text").alias("digest"))
    staging = Staging(spark)
    searched = docs.select(key.alias("doc_id"), "text")
    found = contaminated(searched, _table(spark, sf_dir, "benchmark"), staging=staging)
    leaked = staging.write(found.select(F.col("doc_id").alias("leaked")).distinct(), "leaked")
    return docs.join(broadcast_if_small(leaked, "leaked"), key == F.col("leaked"), "left_anti")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths of every document that is left."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality_classifier", keep_good),
    ("language_id", keep_known_languages),
    ("jaccard_join", keep_one_of_similar),
    ("decontamination", keep_clean),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` to the rows of the last stage."""
    staging = Staging(spark)
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staging.write(stage(spark, docs, sf_dir), name)
    return docs
