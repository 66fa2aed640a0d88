"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  folder of tables (default /root/testdata/sf0.1)
    BENCH_CPUS    cores of the local session (default 8)

Every query runs once in full, after a warm-up of the same queries on the smallest tables.  Results
go to Spark's no-op sink, so all rows are worked out and none is collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from catalogue import terms
from catalogue.tables import corpus, conversations, judged_corpus
from labelweave.config import SplitSettings, TfIdfSettings, TrainingConfig
from labelweave.operators.splits import stratified_split
from labelweave.operators.terms import corpus_term_counts, document_frequency, term_counts
from labelweave.operators.tfidf import TfIdf
from labelweave.plans.scoring import score
from labelweave.plans.training import train
from labelweave.session import session_conf

WARM_UP = "/root/testdata/sf0.001"


def _train(label="lang", reps=5, load=corpus, **settings):
    def run(spark, d):
        config = TrainingConfig(split=SplitSettings(repetitions=reps), seed=42, **settings)
        return train(load(spark, d, label), config).report()

    return run


_models = {}


def _model(spark, d):
    if d not in _models:
        config = TrainingConfig(split=SplitSettings(repetitions=1), seed=42)
        _models[d] = train(corpus(spark, d), config)
    return _models[d]


def _score(load):
    def run(spark, d):
        outcome = _model(spark, d)
        return score(load(spark, d).select("doc_id", "pages"), outcome.tf_idf, outcome.model)

    return run


QUERIES = {
    "term_frequency": lambda s, d: term_counts(corpus(s, d)),
    "corpus_term_frequency": lambda s, d: corpus_term_counts(corpus(s, d)),
    "document_frequency": lambda s, d: document_frequency(corpus(s, d)),
    "vocabulary_index": terms.vocabulary_index,
    "split_stratified": lambda s, d: stratified_split(corpus(s, d), SplitSettings(), 42),
    "tfidf_fit_transform": lambda s, d: TfIdf().fit_transform(corpus(s, d))[1].rows,
    "train_3_splits": _train(reps=3),
    "train_5_splits": _train(),
    "train_quality": _train(
        "quality", 5, judged_corpus, tf_idf=TfIdfSettings("double_normalization_half", "smooth")
    ),
    "train_20_classes": _train("source", 3),
    "score_documents": _score(corpus),
    "score_conversations": _score(conversations),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    size = Path(folder, "documents.parquet").stat().st_size
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for name, value in session_conf(size, cpus).items():
        builder = builder.config(name, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    chosen = [name for name in QUERIES if not sys.argv[1:] or name in sys.argv[1:]]

    def run(name: str, where: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    if Path(WARM_UP).exists():
        for name in chosen:
            run(name, WARM_UP)
    if any(name.startswith("score") for name in chosen):
        _model(spark, folder)
    seconds = {name: round(run(name, folder), 3) for name in chosen}
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    rows, characters = documents.agg(F.count(F.lit(1)), F.sum("n_chars")).first()
    found = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "headline_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(found.group(1)) if found else folder,
                "documents": rows,
                "characters": characters,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
