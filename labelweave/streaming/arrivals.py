"""Uploads and documents that keep arriving.

Uploads come one at a time for as long as the service is up, and are judged by their own row alone,
so taking them in needs no state.  A stored model scores each batch of new documents as it would
score a table of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..config import NotFound
from ..operators.centroid import NearestCentroidModel
from ..plans.scoring import model_scoring_table, score
from ..plans.states import Learner
from ..session import Staging
from ..sources.commits import CommitLog
from ..sources.intake import IntakeConfig, check_uploads, manifest, rejects
from ..sources.models import ModelStore, SavedModel


def manifest_stream(
    uploads: DataFrame, config: IntakeConfig, identity: list[Column]
) -> tuple[DataFrame, DataFrame]:
    """Streams of manifest rows and of rejects.

    Keys must come from the upload itself: a batch that is run again writes the same ones.
    """
    checked = check_uploads(uploads, config)
    return manifest(checked, config, identity), rejects(checked)


def score_stream(
    documents: DataFrame, saved: SavedModel, sink: Callable[[DataFrame, int], None]
) -> DataStreamWriter:
    """Writer that hands every batch's ``doc_id, predicted, dist`` and its number to a sink.

    The model's scoring table is made once for the stream and lives as long as the model's store.
    """
    model = Staging(documents.sparkSession)
    table = model.write(model_scoring_table(saved.tf_idf, saved.model), "scoring")

    def score_batch(batch: DataFrame, number: int) -> None:
        staging = Staging(batch.sparkSession)
        try:
            sink(score(batch, saved.tf_idf, saved.model, staging, table), number)
        finally:
            staging.drop()

    return documents.writeStream.foreachBatch(score_batch)


@dataclass
class _Loaded:
    """The model a stream scores with at the moment, and its scoring table."""

    saved: SavedModel
    staging: Staging
    table: DataFrame | None


def score_published(
    documents: DataFrame,
    store: ModelStore,
    choices: str,
    sink: Callable[[DataFrame, int], None],
    learner: Learner | None = None,
) -> DataStreamWriter:
    """Writer that scores every batch with the model that is published when the batch begins.

    The sink gets ``doc_id, predicted, dist, model_id`` and the number of the batch.  Which model a
    batch was given is noted under the folder ``choices`` before it is scored, so a batch that is
    run again gets the same one, also if another was published since.  A scoring table is made when
    the model changes, and the one before is deleted.
    """
    log = CommitLog(documents.sparkSession, choices)
    loaded: dict[str, _Loaded] = {}

    def chosen(number: int) -> str:
        key = f"{number:012d}"
        if (before := log.entries().get(key)) is not None:
            return before
        model_id = store.published()
        if model_id is None:
            raise NotFound("no model is published")
        if not log.claim(key):
            # The stream that began this batch died before it noted its choice.
            log.release(key)
            log.claim(key)
        log.commit(key, model_id)
        return model_id

    def load(model_id: str) -> _Loaded:
        if model_id not in loaded:
            saved = store.find(model_id, learner=learner)
            if saved is None:
                raise NotFound(f"the published model {model_id} is gone")
            staging = Staging(documents.sparkSession)
            table = None
            if isinstance(saved.model, NearestCentroidModel):
                table = staging.write(model_scoring_table(saved.tf_idf, saved.model), "scoring")
            for old in loaded.values():
                old.staging.drop()
            loaded.clear()
            loaded[model_id] = _Loaded(saved, staging, table)
        return loaded[model_id]

    def score_batch(batch: DataFrame, number: int) -> None:
        model_id = chosen(number)
        now, staging = load(model_id), Staging(batch.sparkSession)
        try:
            found = score(batch, now.saved.tf_idf, now.saved.model, staging, now.table)
            sink(found.withColumn("model_id", F.lit(model_id)), number)
        finally:
            staging.drop()

    return documents.writeStream.foreachBatch(score_batch)
