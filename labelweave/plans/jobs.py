"""The training job as a service would run it: check, train, store, and log how it went."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from ..config import InvalidInput, TrainingConfig
from ..operators.validate import check_classes, check_label_ids, class_table
from ..session import Staging
from ..sources.models import ModelStore
from .training import train


def create_trainer(
    documents: DataFrame, config: TrainingConfig, labels: DataFrame, store: ModelStore
) -> tuple[str, TrainingConfig]:
    """Check settings, documents and label ids and log a run as created.

    Returns its id and the settings with their seed, which is generated here if it was left out.
    """
    config = config.with_seed()
    config.split.check_trainable()
    staging = Staging(documents.sparkSession)
    try:
        classes = staging.write(class_table(documents), "classes")
        check_classes(classes, config.split)
        check_label_ids(classes, labels)
        trainer_id = str(uuid.uuid4())
        store.append_run(trainer_id, config, _label_ids(classes), "created")
    finally:
        staging.drop()
    return trainer_id, config


def _label_ids(classes: DataFrame) -> list[str]:
    # One short row per class: the metadata of a run names its labels.
    return [row["label_id"] for row in classes.orderBy("class_ix").select("label_id").collect()]


def run_training(
    documents: DataFrame, config: TrainingConfig, labels: DataFrame, store: ModelStore
) -> str:
    """Train and store a model, and return its id.

    A run that fails in training is logged with its error and stores no model.
    """
    trainer_id, config = create_trainer(documents, config, labels, store)
    return start_training(trainer_id, documents, config, store)


def start_training(
    trainer_id: str, documents: DataFrame, config: TrainingConfig, store: ModelStore
) -> str:
    """Train a created run.  A run is trained once; after a failure a new one is created."""
    created = store.run(trainer_id)
    if created["status"] != "created" or not store.claim(trainer_id):
        raise InvalidInput("this run was started before")
    label_ids = created["label_ids"]
    staging = Staging(documents.sparkSession)
    try:
        outcome = train(documents, config, staging=staging)
        model_id = store.save(outcome, trainer_id)
    except Exception as error:
        message = str(error) if isinstance(error, InvalidInput) else "training worker failed"
        store.append_run(trainer_id, config, label_ids, "failed", error=message)
        raise
    finally:
        staging.drop()
    store.append_run(trainer_id, config, label_ids, "completed", model_id=model_id)
    return model_id
