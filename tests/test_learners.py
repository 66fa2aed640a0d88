import math
import sys
from collections import Counter

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from labelweave.config import METRICS, InvalidInput, SplitSettings, TfIdfSettings, TrainingConfig
from labelweave.operators.learners import CentroidLearner, CountLearner
from labelweave.plans import states
from labelweave.plans.scoring import score
from labelweave.plans.training import train
from labelweave.sources.models import ModelStore

COUNTS = TfIdfSettings("raw_count", "smooth")


@pytest.fixture(scope="module")
def mixed(spark):
    """Documents whose words overlap between four classes; some are empty."""
    vocabulary = ["river", "stone", "cloud", "grass", "ember", "frost", "maple", "otter", "quartz"]
    rows = []
    for i in range(90):
        words = [vocabulary[(i * k + k * k + i % 4) % 9] for k in range(1, i % 13)]
        rows.append((i, [" ".join(words), vocabulary[i % 4] if i % 9 else ""], f"class {i % 4}"))
    return spark.createDataFrame(rows, "doc_id long, pages array<string>, label_id string").repartition(6)


def evaluations(outcome):
    columns = [f"{p}_{m}" for p in ("train", "test") for m in METRICS]
    return [tuple(r) for r in outcome.evaluations.select("split_index", *columns).orderBy("split_index").collect()]


@pytest.mark.parametrize("settings", [TfIdfSettings("normalization", "base"), TfIdfSettings("binary", "maximum")])
def test_states_learn_what_the_built_in_classifier_learns(mixed, monkeypatch, settings):
    """Ten splits in two passes, states merged two at a time over several levels."""
    monkeypatch.setattr(states, "FAN_IN", 2)
    monkeypatch.setattr(states, "PART_WEIGHTS", 50)
    config = TrainingConfig(split=SplitSettings(0.7, 10), tf_idf=settings, seed=4)
    usual, parts = train(mixed, config), train(mixed, config, learner=CentroidLearner())
    assert parts.selected_split == usual.selected_split
    for mine, its in zip(evaluations(parts), evaluations(usual), strict=True):
        assert mine == pytest.approx(its, abs=1e-12)
    assert [r["label_id"] for r in parts.model.labels().collect()] == [f"class {k}" for k in range(4)]
    words = mixed.select("doc_id", "pages")
    wanted = score(words, usual.tf_idf, usual.model).select("doc_id", "predicted")
    found = score(words, parts.tf_idf, parts.model)
    assert found.filter("dist IS NOT NULL").isEmpty()
    assert sorted(map(tuple, found.select("doc_id", "predicted").collect())) == sorted(map(tuple, wanted.collect()))


@pytest.mark.parametrize("budget", [1, 6000])
def test_documents_get_their_rare_words_back(mixed, monkeypatch, budget):
    """No word is broadcast, or some are; documents meet the others in several buckets."""
    monkeypatch.setattr(states, "BUCKET_WEIGHTS", 100)
    config = TrainingConfig(split=SplitSettings(0.7, 2), seed=4)
    usual = train(mixed, config, learner=CentroidLearner())
    few = train(mixed, config, learner=CentroidLearner(), budget=budget)
    for mine, its in zip(evaluations(few), evaluations(usual), strict=True):
        assert mine == pytest.approx(its, abs=1e-12)


def test_documents_are_shuffled_packed_and_once(mixed, staging):
    """No weight is shuffled by itself, and documents are not sorted beside copies of every model."""
    entries = mixed.select(
        "doc_id", "label_id", F.lit(3).alias("sides"),
        F.expr("transform(sequence(0, 99), c -> struct(CAST(99 - c AS BIGINT) AS column, "
               "array(c % 7D, if(c % 3 = 0, CAST(NULL AS DOUBLE), 1D)) AS weights))").alias("entries"),
    )
    packed = states.PackedDocuments.of(entries, ["doc_id", "label_id", "sides"]).staged(staging, "packed")
    documents = [states._Documents.unpacked(bytes(r["data"])) for r in packed.table.collect()]
    assert sum(len(d.sizes) for d in documents) == 90 and all((d.sizes == 100).all() for d in documents)
    assert all((d.columns.reshape(-1, 100) == range(100)).all() for d in documents)
    assert sum(r["n"] for r in packed.table.collect()) == 90 * 101
    assert sum(len(r["data"]) for r in packed.table.collect()) < 90 * 100 * 8
    models = states.learned(packed, CentroidLearner(), 2, staging, "models")
    plan = states.predictions(packed, models, CentroidLearner(), ["doc_id"])._jdf.queryExecution().toString()
    assert "Sort" not in plan and plan.split("== Physical Plan ==")[1].count("Exchange") == 1


def plain_bayes(documents, train_ids, smoothing=1.0):
    by_class, rows = {}, Counter()
    known = {w for i, words, _ in documents if i in train_ids for w in words}
    for i, words, label in documents:
        if i in train_ids:
            by_class.setdefault(label, Counter()).update(words)
            rows[label] += 1
    found = {}
    for i, words, _ in documents:
        scores = {}
        for label, counts in sorted(by_class.items()):
            total = counts.total() + smoothing * len(known)
            scores[label] = math.log(rows[label] / rows.total()) + sum(
                math.log((counts[w] + smoothing) / total) for w in words if w in known
            )
        found[i] = max(scores, key=lambda c: (round(scores[c], 9), [-ord(x) for x in c]))
    return found


def test_word_counts_per_class(spark, mixed, staging):
    """Weights are word counts when every word of a split has the same frequency weight."""
    config = TrainingConfig(split=SplitSettings(0.6, 2), tf_idf=COUNTS, seed=2)
    documents = [(r["doc_id"], [w for p in r["pages"] for w in p.split()], r["label_id"]) for r in mixed.collect()]
    place = {w: n for n, w in enumerate(sorted({w for _, words, _ in documents for w in words}))}
    rows = spark.createDataFrame(
        [(i, label, 1, [(place[w], [float(n)]) for w, n in sorted(Counter(words).items())])
         for i, words, label in documents],
        "doc_id long, label_id string, sides int, entries array<struct<column:bigint,weights:array<double>>>",
    ).repartition(5)
    trained = rows.withColumn("sides", (F.col("doc_id") % 3 != 0).cast("int"))
    models = states.learned(trained, CountLearner(), 1, staging, "bayes")
    found = states.predictions(rows, models, CountLearner(), ["doc_id"]).collect()
    wanted = plain_bayes(documents, {i for i, _, _ in documents if i % 3})
    assert {r["doc_id"]: r["predicted"] for r in found} == wanted
    assert len(evaluations(train(mixed, config, learner=CountLearner()))) == 2


class Failing(CentroidLearner):
    def __init__(self, where):
        self.where = where

    def partial(self, rows):
        if self.where == "partial":
            raise RuntimeError("no state can be made")
        return super().partial(rows)

    def predict(self, model, rows):
        if self.where == "predict":
            raise RuntimeError("no state can be made")
        return super().predict(model, rows)[self.where == "short" :]


@pytest.mark.parametrize("where", ["partial", "predict", "short"])
def test_the_first_error_of_a_learner_fails_the_run(spark, fruit, staging, where):
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    with pytest.raises(PySparkException, match="no state can be made|one label for every row"):
        train(fruit, TrainingConfig(seed=1), learner=Failing(where), staging=staging)
    from labelweave.session import path_exists

    assert not path_exists(spark, staging.path)


def test_a_learned_model_is_stored_and_fetched(spark, fruit, staging, make_documents):
    outcome = train(fruit, TrainingConfig(split=SplitSettings(repetitions=2), seed=3), learner=CentroidLearner())
    store = ModelStore(spark, f"{staging.path}/store")
    model_id = store.save(outcome)
    assert store.metadata(model_id)["classifier"] == "CentroidLearner"
    with pytest.raises(InvalidInput, match="needs its learner"):
        store.find(model_id)
    saved = store.find(model_id, learner=CentroidLearner())
    outcome.release()
    fresh = make_documents([["apple sweet"], ["sour orange"], ["unknown"], []])
    found = {r["doc_id"]: r["predicted"] for r in score(fresh, saved.tf_idf, saved.model).collect()}
    labels = [r["label_id"] for r in saved.model.labels().collect()]
    assert found[0] == labels[0] and found[1] == labels[1] and len(found) == 4


def test_a_run_takes_one_kind_of_user_model(fruit):
    with pytest.raises(InvalidInput, match="not both"):
        train(fruit, TrainingConfig(), factory=lambda f: None, learner=CentroidLearner())


class Noted:
    """A model that leaves a file wherever it is unpickled."""

    def __init__(self, folder, labels):
        self.folder, self.labels = folder, labels

    def __setstate__(self, state):
        import os
        import uuid

        self.__dict__ = state
        open(os.path.join(self.folder, uuid.uuid4().hex), "w").close()


class Noting(CentroidLearner):
    def __init__(self, folder):
        self.folder = folder

    def finish(self, state):
        return Noted(self.folder, state.labels)

    def labels(self, model):
        return model.labels

    def predict(self, model, rows):
        return [model.labels[0]] * len(rows)


def test_copies_of_models_do_not_grow_with_the_rows(spark, mixed, staging, tmp_path, monkeypatch):
    """A part for every weight would be hundreds, each with a copy of every model."""
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    monkeypatch.setattr(states, "PART_WEIGHTS", 1)
    entries = mixed.select(
        "doc_id", "label_id", F.lit(3).alias("sides"),
        F.expr("transform(sequence(0, 9), c -> struct(CAST(c AS BIGINT) AS column, "
               "array(1D, CAST(NULL AS DOUBLE)) AS weights))").alias("entries"),
    )
    learner = Noting(str(tmp_path))
    models = states.learned(entries, learner, 2, staging, "noted")
    assert models.columns == ["split", "model"]
    found = states.predictions(entries, models, learner, ["doc_id"]).collect()
    assert sorted((r["split"], r["doc_id"]) for r in found) == [(s, i) for s in (0, 1) for i in range(90)]
    assert len(list(tmp_path.iterdir())) <= 2 * 2 * spark.sparkContext.defaultParallelism


def test_states_come_in_chunks_and_meet_one_by_one():
    """Of the states of two groups, cut into chunks, a merge never reads more than one ahead."""
    from pyspark import cloudpickle

    import pyarrow as pa

    read = []

    def chunks():
        for group, part, value in ((0, 0, [1]), (0, 1, [2]), (0, 2, [3]), (1, 16, [4])):
            raw = cloudpickle.dumps(value)
            read.append(part)
            for first in range(0, len(raw), 5):
                yield pa.RecordBatch.from_pydict(
                    {"split": [0], "group": [group], "part": [part], "state": [raw[first : first + 5]]}
                )

    class Lists:
        def merge(self, left, right):
            assert len(read) <= len(left) + 2
            return left + right

    merged = list(states._merging(Lists(), False)(chunks()))
    assert [cloudpickle.loads(b.column("state")[0].as_py()) for b in merged] == [[1, 2, 3], [4]]
    assert [b.column("part")[0].as_py() for b in merged] == [0, 1]
