import math
from dataclasses import replace

import pytest

from labelweave.config import InvalidInput, NotFound, SplitSettings, TfIdfSettings, TrainingConfig
from labelweave.operators.centroid import NearestCentroid
from labelweave.operators.tfidf import weigh_together
from labelweave.plans import training
from labelweave.plans.jobs import create_trainer, run_training, start_training
from labelweave.plans.scoring import named, score
from labelweave.plans.training import train
from labelweave.sources.models import ModelStore, config_of, report_json

from .conftest import LABEL_3, LABEL_8

ONE = TrainingConfig(split=SplitSettings(repetitions=1), seed=42)
OTHER = {LABEL_3: LABEL_8, LABEL_8: LABEL_3}


def words(outcome):
    return {r["term"]: r["idf"] for r in outcome.tf_idf.idf_weights().collect()}


def metrics_of(outcome):
    return {r["split_index"]: r for r in outcome.evaluations.collect()}


def test_one_split(animals):
    outcome = train(animals, ONE)
    row = metrics_of(outcome)[0]
    assert outcome.selected_split == 0
    assert (row["train_samples"], row["test_samples"], row["test_macro_f1"]) == (8, 2, 1.0)
    assert outcome.report().first()["score_usage"] == "held-out selection scores"


@pytest.mark.parametrize("sampling", ["stratified", "random"])
def test_no_test_term_reaches_the_selected_vocabulary(animals, sampling):
    split = SplitSettings(repetitions=3, sampling=sampling)
    outcome = train(animals, TrainingConfig(split=split, seed=42))
    names = {r["doc_id"]: r["name"] for r in animals.collect()}
    idf = words(outcome)
    for row in outcome.assigned.filter(f"split_index = {outcome.selected_split}").collect():
        assert (names[row["doc_id"]] in idf) == row["is_train"]
    if sampling == "stratified":
        assert idf["apple"] == pytest.approx(math.log(2), abs=1e-12)
    vocabularies = {}
    for row in outcome.run.idf().collect():
        vocabularies.setdefault(row["split_index"], set()).add(row["term"])
    for row in outcome.assigned.collect():
        assert (names[row["doc_id"]] in vocabularies[row["split_index"]]) == row["is_train"]


def test_custom_weights_in_every_split(animals):
    config = TrainingConfig(
        split=SplitSettings(repetitions=2), tf_idf=TfIdfSettings(idf_scheme="smooth"), seed=42
    )
    outcome = train(animals, config)
    assert all(r["test_macro_f1"] == 1.0 for r in metrics_of(outcome).values())
    assert words(outcome)["apple"] == pytest.approx(math.log(8 / 5) + 1, abs=1e-12)


def test_selected_pair_fits_its_training_documents(animals):
    outcome = train(animals, TrainingConfig(split=SplitSettings(repetitions=4), seed=42))
    own = outcome.assigned.filter(f"split_index = {outcome.selected_split} AND is_train")
    documents = animals.join(own.select("doc_id"), "doc_id")
    found = outcome.model.predict(outcome.tf_idf.transform(documents))
    labels = {r["doc_id"]: r["label_id"] for r in documents.collect()}
    assert {r["doc_id"]: r["predicted"] for r in found.collect()} == labels
    # Scoring in one pass finds the same as weighting first and predicting then.
    scored = score(documents, outcome.tf_idf, outcome.model)
    assert {r["doc_id"]: r["predicted"] for r in scored.collect()} == labels


def test_passes_and_budgets_change_nothing(fruit, animals, monkeypatch):
    """Splits fitted in several passes, and words joined by shuffle, give the same run."""
    config = TrainingConfig(
        split=SplitSettings(0.6, 3),
        tf_idf=TfIdfSettings("double_normalization_half", "smooth"),
        seed=7,
    )

    def everything(outcome):
        rows = [tuple(r) for r in outcome.run.predictions().drop("dist").collect()]
        return sorted(rows), sorted(tuple(r) for r in outcome.evaluations.collect())

    documents = animals.select("doc_id", "pages", "label_id")
    usual = everything(train(documents, config))
    monkeypatch.setattr(training, "SPLITS_PER_PASS", 2)
    assert everything(train(documents, config)) == usual
    for budget in (0, 1500):
        assert everything(train(documents, config, budget=budget)) == usual


def test_classes_side_by_side_change_nothing(fruit, animals, monkeypatch):
    """A frequent word is one row for all classes, whatever else is broadcast or shuffled."""
    config = TrainingConfig(split=SplitSettings(0.5, 3), seed=7)
    documents = animals.select("doc_id", "pages", "label_id").unionByName(
        fruit.selectExpr("doc_id + 100 AS doc_id", "pages", "if(doc_id % 3 = 0, 'third', label_id) AS label_id")
    )
    tables, whole = [], training.wide_sums

    def noted(tokens, wide, *rest):
        tables.append(wide)
        return whole(tokens, wide, *rest)

    def found(budget):
        predictions = train(documents, config, budget=budget).run.predictions()
        return {tuple(r)[:5]: r["dist"] for r in predictions.collect()}

    monkeypatch.setattr(training, "wide_sums", noted)
    with monkeypatch.context() as narrow:
        narrow.setattr(training, "WIDE_SUMS", 0)
        usual = found(1 << 28)
    assert not tables and len(usual) == 60
    for budget in (0, 4000, 1 << 28):
        assert found(budget) == pytest.approx(usual)
    words = [(t.count(), t.select("term").distinct().count()) for t in tables]
    # No word is broadcast, then some words, then all.
    assert len(words) == 2 and words[0][0] < words[1][0]
    assert all(rows == terms > 0 for rows, terms in words)


def test_replay_with_the_returned_seed(fruit):
    config = TrainingConfig(
        split=SplitSettings(0.6, 2),
        tf_idf=TfIdfSettings("binary", "smooth"),
        evaluation_strategy="matthews_correlation",
    )
    first = train(fruit, config)
    assert first.config.seed is not None
    second = train(fruit, first.config)
    a, b = first.report().first(), second.report().first()
    assert a == b and a["strategy"] == "matthews_correlation"
    assert a["seed"] == str(first.config.seed)
    assert [s["train_samples"] for s in a["splits"]] == [6, 6]
    for weight in words(first).values():
        assert weight == pytest.approx(math.log(6 / 4) + 1, abs=1e-12)


def test_bad_settings_fail_before_training(animals, make_documents):
    for ratio in (0.0, 1.0, math.nan, -0.1, 1.1):
        with pytest.raises(InvalidInput):
            train(animals, TrainingConfig(split=SplitSettings(ratio)))
    with pytest.raises(InvalidInput):
        train(animals, TrainingConfig(split=SplitSettings(repetitions=0)))
    with pytest.raises(InvalidInput, match="no documents"):
        train(animals.limit(0), ONE)
    with pytest.raises(InvalidInput, match="single document"):
        train(make_documents([["a"]], ["x"]), ONE)


def test_empty_pages_and_repeated_ids_fail(make_documents, fruit):
    with pytest.raises(InvalidInput, match="nothing to learn"):
        train(make_documents([[""]] * 4, ["a", "a", "b", "b"]), ONE)
    with pytest.raises(InvalidInput, match="unique"):
        train(fruit.union(fruit), ONE)


class Inverted:
    """A model that is wrong about every document."""

    def __init__(self, inner):
        self.inner = inner

    def predict(self, features):
        return self.inner.predict(features).replace(OTHER, subset=["predicted"])

    def labels(self):
        return self.inner.labels()


def test_a_later_split_can_win_with_its_own_vocabulary(animals):
    seen = []

    def factory(features):
        rows = features.documents.collect()
        seen.append({(r["doc_id"], r["name"], r["label_id"]) for r in rows})
        model = NearestCentroid().fit(features)
        return Inverted(model) if len(seen) == 1 else model

    outcome = train(
        animals, TrainingConfig(split=SplitSettings(repetitions=2), seed=42), factory
    )
    assert outcome.selected_split == 1 and not isinstance(outcome.model, Inverted)
    scores = metrics_of(outcome)
    assert (scores[0]["test_macro_f1"], scores[1]["test_macro_f1"]) == (0.0, 1.0)
    names = {r["doc_id"]: r["name"] for r in animals.collect()}
    vocabulary = set(words(outcome))
    for row in outcome.assigned.collect():
        passed = row["doc_id"] in {d for d, _, _ in seen[row["split_index"]]}
        assert passed == row["is_train"]
        if row["split_index"] == 1:
            assert (names[row["doc_id"]] in vocabulary) == row["is_train"]


def test_failing_factories_fail_the_run(animals):
    config = TrainingConfig(split=SplitSettings(repetitions=3), seed=1)
    with pytest.raises(InvalidInput, match="no factory"):
        train(animals, config, training.missing_factory)
    calls = []

    def fails(features):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("second split failed")
        return NearestCentroid().fit(features)

    with pytest.raises(RuntimeError, match="second split failed"):
        train(animals, config, fails)
    assert len(calls) == 2

    class Silent(Inverted):
        def predict(self, features):
            return self.inner.predict(features).limit(0)

    with pytest.raises(InvalidInput, match="one label and one prediction"):
        train(animals, config, lambda features: Silent(NearestCentroid().fit(features)))


def test_scoring_is_the_same_whatever_is_broadcast(animals):
    outcome = train(animals, TrainingConfig(split=SplitSettings(0.6, 1), seed=3))
    documents = animals.select("doc_id", "pages")

    def scores(budget):
        tf_idf = replace(outcome.tf_idf, budget=budget)
        rows = score(documents, tf_idf, outcome.model).collect()
        return {r["doc_id"]: (r["predicted"], round(r["dist"], 9)) for r in rows}

    usual = scores(1 << 28)
    assert len(usual) == 10
    for budget in (0, 400):
        assert scores(budget) == usual


@pytest.fixture
def labels(spark):
    return spark.createDataFrame(
        [(LABEL_3, "fruit"), (LABEL_8, "citrus")], "label_id string, name string"
    )


@pytest.fixture
def store(spark, staging):
    return ModelStore(spark, f"{staging.path}/store")


def test_run_store_and_score(spark, fruit, labels, store, make_documents):
    config = TrainingConfig(seed=42)
    trainer_id, config = create_trainer(fruit, config, labels, store)
    created = store.run(trainer_id)
    assert (created["status"], created["model_id"], created["error"]) == ("created", None, None)
    assert created["label_ids"] == [LABEL_3, LABEL_8] and store.models() is None
    model_id = start_training(trainer_id, fruit, config, store)
    done = store.run(trainer_id)
    assert (done["status"], done["model_id"]) == ("completed", model_id) and model_id != trainer_id
    with pytest.raises(InvalidInput, match="started before"):
        start_training(trainer_id, fruit, config, store)
    metadata = store.metadata(model_id)
    assert metadata["trainer_id"] == trainer_id and len(metadata["evaluation"]["splits"]) == 5
    assert metadata["feature_count"] == 6 and metadata["label_ids"] == [LABEL_3, LABEL_8]
    assert config_of(metadata) == config and model_id in report_json(metadata)
    saved = store.find(model_id)
    fresh = make_documents([["apple sweet"], ["orange"], ["none of these"], []])
    expected = {0: LABEL_3, 1: LABEL_8, 2: LABEL_3, 3: LABEL_3}
    found = score(fresh, saved.tf_idf, saved.model)
    assert {r["doc_id"]: r["predicted"] for r in found.collect()} == expected
    features = saved.tf_idf.transform(fresh)
    assert {r["doc_id"]: r["predicted"] for r in saved.model.predict(features).collect()} == expected
    assert {r["doc_id"]: r["label_name"] for r in named(found, labels).collect()}[1] == "citrus"
    other = store.find(run_training(fruit, config, labels, store))
    with pytest.raises(InvalidInput, match="another vocabulary"):
        score(fresh, saved.tf_idf, other.model)
    with pytest.raises(InvalidInput, match="another vocabulary"):
        other.model.predict(features)


def test_failed_runs_are_logged_and_store_nothing(fruit, labels, store, make_documents):
    empty = make_documents([[""]] * 4, [LABEL_3] * 2 + [LABEL_8] * 2)
    with pytest.raises(InvalidInput, match="nothing to learn"):
        run_training(empty, ONE, labels, store)
    failed = store.runs().filter("status = 'failed'").first()
    assert "nothing to learn" in failed["error"] and failed["model_id"] is None
    assert store.models() is None
    with pytest.raises(InvalidInput, match="started before"):
        start_training(failed["trainer_id"], empty, ONE, store)
    with pytest.raises(InvalidInput, match="label table lacks"):
        run_training(fruit, ONE, labels.filter("name = 'fruit'"), store)


def test_unknown_ids(store):
    assert store.find("nothing") is None
    with pytest.raises(NotFound):
        store.metadata("nothing")
    with pytest.raises(NotFound):
        store.run("nothing")


def test_request_settings():
    config = TrainingConfig.from_request({"classifier": "nearest_centroid", "documents": []})
    assert config == TrainingConfig() and config.split == SplitSettings(0.8, 5, "stratified")
    config = TrainingConfig.from_request(
        {
            "classifier": "nearest_centroid",
            "split": {"ratio": 0.7, "sampling": "random"},
            "tf_idf": {"tf_scheme": "binary", "idf_scheme": "probabilistic"},
            "evaluation_strategy": "balanced_accuracy",
            "seed": 2**64 - 1,
        }
    )
    assert config.split == SplitSettings(0.7, 5, "random") and config.seed == 2**64 - 1
    for bad in (
        {},
        {"classifier": "svm"},
        {"classifier": "nearest_centroid", "extra": 1},
        {"classifier": "nearest_centroid", "split": {"rate": 0.5}},
        {"classifier": "nearest_centroid", "tf_idf": {"tf_scheme": "log"}},
        {"classifier": "nearest_centroid", "seed": -1},
        {"classifier": "nearest_centroid", "evaluation_strategy": "accuracy"},
        {"classifier": "nearest_centroid", "split": {"sampling": "none"}},
    ):
        with pytest.raises(InvalidInput):
            TrainingConfig.from_request(bad)


def folders(spark):
    from labelweave.session import file_names, staging_root

    return set(file_names(spark, staging_root(spark)))


@pytest.mark.parametrize("ids", [[0, 1, 2, 3, 0, 5, 6, 7], [0, 1, 2, 3, None, 5, 6, 7]])
@pytest.mark.parametrize("factory", [None, NearestCentroid().fit])
def test_ids_are_checked_before_any_work_and_nothing_is_left(spark, ids, factory):
    """One id in two classes, and a null id."""
    rows = [(i, ["one word"], "ab"[k % 2]) for k, i in enumerate(ids)]
    documents = spark.createDataFrame(rows, "doc_id long, pages array<string>, label_id string")
    before = folders(spark)
    with pytest.raises(InvalidInput, match="unique"):
        train(documents, TrainingConfig(seed=1), factory)
    assert folders(spark) == before


def test_a_class_of_one_long_text_does_not_blur_the_others(spark, make_documents):
    texts = ["alpha beta"] * 3 + ["gamma delta"] * 3 + ["omega " * 200_000] * 3
    outcome = train(
        make_documents([[t] for t in texts], list("aaabbbccc")),
        TrainingConfig(split=SplitSettings(0.7, 1), seed=3),
    )
    found = score(make_documents([["gamma delta"], ["unknown"]]), outcome.tf_idf, outcome.model)
    assert {r["doc_id"]: r["predicted"] for r in found.collect()} == {0: "b", 1: "a"}


def test_session_settings_follow_what_is_shuffled():
    from labelweave.session import session_conf

    assert int(session_conf(100 * 10**12, 10_000)["spark.sql.shuffle.partitions"]) < 50_000
    assert session_conf(1000, 8)["spark.sql.shuffle.partitions"] == "8"


def test_a_factory_run_shares_its_budget_among_the_tables_of_a_job(fruit, monkeypatch):
    from labelweave.operators import centroid, tfidf

    budgets = []
    for module in (centroid, tfidf):
        def noted(tokens, table, budget, counted, whole=module.join_terms):
            budgets.append(budget)
            return whole(tokens, table, budget, counted=counted)

        monkeypatch.setattr(module, "join_terms", noted)
    config = TrainingConfig(split=SplitSettings(repetitions=2), seed=3)
    train(fruit, config, factory=centroid.NearestCentroid().fit, budget=1 << 20)
    # Features of both sides, and their distances, of either split.
    assert len(budgets) == 8 and set(budgets) == {1 << 17}


def test_features_of_all_splits_share_one_budget(spark, tmp_path, monkeypatch):
    from catalogue.training import features
    from labelweave.plans.training import FittedRun
    from labelweave.session import BROADCAST_BYTES

    rows = [(i, f"common w{i % 7} w{i % 5}x", f"l{i % 2}", "s") for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(
        str(tmp_path / "documents.parquet")
    )
    budgets, selected = [], FittedRun.selected

    def noted(run, split, config, space, budget):
        budgets.append(budget)
        return selected(run, split, config, space, budget)

    monkeypatch.setattr(FittedRun, "selected", noted)
    found = features(spark, str(tmp_path)).collect()
    assert sorted({(r["split_index"], r["label_id"], r["is_train"]) for r in found}) == [
        (i, label, side) for i in range(3) for label in ("l0", "l1") for side in (False, True)
    ]
    assert sum(budgets[-3:]) * 4 <= BROADCAST_BYTES


@pytest.mark.parametrize("budget", [1, 1 << 20])
def test_weights_of_all_splits_come_side_by_side(animals, staging, budget):
    """Terms that a run has counted get the weights that each split's model gives the texts."""
    outcome = train(animals, TrainingConfig(split=SplitSettings(0.6, 3), seed=7))
    models = [outcome.run.selected(i, outcome.config, f"split {i}", budget)[0] for i in range(3)]
    rows = weigh_together(models, outcome.run.counted, ["doc_id"], staging)
    found = [tuple(r) for r in rows.collect()]
    for i, model in enumerate(models):
        wanted = {(r["doc_id"], r["term"]): r["weight"] for r in model.transform(animals).rows.collect()}
        mine = {r[:2]: r[2 + i] for r in found if r[2 + i]}
        assert mine == pytest.approx(wanted, abs=1e-12) and len(mine) < len(found)
    # The words of test documents are in no row of a split they were not trained for.
    assert len({r[:2] for r in found}) == len(found)
