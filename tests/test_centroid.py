import math

import pytest
from pyspark.errors import PySparkException

from labelweave.config import InvalidInput
from labelweave.operators.centroid import NearestCentroid
from labelweave.operators.tfidf import Features, TfIdf

ROWS = [(0, "1", 2.0), (1, "0", 2.0), (1, "1", 2.0), (2, "0", 6.0), (3, "0", 8.0)]
TEST = [(0, "0", 1.0), (0, "1", 1.0), (1, "0", 6.0), (1, "1", 1.0), (2, "0", 4.0), (2, "1", 1.0),
        (3, "0", 7.0)]


def matrix(spark, rows, documents, columns=2, labels=None, space="s"):
    frame = spark.createDataFrame(rows, "doc_id long, term string, weight double")
    if labels is None:
        ids = spark.createDataFrame([(i,) for i in range(documents)], "doc_id long")
    else:
        ids = spark.createDataFrame(list(enumerate(labels)), "doc_id long, label_id string")
    return Features(frame, ids, space, columns)


@pytest.fixture
def model(spark, staging):
    return NearestCentroid().fit(matrix(spark, ROWS, 4, labels=["3", "3", "8", "8"]), staging)


def test_means_ties_missing_and_empty_rows(spark, model):
    means = {(r["label_id"], r["term"]): r["mean"] for r in model.centroids.collect()}
    assert means == {("3", "0"): 1.0, ("3", "1"): 2.0, ("8", "0"): 7.0}
    assert [r["label_id"] for r in model.labels().collect()] == ["3", "8"]
    found = {r["doc_id"]: (r["predicted"], r["dist"])
             for r in model.distances(matrix(spark, TEST, 5)).collect()}
    assert {i: p for i, (p, _) in found.items()} == {0: "3", 1: "8", 2: "3", 3: "8", 4: "3"}
    expected = {0: 1.0, 1: math.sqrt(2), 2: math.sqrt(10), 3: 0.0, 4: math.sqrt(5)}
    assert {i: d for i, (_, d) in found.items()} == pytest.approx(expected, abs=1e-7)
    assert model.predict(matrix(spark, [], 0)).count() == 0


def test_terms_of_no_class_add_to_the_distance_only(spark, model):
    far = model.distances(matrix(spark, [(0, "0", 7.0), (0, "9", 3.0)], 1)).first()
    assert far["predicted"] == "8" and far["dist"] == pytest.approx(3.0, abs=1e-9)


def test_implicit_zeros_and_single_class(spark, staging):
    single = NearestCentroid().fit(matrix(spark, [(0, "0", 6.0)], 3, 1, ["5"] * 3), staging)
    assert [r["mean"] for r in single.centroids.collect()] == [2.0]
    assert single.predict(matrix(spark, [(0, "0", 100.0)], 1, 1)).first()["predicted"] == "5"


def test_bad_training_data(spark):
    fit = NearestCentroid().fit
    with pytest.raises(InvalidInput, match="nothing to learn"):
        fit(matrix(spark, [], 0))
    with pytest.raises(InvalidInput, match="nothing to learn"):
        fit(matrix(spark, [], 1, 0, ["0"]))
    with pytest.raises(InvalidInput, match="nothing to learn"):
        fit(matrix(spark, ROWS, 2, labels=["1", None]))
    for value in (math.nan, math.inf, -math.inf):
        with pytest.raises(InvalidInput, match="finite"):
            fit(matrix(spark, [(0, "0", value)], 1, 1, ["1"]))


def test_bad_features_to_predict(spark, model):
    with pytest.raises(InvalidInput, match="another vocabulary"):
        model.predict(matrix(spark, [], 1, space="other"))
    with pytest.raises(PySparkException, match="finite"):
        model.predict(matrix(spark, [(0, "0", math.nan)], 1)).collect()


def test_true_ties_go_to_the_lowest_label_whatever_the_scale(spark, staging):
    """Two classes with equal means, large weights that do not add up exactly, many documents."""
    rows, labels = [], []
    for i in range(6):
        labels.append("b" if i % 2 else "a")
        rows += [(i, f"t{j}", 1e5 / (j + 3)) for j in range(30)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 6, 30, labels), staging)
    found = fitted.predict(matrix(spark, rows, 6, 30)).collect()
    assert {r["predicted"] for r in found} == {"a"}


def test_a_far_class_does_not_blur_the_near_ones(spark, staging):
    rows = [(0, "t1", 1.0), (1, "t0", 1.0), (2, "t2", 1e7)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 3, 3, ["a", "b", "c"]), staging)
    found = fitted.distances(matrix(spark, [(0, "t0", 1.0), (1, "t2", 5.0)], 3, 3)).collect()
    assert {r["doc_id"]: (r["predicted"], r["dist"]) for r in found} == {
        0: ("b", 0.0),
        1: ("a", pytest.approx(math.sqrt(26))),
        2: ("a", 1.0),
    }


def test_words_that_push_a_class_away(spark, staging):
    """With negative means the class of least norm can be farther than one that shares nothing."""
    rows = [(0, "t0", -1.0), (1, "t1", 1.5), (2, "t2", 3.0)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 3, 3, ["a", "b", "c"]), staging)
    found = fitted.distances(matrix(spark, [(0, "t0", 2.0)], 2, 3)).collect()
    assert {r["doc_id"]: (r["predicted"], r["dist"]) for r in found} == {
        0: ("b", 2.5),
        1: ("a", 1.0),
    }


def hypot_distances(means, x, terms):
    """Distance to every class, coordinate by coordinate."""
    return {c: math.hypot(*(x.get(t, 0.0) - m.get(t, 0.0) for t in terms)) for c, m in means.items()}


WIDE = [
    # huge, tiny and ordinary classes, one that differs from another in its sign only
    (0, "t0", 1e200), (1, "t0", 3e200), (2, "t1", 1e-200), (3, "t1", 5e-200), (4, "t2", 2.0),
    (5, "t0", -1e200), (6, "t3", 1.7e308), (7, "t4", 5e-324), (8, "t0", 1e200), (8, "t2", 1.0),
]


def test_huge_and_tiny_weights(spark, staging):
    labels = [f"c{k}" for k in range(9)]
    fitted = NearestCentroid().fit(matrix(spark, WIDE, 9, 5, labels), staging)
    means = {c: {} for c in labels}
    for i, t, w in WIDE:
        means[f"c{i}"][t] = w
    terms = [f"t{k}" for k in range(6)]
    documents = [
        {"t0": 1.9e200}, {"t0": 2.1e200}, {"t1": 2e-200}, {"t1": 4e-200}, {"t2": 1.4}, {"t0": -2e200},
        {"t3": 1e308}, {"t0": 1e200, "t2": 3.0}, {}, {"t5": 1e200, "t1": 1e-200}, {"t1": 3e-200, "t5": 1e-190},
        {"t0": 2.5e200, "t5": 2e200}, {"t3": 1.7e308},
    ]
    rows = [(i, t, w) for i, x in enumerate(documents) for t, w in x.items()]
    found = {r["doc_id"]: r for r in fitted.distances(matrix(spark, rows, len(documents), 5)).collect()}
    assert len(found) == len(documents)
    for i, x in enumerate(documents):
        wanted = hypot_distances(means, x, terms)
        least = min(wanted.values())
        assert math.isfinite(found[i]["dist"])
        near = [c for c, d in wanted.items() if d <= least * (1 + 1e-9)]
        largest = max([abs(w) for w in x.values()] + [abs(m) for c in near for m in means[c].values()] or [0])
        assert found[i]["dist"] == pytest.approx(least, rel=1e-9, abs=largest * 1e-6)
        assert wanted[found[i]["predicted"]] <= least + largest * 1e-6


def test_means_of_huge_weights_stay_finite(spark, staging):
    rows = [(i, "t0", 1.5e308) for i in range(4)] + [(4, "t0", 1.0), (5, "t1", 1e-300)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 6, 2, ["a"] * 4 + ["b", "c"]), staging)
    assert {(r["label_id"], r["term"]): r["mean"] for r in fitted.centroids.collect()} == {
        ("a", "t0"): 1.5e308, ("b", "t0"): 1.0, ("c", "t1"): 1e-300,
    }


@pytest.mark.parametrize("scale", [1.0, 1e-220, 1e220])
def test_signs_of_all_kinds_and_sizes(spark, staging, scale):
    import random

    random.seed(5)
    rows = [(i, f"t{random.randrange(12)}x{j}"[:3], scale * random.choice([-2, -1, 1, 3]))
            for i in range(24) for j in range(3)]
    rows = list({(i, t): (i, t, w) for i, t, w in rows}.values())
    labels = [f"c{i % 8}" for i in range(24)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 24, 12, labels), staging)
    means = {f"c{k}": {} for k in range(8)}
    for r in fitted.centroids.collect():
        means[r["label_id"]][r["term"]] = r["mean"]
    terms = sorted({t for _, t, _ in rows})
    for r in fitted.distances(matrix(spark, rows, 24, 12)).collect():
        x = {t: w for i, t, w in rows if i == r["doc_id"]}
        wanted = hypot_distances(means, x, terms)
        best = min(wanted, key=lambda c: (round(wanted[c] / scale, 9), c))
        assert (r["predicted"], r["dist"] / scale) == (best, pytest.approx(wanted[best] / scale, abs=1e-6))


def test_one_sign_for_a_word_meets_only_the_classes_that_hold_it(spark, staging):
    """Frequent words weigh below zero everywhere; their products are positive."""
    rows = [(i, "t0", -1.0) for i in range(4)] + [(i, f"t{i + 1}", 2.0) for i in range(4)]
    fitted = NearestCentroid().fit(matrix(spark, rows, 4, 5, list("abcd")), staging)
    assert not fitted._mixed_signs(matrix(spark, rows, 4).rows)
    assert fitted._mixed_signs(matrix(spark, [(0, "t0", 1.0)], 1).rows)
    found = fitted.predict(matrix(spark, rows, 4, 5)).collect()
    assert {r["doc_id"]: r["predicted"] for r in found} == dict(enumerate("abcd"))


def test_features_are_made_once_for_all_passes(spark, staging, fruit):
    """Judging looks at the features three times; the join that makes them runs once."""
    _, features = TfIdf().fit_transform(fruit, staging)
    model = NearestCentroid().fit(features, staging)
    both = [model.distances(features, staging) for _ in range(2)]
    for found in both:
        files = found.inputFiles()
        assert not [f for f in files if "document_frequency" in f or "term_counts" in f]
        held = spark.read.parquet(*{f for f in files if "judged_features" in f})
        assert sorted(held.collect()) == sorted(features.rows.select(*held.columns).collect())
        assert found.count() == fruit.count()
