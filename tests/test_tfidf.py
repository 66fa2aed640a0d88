import math

import pytest
from pyspark.sql import functions as F

from labelweave.config import InvalidInput, TfIdfSettings
from labelweave.functions.weights import idf_weight, tf_weight
from labelweave.operators.term_join import broadcast_floor, dealt_floor, join_terms, term_bands
from labelweave.operators.tfidf import TfIdf

LN2 = math.log(2)


@pytest.mark.parametrize(
    "scheme, cnt, total, mx, k, expected",
    [
        ("binary", 2, 4, 2, 0.5, 1.0),
        ("raw_count", 2, 4, 2, 0.5, 2.0),
        ("normalization", 2, 4, 2, 0.5, 0.5),
        ("double_normalization_half", 1, 4, 2, 0.5, 0.75),
        ("double_normalization_variable", 1, 4, 2, 0.25, 0.625),
    ],
)
def test_tf_schemes(spark, scheme, cnt, total, mx, k, expected):
    row = spark.range(1).select(F.lit(cnt).alias("c"), F.lit(total).alias("t"), F.lit(mx).alias("m"))
    weight = tf_weight(TfIdfSettings(scheme, "base", k), F.col("c"), F.col("t"), F.col("m"))
    assert row.select(weight.alias("w")).first()["w"] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "scheme, n, df, max_df, expected",
    [
        ("base", 10, 2, 8, math.log(5)),
        ("smooth", 10, 2, 8, math.log(10 / 3) + 1),
        ("maximum", 10, 2, 8, math.log(8 / 3)),
        ("maximum", 10, 8, 8, math.log(8 / 9)),
        ("probabilistic", 10, 2, 8, math.log(4)),
        ("probabilistic", 10, 6, 8, 0.0),
        ("probabilistic", 10, 10, 10, 0.0),
    ],
)
def test_idf_schemes(spark, scheme, n, df, max_df, expected):
    row = spark.range(1).select(*[F.lit(v).cast("long").alias(c) for c, v in
                                  (("n", n), ("d", df), ("m", max_df))])
    weight = idf_weight(TfIdfSettings("binary", scheme), F.col("n"), F.col("d"), F.col("m"))
    assert row.select(weight.alias("w")).first()["w"] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("k", [-0.1, 1.1, math.nan, math.inf])
def test_bad_k_is_rejected_whatever_the_scheme(k):
    with pytest.raises(InvalidInput):
        TfIdfSettings("binary", "base", k)


@pytest.mark.parametrize("k", [0.0, 0.5, 1.0])
def test_good_k(k):
    assert TfIdfSettings(double_normalization_k=k).double_normalization_k == k


def weights(features):
    return {(r["doc_id"], r["term"]): r["weight"] for r in features.rows.collect()}


def test_fit_transform_equals_fit_then_transform(make_documents, staging):
    documents = make_documents([["cat cat dog"], ["cat bird"]])
    model, features = TfIdf().fit_transform(documents, staging)
    assert [r["term"] for r in model.vocabulary().collect()] == ["bird", "cat", "dog"]
    assert features.columns == 3 and features.documents.count() == 2
    got = weights(features)
    assert set(got) == {(0, "dog"), (1, "bird")}
    assert got[(0, "dog")] == pytest.approx(LN2, abs=1e-12)
    assert weights(TfIdf().fit(documents).transform(documents)) == got
    idf = {r["term"]: r["idf"] for r in model.idf_weights().collect()}
    assert idf == pytest.approx({"bird": LN2, "cat": 0.0, "dog": LN2})


def test_unknown_words_have_no_column(make_documents):
    model = TfIdf().fit(make_documents([["cat"]]))
    features = model.transform(make_documents([["bird"]]))
    assert (features.documents.count(), features.columns, weights(features)) == (1, 1, {})


def test_empty_documents_and_no_documents(make_documents):
    model, features = TfIdf().fit_transform(make_documents([[""], [".?!"]]))
    assert (features.documents.count(), features.columns, weights(features)) == (2, 0, {})
    assert model.idf_weights().collect() == []
    model, features = TfIdf().fit_transform(make_documents([]))
    assert (features.documents.count(), features.columns, weights(features)) == (0, 0, {})


def test_empty_documents_count_in_n(make_documents):
    model = TfIdf().fit(make_documents([["cat"], [], [""]]))
    assert model.idf.first()["idf"] == pytest.approx(math.log(3), abs=1e-12)


def test_refitting_replaces_the_vocabulary(make_documents):
    estimator = TfIdf()
    first = estimator.fit(make_documents([["cat dog"], ["cat"]]))
    second = estimator.fit(make_documents([["bird"]]))
    assert first.columns == 2
    assert [tuple(r) for r in second.idf_weights().collect()] == [("bird", 0.0)]


def test_fitted_state_exists_only_on_the_model():
    assert not hasattr(TfIdf(), "transform") and not hasattr(TfIdf(), "vocabulary")


def test_totals_count_unknown_words_too(make_documents):
    model = TfIdf(TfIdfSettings("normalization", "smooth")).fit(make_documents([["cat"], ["dog"]]))
    features = model.transform(make_documents([["cat bird bird bird"]]))
    assert weights(features)[(0, "cat")] == pytest.approx(0.25 * (math.log(2 / 2) + 1), abs=1e-12)


def test_sparse_vectors_keep_column_order_and_empty_rows(make_documents, staging):
    documents = make_documents([["dog bird"], [""], ["dog"]])
    model, features = TfIdf(TfIdfSettings("raw_count", "smooth")).fit_transform(documents)
    rows = features.vectors(model.indexed_terms(staging)).collect()
    assert {r["doc_id"]: r["indices"] for r in rows} == {0: [0, 1], 1: [], 2: [1]}


@pytest.mark.parametrize("budget", [0, 400, 1 << 28])
@pytest.mark.parametrize("counted", [True, False])
def test_join_is_the_same_whatever_is_broadcast(spark, staging, budget, counted):
    """A word of a third of all rows, common words and rare ones, with every share broadcast."""
    tokens = [(i, "hot") for i in range(60)] + [(i, f"w{i % 40}") for i in range(120)]
    held = {}
    for _, term in tokens:
        held[term] = held.get(term, 0) + 1
    table = [(t, n if counted else 1, float(n)) for t, n in held.items() if t != "w3"]
    table.append(("unseen", 1, 0.0))
    left = spark.createDataFrame(tokens, "doc_id long, term string")
    right = staging.write(
        spark.createDataFrame(table, "term string, docs long, x double"), "table"
    )
    joined = join_terms(left, right, budget, counted, staging)
    expected = sorted((d, t, float(held[t])) for d, t in tokens if t != "w3")
    assert sorted((r["doc_id"], r["term"], r["x"]) for r in joined.collect()) == expected


def test_broadcast_floor(spark):
    rows = [("a" * 10, 1000), ("b" * 10, 900), ("c" * 10, 3), ("d" * 10, 1)]
    bands = term_bands(spark.createDataFrame(rows, "term string, docs long"))
    # A sixteenth of a power of two to a band: 1000 and 900 documents are told apart.
    assert [b["band"] for b in bands] == [159, 157, 25, 0]
    assert broadcast_floor(bands, 2, 1 << 20) == 0
    assert broadcast_floor(bands, 2, 10) is None
    two = 2 * (48 + 16 + 10)
    assert broadcast_floor(bands, 2, two) == 900


def test_words_of_all_documents_are_dealt_to_many_tasks(spark, staging):
    """Nothing may be broadcast and one word is in every document."""
    words = [f"w{k}" for k in range(40)]
    rows = [(i, w, 1.0) for i in range(4000) for w in ("the", words[i % 40])]
    left = spark.createDataFrame(rows, "doc_id long, term string, tf double")
    docs = {"the": 4000} | dict.fromkeys(words, 100)
    table = [(t, n, c) for t, n in docs.items() for c in "ab"]
    right = staging.write(spark.createDataFrame(table, "term string, docs long, label string"), "right")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16",
            "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        read = {}
        for most in (50, 1 << 20):
            joined = join_terms(left, right, 0, most=most)
            parts = joined.groupBy(F.spark_partition_id()).count().collect()
            read[most] = sorted(r["count"] for r in parts)
            found = joined.groupBy("term", "label").agg(F.count("*"), F.countDistinct("doc_id"))
            assert {tuple(r) for r in found.collect()} == {(t, c, docs[t], docs[t]) for t, _, c in table}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert read[1 << 20][-1] >= 8000 and read[50][-1] <= 2 * read[50][len(read[50]) // 2]


def test_dealt_floor(spark):
    rows = [("a", 1000), ("b", 900), ("c", 40), ("d", 2)]
    bands = term_bands(spark.createDataFrame(rows, "term string, docs long"))
    assert dealt_floor(bands, None, 30) == 40 and dealt_floor(bands, 900, 30) == 40
    assert dealt_floor(bands, None, 500) == 900 and dealt_floor(bands, None, 1000) is None
    assert dealt_floor([], None, 1) is None
