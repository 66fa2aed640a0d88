"""The trained models: quality and language."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from labelweave.llm import language, quality
from labelweave.llm.arrowtext import text_buffer

from .helpers import rows_of


def sentences(n, seed=0, alphabet="abcdefgh"):
    rng = random.Random(seed)
    lexicon = ["".join(rng.choices(alphabet, k=rng.randrange(2, 7))) for _ in range(30)]
    return [" ".join(rng.choices(lexicon, k=rng.randrange(20, 60))).capitalize() + "." for _ in range(n)]


# Quality


def junk(texts, seed=3):
    rng = random.Random(seed)
    return [" ".join(w + rng.choice(["%%%", "###", " |", "!!"]) for w in t.split()) for t in texts]


def test_quality_is_learned_from_positives_and_unlabelled_text(spark, staging):
    good, bad = sentences(300), junk(sentences(75, seed=9))
    texts = good + bad
    documents = spark.createDataFrame(
        [(k, t, 0.0) for k, t in enumerate(texts)], "doc_id long, text string, score double"
    )
    labels = [(k, int(k < 300), 0) for k in range(0, 375, 2)] + [(None, 1, 0), (4, None, 0), (2, 0, 0)]
    frame = spark.createDataFrame(labels, "doc_id long, quality int, text int")
    held = language.fold("doc_id", 5) != 0
    model, rows = quality.train(documents, frame, in_training=held, staging=staging)
    assert 0.7 < model.prior < 0.9
    scored = {r["doc_id"]: r["score"] for r in quality.score_features(rows, model).collect()}
    assert np.mean([scored[k] >= 0.3 for k in range(300)]) > 0.95
    assert np.mean([scored[k] < 0.3 for k in range(300, 375)]) > 0.95
    by_text = quality.score_texts(documents, model).select("kept.doc_id", "score").collect()
    assert all(abs(r["score"] - scored[r["doc_id"]]) < 1e-9 for r in by_text)
    # Held-out rows are not learned from: their labels may say anything.
    kept = [r for r in labels if r[0] is None or zlib.crc32(str(r[0]).encode()) % 5]
    lies = [(k, 0, 0) for k in range(375) if zlib.crc32(str(k).encode()) % 5 == 0]
    other, _ = quality.train(
        documents,
        spark.createDataFrame(kept + lies, frame.schema),
        in_training=held,
        staging=staging,
    )
    assert np.allclose(other.weights, model.weights) and other.prior == model.prior


def test_quality_of_odd_rows(spark, staging):
    rows = [(1, None), (2, ""), (2, ""), (None, "text"), (3, "x" * 200_000), (4, "\x00 | %")]
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model, kept = quality.train(documents, none, staging=staging)
    assert {r["score"] for r in quality.score_features(kept, model).collect()} == {0.5}
    some = spark.createDataFrame([(3, 1), (1, 0)], "doc_id long, quality int")
    model, kept = quality.train(documents, some, staging=staging)
    scores = [r["score"] for r in quality.score_features(kept, model).collect()]
    assert len(scores) == len(rows) and all(0 <= s <= 1 for s in scores)
    model, kept = quality.train(documents.limit(0), some, staging=staging)
    assert quality.score_features(kept, model).count() == 0


@pytest.mark.parametrize("text", ["", "Plain words here.", "A A A\nA A A\nB", "é%% 1|2\r\nÀ"])
def test_features_do_not_depend_on_neighbours(text):
    alone = quality.text_features(pa.array([text]))
    among = quality.text_features(pa.array(["x\ny", text, "", "| x"]))
    assert np.allclose(alone[0], among[1]) and alone.shape[1] == len(quality.FEATURES)


def test_risk_stays_non_negative(spark, staging):
    """With a prior that is far too high, unlabelled text must not be pushed without end."""
    texts = sentences(40)
    documents = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    _, rows = quality.train(documents, labels, staging=staging)
    model = quality.fit(rows, prior=0.999, ridge=1e-6)
    x = np.vstack([np.array(r["x"], float) for r in rows.collect()])
    g = quality.standardised(x, model.mean, model.scale) @ model.weights
    loss = np.logaddexp(0, g).mean()
    assert np.isfinite(g).all() and loss - 0.999 * loss >= -1e-9


# Language


def test_buckets_of_a_row_do_not_depend_on_neighbours():
    alone = language.gram_buckets(*text_buffer(pa.array(["Ab é"])))[1].tolist()
    rows, buckets = language.gram_buckets(*text_buffer(pa.array(["xyz", "Ab é", "", None, "q"])))
    assert buckets[rows == 1].tolist() == alone and len(alone) == len("Ab é".encode())


def test_languages_and_mixtures(spark):
    one, two = sentences(80, 1, "abcdefg"), sentences(80, 2, "nopqrst")
    rows = [(k, t, "xx", "a") for k, t in enumerate(one)]
    rows += [(100 + k, t, "yy", "a") for k, t in enumerate(two)]
    rows += [(300, "123 !!", "xx", "a"), (301, None, "xx", "a"), (302, "abc", None, "a")]
    documents = spark.createDataFrame(
        rows, "doc_id long, text string, lang string, lang_pred string"
    )
    model = language.train(documents)
    assert model.names == ["xx", "yy"]
    assert np.allclose(model.probability.sum(axis=0), 1, atol=1e-3)
    asked = spark.createDataFrame(
        [(1, one[0], "q"), (2, two[0], "q"), (3, one[1] + " " + two[1] * 3, "q"), (4, None, "q"),
         (5, "", "q"), (6, "12 | 3", "q"), (None, two[2], "q"), (2, two[0], "q"),
         (7, two[3] * 2000, "q")],
        "doc_id long, text string, score string",
    )
    found = rows_of(language.predict(asked, model), "doc_id", "lang_pred")
    assert found == sorted(
        [(1, "xx"), (2, "yy"), (3, "yy"), (4, "und"), (5, "und"), (6, "und"), (None, "yy"),
         (2, "yy"), (7, "yy")],
        key=repr,
    )
    scores = {r["doc_id"]: r["score"] for r in language.predict(asked, model).collect()}
    assert scores[1] > 0.9 and 0.5 < scores[3] < 0.95 and scores[4] == 0
    kept = language.identify(asked, model).select("kept.*")
    assert kept.columns == asked.columns and kept.count() == 9
    nothing = language.train(documents.limit(0))
    assert {r["lang_pred"] for r in language.predict(asked, nothing).collect()} == {"und"}
    assert language.predict(asked.limit(0), model).count() == 0


def test_proportions_are_estimated():
    random_ = np.random.default_rng(0)
    p = random_.dirichlet(np.full(1 << language.BUCKET_BITS, 0.05), 3).T.astype(np.float32)
    mixed = np.concatenate(
        [random_.choice(len(p), size=n, p=p[:, k] / p[:, k].sum()) for k, n in ((0, 700), (2, 300))]
    )
    keys, count = np.unique(mixed, return_counts=True)
    theta, _ = language._expectation_maximisation(
        np.maximum(p[keys], 1e-12), count.astype(np.float32), np.array([0]),
        np.zeros(len(keys), int), np.full((1, 3), 1 / 3, np.float32), 20,
    )
    assert np.allclose(theta[0], [0.7, 0, 0.3], atol=0.03)


def test_features_of_a_batch_take_little_memory():
    texts = pa.array([" ".join(junk(sentences(40, seed)))[:2000] for seed in range(60)] * 17)
    tracemalloc.start()
    quality.text_features(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 24 << 20
