import random

import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline

from .helpers import similar_groups, words
from .test_leaks import best_similarity
from .test_models import junk, sentences

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def fixture(seed=8):
    good, bad = sentences(120, 20), junk(sentences(30, 21))
    item = " ".join(sentences(1, 22)[0].split()[:30])
    rows = [(k, t) for k, t in enumerate(good + bad)]
    rows += [(200 + k, good[k]) for k in range(10)]
    near = [good[40].split() for _ in range(5)]
    for k, w in enumerate(near):
        w[-1] = f"end{k}"
        rows.append((220 + k, " ".join(w)))
    rows += [(240 + k, good[60 + k] + " " + item + " " + good[70 + k]) for k in range(4)]
    rows += [(250, None), (251, ""), (252, "123 456"), (3, good[3]), (3, good[3])]
    rng = random.Random(seed)
    rng.shuffle(rows)
    return [(i, t, "xx", "s", len(t or "")) for i, t in rows], item


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, item = fixture()
    root = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{root}/documents.parquet")
    labels = [(k, int(k < 120), 0) for k in range(150)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(
        f"{root}/labels.parquet"
    )
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(
        f"{root}/benchmark.parquet"
    )
    return str(root)


def test_stages_keep_what_a_plain_reading_keeps(spark, folder):
    rows, item = fixture()
    docs = spark.createDataFrame(rows, COLUMNS)
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == [
        "quality_classifier", "language_id", "jaccard_join", "decontamination", "packing"
    ]
    good = stage["quality_classifier"](spark, docs, folder)
    assert good.columns == docs.columns
    ids = {r["doc_id"] for r in good.collect()}
    assert len(ids & set(range(120, 150))) <= 1 and set(range(120)) <= ids
    told = stage["language_id"](spark, docs, folder)
    wanted = sorted((r for r in rows if any(c.isalpha() for c in r[1] or "")), key=repr)
    assert sorted(map(tuple, told.collect()), key=repr) == wanted
    one = stage["jaccard_join"](spark, docs, folder)
    texts = {i: t for i, t, *_ in rows}
    component = similar_groups(texts)
    wanted = sorted({r for r in rows if component[r[0]][1] == r[0]}, key=repr)
    assert sorted(map(tuple, one.collect()), key=repr) == wanted
    clean = stage["decontamination"](spark, docs, folder)
    wanted = sorted((r for r in rows if best_similarity(r[1], item) < 0.75), key=repr)
    assert sorted(map(tuple, clean.collect()), key=repr) == wanted
    assert len(wanted) == len(rows) - 4
    # A row without an id, and one that shares its id with a clean one.
    leaked = next(t for i, t, *_ in rows if i == 240)
    more = [(None, leaked, "xx", "s", 1), (0, leaked, "xx", "s", 1), (None, "", "xx", "s", 0)]
    some = [r for r in rows if r[0] in (0, 240, 250)]
    clean = stage["decontamination"](spark, spark.createDataFrame(some + more, COLUMNS), folder)
    wanted = [r for r in some + more if best_similarity(r[1], item) < 0.75]
    assert sorted(map(tuple, clean.collect()), key=repr) == sorted(wanted, key=repr)


def test_run_packs_what_is_left(spark, folder):
    rows, _ = fixture()
    found = corpus_pipeline.run(spark, folder)
    pieces = found.groupBy("doc_id").agg(
        F.sum("length").alias("n"), F.max("doc_tokens").alias("total")
    )
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {i: t for i, t, *_ in rows}
    left = {r["doc_id"]: (r["n"], r["total"]) for r in pieces.collect()}
    for i, (n, total) in left.items():
        assert n == total == len(library.encode(texts[i], add_special_tokens=False).ids) + 1
        assert words(texts[i]) and i < 200
    assert set(range(60)) - set(left) <= {40} or set(range(60)) <= set(left)
    assert not {240, 241, 242, 243, 250, 251, 252} & set(left)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_empty_and_repeated_rows(spark, folder, name, stage):
    docs = spark.createDataFrame(
        [(None, "some plain words here", None, None, None)] * 2 + [(1, None, "xx", "s", 0)] * 2,
        COLUMNS,
    )
    assert stage(spark, docs.limit(0), folder).count() == 0
    assert stage(spark, docs, folder).count() <= 4 or name == "packing"
