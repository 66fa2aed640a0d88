import random

import pytest

from labelweave.llm.decontaminate import RADIUS, contaminated, item_windows, window_size
from labelweave.llm.decontaminate import _class_of, document_windows, shingle_hashes
from pyspark.sql import functions as F

from .helpers import shingle_bag, words


def best_similarity(text, item):
    w, i = words(text), words(item)
    m = len(i) - 4
    if m < 1 or len(w) < 5:
        return 0.0
    bag = shingle_bag(i)
    found = 0.0
    for start in range(max(1, len(w) - 4)):
        own = shingle_bag(w, start, start + m)
        found = max(found, sum((bag & own).values()) / sum((bag | own).values()))
    return found


def make(seed=2):
    rng = random.Random(seed)
    vocabulary = [f"v{k}" for k in range(300)] + ["the", "of"] * 20
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: draw(n) for k, n in enumerate([5, 6, 7, 9, 12, 15, 24, 40, 59, 90, 200])}
    items[11] = ["same"] * 30
    texts = [draw(rng.randrange(0, 150)) for _ in range(30)]
    for w in items.values():
        for _ in range(3):
            host, at = draw(60), rng.randrange(60)
            passage = list(w)
            if len(w) > 40:  # one changed word
                passage[rng.randrange(len(w))] = "changed"
            texts.append(host[:at] + passage + host[at:])
        texts.append(list(w))
        texts.append(w[: len(w) // 2] + draw(20))
    texts.append(["Same"] * 29 + draw(10))
    return {k: " ".join(t) for k, t in enumerate(texts)}, {k: " ".join(w) for k, w in items.items()}


def test_leaks_are_those_of_a_full_search(spark, staging):
    texts, items = make()
    found = contaminated(
        spark.createDataFrame(list(texts.items()), "doc_id long, text string"),
        spark.createDataFrame(list(items.items()), "item_id long, text string"),
        staging=staging,
    )
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in found.collect()}
    wanted = {
        (d, i): s
        for d, t in texts.items()
        for i, item in items.items()
        if (s := best_similarity(t, item)) >= 0.75
    }
    assert got.keys() == wanted.keys()
    # A passage that begins before the text does is compared without what is missing.
    assert all(got[k] > wanted[k] - 1e-12 for k in wanted)
    assert sum(abs(got[k] - wanted[k]) < 1e-12 for k in wanted) > 0.9 * len(wanted)
    assert len(wanted) > 40


def test_odd_rows(spark, staging):
    item = "one two three four five six seven eight nine ten"
    documents = spark.createDataFrame(
        [(1, item, 0), (1, item, 0), (None, item, 0), (2, None, 0), (3, "", 0), (4, "one two", 0),
         (5, "x " * 20_000 + item.upper() + " y" * 20_000, 0)],
        "doc_id long, text string, item_id int",
    )
    benchmark = spark.createDataFrame(
        [(7, item, 1), (8, None, 1), (None, item, 1), (9, "one two", 1), (7, item, 1)],
        "item_id long, text string, doc_id int",
    )
    found = contaminated(documents, benchmark, staging=staging).collect()
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["start"]) for r in found) == [
        (1, 7, 1.0, 0),
        (5, 7, 1.0, 20_000),
    ]
    assert contaminated(documents.limit(0), benchmark, staging=staging).count() == 0
    assert contaminated(documents, benchmark.limit(0), staging=staging).count() == 0


@pytest.mark.parametrize("m", [1, 2, 3, 4, 6, 7, 11, 12, 34, 35, 52, 53, 70, 191, 500])
def test_window_sizes(spark, m):
    assert spark.range(1).select(_class_of(F.lit(m)).alias("c")).first()["c"] == window_size(m)


def test_fingerprints_are_majorities(spark):
    """Document and item windows of the same shingles agree with a plain count of bits."""
    text = " ".join(f"w{k % 17}" for k in range(70))
    frame = spark.createDataFrame([(1, text)], "item_id long, text string").select(
        "item_id", shingle_hashes(F.col("text")).alias("hashes")
    )
    hashes = [h & (2**64 - 1) for h in frame.first()["hashes"]]
    assert len(hashes) == 66
    for size in (1, 2, 4, 8, 16, 32):
        def majority(at):
            return sum(
                1 << b
                for b in range(64)
                if 2 * sum(h >> b & 1 for h in hashes[at : at + size]) > size
            )

        stride = max(1, size // 2)
        own = frame.select(document_windows(F.col("hashes"), [size]).alias("w")).first()["w"]
        assert [w["size"] for w in own] == [size]
        prints = [p & (2**64 - 1) for p in own[0]["prints"]]
        assert prints == [majority(k * stride) for k in range((66 - size) // stride + 1)][: len(prints)]
        assert len(prints) >= (66 - size) // stride
        rows = frame.select(F.col("item_id").alias("key"), F.lit(size).alias("size"), "hashes")
        items = item_windows(rows, [size]).collect()
        assert {r["offset"]: r["print"] & (2**64 - 1) for r in items} == {
            k: majority(k) for k in range(66 - size + 1)
        }
    assert RADIUS == 3
