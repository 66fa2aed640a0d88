import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from labelweave.llm import jaccard
from labelweave.llm.arrowtext import text_buffer
from labelweave.llm.components import connected_components
from labelweave.llm.jaccard import jaccard_components, prefixes, shingle_sets

from .helpers import groups, rows_of, shingle_set, similar_groups


def edited(rng, w, edits, vocabulary):
    w = list(w)
    for _ in range(edits):
        k = rng.randrange(len(w))
        w[k] = rng.choice(vocabulary)
    return w


def corpus(seed=5):
    """Texts with exact copies, chains of small edits, a shared passage and short ones."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    passage = [f"p{k}" for k in range(12)]
    texts = []
    for _ in range(40):
        texts.append([rng.choice(vocabulary) for _ in range(rng.randrange(1, 90))])
    base = [rng.choice(vocabulary) for _ in range(120)]
    for _ in range(60):  # a chain: each text differs a little from an earlier one
        base = edited(rng, base, rng.randrange(0, 4), vocabulary)
        texts.append(base)
    for _ in range(40):
        texts.append(passage + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 8))])
    texts += [texts[0]] * 15 + [texts[45]] * 10 + [["One"], ["one"], ["one", "two"], []]
    rng.shuffle(texts)
    return {k: " ".join(t) for k, t in enumerate(texts)}


@pytest.mark.parametrize("crowd", [3, 24])
def test_components_are_those_of_all_pairs(spark, staging, monkeypatch, crowd):
    monkeypatch.setattr(jaccard, "CROWD", crowd)
    texts = corpus()
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = rows_of(
        jaccard_components(documents, staging=staging), "doc_id", "n_shingles", "component_id"
    )
    wanted = [(i, n, c) for i, (n, c) in similar_groups(texts).items()]
    assert found == sorted(wanted, key=repr)


def test_a_lone_text_of_the_first_part_meets_those_of_others(spark, staging, monkeypatch):
    """Shingles are dealt out by the rows that hold them, of which all but two may be copies."""
    monkeypatch.setattr(jaccard, "_TOGETHER_BITS", 0)
    texts = {}
    for pair in range(30):
        w = [f"{pair}-{k}" for k in range(60)]
        for _ in range(4):
            texts[len(texts)] = " ".join(w)
        texts[len(texts)] = " ".join([*w, "end"])
    documents = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    found = rows_of(
        jaccard_components(documents, staging=staging), "doc_id", "n_shingles", "component_id"
    )
    wanted = [(i, n, c) for i, (n, c) in similar_groups(texts).items()]
    assert found == sorted(wanted, key=repr)


def test_odd_rows(spark, staging):
    rows = [
        (4, "a b c d e f", 1),
        (2, "A  b\tc\nd e\x0bf", 1),
        (None, "a b c d e f", 1),
        (7, None, 1),
        (8, "", 1),
        (9, " \n", 1),
        (5, "x y", 1),
        (5, "x y", 1),
        (6, "X y", 1),
        (3, "Été " * 30_000, 1),
    ]
    documents = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = rows_of(
        jaccard_components(documents, staging=staging), "doc_id", "n_shingles", "component_id"
    )
    wanted = [(4, 2, 2), (2, 2, 2), (None, 2, 2), (7, 0, 7), (8, 0, 8), (9, 0, 9), (5, 1, 5)]
    wanted += [(5, 1, 5), (6, 1, 6), (3, 1, 3)]
    assert found == sorted(wanted, key=repr)
    assert jaccard_components(documents.limit(0), staging=staging).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abAB \né", max_size=60), max_size=6))
def test_sets_name_equal_texts_alike(texts):
    import pyarrow as pa

    sets = shingle_sets(*text_buffer(pa.array(texts, pa.string())))
    assert sets.size.tolist() == [len(shingle_set(t)) for t in texts]
    names = sets.identity(0).tolist()
    for a, x in zip(texts, names, strict=True):
        for b, y in zip(texts, names, strict=True):
            assert (x == y) == (shingle_set(a) == shingle_set(b))


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.lists(st.integers(0, 120), min_size=1 << 4, max_size=1 << 4))
def test_linked_sets_share_their_matches_within_both_prefixes(seed, levels):
    """Whatever the frequencies say, no linked pair escapes the smaller number of matches."""
    rng = random.Random(seed)
    one = [rng.getrandbits(64) for _ in range(rng.randrange(1, 60))]
    two = one[:]
    for _ in range(rng.randrange(0, 8)):
        two[rng.randrange(len(two))] = rng.getrandbits(64)
    pair = [sorted(set(one)), sorted(set(two))]
    both = len(set(pair[0]) & set(pair[1]))
    if 100 * both < 75 * (len(pair[0]) + len(pair[1]) - both):
        return
    sizes = np.array([len(p) for p in pair])
    sets = jaccard.ShingleSets(
        np.repeat([0, 1], sizes), np.array(pair[0] + pair[1], np.uint64), sizes
    )
    table = np.resize(np.array(levels, np.uint8), 1 << jaccard.SKETCH_BITS)
    row, token, _, place, m = prefixes(sets, table, 0.0)
    asked = int(min(m))
    within = [
        {t for r, t, p in zip(row, token, place, strict=True)
         if r == k and p <= sizes[k] - jaccard.least_overlap(sizes[k]) + asked}
        for k in (0, 1)
    ]
    assert len(within[0] & within[1]) >= asked


@pytest.mark.parametrize("n", [0, 1, 300])
def test_connected_components(spark, staging, n):
    rng = random.Random(n)
    path = [(k, k + 1) for k in range(0, min(n, 60))]
    edges = path + [(rng.randrange(1000), rng.randrange(1000)) for _ in range(n)]
    frame = spark.createDataFrame(edges, "a long, b long")
    found = {r["id"]: r["component"] for r in connected_components(frame, staging).collect()}
    ids = {i for a, b in edges if a != b for i in (a, b)}
    assert found == groups(ids, [e for e in edges if e[0] != e[1]])
