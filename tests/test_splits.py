import hashlib
import math

import numpy as np
import pytest

from labelweave.config import InvalidInput, SplitSettings
from labelweave.operators import splits as ops
from labelweave.operators.validate import (
    check_document_ids,
    check_label_ids,
    check_page_counts,
    check_training_documents,
    oversized_documents,
)


def plain(spark, sizes):
    rows, i = [], 0
    for label, n in sizes.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    return spark.createDataFrame(rows, "doc_id long, label_id string")


def sides(assigned):
    got = {}
    for r in assigned.collect():
        got.setdefault(r["split_index"], {})[r["doc_id"]] = r["is_train"]
    return got


@pytest.mark.parametrize(
    "n, ratio, train",
    [
        (10, 0.7, 7),
        (5, 0.8, 4),
        (3, 0.5, 1),
        (2, 0.0, 0),
        (2, -1.0, 0),
        (2, 1.0, 2),
        (2, 3.5, 2),
        (0, 0.1, 0),
        (1, 0.1, 0),
        (2, 0.1, 0),
    ],
)
def test_random_sizes(spark, n, ratio, train):
    assigned = ops.random_split(plain(spark, {"a": n}), SplitSettings(ratio, 5), 1)
    got = sides(assigned)
    assert len(got) == (5 if n else 0)
    for split in got.values():
        assert len(split) == n and sum(split.values()) == train


@pytest.mark.parametrize("ratio", [math.nan, math.inf, -math.inf])
def test_random_needs_a_finite_ratio(spark, ratio):
    with pytest.raises(InvalidInput):
        ops.random_split(plain(spark, {"a": 3}), SplitSettings(ratio), 1)


def test_random_needs_a_repetition(spark):
    with pytest.raises(InvalidInput):
        ops.random_split(plain(spark, {"a": 3}), SplitSettings(0.5, 0), 1)


@pytest.mark.parametrize("sampling", ["stratified", "random"])
def test_seeded_splits_partition_the_input_and_repeat(spark, sampling):
    documents = plain(spark, {"a": 5, "b": 5})
    split = ops.stratified_split if sampling == "stratified" else ops.random_split
    first = sides(split(documents, SplitSettings(0.8, 4), 123))
    assert first == sides(split(documents.repartition(3), SplitSettings(0.8, 4), 123))
    assert first != sides(split(documents, SplitSettings(0.8, 4), 124))
    for one in first.values():
        assert set(one) == set(range(10)) and sum(one.values()) == 8
        if sampling == "stratified":
            assert sum(one[i] for i in range(5)) == 4


@pytest.mark.parametrize("ratio", [0.001, 0.999])
def test_every_class_stays_on_both_sides(spark, ratio):
    got = sides(ops.stratified_split(plain(spark, {"a": 2, "b": 7}), SplitSettings(ratio, 2), 1))
    for one in got.values():
        assert 0 < sum(one[i] for i in range(2)) < 2
        assert 0 < sum(one[i] for i in range(2, 9)) < 7


def by_hand(sizes, ratio, reps, seed, stratified):
    """The definition, ranked in one list per group."""
    expected, start = {}, 0
    groups = []
    for label, n in sizes.items():
        groups.append(list(range(start, start + n)))
        start += n
    if not stratified:
        groups = [list(range(start))]
    for s in range(reps):
        expected[s] = {}
        for group in groups:
            n = len(group)
            k = int(np.float32(n) * np.float32(ratio))
            if stratified:
                k = min(max(k, 1), n - 1)
            ranked = sorted(
                group, key=lambda i: (hashlib.md5(f"{seed}:{s}:{i}".encode()).hexdigest(), i)
            )
            expected[s].update({i: rank < k for rank, i in enumerate(ranked)})
    return expected


@pytest.mark.parametrize("stratified", [True, False])
@pytest.mark.parametrize("rank_rows", [7, 40, 10_000])
def test_large_groups_are_cut_where_a_full_ranking_would(spark, staging, stratified, rank_rows):
    """One class holds most rows; it is ranked bucket by bucket and must come out the same."""
    sizes = {"big": 400, "mid": 50, "low": 2}
    documents = plain(spark, sizes)
    settings = SplitSettings(0.7, 3, "stratified" if stratified else "random")
    cuts = staging.write(ops.split_cuts(documents, settings, 9, rank_rows=rank_rows), "cuts")
    got = sides(ops.assignment(ops.assign_sides(documents, cuts, settings, 9)))
    assert got == by_hand(sizes, 0.7, 3, 9, stratified)


def test_32_bit_arithmetic():
    assert int(np.float32(10) * np.float32(0.7)) == 7
    assert SplitSettings(0.7).ratio == float(np.float32(0.7))


@pytest.mark.parametrize("ratio", [0.0, 1.0, math.nan, -0.1, 1.1])
def test_training_needs_a_ratio_inside(spark, ratio):
    with pytest.raises(InvalidInput):
        check_training_documents(plain(spark, {"a": 3}), SplitSettings(ratio))


def test_training_documents_are_checked(spark):
    settings = SplitSettings()
    with pytest.raises(InvalidInput):
        check_training_documents(plain(spark, {"a": 3}), SplitSettings(repetitions=0))
    with pytest.raises(InvalidInput, match="no documents"):
        check_training_documents(plain(spark, {}), settings)
    with pytest.raises(InvalidInput, match="single document"):
        check_training_documents(plain(spark, {"a": 3, "b": 1}), settings)
    with pytest.raises(InvalidInput, match="single document"):
        check_training_documents(plain(spark, {"a": 3, "b": 1}), SplitSettings(0.8, 1, "random"))
    with pytest.raises(InvalidInput, match="part empty"):
        check_training_documents(plain(spark, {"a": 4}), SplitSettings(0.1, 1, "random"))
    with pytest.raises(InvalidInput, match="label"):
        check_training_documents(
            spark.createDataFrame([(1, None), (2, None)], "doc_id long, label_id string"), settings
        )
    assert check_training_documents(plain(spark, {"a": 4}), settings)["documents"] == 4


def test_other_checks(spark, make_documents):
    documents = make_documents([["a"], ["b"] * 4], ["x", "y"])
    check_page_counts(documents)
    assert [r["doc_id"] for r in oversized_documents(documents, 3).collect()] == [1]
    with pytest.raises(InvalidInput):
        check_page_counts(documents, 3)
    labels = spark.createDataFrame([("x",), ("z",)], "label_id string")
    with pytest.raises(InvalidInput):
        check_label_ids(documents, labels)
    check_label_ids(documents.filter("label_id = 'x'"), labels)
    check_document_ids(documents)
    with pytest.raises(InvalidInput):
        check_document_ids(documents.union(documents))
