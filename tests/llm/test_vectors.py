import numpy as np
import pytest

from labelweave.llm.hamming import encode, learn_rotation, near_duplicates, unit_rows

from .helpers import groups, rows_of

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, least=0.98):
    good = {}
    for k, (_, v, label, _) in enumerate(rows):
        if v is None or label is None or any(p is None or not np.isfinite(p) for p in v):
            continue
        if any(v):
            x = np.array(v, np.float32).astype(float)
            good[k] = x / np.linalg.norm(x)
    links = [
        (a, b)
        for a in good
        for b in good
        if a != b
        and rows[a][2] == rows[b][2]
        and len(good[a]) == len(good[b])
        and good[a] @ good[b] >= least
    ]
    place = groups(range(len(rows)), links)
    out = []
    for k, row in enumerate(rows):
        ids = [rows[j][0] for j in place if place[j] == place[k] and rows[j][0] is not None]
        component = min(ids) if ids else None
        n = sum(a == k for a, _ in links)
        out.append((row[0], n, component, row[0] is not None and row[0] == component))
    return sorted(out, key=repr)


def test_links_and_components_are_those_of_all_pairs(spark, staging):
    random = np.random.default_rng(3)
    rows = []
    for centre in random.normal(size=(25, 64)):
        for _ in range(random.integers(1, 9)):
            v = centre + random.normal(size=64) * 0.09
            rows.append((len(rows), v.astype(np.float32).tolist(), int(random.integers(2)), ""))
    rows += [(500 + k, rows[7][1], rows[7][2], "") for k in range(12)]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = near_duplicates(frame, staging=staging)
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == brute(rows)


def test_odd_vectors(spark, staging):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 0, ""),
        (2, [2.0, -0.0], 0, ""),
        (3, [1.0, 0.0], None, ""),
        (4, None, 0, ""),
        (5, [0.0, 0.0], 0, ""),
        (6, [0.0, 0.0], 0, ""),
        (7, [nan, 1.0], 0, ""),
        (8, [inf, 1.0], 0, ""),
        (9, [None, 1.0], 0, ""),
        (10, [1.0], 0, ""),
        (11, [], 0, ""),
        (1, [1.0, 0.0], 0, ""),
        (None, [1.0, 0.0], 0, ""),
        (0, [1e30, 1e30], 1, ""),
        (12, [1e-30, 1e-30], 1, ""),
        (13, [-1.0, 0.0], 0, ""),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    found = near_duplicates(frame, staging=staging)
    assert rows_of(found, "vec_id", "n_links", "component_id", "kept") == brute(rows)
    assert near_duplicates(frame.limit(0), staging=staging).count() == 0


@pytest.mark.parametrize("length", [3, 64, 100])
def test_codes_are_balanced_and_close_for_close_vectors(length):
    random = np.random.default_rng(1)
    x = unit_rows(random.normal(size=2000 * length), length)
    mean, projection = learn_rotation(x)
    codes = encode(x, mean, projection)
    bits = (codes[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
    assert (np.abs(bits.mean(axis=0) - 0.5) < 0.2).all()
    near = x + random.normal(size=x.shape) * 0.02
    other = encode(unit_rows(near.ravel(), length), mean, projection)
    assert np.mean([bin(int(a ^ b)).count("1") for a, b in zip(codes, other, strict=True)]) < 14
