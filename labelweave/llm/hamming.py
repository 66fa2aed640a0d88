"""Near-duplicate vectors through iterative quantisation and multi-index Hamming tables.

A rotation learned on a bounded sample turns unit vectors into balanced 64-bit codes: after a
principal-component projection, codes and rotation are fitted to each other in turns.  Codes are cut
into four substrings, each with a table of its own.  Two vectors are compared if some substring of
theirs differs in at most one bit; a vector lies in each table under its own substring and asks for
that one and the sixteen around it.  Every pair found is reranked by the exact cosine, in double
precision.  Equal vectors are compared once and counted as often as they occur.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from .components import connected_components
from .shipping import map_arrow

CODE_BITS = 64
TABLES = 4
_SUB_BITS = CODE_BITS // TABLES
#: Vectors of each length that the rotation is learned on.
SAMPLE = 10_000
#: Lengths of vectors for which rotations are learned; there is one in ordinary tables.
MOST_LENGTHS = 64


def learn_rotation(x: np.ndarray, rounds: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to ``CODE_BITS`` columns from unit vectors.

    Shorter vectors get several rotations, each learned from another start.
    """
    mean = x.mean(axis=0)
    centred = x - mean
    values, directions = np.linalg.eigh(centred.T @ centred)
    width = min(CODE_BITS, x.shape[1])
    projection = directions[:, np.argsort(-values, kind="stable")[:width]]
    v = centred @ projection
    random, columns = np.random.default_rng(seed), []
    while sum(c.shape[1] for c in columns) < CODE_BITS:
        rotation = np.linalg.qr(random.normal(size=(width, width)))[0]
        for _ in range(rounds):
            codes = np.where(v @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(v.T @ codes)
            rotation = left @ right
        columns.append(projection @ rotation)
    return mean, np.hstack(columns)[:, :CODE_BITS]


def unit_rows(flat: np.ndarray, length: int) -> np.ndarray:
    """Rows scaled to norm 1, in double precision and without overflow."""
    x = flat.reshape(-1, length).astype(float)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def encode(x: np.ndarray, mean: np.ndarray, projection: np.ndarray) -> np.ndarray:
    bits = ((x - mean) @ projection >= 0).astype(np.uint64)
    return (bits << np.arange(CODE_BITS, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def usable(embedding: Column) -> Column:
    """Whether a vector has a direction: not null, no null or non-finite part, not zero."""
    finite = F.forall(
        embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _add_codes(classes: DataFrame, models: dict[int, tuple]) -> DataFrame:
    shared = classes.sparkSession.sparkContext.broadcast(models)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            column = batch.column(1)
            lengths = np.diff(column.offsets.to_numpy())
            codes = np.zeros(batch.num_rows, np.uint64)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                flat = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
                codes[at] = encode(unit_rows(flat, length), *own[length])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(codes.view(np.int64))], ["x", "code"]
            )

    return map_arrow(classes.select("x", "embedding"), per_batch, "x long, code long")


def learn(classes: DataFrame, sample: int = SAMPLE) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """A rotation for every length of vectors, each from a bounded sample chosen by hash."""
    sizes = classes.select(F.size("embedding").alias("n")).distinct().limit(MOST_LENGTHS + 1)
    lengths = sorted(r["n"] for r in sizes.collect())
    if len(lengths) > MOST_LENGTHS:
        raise ValueError(f"vectors of more than {MOST_LENGTHS} lengths")
    models = {}
    for length in lengths:
        rows = (
            classes.filter(F.size("embedding") == length)
            .orderBy(F.xxhash64("x"), "x")
            .limit(sample)
            .select("embedding")
            .toArrow()["embedding"]
            .combine_chunks()
        )
        flat = rows.flatten().to_numpy(zero_copy_only=False)
        models[length] = learn_rotation(unit_rows(flat, length))
    return models


def _substring(code: Column, table: int) -> Column:
    mask = F.lit((1 << _SUB_BITS) - 1)
    return F.shiftrightunsigned(code, table * _SUB_BITS).bitwiseAND(mask)


def _near(difference: Column, table: int) -> Column:
    return F.bit_count(_substring(difference, table)) <= 1


def candidate_pairs(coded: DataFrame) -> DataFrame:
    """``a, b`` of classes of one label and length that agree closely in some substring.

    Each pair comes once, from the first table in which it agrees.
    """
    code = F.col("code")
    homes = F.explode(
        F.array(*[F.struct(F.lit(t).alias("t"), _substring(code, t).alias("s"))
                  for t in range(TABLES)])
    )
    around = [F.lit(0), *[F.lit(1 << k) for k in range(_SUB_BITS)]]
    probes = F.explode(
        F.array(
            *[
                F.struct(F.lit(t).alias("t"), _substring(code, t).bitwiseXOR(change).alias("s"))
                for t in range(TABLES)
                for change in around
            ]
        )
    )
    home = coded.select("label", "length", F.col("x").alias("a"), code.alias("code_a"),
                        homes.alias("h")).select("*", "h.t", "h.s").drop("h")
    probe = coded.select("label", "length", F.col("x").alias("b"), code.alias("code_b"),
                         probes.alias("h")).select("*", "h.t", "h.s").drop("h")
    difference = F.col("code_a").bitwiseXOR(F.col("code_b"))
    earlier = F.lit(False)
    for table in range(TABLES - 1):
        earlier = earlier | ((F.col("t") > table) & _near(difference, table))
    met = home.join(probe, ["label", "length", "t", "s"]).filter(F.col("a") < F.col("b"))
    return met.filter(~earlier).select("a", "b")


def rerank(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose exact cosine reaches ``least``, with it: ``a, b, cosine``."""
    at_a = classes.select(F.col("x").alias("a"), F.col("embedding").alias("v"))
    at_b = classes.select(F.col("x").alias("b"), F.col("embedding").alias("w"))
    met = pairs.join(at_a, "a").join(at_b, "b").select("a", "b", "v", "w")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            cosine = np.zeros(batch.num_rows)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                v, w = (
                    unit_rows(
                        batch.column(c).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False),
                        length,
                    )
                    for c in (2, 3)
                )
                cosine[at] = (v * w).sum(axis=1)
            keep = pa.array(np.flatnonzero(cosine >= least))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(keep),
                    batch.column(1).take(keep),
                    pa.array(cosine).take(keep),
                ],
                ["a", "b", "cosine"],
            )

    return map_arrow(met, per_batch, "a long, b long, cosine double")


def near_duplicates(
    vectors: DataFrame,
    least: float = 0.98,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    label_column: str = "label",
    sample: int = SAMPLE,
    staging: Staging | None = None,
) -> DataFrame:
    """``<id>, n_links, component_id, kept`` for every row.

    Only rows with the same label, not null, and the same number of parts are compared.  Null and
    zero vectors, and such with null or non-finite parts, link with nothing; neither do rows whose
    label is null.  Equal vectors of a label link with each other, repeated rows too.  A row with a
    null id counts as a link of others and is not kept.  An empty table gives no rows.  Other
    columns are not read.
    """
    staging = staging or Staging(vectors.sparkSession)
    # Adding 0 turns -0 into 0, so that equal vectors are equal byte by byte.
    rows = vectors.select(
        F.col(id_column).alias("id"),
        F.col(label_column).alias("label"),
        F.transform(vector_column, lambda v: v + F.lit(0.0).cast("float")).alias("embedding")
        if vectors.schema[vector_column].dataType.simpleString() == "array<float>"
        else F.transform(vector_column, lambda v: v.cast("double") + F.lit(0.0)).alias("embedding"),
    )
    for seed in range(16):
        name = F.when(
            usable(F.col("embedding")) & F.col("label").isNotNull(),
            F.xxhash64(F.lit(seed), "label", "embedding"),
        )
        members = rows.select("*", name.alias("x"))
        classes = staging.write(
            members.filter("x IS NOT NULL")
            .groupBy("label", "embedding", "x")
            .agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")),
            f"classes-{seed}",
        )
        # Two vectors of one name, which no table of ordinary size has, are named anew.
        if classes.groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
            break
    models = learn(classes, sample)
    codes = _add_codes(classes, models)
    coded = staging.write(
        classes.select("x", "label", F.size("embedding").alias("length")).join(codes, "x"), "codes"
    )
    links = staging.write(rerank(candidate_pairs(coded), classes, least), "links")
    copies = classes.select("x", "first", "copies")
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    linked = both.join(copies.select(F.col("x").alias("b"), "copies"), "b")
    counts = linked.groupBy(F.col("a").alias("x")).agg(F.sum("copies").alias("others"))
    parts = connected_components(links.select("a", "b"), staging)
    own = copies.join(counts, "x", "left").join(parts, F.col("x") == F.col("id"), "left").select(
        "x",
        "first",
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"),
        F.coalesce("component", "x").alias("component"),
    )
    least_ids = own.groupBy("component").agg(F.min("first").alias("component_id"))
    named = staging.write(own.join(least_ids, "component").drop("first", "component"), "named")
    found = members.select("id", "x").join(named, "x", "left")
    component = F.when(F.col("x").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return found.select(
        F.col("id").alias(id_column),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )
