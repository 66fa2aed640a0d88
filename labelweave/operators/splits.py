"""Seeded train/test splits.

A document's place in a split is the rank of ``md5(seed:split:doc_id)`` among the documents of its
class (stratified) or of the whole set (random); the lowest ranks are the training part.  Whoever
knows the hash of the last training rank of each group can tell every other document's side from
its own id alone.  So only ids and labels are ranked, and the documents themselves, with all their
text, learn their sides from a table of one row per class without being moved.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import SplitSettings
from ..session import ClassTableSize, broadcast_if_small
from .validate import class_counts, train_size

#: Documents one task ranks at a time.
RANK_ROWS = 50_000
_HASH_BITS = 48


def split_key(seed: int, split: Column, doc_id: Column) -> Column:
    """Hash whose order is the shuffled order of a split."""
    return F.md5(
        F.concat_ws(":", F.lit(str(seed)), split.cast("string"), doc_id.cast("string")).cast(
            "binary"
        )
    )


def _train_rows(n: Column, settings: SplitSettings, clamped: bool) -> Column:
    """Training documents among the ``n`` of a group."""
    k = train_size(n, min(max(settings.ratio, 0.0), 1.0))
    if clamped and settings.sampling == "stratified":
        k = F.greatest(F.lit(1).cast("bigint"), F.least(n - 1, k))
    return k


def _bucket(key: Column, buckets: int) -> Column:
    """Order-preserving bucket of a hash: its leading bits scaled to the number of buckets."""
    leading = F.conv(F.substring(key, 1, _HASH_BITS // 4), 16, 10).cast("bigint").cast("double")
    return F.floor(leading * float(buckets) / float(2**_HASH_BITS))


def split_cuts(
    documents: DataFrame,
    settings: SplitSettings,
    seed: int,
    clamped: bool = True,
    largest_group: int | None = None,
    rank_rows: int = RANK_ROWS,
    classes: ClassTableSize | None = None,
) -> DataFrame:
    """``label_id, cuts``: per group an array with the last training hash of every split.

    Groups are not ranked as a whole.  Their hashes, uniform whatever the data looks like, are
    counted in buckets of about ``rank_rows``; the counts tell the bucket the cut falls into, and
    only that bucket is ranked.  ``classes`` tells how many classes there are, which spares
    weighing the table of those buckets.
    """
    stratified = settings.sampling == "stratified"
    if largest_group is None:
        sizes = class_counts(documents) if stratified else documents.select(
            F.count(F.lit(1)).alias("n")
        )
        largest_group = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    label = F.col("label_id") if stratified else F.lit(None).cast("string")
    splits = F.sequence(F.lit(0), F.lit(settings.repetitions - 1))
    keyed = documents.select(
        label.alias("label_id"), "doc_id", F.explode(splits).alias("split_index")
    ).withColumn("key", split_key(seed, F.col("split_index"), F.col("doc_id")))
    group = ["split_index", "label_id"]
    whole = Window.partitionBy(*group)
    ranked = whole.orderBy("key", "doc_id")
    buckets = max(1, math.ceil(largest_group / rank_rows))
    keyed = keyed.withColumn("bucket", _bucket(F.col("key"), buckets))
    counts = keyed.groupBy(*group, "bucket").agg(F.count(F.lit(1)).alias("held"))
    # At most one row per bucket of a group.
    through = F.sum("held").over(whole.orderBy("bucket"))
    k = _train_rows(F.sum("held").over(whole), settings, clamped)
    cut = (
        counts.withColumn("through", through)
        .withColumn("k", k)
        .withColumn("before", F.col("through") - F.col("held"))
        .filter((F.col("before") < F.col("k")) & (F.col("k") <= F.col("through")))
        .select(*group, "bucket", (F.col("k") - F.col("before")).alias("wanted"))
    )
    same_bucket = [
        F.col("a.split_index") == F.col("b.split_index"),
        F.col("a.label_id").eqNullSafe(F.col("b.label_id")),
        F.col("a.bucket") == F.col("b.bucket"),
    ]
    small = (
        classes.hint(cut, 4 * settings.repetitions)
        if classes
        else broadcast_if_small(cut, "label_id")
    )
    near = (
        keyed.alias("a")
        .join(small.alias("b"), same_bucket)
        .select("a.split_index", "a.label_id", "a.doc_id", "a.key", "b.wanted")
    )
    last = near.withColumn("rank", F.row_number().over(ranked)).filter("rank = wanted")
    # One element per split.  A group without training documents has no cut there; no hash is
    # below the empty text.
    found = last.groupBy("label_id").agg(
        F.map_from_entries(F.collect_list(F.struct("split_index", "key"))).alias("found")
    )
    cuts = F.transform(
        splits, lambda s: F.coalesce(F.try_element_at(F.col("found"), s), F.lit(""))
    )
    return found.select("label_id", cuts.alias("cuts"))


def assign_sides(
    documents: DataFrame,
    cuts: DataFrame,
    settings: SplitSettings,
    seed: int,
    classes: ClassTableSize | None = None,
) -> DataFrame:
    """Add ``in_train``: an array that tells for every split whether the document trains.

    The cuts travel to the documents; ``classes`` tells how many there are without counting them
    again.  A class without any training document has no cuts.
    """
    none = F.array_repeat(F.lit(""), settings.repetitions)
    if settings.sampling == "stratified":
        small = (
            classes.hint(cuts, 6 * settings.repetitions)
            if classes
            else broadcast_if_small(cuts, "label_id")
        )
        matched = documents.join(small, "label_id", "left").withColumn(
            "cuts", F.coalesce("cuts", none)
        )
    else:
        # A sole group: its cuts, one per split, become constants.
        rows = cuts.select("cuts").collect()
        keys = F.array(*[F.lit(key) for key in rows[0]["cuts"]]) if rows else none
        matched = documents.withColumn("cuts", keys)
    sides = F.transform(
        "cuts", lambda cut, split: split_key(seed, split, F.col("doc_id")) <= cut
    )
    return matched.select(*documents.columns, sides.alias("in_train"))


def assignment(sided: DataFrame) -> DataFrame:
    """``split_index, doc_id, [label_id], is_train`` of documents with sides."""
    keep = [name for name in ("doc_id", "label_id") if name in sided.columns]
    return sided.select(F.posexplode("in_train").alias("split_index", "is_train"), *keep).select(
        "split_index", *keep, "is_train"
    )


def stratified_split(documents: DataFrame, settings: SplitSettings, seed: int) -> DataFrame:
    """Assignment in which every class is split on its own, with at least one on either side."""
    settings.check_trainable()
    ids = documents.select("doc_id", "label_id")
    cuts = split_cuts(ids, settings, seed)
    return assignment(assign_sides(ids, cuts, settings, seed))


def random_split(documents: DataFrame, settings: SplitSettings, seed: int) -> DataFrame:
    """Assignment that ignores classes, clamps the ratio to [0, 1] and allows empty sides."""
    settings.check_partitionable()
    settings = SplitSettings(settings.ratio, settings.repetitions, "random")
    ids = documents.select(*[c for c in ("doc_id", "label_id") if c in documents.columns])
    cuts = split_cuts(ids, settings, seed, clamped=False)
    return assignment(assign_sides(ids, cuts, settings, seed))


def split_sizes(assigned: DataFrame) -> DataFrame:
    """``split_index, train_samples, test_samples``."""
    return assigned.groupBy("split_index").agg(
        F.count_if("is_train").alias("train_samples"),
        F.count_if(~F.col("is_train")).alias("test_samples"),
    )
