"""User models that are learned from parts: all splits in one job, no split in one task.

A learner turns a part of the training rows into a state, merges two states into one, and finishes a
state into a model.  Every task folds its rows into one state a split; states meet ``FAN_IN`` at a
time, level by level, until one of each split is left.  The same job then finishes the models and
applies them, part by part.  States and models are read in chunks, one after the other.  States and models travel as rows, never through the driver.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from typing import Any, Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..config import InvalidInput
from ..operators.centroid import NO_TRAINING_DATA
from ..operators.term_join import join_terms
from ..operators.tfidf import Features, check_same_space
from ..session import BROADCAST_BYTES, Staging, bound_batches, ship

#: States merged by one task.
FAN_IN = 16
#: Weights of documents, and rows without any, that are worth a part of their own.
PART_WEIGHTS = 1 << 20
#: Weights and rows that are learned from or predicted at once.
SLICE_WEIGHTS = 1 << 18
#: Bytes of a batch, beside which executors keep buffers of several times its size.
BATCH_BYTES = 4 << 20
#: Bytes of a state or model in one row.
CHUNK_BYTES = 1 << 20
#: Weights of the documents whose frequent and rare words meet in one task.
BUCKET_WEIGHTS = 1 << 22
#: Weights a task holds before it deals their documents to buckets.
BUNDLE_WEIGHTS = 1 << 20


@dataclass(frozen=True)
class Rows:
    """Sparse rows of one split: row ``r`` has ``weights[starts[r]:starts[r + 1]]`` in ``columns``.

    Columns ascend within a row and no weight is zero.  ``labels`` has a label id per row, and is
    None where rows are to be predicted.
    """

    starts: np.ndarray
    columns: np.ndarray
    weights: np.ndarray
    labels: np.ndarray | None

    def __len__(self) -> int:
        return len(self.starts) - 1


class Learner(Protocol):
    """What a user's model has to offer.  States and models may be anything that can be pickled.

    ``merge`` must not depend on which states it gets in which order.  A state has to fit a task,
    which holds two while states are merged, and while it learns one for each doubling of its slices.
    """

    def partial(self, rows: Rows) -> Any:
        """The state of some training rows."""

    def merge(self, left: Any, right: Any) -> Any:
        """The state of both."""

    def finish(self, state: Any) -> Any:
        """The model learned from a state of all training rows of a split."""

    def labels(self, model: Any) -> Sequence[str]:
        """The label ids a model may predict."""

    def predict(self, model: Any, rows: Rows) -> Sequence[str]:
        """A label id for every row."""


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


@dataclass(frozen=True)
class _Documents:
    """Documents of a batch: their keys, and the columns and weights of all splits of each in turn."""

    keys: pa.RecordBatch
    sizes: np.ndarray
    columns: np.ndarray
    #: a row for every entry, a column for every split; not a number where a split has no weight
    weights: np.ndarray

    def rows(self, split: int, taken: np.ndarray, labels) -> Rows:
        """The chosen documents as rows of a split, without weights of zero."""
        weights = np.nan_to_num(self.weights[:, split], nan=0.0)
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        kept = (weights != 0) & taken[row]
        place = np.cumsum(taken) - 1
        counts = np.bincount(place[row[kept]], minlength=int(taken.sum()))
        return Rows(np.concatenate(([0], np.cumsum(counts))), self.columns[kept], weights[kept], labels)

    def packed(self) -> bytes:
        """As one value.  In order of columns, where weights repeat, the entries take few bytes."""
        row = np.repeat(np.arange(len(self.sizes)), self.sizes)
        order = np.argsort(self.columns, kind="stable")
        steps = np.diff(self.columns[order], prepend=0)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, self.keys.schema) as to:
            to.write(self.keys)
        # Rows of 16 bits are sorted quickly; weights are kept split by split.
        row = row[order].astype(np.uint16 if len(self.sizes) < 1 << 16 else np.int64)
        steps = steps.astype(np.min_scalar_type(int(steps.max(initial=0))))
        weights = np.ascontiguousarray(self.weights[order].T)
        return _compressed(pickle.dumps((sink.getvalue().to_pybytes(), row, steps, weights), protocol=5))

    @classmethod
    def unpacked(cls, raw: bytes) -> _Documents:
        keys, row, steps, weights = pickle.loads(_decompressed(raw))
        keys = pa.ipc.open_stream(keys).read_next_batch()
        order = np.argsort(row, kind="stable")
        columns = np.cumsum(steps, dtype=np.int64)[order]
        return cls(keys, np.bincount(row, minlength=keys.num_rows), columns, weights.T[order])

    @classmethod
    def sorted(cls, keys: pa.RecordBatch, row, columns, weights) -> _Documents:
        """From entries in any order."""
        order = np.lexsort((columns, row))
        return cls(keys, np.bincount(row, minlength=keys.num_rows), columns[order], weights[order])

    @classmethod
    def joined(cls, some: list[_Documents]) -> _Documents:
        if len(some) == 1:
            return some[0]
        keys = pa.Table.from_batches([d.keys for d in some]).combine_chunks().to_batches()[0]
        parts = ([getattr(d, name) for d in some] for name in ("sizes", "columns", "weights"))
        return cls(keys, *(np.concatenate(part) for part in parts))

    @classmethod
    def of_entries(cls, batch: pa.RecordBatch, keys: list[str]) -> _Documents:
        entries = batch.column("entries")
        sizes = np.diff(entries.offsets.to_numpy())
        flat = entries.flatten()
        weights = _numbers(flat.field("weights").flatten()).astype(np.float64)
        weights = weights.reshape(len(flat), -1) if len(flat) else np.zeros((0, 1 << 10))
        return cls.sorted(batch.select(keys), np.repeat(np.arange(len(sizes)), sizes),
                          _numbers(flat.field("column")).astype(np.int64), weights)


def _compressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _decompressed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


@dataclass(frozen=True)
class PackedDocuments:
    """``n, data``: some hundred thousand entries of documents in a row, and how many those are."""

    table: DataFrame
    #: the keys a document has
    keys: T.StructType

    @classmethod
    def of(cls, entries: DataFrame, keys: list[str]) -> PackedDocuments:
        """Documents with a column ``entries``."""
        ship(entries.sparkSession)
        bound_batches(entries.sparkSession, BATCH_BYTES)
        rows = entries.select(*keys, "entries")
        return cls(rows.mapInArrow(_packing(keys), _PACKED), T.StructType([rows.schema[k] for k in keys]))

    def staged(self, staging: Staging, name: str) -> PackedDocuments:
        return PackedDocuments(staging.write(self.table, name), self.keys)


_PACKED = "n long, data binary"


def _packed_row(documents: _Documents) -> pa.RecordBatch:
    n = len(documents.columns) + len(documents.sizes)
    return pa.RecordBatch.from_arrays(
        [pa.array([n], pa.int64()), pa.array([documents.packed()], pa.binary())], ["n", "data"]
    )


def _packing(keys: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _slices(whole)):
            yield _packed_row(_Documents.of_entries(batch, keys))

    return pack


def entry_rows(joined: DataFrame, keys: list[str], weights: list[Column]) -> DataFrame:
    """``<keys>, entries``: one row per document, its weights of all splits side by side by column.

    Rows whose ``term_index`` is null stand for documents without any weight.
    """
    entry = F.struct(F.col("term_index").alias("column"), F.array(*weights).alias("weights"))
    entry = F.when(F.col("term_index").isNotNull(), entry)
    return joined.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("entries"))


def _side_by_side(batch: pa.RecordBatch | pa.Table, width: int) -> np.ndarray:
    """The columns ``w_0 ..``, not a number where they are null."""
    return np.stack([_numbers(batch.column(f"w_{i}").fill_null(np.nan)) for i in range(width)], axis=1)


def _gathered(batches: Iterator[pa.RecordBatch], keys: list[str], width: int, most: int) -> Iterator[_Documents]:
    """Documents from rows ``<keys>, term_index, w_i``, each of whose last row has its keys; of some
    ``most`` rows at once."""

    def documents(table: pa.Table) -> _Documents:
        last = _numbers(table.column(keys[0]).is_valid())
        kept = _numbers(table.column("term_index").is_valid())
        row = (np.cumsum(last) - last)[kept]
        entries = table.filter(pa.array(kept))
        columns = _numbers(entries.column("term_index")).astype(np.int64)
        of = table.select(keys).filter(pa.array(last)).combine_chunks().to_batches()[0]
        return _Documents.sorted(of, row, columns, _side_by_side(entries, width))

    held, rows, ready = [], 0, 0
    for batch in batches:
        ends = np.flatnonzero(_numbers(batch.column(keys[0]).is_valid()))
        held.append(batch)
        rows += batch.num_rows
        if len(ends):
            ready = rows - batch.num_rows + int(ends[-1]) + 1
        if ready >= most:
            whole = pa.Table.from_batches(held)
            yield documents(whole.slice(0, ready))
            held, rows, ready = whole.slice(ready).to_batches(), rows - ready, 0
    if held and ready:
        yield documents(pa.Table.from_batches(held).slice(0, ready))


def _gathering(keys: list[str], width: int):
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from map(_packed_row, _gathered(batches, keys, width, SLICE_WEIGHTS))

    return gather


def _bundling(keys: list[str], width: int):
    """Documents of a task, those of a bucket packed together."""

    def bundle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in _gathered(batches, [*keys, "bucket"], width, BUNDLE_WEIGHTS):
            of = _numbers(some.keys.column("bucket"))
            buckets, place = np.unique(of, return_inverse=True)
            entry = np.repeat(place, some.sizes)
            by_bucket, by_entry = np.argsort(place, kind="stable"), np.argsort(entry, kind="stable")
            ends, entry_ends = (np.cumsum(np.bincount(x, minlength=len(buckets))) for x in (place, entry))
            rows = []
            for n in range(len(buckets)):
                mine = by_bucket[ends[n - 1] if n else 0 : ends[n]]
                its = by_entry[entry_ends[n - 1] if n else 0 : entry_ends[n]]
                own = some.keys.select(keys).take(pa.array(mine))
                rows.append(_Documents(own, some.sizes[mine], some.columns[its], some.weights[its]).packed())
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int32()), pa.array(rows, pa.binary())], ["bucket", "documents"]
            )

    return bundle


def _completing(width: int):
    """Documents with the entries of their rare words, given as rows ``doc_id, term_index, w_i``."""

    def complete(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles, rare = [], []
        for batch in batches:
            bundled = batch.column("documents").is_valid()
            bundles += batch.column("documents").filter(bundled).to_pylist()
            single = pc.invert(bundled)
            rare.append(batch.filter(single).select(["doc_id", "term_index", *[f"w_{i}" for i in range(width)]]))
        if not bundles:
            return
        # Where the document of a rare word is among those of all bundles.
        ids = pa.chunked_array([_Documents.unpacked(raw).keys.column("doc_id") for raw in bundles])
        words = pa.Table.from_batches(rare).combine_chunks()
        at = _numbers(pc.index_in(words.column("doc_id"), ids).combine_chunks()).astype(np.int64)
        order = np.argsort(at, kind="stable")
        at, columns = at[order], _numbers(words.column("term_index"))[order].astype(np.int64)
        weights = _side_by_side(words, width)[order]
        first, held, n = 0, [], 0
        for raw in bundles:
            some = _Documents.unpacked(raw)
            its = slice(*np.searchsorted(at, [first, first + len(some.sizes)]).tolist())
            row = np.repeat(np.arange(len(some.sizes)), some.sizes)
            held.append(_Documents.sorted(
                some.keys,
                np.concatenate((row, at[its] - first)),
                np.concatenate((some.columns, columns[its])),
                np.concatenate((some.weights, weights[its])),
            ))
            first, n = first + len(some.sizes), n + len(held[-1].columns)
            if n >= SLICE_WEIGHTS:
                yield _packed_row(_Documents.joined(held))
                held, n = [], 0
        if held:
            yield _packed_row(_Documents.joined(held))

    return complete


def gathered_documents(
    frequent: DataFrame, rare: DataFrame | None, keys: list[str], width: int, weights: int
) -> PackedDocuments:
    """Documents of rows that hold one weight of every split, without a shuffle of single weights.

    ``frequent`` holds ``<keys>, term_index, w_0 ..`` with the rows of a document one after the other,
    of which only the last has the keys and every document has one; ``doc_id`` is unique.  ``rare`` holds
    ``doc_id, term_index, w_0 ..`` of the words that are not in there, in any order.  Then documents
    are packed and dealt to buckets by their id, some ``BUCKET_WEIGHTS`` of so many weights to each.
    """
    spark = frequent.sparkSession
    ship(spark)
    bound_batches(spark, BATCH_BYTES)
    kept = T.StructType([frequent.schema[k] for k in keys])
    own = [f"w_{i}" for i in range(width)]
    if rare is None:
        found = frequent.select(*keys, "term_index", *own).mapInArrow(_gathering(keys, width), _PACKED)
        return PackedDocuments(found, kept)
    buckets = weights // BUCKET_WEIGHTS + 1
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    marked = F.when(F.col("doc_id").isNotNull(), bucket).alias("bucket")
    bundles = frequent.select(*keys, marked, "term_index", *own).mapInArrow(
        _bundling(keys, width), "bucket int, documents binary"
    )
    none = [F.lit(None).cast(kept["doc_id"].dataType).alias("doc_id"), F.lit(None).cast("bigint").alias("term_index")]
    bundles = bundles.select("*", *none, *[F.lit(None).cast("double").alias(w) for w in own])
    single = rare.select(
        bucket.alias("bucket"), F.lit(None).cast("binary").alias("documents"), "doc_id", "term_index", *own
    )
    dealt = bundles.unionByName(single).repartition(buckets, "bucket")
    return PackedDocuments(dealt.mapInArrow(_completing(width), _PACKED), kept)


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch of entries in runs of rows with some ``SLICE_WEIGHTS`` weights."""
    ends = np.cumsum(np.diff(batch.column("entries").offsets.to_numpy()) + 1)
    cuts = np.flatnonzero(np.diff(ends // SLICE_WEIGHTS)) + 1
    bounds = [0, *cuts.tolist(), batch.num_rows]
    for first, last in zip(bounds, bounds[1:], strict=False):
        if last > first:
            yield batch.slice(first, last - first)


def _folding(learner: Learner, splits: int):
    """One state a split of all rows of a task."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # States of 1, 2, 4 .. slices: a state meets others of its size, not every slice the whole.
        held: dict[int, list[tuple[int, Any]]] = {}
        for raw in (raw for batch in batches for raw in batch.column("data")):
            some = _Documents.unpacked(raw.as_py())
            sides = _numbers(some.keys.column("sides"))
            labels = np.array(some.keys.column("label_id").to_pylist(), dtype=object)
            for split in range(splits):
                taken = (sides >> split & 1).astype(bool)
                if not taken.any():
                    continue
                own = held.setdefault(split, [])
                own.append((1, learner.partial(some.rows(split, taken, labels[taken]))))
                while len(own) > 1 and own[-2][0] == own[-1][0]:
                    (size, left), (_, right) = own[-2:]
                    own[-2:] = [(2 * size, learner.merge(left, right))]
        for split in sorted(held):
            own = held.pop(split)
            _, state = own.pop()
            while own:
                state = learner.merge(own.pop()[1], state)
            yield from _chunks(split, state)

    return fold


def _chunks(split: int, value: Any) -> Iterator[pa.RecordBatch]:
    """Rows ``split, at, state`` of at most ``CHUNK_BYTES`` that hold a state in order of ``at``."""
    yield from _cut(split, cloudpickle.dumps(value))


def _cut(split: int, raw: bytes) -> Iterator[pa.RecordBatch]:
    for at, first in enumerate(range(0, len(raw), CHUNK_BYTES)):
        columns = [pa.array([split], pa.int32()), pa.array([at], pa.int32()),
                   pa.array([raw[first : first + CHUNK_BYTES]], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["split", "at", "state"])


def _model_row(split: int, value: Any) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([split], pa.int32()), pa.array([cloudpickle.dumps(value)], pa.large_binary()).cast(pa.binary())],
        ["split", "model"],
    )


def _merging(learner: Learner, last: bool):
    """Merge the states of a task's groups one after the other, given in chunks in order."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, bytes]]:
        key, part, held = None, None, []
        for batch in batches:
            splits, groups, parts = (batch.column(c).to_pylist() for c in ("split", "group", "part"))
            for i, here in enumerate(zip(splits, groups, strict=True)):
                if held and (here, parts[i]) != (key, part):
                    yield key, part, b"".join(held)
                    held = []
                key, part = here, parts[i]
                held.append(batch.column("state")[i].as_py())
        if held:
            yield key, part, b"".join(held)

    def made(key: tuple[int, int], state: Any) -> Iterator[pa.RecordBatch]:
        if last:
            yield _model_row(key[0], learner.finish(state))
            return
        for batch in _chunks(key[0], state):
            yield batch.append_column("part", pa.array([key[1]] * batch.num_rows, pa.int64()))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, state = None, None
        for key, _, raw in whole(batches):
            other = cloudpickle.loads(raw)
            if key == met:
                state = learner.merge(state, other)
                continue
            if met is not None:
                yield from made(met, state)
            met, state = key, other
        if met is not None:
            yield from made(met, state)

    return merge


def learned(
    entries: DataFrame | PackedDocuments, learner: Learner, splits: int, staging: Staging, name: str
) -> DataFrame:
    """``split, model``: what a learner makes of the training rows of every split.

    ``entries`` holds ``label_id, sides, entries``, or documents packed with these keys; bit i of
    ``sides`` tells the training rows of split i.
    """
    if isinstance(entries, DataFrame):
        entries = PackedDocuments.of(entries, ["label_id", "sides"])
    ship(entries.table.sparkSession)
    bound_batches(entries.table.sparkSession, BATCH_BYTES)
    states = entries.table.select("data").mapInArrow(
        _folding(learner, splits), "split int, at int, state binary"
    )
    states = states.withColumn("part", F.spark_partition_id().cast("long"))
    states = staging.write(states, f"{name}-0")
    found = states.agg(F.countDistinct("split"), F.max("part")).first()
    if found[0] != splits:
        raise InvalidInput(NO_TRAINING_DATA)
    parts, level = found[1] + 1, 0
    while True:
        level += 1
        parts = -(-parts // FAN_IN)
        last = parts == 1
        grouped = states.withColumn("group", F.expr(f"part div {FAN_IN}"))
        # A task reads its states one by one, in chunks: it never has all of a group at once.
        grouped = grouped.repartition("split", "group").sortWithinPartitions("split", "part", "at")
        kept = "split int, model binary" if last else "split int, at int, state binary, part long"
        states = staging.write(grouped.mapInArrow(_merging(learner, last), kept), f"{name}-{level}")
        staging.remove(f"{name}-{level - 1}")
        if last:
            return states


def _chunking(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``split, at, data``: models in compressed chunks."""
    for batch in batches:
        for split, raw in zip(batch.column("split"), batch.column("model"), strict=True):
            for chunk in _cut(split.as_py(), raw.as_py()):
                data = pa.array([_compressed(chunk.column("state")[0].as_py())], pa.binary())
                yield pa.RecordBatch.from_arrays([chunk.column("split"), chunk.column("at"), data], ["split", "at", "data"])


def _applying(learner: Learner, splits: list[int], keys: list[str], schema: pa.Schema):
    """Predictions of a task's documents by one model after the other.

    Documents and models come in any order and wait, packed, in a temporary file.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryFile() as waiting:
            documents, chunks = [], {}
            for batch in batches:
                numbers = zip(batch.column("split").to_pylist(), batch.column("at").to_pylist(), strict=True)
                for row, key in enumerate(numbers):
                    if key in chunks:
                        continue
                    raw = batch.column("data")[row].as_py()
                    place = waiting.tell(), len(raw)
                    waiting.write(raw)
                    if key[0] is None:
                        documents.append(place)
                    else:
                        chunks[key] = place

            def read(place: tuple[int, int]) -> bytes:
                waiting.seek(place[0])
                return waiting.read(place[1])

            for split in splits if documents else []:
                own = sorted(key for key in chunks if key[0] == split)
                model = cloudpickle.loads(b"".join(_decompressed(read(chunks[key])) for key in own))
                for place in documents:
                    yield found(model, split, _Documents.unpacked(read(place)))
                del model

    def found(model: Any, split: int, some: _Documents) -> pa.RecordBatch:
        every = np.ones(len(some.sizes), dtype=bool)
        labels = list(learner.predict(model, some.rows(split, every, None)))
        if len(labels) != len(some.sizes):
            raise InvalidInput("a model has to give one label for every row")
        columns = [pa.array([split] * len(labels), pa.int32()), *[some.keys.column(k) for k in keys], pa.array(labels, pa.string())]
        columns = [c.cast(kind) for c, kind in zip(columns, schema.types, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    return apply


def _part_keys(spark, parts: int) -> DataFrame:
    """``part, key``: for each of so many partitions a number that is dealt to it."""
    keys = spark.range(64 * parts).selectExpr("CAST(id AS INT) AS key", f"pmod(hash(CAST(id AS INT)), {parts}) AS part")
    return keys.groupBy("part").agg(F.min("key").alias("key"))


def predictions(
    entries: DataFrame | PackedDocuments, models: DataFrame, learner: Learner, keys: list[str]
) -> DataFrame:
    """``split, <keys>, predicted`` of all rows by the models of all splits.

    Documents are dealt to parts of some ``PART_WEIGHTS`` weights, but no more than there are cores:
    every part gets a copy of every model.  A task keeps its part, which need not fit its memory, in
    a temporary file and reads it in slices for one model after the other, so documents are shuffled
    once for all splits.
    """
    if isinstance(entries, DataFrame):
        entries = PackedDocuments.of(entries, keys)
    spark = entries.table.sparkSession
    ship(spark)
    bound_batches(spark, BATCH_BYTES)
    weights = entries.table.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    parts = min(weights // PART_WEIGHTS + 1, spark.sparkContext.defaultParallelism)
    splits = sorted(row["split"] for row in models.select("split").collect())
    kinds = [to_arrow_type(entries.keys[k].dataType) for k in keys]
    schema = pa.schema(
        [("split", pa.int32()), *zip(keys, kinds, strict=True), ("predicted", pa.string())]
    )
    # A number of rows for each core, so that no two parts meet in a partition.
    key_of = {row["part"]: row["key"] for row in _part_keys(spark, parts).collect()}
    key = F.element_at(F.array(*[F.lit(key_of[p]) for p in range(parts)]), F.col("part") + 1).alias("key")
    place = F.monotonically_increasing_id()
    part = F.pmod(F.shiftright(place, 33) + place.bitwiseAND((1 << 33) - 1), F.lit(parts)).cast("int")
    rows = entries.table.select(part.alias("part"), "data")
    none = [F.lit(None).cast("int").alias(c) for c in ("split", "at")]
    met = models.select("split", "model").mapInArrow(_chunking, "split int, at int, data binary")
    met = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1).cast("int"))))
    dealt = met.select(key, "split", "at", "data").unionByName(rows.select(key, *none, "data"))
    types = [f"`{k}` {entries.keys[k].dataType.simpleString()}" for k in keys]
    return dealt.repartition(parts, "key").drop("key").mapInArrow(
        _applying(learner, splits, keys, schema), f"split int, {', '.join(types)}, predicted string"
    )


@dataclass(frozen=True)
class LearnedModel:
    """A finished model behind the classifier contract: any features of its space can be predicted.

    ``table`` holds the one row ``split, model``, ``terms`` the columns as ``term, docs, term_index``;
    both are staged or saved.
    """

    learner: Learner
    table: DataFrame
    terms: DataFrame
    space: str
    budget: int = BROADCAST_BYTES

    @property
    def name(self) -> str:
        return type(self.learner).__name__

    def labels(self) -> DataFrame:
        """Distinct learned ``label_id`` values in order, as the model itself names them."""
        learner = self.learner

        def names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for raw in batch.column("model"):
                    found = sorted(learner.labels(cloudpickle.loads(raw.as_py())))
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["label_id"])

        ship(self.table.sparkSession)
        found = self.table.select("model").mapInArrow(names, "label_id string")
        return found.distinct().orderBy("label_id")

    def predict(self, features: Features) -> DataFrame:
        check_same_space(features.space, self.space)
        placed = join_terms(features.rows, self.terms, self.budget, counted=False)
        placed = placed.select("doc_id", "term_index", "weight")
        every = features.documents.select("doc_id")
        bare = every.selectExpr("doc_id", "CAST(NULL AS BIGINT) AS term_index", "0D AS weight")
        entries = entry_rows(placed.unionByName(bare), ["doc_id"], [F.col("weight")])
        entries = PackedDocuments.of(entries, ["doc_id"]).staged(Staging(every.sparkSession), "entries")
        one = self.table.select(F.lit(0).alias("split"), "model")
        return predictions(entries, one, self.learner, ["doc_id"]).drop("split")
