"""Masked pseudo-likelihood of texts under a bidirectional window network.

A token is a run of letters and digits, a sign, or one character of the scripts that UTF-8 writes
with three bytes or more.  The network of ``window_network`` predicts the class of every token from
the two tokens on either side; the corpus tells how probable the token is within its class.  The
logarithms of both are summed over a text.

Each of the most frequent tokens is a class of its own.  All others share classes by their last two
bytes; within a class, tokens are as probable as they are frequent in all texts, the predicted
occurrence left out, mixed with their spelling by pairs of bytes, so that no token is impossible.

Texts are read twice: for the frequent tokens and pairs of bytes, and for a table of blocks, which
holds the tokens of about a million places by number, under names of 64 bits.  Training and scoring
read blocks.  Blocks list the names they hold with their counts, in parts by ranges of names; a part
adds up the counts of all blocks and sends every block the sums, in the order of its names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from . import window_network
from .arrowtext import _SPACE, hash_runs, mix, row_slices, text_buffer
from .shipping import map_arrow, ship
from .window_network import CLASSES, WindowNetwork

#: Bytes of text worked on at once, and tokens of a block.
SLICE = 1 << 18
BLOCK = 1 << 20
#: Rows after which a block ends, if they hold few tokens.
BLOCK_ROWS = 1 << 16
#: Packed bytes of names behind a part.
PART = 4 << 20
#: Share of the spelling in the probability of a token within its class.
SPELLED = 0.05
#: Classes of what stands before and after a text, of frequent tokens, and of endings.
BEFORE, AFTER, FIRST_OWN = 0, 1, 2
ENDINGS = 256
FIRST_ENDING = CLASSES - ENDINGS
#: Least share a token has of some batch to be taken for frequent.
FREQUENT = 1 / (1 << 14)
_BEFORE, _AFTER = np.uint64(11), np.uint64(12)
#: What stands between tokens, for their spelling.
_GAP = ord(" ")

#: Bytes that make up runs: digits, letters, and characters of two bytes that are no signs.
_INSIDE = np.zeros(256, bool)
for _first, _last in (("0", "9"), ("A", "Z"), ("a", "z")):
    _INSIDE[ord(_first) : ord(_last) + 1] = True
_INSIDE[0xC3:0xE0] = True


def tokens(data: np.ndarray, offsets: np.ndarray):
    """Row, hash, start and end of every token."""
    if not len(data):
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 2)
    lead = (data & 0xC0) != 0x80
    # A further byte belongs to what its character belongs to.
    at = np.maximum.accumulate(np.where(lead, np.arange(len(data)), 0))
    inside, space = _INSIDE[data[at]], _SPACE[data]
    begins = lead & ~space
    begins[1:] &= ~(inside[1:] & inside[:-1])
    row_starts = offsets[:-1][np.diff(offsets) > 0]
    begins[row_starts] = ~space[row_starts]
    starts = np.flatnonzero(begins)
    stop = np.append(np.flatnonzero(space | begins), len(data))
    ends = stop[np.searchsorted(stop, starts, "right")]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return rows, hash_runs(data, starts, ends), starts, ends


def pieces(column: pa.Array, limit: int):
    """First row, bytes and bounds of parts of a column; longer texts are cut at white space."""
    data, offsets = text_buffer(column)
    for first, last in row_slices(offsets, limit):
        begin, end = int(offsets[first]), int(offsets[last])
        if last - first > 1 or end - begin <= limit:
            yield first, data[begin:end], offsets[first : last + 1] - begin
            continue
        while begin < end:
            stop = min(begin + limit, end)
            while stop < end and not _SPACE[data[stop]]:
                space = _SPACE[data[stop : min(stop + limit, end)]]
                stop += int(space.argmax()) if space.any() else len(space)
            yield first, data[begin:stop], np.array([0, stop - begin])
            begin = stop


def _before(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The byte before each within its token."""
    before = np.empty(len(data), np.int64)
    before[1:] = data[:-1]
    before[starts] = _GAP
    return before


def byte_pairs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How often each byte follows each within tokens; a gap stands before and after a token."""
    before = _before(data, starts)
    inside = np.zeros(len(data) + 1, np.int8)
    inside[starts] += 1
    inside[ends] -= 1  # no two tokens end at the same place
    inside = np.cumsum(inside[:-1]) > 0
    found = np.bincount(before[inside] * 256 + data[inside], minlength=1 << 16)
    return found + np.bincount(data[ends - 1].astype(np.int64) * 256 + _GAP, minlength=1 << 16)


@dataclass
class Vocabulary:
    """Names of the frequent tokens in the order of their classes, and logarithms of byte pairs."""

    frequent: np.ndarray
    pairs: np.ndarray

    def endings(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Class of every token by its last two bytes."""
        last = data[ends - 1].astype(np.uint64)
        longer = np.where(ends - starts > 1, data[np.maximum(ends - 2, 0)], 0).astype(np.uint64)
        share = mix(last * np.uint64(256) + longer + np.uint64(1)) % np.uint64(ENDINGS)
        return (FIRST_ENDING + share).astype(np.int16)

    def classes(self, names: np.ndarray, endings: np.ndarray) -> np.ndarray:
        """Classes of names: their own, or that of their endings."""
        found = endings.copy()
        order = np.argsort(self.frequent)
        if len(order):
            at = np.searchsorted(self.frequent[order], names)
            at = order[np.minimum(at, len(order) - 1)]
            known = self.frequent[at] == names
            found[known] = FIRST_OWN + at[known]
        found[names == _BEFORE], found[names == _AFTER] = BEFORE, AFTER
        return found

    def spelling(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of every token by its pairs of bytes."""
        of_byte = self.pairs[_before(data, starts) * 256 + data]
        before = np.concatenate(([0.0], np.cumsum(of_byte, dtype=float)))
        end = self.pairs[data[ends - 1].astype(np.int64) * 256 + _GAP]
        return (before[ends] - before[starts] + end).astype(np.float32)


def learn_vocabulary(texts: DataFrame) -> Vocabulary:
    """From one pass over ``text`` that brings the driver a row per class and per pair of bytes."""
    limit = SLICE

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = np.zeros(1 << 16, np.int64)
        names, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            found = []
            for _, data, bounds in pieces(batch.column(0), limit):
                _, hashes, starts, ends = tokens(data, bounds)
                if len(hashes):
                    pairs += byte_pairs(data, starts, ends)
                    found.append(hashes)
            if not found:
                continue
            own, n = np.unique(np.concatenate(found), return_counts=True)
            often = n >= FREQUENT * n.sum()
            names, at = np.unique(np.concatenate((names, own[often])), return_inverse=True)
            counts = np.bincount(at, np.concatenate((counts, n[often]))).astype(np.int64)
        seen = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.repeat([0, 1], [len(names), len(seen)])),
                pa.array(np.concatenate((names.view(np.int64), seen))),
                pa.array(np.concatenate((counts, pairs[seen]))),
            ],
            ["kind", "name", "n"],
        )

    counted = map_arrow(texts, per_task, "kind long, name long, n long")
    counted = counted.groupBy("kind", "name").agg(F.sum("n").alias("n"))
    # Written, as both parts of what follows would read all texts for themselves.
    counted = Staging(texts.sparkSession).write(counted, "vocabulary")
    # One job for both: at most as many rows as there are own classes and pairs of bytes.
    best = counted.filter("kind = 0").orderBy(F.desc("n"), "name").limit(FIRST_ENDING - FIRST_OWN)
    found = best.unionByName(counted.filter("kind = 1")).toArrow().to_pandas()
    frequent = found[found["kind"] == 0].sort_values(["n", "name"], ascending=[False, True])
    of_pair = found[found["kind"] == 1]
    table = np.full(1 << 16, 0.5)
    table[of_pair["name"].to_numpy()] += of_pair["n"].to_numpy()
    table = table.reshape(256, 256)
    table = np.log(table / table.sum(axis=1, keepdims=True)).astype(np.float32).ravel()
    return Vocabulary(frequent["name"].to_numpy(np.int64).view(np.uint64), table)


def _pack(values: np.ndarray) -> bytes:
    """Numbers byte by byte, the low bytes of all first, in as many bytes as the largest needs."""
    width = (int(values.max()).bit_length() + 7) // 8 or 1 if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + planes.tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    width, raw = packed[0], np.frombuffer(packed, np.uint8, offset=1)
    values = np.zeros((len(raw) // width, 8), np.uint8)
    values[:, :width] = raw.reshape(width, -1).T
    return values.view("<u8").ravel()


def _squeezed(values: np.ndarray, strategy: int = zlib.Z_DEFAULT_STRATEGY) -> bytes:
    coder = zlib.compressobj(1, strategy=strategy)
    return coder.compress(_pack(values)) + coder.flush()


def _numbers(squeezed: bytes) -> np.ndarray:
    return _unpack(zlib.decompress(squeezed))


def _pack_steps(steps: np.ndarray) -> bytes:
    """Steps between hashes: only their highest byte can be squeezed."""
    packed, n = _pack(steps), len(steps)
    coder = zlib.compressobj(1, strategy=zlib.Z_HUFFMAN_ONLY)
    return n.to_bytes(8, "little") + packed[:-n] + coder.compress(packed[-n:]) + coder.flush()


def _unpack_steps(packed: bytes) -> np.ndarray:
    n, width = int.from_bytes(packed[:8], "little"), packed[8]
    cut = 9 + n * (width - 1)
    return _unpack(packed[8:cut] + zlib.decompress(packed[cut:]))


@dataclass
class BlockWriter:
    """Gathers the tokens of rows and cuts them into blocks, long texts too.

    A part of a text keeps the two tokens on either side of it, which are not predicted again.
    """

    vocabulary: Vocabulary
    first_row: int
    limit: int
    ids: list = field(default_factory=list)
    lengths: list = field(default_factory=list)
    found: list = field(default_factory=list)
    held: int = 0
    rows: int = 0

    def add(self, ids: pa.Array, lengths: np.ndarray, found: list) -> None:
        self.ids.append(ids)
        self.lengths.append(lengths)
        self.found += found
        self.held += int(lengths.sum())
        self.rows += len(lengths)

    def blocks(self) -> Iterator[dict]:
        if not self.rows:
            return
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int16), np.zeros(0, np.float32))
        hashes, endings, spelled = (
            np.concatenate(parts) for parts in zip(empty, *self.found, strict=True)
        )
        bounds = np.concatenate(([0], np.cumsum(np.concatenate(self.lengths))))
        starts, stops = bounds[:-1], bounds[1:]
        ids = pa.concat_arrays(self.ids)
        for begin in range(0, max(self.held, 1), self.limit):
            end = min(begin + self.limit, self.held)
            # Rows without a token go with the block in which they would begin.
            first = min(
                int(np.searchsorted(stops, begin, "right")),
                int(np.searchsorted(starts, begin, "left")),
            )
            last = self.rows if end == self.held else int(np.searchsorted(starts, end, "left"))
            own = slice(first, last)
            part_starts, part_stops = np.maximum(starts[own], begin), np.minimum(stops[own], end)
            lengths = part_stops - part_starts
            at = padded_places(lengths)
            names = np.empty(len(at) + 4 * len(lengths), np.uint64)
            source = np.full(len(names), -1)
            source[at] = np.arange(begin, end)
            tail = np.cumsum(lengths + 4)
            head = tail - lengths - 4
            for k in (0, 1):
                names[head + k], names[tail - 2 + k] = _BEFORE, _AFTER
                earlier, later = part_starts - 2 + k, part_stops + k
                inside = earlier >= starts[own]
                source[(head + k)[inside]] = earlier[inside]
                inside = later < stops[own]
                source[(tail - 2 + k)[inside]] = later[inside]
            real = source >= 0
            names[real] = hashes[source[real]]
            distinct, place = np.unique(names, return_inverse=True)
            # Where each name stands first: the last of what is assigned to one place stays.  Asking
            # ``unique`` for it takes a stable sort, which is much slower.
            one = np.empty(len(distinct), np.int64)
            one[place[::-1]] = np.arange(len(names) - 1, -1, -1)
            one = source[one]
            classes = self.vocabulary.classes(distinct, endings[one] if self.held else one)
            counts = np.bincount(place[at], minlength=len(distinct))
            yield {
                "first_row": self.first_row + first,
                "ids": ids[first:last],
                "lengths": _squeezed(lengths),
                "names": _pack_steps(np.diff(distinct, prepend=np.uint64(0))),
                "counts": _squeezed(counts),
                "classes": _squeezed(classes),
                "spelled": spelled[one].tobytes() if self.held else bytes(4 * len(one)),
                # Hardly any stretch of them occurs again, so none is looked for.
                "places": _squeezed(place, zlib.Z_HUFFMAN_ONLY),
            }
        self.first_row += self.rows
        self.ids, self.lengths, self.found, self.held, self.rows = [], [], [], 0, 0


def padded_places(lengths: np.ndarray) -> np.ndarray:
    """Places of tokens, where every row has two more before and after it."""
    rows = np.repeat(np.arange(len(lengths)), lengths)
    return np.arange(len(rows)) + 4 * rows + 2


_PACKED = ("lengths", "names", "counts", "classes", "spelled", "places")


def write_blocks(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """The blocks of ``id, text``, a frame to be written to a table at once."""
    kind = rows.schema["id"].dataType.simpleString()
    limit, most, most_rows = SLICE, BLOCK, BLOCK_ROWS
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned, number = shared.value, 0
        # Written once to a table, so that what another attempt numbered is never seen.
        base = TaskContext.get().partitionId() << 40
        writer, id_type = BlockWriter(learned, base, most), None

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal number
            for block in writer.blocks():
                columns = [pa.array([(base >> 16) + number], pa.int64())]
                columns.append(pa.array([block["first_row"]], pa.int64()))
                offsets = pa.array([0, len(block["ids"])], pa.int32())
                columns.append(pa.ListArray.from_arrays(offsets, block["ids"]))
                columns += [pa.array([block[name]], pa.binary()) for name in _PACKED]
                number += 1
                yield pa.RecordBatch.from_arrays(columns, ["block", "first_row", "ids", *_PACKED])

        for batch in batches:
            id_type = batch.column(0).type
            lengths, found = np.zeros(batch.num_rows, np.int64), []
            for first, data, bounds in pieces(batch.column(1), limit):
                row, hashes, starts, ends = tokens(data, bounds)
                if not len(row):
                    continue
                lengths[first : first + len(bounds) - 1] += np.bincount(row, minlength=len(bounds) - 1)
                spelled = learned.spelling(data, starts, ends)
                found.append((hashes, learned.endings(data, starts, ends), spelled))
            writer.add(batch.column(0).cast(id_type), lengths, found)
            if writer.held >= most or writer.rows >= most_rows:
                yield from flush()
        yield from flush()

    binaries = ", ".join(f"{name} binary" for name in _PACKED)
    return map_arrow(rows, per_task, f"block long, first_row long, ids array<{kind}>, {binaries}")


def _block_windows(lengths: bytes, classes: bytes, places: bytes, some: slice = slice(None)):
    """Classes around and in the middle of some tokens of a block, and the tokens' numbers."""
    lengths, place = _numbers(lengths).astype(np.int64), _numbers(places).view(np.int64)
    at = padded_places(lengths)[some]
    classes = _numbers(classes).astype(np.int16)
    around = [classes.take(place.take(at + step)) for step in (-2, -1, 1, 2)]
    middle = place.take(at)
    return np.stack(around, axis=1), classes.take(middle), middle, lengths


def _training_windows(batch: pa.RecordBatch, row: int, some: slice):
    values = [batch.column(k)[row].as_py() for k in range(1, 4)]
    return _block_windows(*values, some)[:2]


def _list_names(blocks: DataFrame, part_bits: int) -> DataFrame:
    """``block, part, names, counts`` of names that share a class, as steps from the part's least."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                block, steps, counts, classes = (batch.column(k)[row].as_py() for k in range(4))
                shared = _numbers(classes) >= FIRST_ENDING
                names = np.cumsum(_unpack_steps(steps), dtype=np.uint64)[shared]
                counts = _numbers(counts)[shared]
                part = (names >> np.uint64(32)) >> np.uint64(32 - part_bits)
                ends = np.searchsorted(part, np.arange(1, (1 << part_bits) + 1, dtype=np.uint64))
                first = 0
                for number, last in enumerate(ends.tolist()):
                    if last > first:
                        base = np.uint64(number << (64 - part_bits))
                        steps = _pack_steps(np.diff(names[first:last], prepend=base))
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([block], pa.int64()),
                                pa.array([number], pa.int64()),
                                pa.array([steps], pa.binary()),
                                pa.array([_squeezed(counts[first:last])], pa.binary()),
                            ],
                            ["block", "part", "names", "counts"],
                        )
                    first = last

    listed = blocks.select("block", "names", "counts", "classes")
    return map_arrow(listed, per_task, "block long, part long, names binary, counts binary")


def _add_part(rows: pa.Table) -> pa.Table:
    """``block, part, sums``: for every block the sums of the names it listed, in their order."""
    names = [np.cumsum(_unpack_steps(r.as_py()), dtype=np.uint64) for r in rows["names"]]
    counts = np.concatenate([_numbers(r.as_py()) for r in rows["counts"]])
    lengths = [len(n) for n in names]
    whole = np.concatenate(names)
    del names
    order = np.argsort(whole, kind="stable")  # runs of sorted names: merged
    whole = whole[order]
    new = np.ones(len(whole), bool)
    new[1:] = whole[1:] != whole[:-1]
    sums = np.add.reduceat(counts[order], np.flatnonzero(new))
    counts[order] = sums[np.cumsum(new) - 1]
    parts = np.split(counts, np.cumsum(lengths)[:-1])
    return pa.table(
        [rows["block"], rows["part"], pa.array([_squeezed(p) for p in parts], pa.binary())],
        ["block", "part", "sums"],
    )


def _count_classes(blocks: DataFrame) -> np.ndarray:
    """How many tokens of all texts are of each class."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CLASSES)
        for batch in batches:
            for classes, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = _numbers(classes).astype(np.int64)
                total += np.bincount(own, _numbers(counts), minlength=CLASSES)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(CLASSES)), pa.array(total.astype(np.int64))], ["class", "n"]
        )

    found = map_arrow(blocks.select("classes", "counts"), per_task, "class long, n long")
    found = found.groupBy("class").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(CLASSES)
    counts[found["class"].to_numpy()] = found["n"].to_numpy()
    return counts


def _score_block(
    rows: pa.Table, sums: pa.Table, network: WindowNetwork, class_counts: np.ndarray
) -> pa.Table:
    own = {name: rows[name][0].as_py() for name in ("first_row", *_PACKED)}
    context, middle, place, lengths = _block_windows(own["lengths"], own["classes"], own["places"])
    classes = _numbers(own["classes"]).astype(np.int64)
    packed = sorted(zip(sums["part"].to_pylist(), sums["sums"].to_pylist(), strict=True))
    shared = classes >= FIRST_ENDING
    within = np.zeros(len(classes))
    if shared.any():
        n = np.concatenate([_numbers(p) for _, p in packed]).astype(float)
        spelled = np.exp(np.frombuffer(own["spelled"], np.float32)[shared].astype(float))
        others = np.maximum(class_counts[classes[shared]] - 1, 1)
        # A token beside a part of a text may be counted by no block but that of its own part.
        share = SPELLED * spelled + (1 - SPELLED) * np.maximum(n - 1, 0) / others
        within[shared] = np.log(np.maximum(share, 1e-300))
    log_p = network.log_probabilities(context, middle) + within[place]
    row = np.repeat(np.arange(len(lengths)), lengths)
    return pa.table(
        [
            pa.array(own["first_row"] + np.arange(len(lengths))),
            rows["ids"].combine_chunks().flatten(),
            pa.array(lengths),
            pa.array(np.bincount(row, weights=log_p, minlength=len(lengths)).astype(float)),
        ],
        ["row", "id", "n_tokens", "total"],
    )


def score(
    documents: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``<id>, n_tokens, pseudo_log_likelihood, per_token`` of every text among all of them.

    A text without a token has 0 tokens, a sum of 0 and no value per token.  Repeated rows are kept
    and get nearly equal scores (the sums of long texts may differ in rounding), a null id stays
    null, an empty table gives no rows; other columns are not read.
    """
    spark = documents.sparkSession
    ship(spark)
    staging = Staging(spark)
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    vocabulary = learn_vocabulary(rows.select("text"))
    blocks = staging.write(write_blocks(rows, vocabulary), "blocks")
    class_counts = _count_classes(blocks)
    network = window_network.train(
        blocks.select("block", "lengths", "classes", "places"), _training_windows, class_counts
    )
    n_bytes = blocks.agg(F.sum(F.octet_length("names"))).first()[0] or 0
    part_bits = int(n_bytes // PART).bit_length()
    sums = (
        _list_names(blocks, part_bits)
        .groupBy("part")
        .applyInArrow(_add_part, "block long, part long, sums binary")
    )
    shared = spark.sparkContext.broadcast(network.flat())
    kind = rows.schema["id"].dataType.simpleString()
    scored = (
        blocks.groupBy("block")
        .cogroup(sums.groupBy("block"))
        .applyInArrow(
            lambda own, found: _score_block(
                own, found, WindowNetwork.from_flat(shared.value), class_counts
            ),
            f"row long, id {kind}, n_tokens long, total double",
        )
    )
    # Parts of a long text meet again.
    whole = scored.groupBy("row").agg(
        F.first("id").alias("id"), F.sum("n_tokens").alias("n_tokens"), F.sum("total").alias("total")
    )
    return whole.select(
        F.col("id").alias(id_column),
        "n_tokens",
        F.col("total").alias("pseudo_log_likelihood"),
        F.when(F.col("n_tokens") > 0, F.col("total") / F.col("n_tokens")).alias("per_token"),
    )
