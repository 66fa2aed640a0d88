"""Remove every byte that lies in a long string which occurs more than once in the corpus.

Prefix-free parsing with a rolling hash.  Within every string of ``length`` bytes, a twelfth of that
many bytes, those of least hash, are its trigger; neighbouring strings mostly share theirs, and all strings around one
trigger are a phrase.  Phrases overlap so that each string lies in exactly one, and where a text
repeats, triggers and phrases repeat with it.  So a corpus is parsed into phrases, one for some 185
bytes, and its dictionary is that of the distinct ones:

1. A phrase that occurs twice is repeated as a whole; one whose trigger occurs once is not at all.
2. Left are phrases with a trigger in common and different surroundings, where repeated passages
   begin and end.  Each distinct one is taken once, and its suffixes, cut to ``length`` bytes, are
   compared with those of the others: in blocks of neighbouring suffixes by what they all hold
   and by all they hold, and one by one where blocks do not decide.

Only equality of strings matters, not their order, so suffixes are grouped by 128 bits of hash
instead of being sorted: counts are combined before every shuffle, and no group meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import InvalidInput
from ..session import Staging, broadcast_if_small
from .arrowtext import mix, row_slices, text_buffer
from .shipping import map_arrow

#: A string is so many times as long as its trigger.
TRIGGERS = 12
#: A string is so many times as long as a block, the neighbouring strings compared as one.
BLOCKS = 25
#: Bytes parsed at once; a longer text is parsed in parts, which only cuts phrases.
_PART_BYTES = 1 << 20
#: Bits for the strings of a phrase and for the bytes before its trigger.
_PHRASE_BITS = 10
#: The longest strings that leave both within these bits.
MAX_LENGTH = 1 << _PHRASE_BITS
_PHRASE_MASK = (1 << _PHRASE_BITS) - 1
_POSITION = np.uint64((1 << 24) - 1)
_random = np.random.default_rng(20240801)
_BYTE_VALUES = _random.integers(0, 2**64, (2, 256), dtype=np.uint64)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    done = 1
    while done < n:
        more = min(done, n - done)
        out[done : done + more] = out[:more] * np.uint64(pow(base, done, 2**64))
        done += more
    return out


_scales: list[tuple[np.ndarray, np.ndarray]] = []


def _scale(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2^64, kept by the worker."""
    if not _scales or len(_scales[0][0]) < n:
        n = max(n, _PART_BYTES + 2 * (1 << _PHRASE_BITS))
        _scales[:] = [(_powers(b, n), _powers(pow(b, -1, 2**64), n)) for b in _BASES]
    return _scales[which]


class _Hashes:
    """Polynomial hashes of any ranges of some bytes, equal for equal bytes."""

    def __init__(self, data: np.ndarray, which: int) -> None:
        powers, self.inverse = _scale(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[which][data] * powers[: len(data)], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def _least_of(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of every ``width`` neighbours."""
    blocks = np.concatenate((keys, np.full(-len(keys) % width, 2**64 - 1, np.uint64)))
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    found = len(keys) - width + 1
    return np.minimum(behind[:found], ahead[width - 1 : width - 1 + found])


def parse(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """The phrases of texts: row, first and last string, trigger, and hashes of trigger and phrase."""
    strings = len(data) - length + 1
    if strings <= 0:
        return {k: np.zeros(0, np.int64) for k in ("row", "first", "last", "trigger", "core", "whole")}
    size = max(1, length // TRIGGERS)
    left, right = _Hashes(data, 0), _Hashes(data, 1)
    at = np.arange(len(data) - size + 1)
    keys = left.of(at, at + size)
    keys = keys & ~_POSITION | at.astype(np.uint64)
    triggers = (_least_of(keys, length - size + 1) & _POSITION).astype(np.int64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:strings]
    inside = np.flatnonzero(np.arange(strings) + length <= offsets[row + 1])
    row, trigger = row[inside], triggers[inside]
    begins = np.ones(len(inside), dtype=bool)
    begins[1:] = (trigger[1:] != trigger[:-1]) | (inside[1:] != inside[:-1] + 1)
    starts = np.flatnonzero(begins)
    first, last = inside[starts], inside[np.append(starts[1:], len(inside))[: len(starts)] - 1]
    row, trigger = row[starts], trigger[starts]
    shape = ((last - first) << _PHRASE_BITS) + trigger - first
    return {
        "row": row,
        "first": first - offsets[row],
        "last": last - offsets[row],
        "trigger": trigger - offsets[row],
        "core": left.of(trigger, trigger + size),
        "whole": right.of(first, last + length) ^ mix(shape.astype(np.uint64)),
    }


def _parts(data: np.ndarray, offsets: np.ndarray, length: int):
    """``(first row, first byte, bytes, offsets)`` of runs of texts and of parts of long ones."""
    for first, last in row_slices(offsets, _PART_BYTES):
        part = data[offsets[first] : offsets[last]]
        if last - first > 1 or len(part) <= _PART_BYTES:
            yield first, 0, part, offsets[first : last + 1] - offsets[first]
            continue
        for at in range(0, len(part) - length + 1, _PART_BYTES):
            piece = part[at : at + _PART_BYTES + length - 1]
            yield first, at, piece, np.array([0, len(piece)])


def joined_spans(row: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Overlapping and touching spans of a row as one, in order."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    if not len(row):
        return row, start, end
    reach = np.maximum.accumulate(end + (row << 44))
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = start[1:] + (row[1:] << 44) > reach[:-1]
    at = np.flatnonzero(fresh)
    stops = np.append(at[1:], len(row)) - 1
    return row[at], start[at], reach[stops] - (row[at] << 44)


def _lists(row: np.ndarray, n: int, *columns: np.ndarray) -> list[pa.ListArray]:
    order = np.argsort(row, kind="stable")
    bounds = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=n)))).astype(np.int32)
    bounds = pa.array(bounds)
    return [pa.ListArray.from_arrays(bounds, pa.array(c[order].view(np.int64))) for c in columns]


def _place(first, last, trigger, many):
    """Where a phrase lies, how many strings it has, and whether its text repeats it, in 64 bits."""
    bits = (first << 1 | many) << _PHRASE_BITS | (last - first)
    return bits << _PHRASE_BITS | (trigger - first)


def _phrases(length: int):
    """The distinct phrases of every text, and the spans that its own phrases repeat."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(batch.num_columns - 1))
            n = batch.num_rows
            found, own = [], []
            for first_row, at, part, bounds in _parts(data, offsets, length):
                p = parse(part, bounds, length)
                order = np.lexsort((p["whole"], p["core"], p["row"]))
                row, first, last, trigger, core, whole = (
                    p[k][order] for k in ("row", "first", "last", "trigger", "core", "whole")
                )
                fresh = np.ones(len(row), dtype=bool)
                same = (row[1:] == row[:-1]) & (core[1:] == core[:-1]) & (whole[1:] == whole[:-1])
                fresh[1:] = ~same
                many = np.zeros(len(row), dtype=np.int64)
                many[1:] |= same
                many[:-1] |= same
                row, first, last, trigger = row + first_row, first + at, last + at, trigger + at
                own.append((row[many > 0], first[many > 0], last[many > 0] + length))
                place = _place(first, last, trigger, many)
                found.append((row[fresh], core[fresh], whole[fresh], place[fresh]))
            none = np.zeros(0, np.int64)
            row, core, whole, place = (
                np.concatenate(c) for c in zip(*found, (none, none.view(np.uint64), none.view(np.uint64), none))
            )
            spans = joined_spans(*(np.concatenate(c) for c in zip(*own, (none, none, none))))
            arrays = [*_lists(row, n, core, whole, place), *_lists(spans[0], n, *spans[1:])]
            kept = [batch.column(k) for k in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *arrays], ["k1", "k2", "id", "n_bytes", *_PHRASE_COLUMNS]
            )

    return find


_PHRASE_COLUMNS = ["core", "whole", "place", "own_start", "own_end"]


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of every entry of a list column; null is empty."""
    sizes = np.diff(column.offsets.to_numpy().astype(np.int64))
    if column.null_count:
        sizes = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, sizes)
    return np.repeat(np.arange(len(column)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _take_phrases(length: int):
    """The bytes of chosen phrases of every text."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tid, chosen, texts = batch.column(0), batch.column(1), batch.column(2)
            data, offsets = text_buffer(texts)
            row, value = _flat(chosen)
            single, place = value & 1, value >> 1
            ahead = place & _PHRASE_MASK
            more = place >> _PHRASE_BITS & _PHRASE_MASK
            first = place >> (2 * _PHRASE_BITS + 1)
            ids = tid.to_numpy()[row]
            for at in range(0, len(row), 8192):
                some = slice(at, at + 8192)
                begin = offsets[row[some]] + first[some]
                sizes = length + more[some]
                ends = np.cumsum(sizes)
                index = np.arange(int(ends[-1])) + np.repeat(begin - (ends - sizes), sizes)
                bounds = pa.array(np.concatenate(([0], ends)).astype(np.int32))
                piece = pa.BinaryArray.from_buffers(
                    pa.binary(), len(sizes), [None, bounds.buffers()[1], pa.py_buffer(data[index])]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[some]),
                        pa.array(single[some]),
                        pa.array(first[some]),
                        pa.array(ahead[some]),
                        pa.array(more[some]),
                        piece,
                    ],
                    ["tid", "single", "first", "ahead", "more", "phrase"],
                )

    return take


def _suffixes(length: int, block: int, within: int = 0):
    """Blocks of neighbouring suffixes of phrases: what all of them hold, and all that they hold.

    A suffix is known by how far its trigger lies ahead.  Blocks are cut at multiples of ``block`` of
    that distance, so that equal suffixes of different phrases fall into blocks of one number.  With
    a list of numbers of blocks of ``within`` suffixes only those are cut.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fid, single, ahead, more = (batch.column(k).to_numpy() for k in range(4))
            column = batch.column(4).cast(pa.large_binary())
            _, raw, data = column.buffers()
            all_bounds = np.frombuffer(raw, np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(data, np.uint8)
            for one, end in row_slices(all_bounds, _PART_BYTES):
                some = slice(one, end)
                low, high = ahead[some] - more[some], ahead[some]
                row = np.arange(end - one)
                if within:
                    row, number = _flat(batch.column(5).slice(one, end - one))
                    low = np.maximum(low[row], number * within)
                    high = np.minimum(high[row], number * within + within - 1)
                counts = high // block - low // block + 1
                of = np.repeat(np.arange(len(row)), counts)
                number = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                number = number + (low // block)[of]
                low = np.maximum(low[of], number * block)
                high = np.minimum(high[of], number * block + block - 1)
                row = row[of]
                part = data[all_bounds[one] : all_bounds[end]]
                trigger = all_bounds[one:end][row] - all_bounds[one] + ahead[some][row]
                left, right = _Hashes(part, 0), _Hashes(part, 1)
                core = left.of(trigger - number * block, trigger - number * block - block + 1 + length)
                whole = right.of(trigger - high, trigger - low + length)
                shape = (number << 2 * _PHRASE_BITS) + (low << _PHRASE_BITS) + high
                if block > 1:
                    core = core ^ mix(number.astype(np.uint64))
                    whole = whole ^ mix(shape.astype(np.uint64))
                ref = (fid[some][row] << 1 | single[some][row]) << _PHRASE_BITS | number
                yield pa.RecordBatch.from_arrays(
                    [pa.array(core.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(ref)],
                    ["core", "whole", "ref"],
                )

    return cut


def _joined_removals(length: int):
    """Spans of removed bytes of every text, from its repeated strings."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            copies, n_bytes = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            row, packed = _flat(batch.column(4))
            own_row, own_start = _flat(batch.column(5))
            _, own_end = _flat(batch.column(6))
            first = packed >> _PHRASE_BITS
            every = np.flatnonzero((copies > 1) & (n_bytes >= length))
            row = np.concatenate((row, own_row, every))
            start = np.concatenate((first, own_start, np.zeros(len(every), np.int64)))
            end = np.concatenate((first + (packed & _PHRASE_MASK) + length, own_end, n_bytes[every]))
            spans = joined_spans(row, start, end)
            arrays = _lists(spans[0], n, *spans[1:])
            found = pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *arrays], ["k1", "k2", "starts", "ends"]
            )
            yield found.filter(pa.array(np.bincount(spans[0], minlength=n) > 0))

    return join


def _text_key(text: str) -> list:
    """128 bits that tell texts apart."""
    text = F.coalesce(F.col(text), F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("other"), text).alias("k2")]


def _decided(items: DataFrame, staging: Staging, name: str) -> tuple[DataFrame, DataFrame]:
    """Items ``core, whole, n, ..`` that occur again as they are, and those that only share a core.

    Items whose core occurs once are in neither; items of a core with several wholes are all in the
    second.
    """
    cores = items.groupBy("core").agg(
        F.min("whole").alias("least"), F.max("whole").alias("most"), F.sum("n").alias("times")
    )
    cores = cores.filter("times > 1").select("core", (F.col("least") != F.col("most")).alias("mixed"))
    found = staging.write(items.join(cores, "core"), name)
    return found.filter("NOT mixed").drop("mixed"), found.filter("mixed").drop("mixed")


def repeated_spans(
    documents: DataFrame,
    length: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """``k1, k2, starts, ends``: the bytes that strings of ``length`` bytes found twice cover.

    One row per distinct text with such bytes, under the two hashes of the text; spans are in order
    and do not touch.  All rows count, copies too; strings may overlap and do not cross texts.
    """
    if not 1 <= length <= MAX_LENGTH:
        raise InvalidInput(f"strings must have 1 to {MAX_LENGTH} bytes")
    staging = staging or Staging(documents.sparkSession)
    rows = documents.select(
        *_text_key(text_column),
        F.col(id_column).alias("id"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_column).alias("text"),
    )
    lists = ", ".join(f"{c} array<long>" for c in _PHRASE_COLUMNS)
    kind = rows.schema["id"].dataType.simpleString()
    parsed = map_arrow(rows, _phrases(length), f"k1 long, k2 long, id {kind}, n_bytes long, {lists}")
    # Copies are parsed each and go on as one text.
    texts = parsed.groupBy("k1", "k2").agg(
        F.count(F.lit(1)).alias("copies"),
        F.min("id").alias("one"),
        F.first("n_bytes").alias("n_bytes"),
        *[F.first(c).alias(c) for c in _PHRASE_COLUMNS],
    )
    texts = staging.write(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")

    phrases = texts.select(
        "tid", "copies", F.explode(F.arrays_zip("core", "whole", "place")).alias("p")
    ).select("p.core", "p.whole", "tid", "p.place", "copies")
    many = F.shiftright("place", 2 * _PHRASE_BITS).bitwiseAND(F.lit(1))
    phrases = phrases.withColumn("n", F.col("copies") * (many + 1)).drop("copies")
    whole, mixed = _decided(phrases, staging, "phrases")
    # The dictionary of phrases whose triggers have several surroundings.
    classes = mixed.groupBy("core", "whole").agg(
        F.sum("n").alias("n"), F.min(F.struct("tid", "place")).alias("at")
    )
    classes = staging.write(classes, "classes")
    again = classes.filter("n > 1").select("core", "whole")
    whole = whole.select("tid", "place").unionByName(
        mixed.join(again, ["core", "whole"]).select("tid", "place")
    )
    size = F.shiftright("place", _PHRASE_BITS).bitwiseAND(F.lit(_PHRASE_MASK))
    first = F.shiftright("place", 2 * _PHRASE_BITS + 1)
    packed = F.shiftleft(first, _PHRASE_BITS).bitwiseOR(size).alias("packed")
    removed = whole.select("tid", packed)

    # One text of those that hold a phrase gives its bytes, and of its copies that of the least id.
    single = (F.col("n") == 1).cast("long")
    wanted = classes.select(
        F.col("at.tid").alias("tid"),
        F.shiftleft(F.col("at.place"), 1).bitwiseOR(single).alias("chosen"),
    )
    wanted = wanted.groupBy("tid").agg(F.collect_list("chosen").alias("chosen"))
    keys = texts.select("tid", F.col("k1").alias("t1"), F.col("k2").alias("t2"), "one")
    wanted = staging.write(wanted.join(keys, "tid"), "wanted")
    holding = documents.select(
        *_text_key(text_column), F.col(id_column).alias("id"), F.col(text_column).alias("text")
    )
    same_text = (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2"))
    holding = holding.join(
        broadcast_if_small(wanted, "chosen"), same_text & F.col("id").eqNullSafe(F.col("one"))
    )
    taken = map_arrow(
        holding.select("tid", "chosen", "text"),
        _take_phrases(length),
        "tid long, single long, first long, ahead long, more long, phrase binary",
    )
    taken = staging.write(taken.withColumn("fid", F.monotonically_increasing_id()), "dictionary")
    columns = ["fid", "single", "ahead", "more", "phrase"]
    items = "core long, whole long, ref long"
    block = max(1, length // BLOCKS)
    blocks = map_arrow(taken.select(*columns), _suffixes(length, block), items)
    same, open_blocks = _decided(blocks.withColumn("n", F.lit(1)), staging, "blocks")
    number = F.col("ref").bitwiseAND(F.lit(_PHRASE_MASK)).alias("number")
    fid = F.shiftright("ref", _PHRASE_BITS + 1).alias("fid")
    alone = F.shiftright("ref", _PHRASE_BITS).bitwiseAND(F.lit(1)) == 1
    open_blocks = open_blocks.select(fid, number).groupBy("fid").agg(
        F.collect_list("number").alias("numbers")
    )
    suffixes = map_arrow(
        taken.join(open_blocks, "fid").select(*columns, "numbers"),
        _suffixes(length, 1, within=block),
        items,
    )
    suffixes = staging.write(suffixes, "suffixes")
    twice = suffixes.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    found = suffixes.filter(alone).join(twice.drop("n"), ["core", "whole"]).select(fid, number)
    # Phrases that occur as a whole are settled; of the others, blocks and single suffixes.
    found = found.select("fid", F.col("number").alias("low"), F.col("number").alias("high"))
    blocks = same.filter(alone).select(fid, number)
    blocks = blocks.select(
        "fid",
        (F.col("number") * block).alias("low"),
        (F.col("number") * block + block - 1).alias("high"),
    )
    about = taken.filter("single = 1").select("fid", "tid", "first", "ahead", "more")
    ranges = blocks.unionByName(found).join(about, "fid")
    low = F.greatest("low", F.col("ahead") - F.col("more"))
    high = F.least("high", "ahead")
    begin = F.col("first") + F.col("ahead") - high
    ranges = ranges.select("tid", F.shiftleft(begin, _PHRASE_BITS).bitwiseOR(high - low).alias("packed"))

    removed = removed.unionByName(ranges).groupBy("tid").agg(F.collect_list("packed").alias("packed"))
    every = texts.select("tid", "k1", "k2", "copies", "n_bytes", "own_start", "own_end")
    every = every.join(removed, "tid", "left").select(
        "k1", "k2", "copies", "n_bytes", "packed", "own_start", "own_end"
    )
    every = every.withColumn("packed", F.coalesce("packed", F.array().cast("array<long>")))
    spans = map_arrow(
        every, _joined_removals(length), "k1 long, k2 long, starts array<long>, ends array<long>"
    )
    return staging.write(spans, "spans")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without their spans, about a part's bytes at a time."""
    for batch in batches:
        _, offsets = text_buffer(batch.column(3))
        for first, last in row_slices(offsets, _PART_BYTES):
            yield _kept_of(batch.slice(first, last - first))


def _kept_of(batch: pa.RecordBatch) -> pa.RecordBatch:
    n = batch.num_rows
    data, offsets = text_buffer(batch.column(3))
    row, start = _flat(batch.column(1))
    _, end = _flat(batch.column(2))
    edges = np.zeros(len(data) + 1, np.int8)
    edges[offsets[row] + start] += 1  # no two spans of a row touch
    np.subtract.at(edges, offsets[row] + end, 1)
    left = np.cumsum(edges[:-1], dtype=np.int8) == 0
    removed = np.bincount(row, weights=end - start, minlength=n).astype(np.int64)
    bounds = offsets - np.concatenate(([0], np.cumsum(removed)))
    kept = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data[left])]
    )
    return pa.RecordBatch.from_arrays(
        [batch.column(0), pa.array(np.diff(offsets)), pa.array(removed), batch.column(1),
         batch.column(2), kept.cast(pa.binary())],
        ["id", "n_bytes", "n_removed", "starts", "ends", "kept"],
    )


def without_repeats(
    documents: DataFrame,
    length: int = 400,
    id_column: str = "doc_id",
    text_column: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """``<id>, n_bytes, n_removed, starts, ends, kept``: every text without its repeated bytes.

    A byte goes if it lies in a string of ``length`` bytes that starts anywhere else too, in the same
    text or another, as the input is; all such strings go, none is kept as the first.  ``starts`` and
    ``ends`` are the removed runs, ``kept`` the other bytes, which need not be valid UTF-8.

    Null and empty texts have no bytes.  Every row counts, also with a null or repeated id, and copies
    of a text of at least ``length`` bytes lose all of it.  Other columns are not read.  An empty table
    gives no rows.
    """
    staging = staging or Staging(documents.sparkSession)
    spans = repeated_spans(documents, length, id_column, text_column, staging)
    spans = spans.withColumnsRenamed({"k1": "t1", "k2": "t2"})
    rows = documents.select(
        F.col(id_column).alias("id"), *_text_key(text_column), F.col(text_column).alias("text")
    )
    rows = rows.join(
        broadcast_if_small(spans, "starts"),
        (F.col("k1") == F.col("t1")) & (F.col("k2") == F.col("t2")),
        "left",
    )
    none = F.array().cast("array<long>")
    rows = rows.select(
        "id", F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends"), "text"
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_removed long, starts array<long>, ends array<long>, kept binary"
    return map_arrow(rows, _kept, schema).withColumnRenamed("id", id_column)
