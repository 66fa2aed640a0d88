"""Benchmark decontamination with SimHash windows, in DataFrame functions only.

A SimHash is the majority vote, bit by bit, over the hashes of a window's word shingles.  Windows
are sized by the items.  A passage similar to an item of m shingles can lack at most a seventh of
them, and a changed word costs five, which tells how long a stretch it must share with the item
unchanged.  The window size c is the largest power of two with c + c/2 - 1 within that stretch.
Documents are cut into such windows at every c/2 shingles, items at every shingle, so a similar
passage always holds a document window that is also one of the item's.  Fingerprints are cut into
four blocks: two that differ in at most three bits agree in at least one of them, so looking the
blocks up finds every pair within that radius.  A window that is found says where in the document the whole item would
lie, and there the weighted similarity of the shingles, counted with their multiplicities, decides.

Documents count the votes for all 64 bits at once, in binary: number k of a count holds the digits
of weight 2**k, a bit of the hash each, and counts are added with the logic of a digital adder.
"""

from __future__ import annotations

import math
import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import BROADCAST_BYTES, Staging, broadcast_if_small, estimated_bytes

SHINGLE = 5
#: Least weighted similarity of an item and the passage it leaked into.
SIMILAR = 0.75
#: Fingerprints of one item window and its copy may differ in so many bits; one block more.
RADIUS = 3
_BLOCKS = RADIUS + 1
_BLOCK_BITS = 64 // _BLOCKS
_LANES = 8
_ONES = 0x0101010101010101
_HALF = 0x4040404040404040
#: Most shingles in a window; longer items are found by windows within them.
LARGEST_WINDOW = 128


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _indices(n: Column) -> Column:
    """0 to n - 1."""
    none = F.array().cast("array<int>")
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(none)


def shingle_hashes(text: Column) -> Column:
    """Hashes of all shingles in order; none for a null text or one of fewer words."""
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    words = F.filter(F.split(lower, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        return F.transform(
            _indices(F.size(h) - (SHINGLE - 1)),
            lambda i: F.xxhash64(*[h[i + k] for k in range(SHINGLE)]),
        )

    return _let(hashes, of)


def _lanes(value: Column) -> list[Column]:
    """The bits of a hash in eight numbers, a byte for each: number k holds k, k + 8, k + 16, .."""
    return [F.shiftrightunsigned(value, k).bitwiseAND(F.lit(_ONES)) for k in range(_LANES)]


def _majority(counts: list[Column], window: int) -> Column:
    """Fingerprint of a window from sums of lanes: a bit is set if more than half have it."""
    bits = []
    for k, votes in enumerate(counts):
        # More than window / 2 votes carry into the byte's second-highest bit.
        over = (votes + F.lit(_ONES * (63 - window // 2))).bitwiseAND(F.lit(_HALF))
        bits.append(F.shiftleft(F.shiftrightunsigned(over, 6), k))
    result = bits[0]
    for bit in bits[1:]:
        result = result.bitwiseOR(bit)
    return result


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _count(digits: list[Column]) -> Column:
    return F.struct(*[d.alias(f"d{k}") for k, d in enumerate(digits)])


def _digits(count: Column, n: int) -> list[Column]:
    return [count.getField(f"d{k}") for k in range(n)]


def _add(a: list[Column], b: list[Column]) -> list[Column]:
    """The sum of two counts of equally many digits, one digit longer."""
    total, carry = [_xor(a[0], b[0])], _and(a[0], b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        total.append(_xor(_xor(x, y), carry))
        carry = _or(_and(x, y), _and(carry, _xor(x, y)))
    return [*total, carry]


def _over_half(digits: list[Column]) -> Column:
    """Bits that more than half of ``2 ** (len(digits) - 1)`` votes are for."""
    all_of_them, half, rest = digits[-1], digits[-2:-1], digits[:-2]
    if not rest:
        return all_of_them
    more = rest[0]
    for digit in rest[1:]:
        more = _or(more, digit)
    return _or(all_of_them, _and(half[0], more))


def _base_blocks(hashes: Column, size: int) -> Column:
    """Counts of 1, 2 or 4 hashes after each other."""
    if size == 1:
        return F.transform(hashes, lambda h: _count([h]))
    starts = _indices(F.floor(F.size(hashes) / size))
    if size == 2:
        pair = lambda i: _add([hashes[i * 2]], [hashes[i * 2 + 1]])
        return F.transform(starts, lambda i: _count(pair(i)))

    def four(i: Column) -> Column:
        a, b, c, d = (hashes[i * 4 + k] for k in range(4))
        ab, cd, x, y = _and(a, b), _and(c, d), _xor(a, b), _xor(c, d)
        return _count([_xor(x, y), _xor(_xor(ab, cd), _and(x, y)), _and(ab, cd)])

    return F.transform(starts, four)


def unchanged_stretch(shingles: int) -> int:
    """Shingles in a row that a passage similar to an item of so many must share with it."""
    lost = math.floor(shingles * (1 - SIMILAR) / (1 + SIMILAR))
    return (shingles - lost) // (lost // SHINGLE + 1)


def window_size(shingles: int) -> int:
    """Shingles in a window for items of so many shingles."""
    size = 1
    while size < LARGEST_WINDOW and 2 * size + size - 1 <= unchanged_stretch(shingles):
        size *= 2
    return size


def _stride(window: int) -> int:
    return max(1, window // 2)


def document_windows(hashes: Column, windows: list[int]) -> Column:
    """``array<struct<size, prints array<long>>>``, prints at every stride of their window."""
    strides = [_stride(w) for w in windows]

    def prints(blocks: Column, window: int, digits: int) -> Column:
        if window == _stride(window):
            found = F.transform(blocks, lambda b: _over_half(_digits(b, digits)))
        else:
            found = F.transform(
                _indices(F.size(blocks) - 1),
                lambda i: _over_half(
                    _add(
                        _digits(blocks[i], digits), _digits(blocks[i + 1], digits)
                    )
                ),
            )
        return F.struct(F.lit(window).alias("size"), found.alias("prints"))

    def level(blocks: Column, stride: int) -> Column:
        """Windows made of blocks of ``stride`` shingles, and of larger ones."""
        digits = stride.bit_length()
        own = [prints(blocks, w, digits) for w in windows if _stride(w) == stride]
        here = F.array(*own) if own else None
        if stride >= max(strides):
            return here
        pairs = F.transform(
            _indices(F.floor(F.size(blocks) / 2)),
            lambda i: _count(
                _add(
                    _digits(blocks[i * 2], digits),
                    _digits(blocks[i * 2 + 1], digits),
                )
            ),
        )
        above = _let(pairs, lambda b: level(b, 2 * stride))
        return above if here is None else F.concat(here, above)

    base = min(4, *strides) if len(strides) > 1 else min(4, strides[0])
    return _let(
        hashes, lambda h: _let(_base_blocks(h, base), lambda b: level(b, base))
    )


def item_windows(items: DataFrame, windows: list[int]) -> DataFrame:
    """``key, size, offset, print`` at every shingle of the items of each window's class."""
    rows = items.select(
        "key", "size", F.posexplode("hashes").alias("place", "hash"), F.size("hashes").alias("m")
    )
    # A shingle is in the windows that begin up to size - 1 shingles before it.
    first = F.greatest(F.col("place") - F.col("size") + 1, F.lit(0))
    last = F.least(F.col("place"), F.col("m") - F.col("size"))
    starts = rows.select("key", "size", "hash", F.explode(F.sequence(first, last)).alias("offset"))
    counts = starts.groupBy("key", "size", "offset").agg(
        *[F.sum(lane).alias(f"v{k}") for k, lane in enumerate(_lanes(F.col("hash")))]
    )
    votes = [F.col(f"v{k}") for k in range(_LANES)]
    found = F.lit(None).cast("long")
    for window in windows:
        found = F.when(F.col("size") == window, _majority(votes, window)).otherwise(found)
    return counts.select("key", "size", "offset", found.alias("print"))


def _blocks(prints: Column) -> Column:
    return F.array(
        *[
            F.struct(
                F.lit(k).alias("block"),
                F.shiftrightunsigned(prints, k * _BLOCK_BITS)
                .bitwiseAND(F.lit((1 << _BLOCK_BITS) - 1))
                .alias("value"),
            )
            for k in range(_BLOCKS)
        ]
    )


def candidates(documents: DataFrame, prints: DataFrame, windows: list[int]) -> DataFrame:
    """``doc_id, key, start``: where whole items would begin, in shingles, within the radius."""
    found = documents.select(
        "doc_id", F.explode(document_windows(shingle_hashes(F.col("text")), windows)).alias("w")
    )
    rows = found.select("doc_id", "w.size", F.posexplode("w.prints").alias("place", "own"))
    keyed = rows.select("*", F.explode(_blocks(F.col("own"))).alias("b")).select(
        "doc_id", "size", "place", "own", "b.block", "b.value"
    )
    looked_up = prints.select("*", F.explode(_blocks(F.col("print"))).alias("b")).select(
        "key", "size", "offset", "print", "b.block", "b.value"
    )
    weight = estimated_bytes(prints.count() * _BLOCKS, 0, 6)
    if weight <= BROADCAST_BYTES // 4:
        looked_up = F.broadcast(looked_up)
    stride = F.greatest(F.floor(F.col("size") / 2), F.lit(1))
    met = keyed.join(looked_up, ["size", "block", "value"]).filter(
        F.bit_count(F.col("own").bitwiseXOR(F.col("print"))) <= RADIUS
    )
    start = (F.col("place") * stride - F.col("offset")).cast("int")
    return met.select("doc_id", "key", start.alias("start")).distinct()


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the lesser over the sum of the greater multiplicities of two arrays' elements."""

    def times(array: Column, element: Column) -> Column:
        return F.size(F.filter(array, lambda y: y == element))

    def both(x: Column) -> Column:
        return F.least(times(a, x), times(b, x))

    shared = F.aggregate(
        F.array_intersect(a, b), F.lit(0), lambda total, x: total + both(x)
    )
    return _let(
        shared, lambda s: F.when(F.size(a) + F.size(b) > 0, s / (F.size(a) + F.size(b) - s))
    )


def contaminated(
    documents: DataFrame,
    benchmark: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    item_id_column: str = "item_id",
    item_text_column: str = "text",
    staging: Staging | None = None,
) -> DataFrame:
    """``<id>, <item id>, similarity, start`` of every document and item leaked into it.

    ``start`` is the first shingle (counted from 0) of the most similar passage, the earliest of
    equally similar ones.  Null texts, and items or documents of fewer than five words, have no
    shingles and match nothing; rows with a null id cannot be named and are left out.  Repeated rows
    of one id count as one document that holds what any of them holds.  Empty tables give no rows.
    Other columns are not read.
    """
    staging = staging or Staging(documents.sparkSession)
    items = staging.write(
        benchmark.select(
            F.col(item_id_column).alias("item_id"),
            shingle_hashes(F.col(item_text_column)).alias("hashes"),
        )
        .filter("item_id IS NOT NULL AND size(hashes) > 0")
        .distinct()
        .select(
            # Several texts of one id are looked for each.
            F.monotonically_increasing_id().alias("key"),
            "item_id",
            "hashes",
            _class_of(F.size("hashes")).alias("size"),
        ),
        "items",
    )
    # At most eight sizes, however many items there are.
    windows = sorted(r["size"] for r in items.select("size").distinct().collect())
    rows = documents.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    rows = rows.filter("doc_id IS NOT NULL")
    if not windows:
        nothing = rows.limit(0).select("doc_id")
        item_type = items.schema["item_id"].dataType
        return nothing.select(
            F.col("doc_id").alias(id_column),
            F.lit(None).cast(item_type).alias(item_id_column),
            F.lit(None).cast("double").alias("similarity"),
            F.lit(None).cast("int").alias("start"),
        )
    prints = staging.write(item_windows(items, windows), "prints")
    found = staging.write(candidates(rows, prints, windows), "candidates")
    # Texts are read again only where something was found; they move only if these are many.
    ids = broadcast_if_small(found.select("doc_id").distinct(), "doc_id")
    texts = rows.join(ids, "doc_id", "left_semi").select(
        "doc_id", shingle_hashes(F.col("text")).alias("own")
    )
    placed = found.join(texts, "doc_id").join(items.select("key", "item_id", "hashes"), "key")
    first = F.greatest(F.col("start"), F.lit(0))
    length = F.greatest(F.col("start") + F.size("hashes") - first, F.lit(0))
    passage = F.slice("own", first + 1, length)
    judged = placed.select(
        "doc_id", "item_id", first.alias("start"), passage.alias("passage"), "hashes"
    ).select(
        "doc_id",
        "item_id",
        "start",
        weighted_similarity(F.col("hashes"), F.col("passage")).alias("similarity"),
    )
    best = (
        judged.filter(F.col("similarity") >= SIMILAR)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best"))
    )
    return best.select(
        F.col("doc_id").alias(id_column),
        F.col("item_id").alias(item_id_column),
        F.col("best.similarity").alias("similarity"),
        (-F.col("best.back")).alias("start"),
    )


def _class_of(shingles: Column) -> Column:
    """``window_size`` of a column."""
    lost = F.floor(shingles * F.lit((1 - SIMILAR) / (1 + SIMILAR)))
    stretch = F.floor((shingles - lost) / (F.floor(lost / SHINGLE) + 1))
    size = F.lit(1)
    for power in range(1, int(math.log2(LARGEST_WINDOW)) + 1):
        window = 1 << power
        size = F.when(stretch >= window + _stride(window) - 1, window).otherwise(size)
    return size
