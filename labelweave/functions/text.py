"""Tokens and per-document term counts, computed inside each document's own row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import bound_batches, ship

# A word starts with a letter or number and may go on with marks as well.
STARTS, MARKS = r"[\p{L}\p{N}]", r"\p{M}"
TOKEN_PATTERN = r"[\p{L}\p{N}][\p{L}\p{M}\p{N}]*"
#: Number of Unicode's code points.
CODE_POINTS = 0x110000
#: Bytes of text whose words are counted at once.
SLICE_BYTES = 4 << 20

_TERM = T.StructType([T.StructField("term", T.StringType()), T.StructField("cnt", T.LongType())])
#: What the counts of a document are.
COUNTED = T.StructType(
    [
        T.StructField("terms", T.ArrayType(_TERM)),
        T.StructField("total", T.LongType()),
        T.StructField("mx", T.LongType()),
    ]
)


def page_text(page: Column) -> Column:
    """A page in lower case; a null page is an empty one."""
    return F.lower(F.coalesce(page, F.lit("")))


def page_tokens(page: Column) -> Column:
    """Lower-cased words and numbers of one page, in order."""
    return F.regexp_extract_all(page_text(page), F.lit(TOKEN_PATTERN), F.lit(0))


def document_tokens(pages: Column) -> Column:
    """Tokens of all pages.  Pages are read one by one, so no token crosses a page break."""
    return F.flatten(F.transform(F.coalesce(pages, F.array().cast("array<string>")), page_tokens))


_ranges: dict[str, list[tuple[int, int]]] = {}


def character_ranges(spark: SparkSession) -> list[tuple[int, int]]:
    """``(first code point, kind)`` of ranges of characters that start words (1), mark them (2) or end
    them (0), as Spark's own regular expressions have it; asked once per application."""
    application = spark.sparkContext.applicationId
    if application not in _ranges:

        def kind(point: Column) -> Column:
            code = F.unhex(F.lpad(F.hex(point), 8, "0"))
            letter = F.decode(code, "UTF-32")
            found = F.when(F.rlike(letter, F.lit(STARTS)), 1).when(F.rlike(letter, F.lit(MARKS)), 2)
            # Halves of surrogate pairs are no characters.
            return F.when(point.between(0xD800, 0xDFFF), 0).otherwise(found.otherwise(0))

        points = spark.range(1, CODE_POINTS).select("id", kind(F.col("id")).alias("kind"))
        changes = points.filter(F.col("kind") != kind(F.col("id") - 1))
        _ranges[application] = [(0, 0), *sorted((r["id"], r["kind"]) for r in changes.collect())]
    return _ranges[application]


def _kinds(ranges: list[tuple[int, int]]) -> np.ndarray:
    """The kind of every code point."""
    firsts, kinds = np.array(ranges).T
    return np.repeat(kinds.astype(np.uint8), np.diff(np.append(firsts, CODE_POINTS)))


def _byte_kinds(data: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The kind of the character that every byte of UTF-8 belongs to."""
    single = np.zeros(256, np.uint8)
    single[:128] = kinds[:128]
    found = single[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int64)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        code = first & (0x7F >> size)
        for at in range(1, 4):
            on = size > at
            code[on] = code[on] << 6 | data[lead[on] + at] & 0x3F
        kind = kinds[code]
        found[lead] = kind
        for at in range(1, 4):
            on = size > at
            found[lead[on] + at] = kind[on]
    return found


def _find_words(
    data: np.ndarray, ends: np.ndarray, kinds: np.ndarray
) -> tuple[pa.StringArray, np.ndarray]:
    """All words of texts that end at ``ends`` in one array of bytes, and each text's number of words."""
    found = _byte_kinds(data, kinds)
    inside = found > 0
    edges = np.concatenate([[0], ends])
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    # A text begins and ends its own words.
    starting, ending = edges[:-1][edges[:-1] < len(data)], ends[ends > 0] - 1
    first[starting] = inside[starting]
    last[ending] = inside[ending]
    starts, stops = np.flatnonzero(first), np.flatnonzero(last) + 1
    marked = np.flatnonzero(found[starts] == 2)
    if len(marked):
        # Marks that no letter or number goes before are in no word.
        letters = np.append(np.flatnonzero(found == 1), len(data))
        begin = np.minimum(letters[np.searchsorted(letters, starts[marked])], stops[marked])
        size = begin - starts[marked]
        before = np.cumsum(size) - size
        inside[np.repeat(starts[marked] - before, size) + np.arange(size.sum())] = False
        starts[marked] = begin
        starts, stops = starts[starts < stops], stops[starts < stops]
    offsets = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(stops - starts, out=offsets[1:])
    words = pa.StringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside])
    )
    return words, np.diff(np.searchsorted(starts, edges))


def _count_words(words: pa.StringArray, total: np.ndarray) -> list[pa.Array]:
    """Sorted counts, numbers of words and highest counts of texts with so many words each."""
    coded = words.dictionary_encode()
    # Sorted as bytes, as Spark sorts texts.
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    size = max(1, len(order))
    keys = np.repeat(np.arange(len(total)), total) * size + place[coded.indices.to_numpy()]
    keys, counts = np.unique(keys, return_counts=True)
    counts = counts.astype(np.int64)
    ends = np.searchsorted(keys, np.arange(len(total) + 1) * size)
    most, held = np.zeros(len(total), np.int64), total > 0
    if held.any():
        most[held] = np.maximum.reduceat(counts, ends[:-1][held])
    terms = pa.StructArray.from_arrays(
        [coded.dictionary.take(pa.array(order[keys % size])), pa.array(counts)], ["term", "cnt"]
    )
    counted = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), terms)
    return [counted, pa.array(total.astype(np.int64)), pa.array(most)]


def _counting(ranges: list[tuple[int, int]]):
    """Replace the last column, lower-cased texts, by the counts of their words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds(ranges)
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            edges = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
            at = 0
            while at < len(texts):
                # As many texts as make a slice, and one at least.
                to = np.searchsorted(edges, edges[at] + SLICE_BYTES, "right") - 1
                to = min(max(int(to), at + 1), len(texts))
                piece = data[edges[at] : edges[to]]
                words, total = _find_words(piece, edges[at + 1 : to + 1] - edges[at], kinds)
                rest = batch.slice(at, to - at).columns[:-1]
                yield pa.RecordBatch.from_arrays(
                    [*rest, *_count_words(words, total)],
                    [*batch.schema.names[:-1], "terms", "total", "mx"],
                )
                at = to

    return count


def with_term_counts(documents: DataFrame, pages: str = "pages") -> DataFrame:
    """Replace ``pages`` by ``terms`` (array of term and cnt, sorted by term), ``total`` and ``mx``.

    A document is one row, so its words are counted where it is: counting the whole corpus needs no
    shuffle and ``total`` and ``mx`` come for free.  Spark folds the case; words are found and counted
    for some megabytes of documents at once, as a regular expression makes an object of every word.
    """
    rest = [name for name in documents.columns if name != pages]
    # No word crosses a line, so pages may be lines of one text.
    text = F.coalesce(F.array_join(F.transform(pages, page_text), "\n"), F.lit(""))
    texts = documents.select(*rest, text.alias("_text"))
    counted = T.StructType([texts.schema[name] for name in rest] + COUNTED.fields)
    ship(documents.sparkSession)
    bound_batches(documents.sparkSession)
    return texts.mapInArrow(_counting(character_ranges(documents.sparkSession)), counted)


def text_bytes(pages: Column) -> Column:
    """Bytes of all pages; a null page has none."""
    return F.aggregate(
        pages,
        F.lit(0).cast("bigint"),
        lambda total, page: total + F.coalesce(F.octet_length(page), F.lit(0)),
    )


def page_pieces(page: Column, most: int) -> Column:
    """A page cut behind white space into pieces of some ``most`` characters.

    A piece goes on to the end of the word it is in, so no token is cut.
    """
    piece = F.lit(rf"(?s).{{1,{most}}}\S*\s?")
    return F.regexp_extract_all(F.coalesce(page, F.lit("")), piece, F.lit(0))


def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression holds it."""
    return F.get(F.transform(F.array(value), body), 0)


def text_blocks(pages: Column, most: int) -> Column:
    """The pages of a document in blocks of some ``most`` bytes; a short document is one block.

    Only a longer document's pages are cut, and so many pieces are put together as make a block.
    """
    pages = F.coalesce(pages, F.array().cast("array<string>"))
    size = F.greatest(F.lit(1).cast("bigint"), text_bytes(pages))
    pieces = F.flatten(F.transform(pages, lambda page: page_pieces(page, most)))

    def put_together(pieces: Column, each: Column) -> Column:
        count = F.ceil(F.size(pieces) / each).cast("int")
        return F.transform(
            F.sequence(F.lit(0), count - 1), lambda at: F.slice(pieces, at * each + 1, each)
        )

    def share(pieces: Column) -> Column:
        return F.greatest(F.lit(1), F.floor(F.size(pieces) * F.lit(most) / size)).cast("int")

    # Cut once, not again for every block.
    blocks = _given(pieces, lambda p: _given(share(p), lambda each: put_together(p, each)))
    return F.when(size > most, blocks).otherwise(F.array(pages))


def unicode_trim(text: Column) -> Column:
    """Strip every kind of Unicode white space; the built-in trim strips spaces only."""
    return F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")


def is_one_json_value(json: Column) -> Column:
    """Whether a text is a single JSON value with nothing after it.

    JSON functions stop at the end of the first value.  Put into an array and into an object, any
    further text spoils at least one of them.
    """
    items = F.json_array_length(F.concat(F.lit("["), json, F.lit("]")))
    keys = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), json, F.lit("}"))))
    return F.coalesce((items == 1) & (keys == 1), F.lit(False))


# Accessors of the map form of a document's counts.


def count_of(counts: Column, word: str | Column) -> Column:
    """Occurrences of a word, null when the document does not hold it."""
    return F.try_element_at(counts, F.lit(word) if isinstance(word, str) else word)


def distinct_terms(counts: Column) -> Column:
    return F.size(counts)


def has_no_terms(counts: Column) -> Column:
    return F.size(counts) == 0


def counted_terms(counts: Column) -> Column:
    return F.map_keys(counts)


def term_occurrences(counts: Column) -> Column:
    return F.map_values(counts)


def count_entries(counts: Column) -> Column:
    return F.map_entries(counts)
