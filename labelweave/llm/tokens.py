"""Token ids and counts of whole texts, as a public tokenizer's own library gives them.

Texts are cut at boundaries no token crosses, into runs of letters, digits or signs.  A run occurs
again and again, so the library encodes each distinct run once and its ids are remembered for the
batches that follow.  Memory is bounded: the memory of runs is emptied when it is full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrowtext import _LOWER, hash_runs, row_slices, text_buffer
from .shipping import left_behind, map_arrow

#: Distinct runs remembered by a worker, some 130 MB with all that goes with them.
MEMORY = 1_000_000
#: Bytes of text whose runs are looked up at once.
SLICE_BYTES = 1 << 20
#: Runs encoded in one call of the library.
_PER_CALL = 2_000

# Byte classes.  No run ends next to a joining byte: an apostrophe may belong to the letters after
# it, and bytes of other scripts may be letters, signs or marks.
_WHITE, _LETTER, _DIGIT, _SIGN, _JOINING = range(5)
_CLASS = np.full(256, _SIGN, dtype=np.uint8)
_CLASS[128:] = _JOINING
_CLASS[[0x20, 0x09, 0x0A, 0x0D]] = _WHITE
_CLASS[ord("'")] = _JOINING
_CLASS[ord("0") : ord("9") + 1] = _DIGIT
_CLASS[ord("a") : ord("z") + 1] = _LETTER
_CLASS[ord("A") : ord("Z") + 1] = _LETTER


class RunTokens:
    """Ids of runs of a lower-casing tokenizer that drops white space, kept by the run's hash."""

    def __init__(self, path: str, memory: int = MEMORY) -> None:
        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.memory = memory
        specials = {
            token.content: number
            for number, token in self.tokenizer.get_added_tokens_decoder().items()
        }
        self.specials = [s.encode() for s in specials]
        self.separator, self.separator_id = max(specials.items(), key=lambda kv: kv[1])
        self._forget()

    def _forget(self) -> None:
        self.hashes = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.lengths = np.zeros(0, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs end to end, and how many each has.

        Many runs go to the library as one text.  Between special tokens it normalises and cuts
        every part by itself, so the ids are those of the runs alone.
        """
        ids, lengths = [], []
        for first in range(0, len(runs), _PER_CALL):
            part = runs[first : first + _PER_CALL]
            joined = self.tokenizer.encode(self.separator.join(part), add_special_tokens=False)
            found = np.asarray(joined.ids, dtype=np.uint32)
            cuts = np.flatnonzero(found == self.separator_id)
            if len(cuts) != len(part) - 1:  # a run holds a special string itself
                each = self.tokenizer.encode_batch(part, add_special_tokens=False)
                lengths.append(np.array([len(e.ids) for e in each], np.int64))
                ids.extend(np.asarray(e.ids, dtype=np.uint32) for e in each)
                continue
            edges = np.concatenate(([-1], cuts, [len(found)]))
            lengths.append(np.diff(edges) - 1)
            ids.append(found[found != self.separator_id])
        return np.concatenate(ids), np.concatenate(lengths)

    def _learn(self, hashes: np.ndarray, runs: list[str]) -> None:
        """Remember unknown runs, given in the order of their hashes."""
        ids, lengths = self._encode(runs)
        where = len(self.ids) + np.cumsum(lengths) - lengths
        self.ids = np.concatenate((self.ids, ids))
        # One array after the other, so that only one is there twice; sorted hashes stay so.
        at = np.searchsorted(self.hashes, hashes)
        self.where = np.insert(self.where, at, where)
        self.lengths = np.insert(self.lengths, at, lengths.astype(np.int32))
        self.hashes = np.insert(self.hashes, at, hashes)

    def runs(self, data: np.ndarray, offsets: np.ndarray):
        """Bytes to encode, and the row, start and end of every run."""
        kind, small = _CLASS[data], _LOWER[data]
        if len(data):
            raw = data.tobytes()
            for special in self.specials:
                at = raw.find(special)
                while at >= 0:
                    # The stretch between white space that holds a special string stays whole.
                    first, last = at, at + len(special)
                    while first > 0 and kind[first - 1] != _WHITE:
                        first -= 1
                    while last < len(data) and kind[last] != _WHITE:
                        last += 1
                    kind[first:last] = _JOINING
                    small = small.copy()
                    small[first:last] = data[first:last]
                    at = raw.find(special, last)
        before, after = kind[:-1], kind[1:]
        cut = np.zeros(len(data) + 1, dtype=bool)
        cut[1:-1] = (before != after) & (
            (before == _WHITE)
            | (after == _WHITE)
            | ((before != _JOINING) & (after != _JOINING))
        )
        cut[offsets] = True
        cut[[0, -1]] = True
        edges = np.flatnonzero(cut)
        starts, ends = edges[:-1], edges[1:]
        keep = kind[starts] != _WHITE if len(starts) else np.zeros(0, bool)
        starts, ends = starts[keep], ends[keep]
        rows = np.searchsorted(offsets, starts, "right") - 1
        return small, rows, starts, ends

    def look_up(self, data: np.ndarray, offsets: np.ndarray):
        """Row of every run, and the place and number of its ids in ``self.ids``."""
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        small, rows, starts, ends = self.runs(data, offsets)
        hashes = hash_runs(small, starts, ends)
        distinct, example, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) + len(distinct) > self.memory:
            self._forget()
        at = np.searchsorted(self.hashes, distinct)
        known = np.zeros(len(distinct), dtype=bool)
        inside = at < len(self.hashes)
        known[inside] = self.hashes[at[inside]] == distinct[inside]
        if not known.all():
            raw, unknown = small.tobytes(), example[~known]
            texts = [
                raw[s:e].decode("utf-8", "replace")
                for s, e in zip(starts[unknown].tolist(), ends[unknown].tolist(), strict=True)
            ]
            self._learn(distinct[~known], texts)
            at = np.searchsorted(self.hashes, distinct)
        at = at[inverse]
        return rows, self.where[at], self.lengths[at]


def run_tokens(path: str) -> RunTokens:
    """The worker's table of runs, which later tasks of the same worker go on using.

    Their ``map_arrow`` has to keep it, by ``path``.
    """
    if path not in left_behind:
        left_behind[path] = RunTokens(path)
    return left_behind[path]


def text_parts(
    data: np.ndarray, offsets: np.ndarray, limit: int = SLICE_BYTES
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """First row, bytes and offsets of parts of about ``limit`` bytes.

    A longer text comes in several parts of one row each, cut at white space.
    """
    for first, last in row_slices(offsets, limit):
        part = data[offsets[first] : offsets[last]]
        if last - first > 1 or len(part) <= limit:
            yield first, part, offsets[first : last + 1] - offsets[first]
            continue
        at = 0
        while at < len(part):
            end = min(at + limit, len(part))
            if end < len(part):
                white = np.flatnonzero(_CLASS[part[at:end]] == _WHITE)
                if len(white):
                    end = at + int(white[-1]) + 1
                else:
                    white = np.flatnonzero(_CLASS[part[end:]] == _WHITE)
                    end = end + int(white[0]) + 1 if len(white) else len(part)
            yield first, part[at:end], np.array([0, end - at])
            at = end


def count_udf(path: str, limit: int = SLICE_BYTES):
    def count(texts: pa.Array) -> pa.Array:
        table = run_tokens(path)
        data, offsets = text_buffer(texts)
        found = np.zeros(len(texts), np.int64)
        for first, part, bounds in text_parts(data, offsets, limit):
            rows, _, lengths = table.look_up(part, bounds)
            found[first : first + len(bounds) - 1] += np.bincount(
                rows, weights=lengths, minlength=len(bounds) - 1
            ).astype(np.int64)
        return pa.array(found)

    return count


def token_counts(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    max_tokens: int = 2048,
) -> DataFrame:
    """``<id>, n_bytes, n_tokens, over_limit`` for every row.

    The tokenizer must drop white space, lower-case and cut between letters, digits and signs, as
    ``word_bpe`` files do.  Only lengths leave the worker.  Null and empty texts have 0 bytes and 0
    tokens; repeated rows are counted each; a null id stays null; an empty table gives no rows.
    Other columns are not read, so their names do not matter.
    """

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = count_udf(tokenizer_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), count(batch.column(2))],
                ["id", "n_bytes", "n_tokens"],
            )

    rows = documents.select(
        F.col(id_column).alias("id"),
        F.coalesce(F.octet_length(text_column), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_column).alias("text"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_bytes long, n_tokens long"
    counted = map_arrow(rows, per_batch, schema, keep=tokenizer_path)
    return counted.select(
        F.col("id").alias(id_column),
        "n_bytes",
        "n_tokens",
        over_limit(F.col("n_tokens"), max_tokens).alias("over_limit"),
    )


def over_limit(n_tokens: Column, max_tokens: int) -> Column:
    return n_tokens > max_tokens
