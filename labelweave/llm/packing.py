"""Packing by power-of-two decomposition.

Every document's ids, an end id included, are cut into pieces whose lengths are powers of two: as
many of the full length as fit, then the binary digits of what is left, longest first.  A piece is a
training sequence by itself, so no sequence crosses documents and none needs padding.  Sequences are
numbered bucket by bucket, a bucket holding all pieces of one length, so that a range of numbers is
a batch of equal lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import Staging
from .arrowtext import text_buffer
from .shipping import map_arrow
from .tokens import run_tokens, text_parts

#: Parts a bucket is dealt out to when its pieces are numbered.
SLOTS = 1024


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Full pieces first, then the binary digits of the rest from the highest down."""
    whole, rest = divmod(tokens, longest)
    digits = [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [longest] * whole + digits


def document_ids(
    texts: pa.Array, tokenizer_path: str, end_id: int
) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ids of every text, the end id last."""
    table = run_tokens(tokenizer_path)
    data, offsets = text_buffer(texts)
    held_row, held = -1, []
    for first, part, bounds in text_parts(data, offsets):
        rows, where, lengths = table.look_up(part, bounds)
        n_rows = len(bounds) - 1
        before = np.cumsum(lengths) - lengths
        at = np.arange(int(lengths.sum())) + np.repeat(where - before, lengths)
        ids = table.ids[at].astype("<u4", copy=False)
        stops = np.cumsum(np.bincount(rows, weights=lengths, minlength=n_rows).astype(np.int64))
        for k in range(n_rows):
            if first + k != held_row:
                if held_row >= 0:
                    yield held_row, np.concatenate([*held, [end_id]]).astype("<u4")
                held_row, held = first + k, []
            held.append(ids[stops[k - 1] if k else 0 : stops[k]])
    if held_row >= 0:
        yield held_row, np.concatenate([*held, [end_id]]).astype("<u4")


def cut_into_pieces(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = 4096,
    end_id: int = 2,
    with_ids: bool = False,
) -> DataFrame:
    """``<id>, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids`` of every piece."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, length, crc, total, pieces = [], [], [], [], [], []
            for k, ids in document_ids(batch.column(1), tokenizer_path, end_id):
                at, raw = 0, memoryview(ids).cast("B")
                for n in piece_lengths(len(ids), longest):
                    row.append(k)
                    start.append(at)
                    length.append(n)
                    total.append(len(ids))
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    if with_ids:
                        pieces.append(ids[at : at + n].astype(np.int32))
                    at += n
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                *(pa.array(c, pa.int64()) for c in (start, length, crc, total)),
            ]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(pieces, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    if with_ids:
        schema += ", ids array<int>"
    packed = map_arrow(rows, per_batch, schema, keep=tokenizer_path)
    return packed.withColumnRenamed("id", id_column)


def pack(
    documents: DataFrame,
    tokenizer_path: str,
    id_column: str = "doc_id",
    text_column: str = "text",
    longest: int = 4096,
    end_id: int = 2,
    with_ids: bool = False,
    staging: Staging | None = None,
) -> DataFrame:
    """All pieces with ``sequence_id`` and ``offset``; see ``cut_into_pieces`` for the others.

    A null or empty text is the end id alone, one piece of length 1.  Repeated rows are packed
    each.  A null id stays null.  An empty table gives no rows.  Other columns are not read.
    Numbers follow from lengths, ids and starts, so they do not depend on the partitioning.
    """
    staging = staging or Staging(documents.sparkSession)
    cut = cut_into_pieces(
        documents, tokenizer_path, id_column, text_column, longest, end_id, with_ids
    )
    # Written once, so that the texts are tokenised once for counting and for numbering.
    slot = F.pmod(F.xxhash64(id_column), F.lit(SLOTS)).alias("slot")
    pieces = staging.write(cut.select("*", slot), "pieces")
    counts = pieces.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n"))
    # At most one row per length and slot, whatever the size of the corpus.
    before = Window.orderBy(F.desc("length"), "slot").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    rank = F.row_number().over(
        Window.partitionBy("length", "slot").orderBy(id_column, "start", "ids_crc32")
    )
    numbered = pieces.select("*", rank.alias("rank")).join(F.broadcast(base), ["length", "slot"])
    return numbered.select(
        id_column,
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("base") + F.col("rank") - 1).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
