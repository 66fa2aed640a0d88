"""Language identification by multilingual mixture inference.

A language is a distribution over hashed byte n-grams, counted over every training text.  A document
is a mixture of languages: expectation-maximisation estimates its proportions from its n-gram
counts.  Of the sets made of its one, two, ... largest languages, the one with the highest
likelihood after a penalty of ``penalty * log(n-grams)`` per further language is taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import InvalidInput
from .arrowtext import _LOWER, _ODD, mix, row_slices, text_buffer
from .shipping import map_arrow

UNDETERMINED = "und"
#: Buckets n-grams are hashed to; with the number of languages it bounds the model's size.
BUCKET_BITS = 16
MAX_LANGUAGES = 512
_SLICE = 1 << 20


def gram_buckets(data: np.ndarray, offsets: np.ndarray, size: int = 3):
    """Row and bucket of every n-gram of lower-cased bytes, each row between two spaces."""
    n_rows = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    bounds = np.concatenate(([0], np.cumsum(lengths)))
    padded = np.full(int(bounds[-1]) + size, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(2 * np.arange(n_rows) + 1, np.diff(offsets))
    padded[at] = _LOWER[data]
    value = np.zeros(int(bounds[-1]), np.uint64)
    for k in range(size):
        value |= padded[k : k + len(value)].astype(np.uint64) << np.uint64(8 * k)
    bucket = mix(value * _ODD[3]) >> np.uint64(64 - BUCKET_BITS)
    rows = np.repeat(np.arange(n_rows), lengths)
    # The last places of a row would reach into the next one.
    inside = np.arange(len(value)) - np.repeat(bounds[:-1], lengths) <= np.repeat(
        lengths - size, lengths
    )
    return rows[inside], bucket[inside].astype(np.int64)


@dataclass(frozen=True)
class LanguageModel:
    """Names in order, and the probability of every bucket (rows) in every language (columns)."""

    names: list[str]
    probability: np.ndarray


def count_grams(texts: DataFrame) -> DataFrame:
    """``lang, bucket, n`` of all rows of ``lang, text``."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            names = np.array(batch.column(0).to_pylist(), dtype=object)
            data, offsets = text_buffer(batch.column(1))
            for first, last in row_slices(offsets, _SLICE):
                own = names[first:last]
                rows, buckets = gram_buckets(
                    data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
                )
                for name in set(own):
                    picked = buckets[(own == name)[rows]]
                    found = np.bincount(picked, minlength=1 << BUCKET_BITS)
                    counts[name] = counts.get(name, 0) + found
        for name, found in counts.items():
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(some), pa.string()), pa.array(some), pa.array(found[some])],
                ["lang", "bucket", "n"],
            )

    counted = map_arrow(texts, per_task, "lang string, bucket long, n long")
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def train(
    documents: DataFrame,
    lang_column: str = "lang",
    text_column: str = "text",
    smoothing: float = 0.5,
) -> LanguageModel:
    """Count the n-grams of every row with a language and a text.

    The driver sees at most ``MAX_LANGUAGES * 2**BUCKET_BITS`` sums; more languages are refused.
    """
    texts = documents.select(
        F.col(lang_column).cast("string").alias("lang"), F.col(text_column).alias("text")
    ).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = count_grams(texts).toArrow()
    names = sorted(set(counts["lang"].to_pylist()))
    if len(names) > MAX_LANGUAGES:
        raise InvalidInput(f"more than {MAX_LANGUAGES} languages")
    table = np.zeros((1 << BUCKET_BITS, len(names)))
    index = {name: k for k, name in enumerate(names)}
    columns = np.array([index[name] for name in counts["lang"].to_pylist()], dtype=np.int64)
    table[counts["bucket"].to_numpy(), columns] = counts["n"].to_numpy()
    table += smoothing
    return LanguageModel(names, (table / table.sum(axis=0)).astype(np.float32))


def _expectation_maximisation(p, count, starts, rows, theta, rounds):
    """Proportions per document after some rounds, and the log-likelihood under them.

    ``p`` holds the probabilities of every document's distinct n-grams, ``count`` how often each
    occurs, ``rows`` the document it is in and ``starts`` where that document begins.
    """
    total = np.add.reduceat(count, starts)[:, None]
    for _ in range(rounds):
        weighted = p * theta[rows]
        weighted *= (count / weighted.sum(axis=1))[:, None]
        theta = np.add.reduceat(weighted, starts, axis=0) / total
    likelihood = np.log((p * theta[rows]).sum(axis=1)) * count
    return theta, np.add.reduceat(likelihood, starts)


def infer(model: LanguageModel, data, offsets, penalty: float = 3.0):
    """Language number and its proportion for every row; -1 for rows without n-grams.

    A row's set of languages grows as long as that raises the penalised likelihood of any row.
    """
    n_rows, n_langs = len(offsets) - 1, len(model.names)
    best, score = np.full(n_rows, -1), np.zeros(n_rows)
    rows, buckets = gram_buckets(data, offsets)
    if not len(rows) or not n_langs:
        return best, score
    keys, count = np.unique((rows << BUCKET_BITS) | buckets, return_counts=True)
    rows, buckets = keys >> BUCKET_BITS, keys & ((1 << BUCKET_BITS) - 1)
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    present = rows[starts]
    local = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rows))))
    p, count = model.probability[buckets], count.astype(np.float32)
    theta = np.full((len(starts), n_langs), 1 / n_langs, np.float32)
    theta, _ = _expectation_maximisation(p, count, starts, local, theta, 8)
    rank = np.argsort(np.argsort(-theta, axis=1, kind="stable"), axis=1)
    cost = penalty * np.log(np.add.reduceat(count, starts))
    chosen, value = theta, np.full(len(starts), -np.inf)
    for size in range(1, n_langs + 1):
        start = np.where(rank < size, theta + 1e-6, 0).astype(np.float32)
        start /= start.sum(axis=1, keepdims=True)
        # One language has no proportions to estimate.
        own, likelihood = _expectation_maximisation(
            p, count, starts, local, start, 0 if size == 1 else 4
        )
        penalised = likelihood - size * cost
        better = penalised > value
        if not better.any():
            break
        chosen = np.where(better[:, None], own, chosen)
        value = np.where(better, penalised, value)
    best[present] = np.argmax(chosen, axis=1)
    score[present] = chosen[np.arange(len(starts)), best[present]]
    return best, np.clip(score, 0, 1)


def identify(
    documents: DataFrame, model: LanguageModel, text_column: str = "text", penalty: float = 3.0
) -> DataFrame:
    """Every row as struct ``kept`` with ``lang_pred`` and ``score``, whatever its columns' names.

    A null text and one without a letter are ``und`` with score 0, and so is every text if there
    is no learned language.  Equally large languages go to the first by name.  Repeated rows and
    null ids are kept as they are; an empty table gives no rows.
    """
    context = documents.sparkSession.sparkContext
    shared = context.broadcast((model.names, model.probability))
    letters = F.coalesce(F.col(text_column).rlike(r"\p{L}"), F.lit(False))
    texts = documents.select(F.struct("*").alias("kept"), letters.alias("letters"))
    place = documents.columns.index(text_column)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = LanguageModel(*shared.value)
        names = np.array([*own.names, UNDETERMINED], dtype=object)
        for batch in batches:
            data, offsets = text_buffer(batch.column(0).field(place))
            empty = ~batch.column(1).to_numpy(zero_copy_only=False)
            best, score = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            for first, last in row_slices(offsets, _SLICE):
                best[first:last], score[first:last] = infer(
                    own,
                    data[offsets[first] : offsets[last]],
                    offsets[first : last + 1] - offsets[first],
                    penalty,
                )
            best[empty], score[empty] = -1, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names[best], pa.string()), pa.array(score)],
                ["kept", "lang_pred", "score"],
            )

    kind = texts.schema["kept"].dataType.simpleString()
    return map_arrow(texts, per_batch, f"kept {kind}, lang_pred string, score double")


def predict(
    documents: DataFrame,
    model: LanguageModel,
    id_column: str = "doc_id",
    text_column: str = "text",
    penalty: float = 3.0,
) -> DataFrame:
    """``<id>, lang_pred, score`` of every row; see ``identify``."""
    rows = documents.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = identify(rows.select("id", "text"), model, "text", penalty)
    return found.select(F.col("kept.id").alias(id_column), "lang_pred", "score")


def fold(id_column: str, folds: int) -> Column:
    """Number of the fold a row belongs to, from the checksum of its id as text."""
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(folds))
