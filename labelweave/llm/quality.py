"""Quality classification by positive-unlabelled learning.

Trusted positives (documents judged good) and unlabelled text are what the classifier learns from.
With class prior ``p`` the risk of a scorer ``g`` under the logistic loss ``l`` is

    p E+[l(g)]  +  max(0, E_u[l(-g)] - p E+[l(-g)])

where the second part estimates the risk on the unseen negatives from unlabelled text and can be
negative only by overfitting, hence the bound.  For a linear ``g`` and this loss the unbounded form
is convex, so Newton steps are taken; a step whose second part falls below zero is shortened.

Every step is one pass of Spark over the features of all documents; the driver sees sums whose size
depends on the number of features alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Staging
from .arrowtext import hash_runs, row_slices, text_buffer, words
from .shipping import map_arrow

#: Bytes of text worked on at once; some forty times as much is held for them.
_SLICE = 1 << 18
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Names of the features, in order.
FEATURES = (
    "constant",
    "log_bytes",
    "log_words",
    "word_bytes",
    "upper_share",
    "digit_share",
    "white_share",
    "other_script_share",
    "control_share",
    "distinct_word_share",
    "commonest_word_share",
    "repeated_line_share",
    "words_per_line",
    "words_with_sign_share",
    "upper_word_share",
    "sign_run_share",
    *(f"sign_{ord(sign)}" for sign in _SIGNS),
)
N_FEATURES = len(FEATURES)


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of features per text; shares are under a square root, which spreads small ones."""
    n = len(offsets) - 1
    out = np.zeros((n, N_FEATURES))
    out[:, 0] = 1
    if not n:
        return out
    size = np.diff(offsets).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(row_of * 256 + data, minlength=n * 256).reshape(n, 256).astype(float)
    bytes_ = np.maximum(size, 1)
    found, hashes = words(data, offsets)
    n_words = np.bincount(found, minlength=n).astype(float)
    words_ = np.maximum(n_words, 1)
    out[:, 1] = np.log1p(size)
    out[:, 2] = np.log1p(n_words)
    white = classes[:, [9, 10, 11, 12, 13, 32]].sum(axis=1)
    out[:, 3] = np.log1p((size - white) / words_)
    out[:, 4] = classes[:, 65:91].sum(axis=1) / bytes_
    out[:, 5] = classes[:, 48:58].sum(axis=1) / bytes_
    out[:, 6] = white / bytes_
    out[:, 7] = classes[:, 128:].sum(axis=1) / bytes_
    out[:, 8] = (classes[:, :9].sum(axis=1) + classes[:, 14:32].sum(axis=1)) / bytes_
    # Distinct words and the most frequent one.
    order = np.lexsort((hashes, found))
    rows, keys = found[order], hashes[order]
    first = np.ones(len(keys), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (keys[1:] != keys[:-1])
    starts = np.flatnonzero(first)
    times = np.diff(np.append(starts, len(keys)))
    out[:, 9] = np.bincount(rows[starts], minlength=n) / words_
    most = np.zeros(n)
    np.maximum.at(most, rows[starts], times)
    out[:, 10] = most / words_
    # Lines: how many repeat an earlier one of the same text.
    inside = data != 10
    edge = np.zeros(len(data) + 1, bool)
    edge[1:-1] = inside[1:] != inside[:-1]
    edge[offsets] = True
    edges = np.flatnonzero(edge)
    begins, ends = edges[:-1], edges[1:]
    line = inside[begins] if len(begins) else np.zeros(0, bool)
    begins, ends = begins[line], ends[line]
    of_line = np.searchsorted(offsets, begins, "right") - 1
    lines = np.bincount(of_line, minlength=n)
    key = hash_runs(data, begins, ends)
    order = np.lexsort((key, of_line))
    again = np.zeros(len(key), bool)
    again[1:] = (key[order][1:] == key[order][:-1]) & (of_line[order][1:] == of_line[order][:-1])
    out[:, 11] = np.bincount(of_line[order][again], minlength=n) / np.maximum(lines, 1)
    out[:, 12] = np.log1p(n_words / np.maximum(lines, 1))
    # Signs, alone and in runs, and words written in capitals.
    sign = np.zeros(256, bool)
    sign[[ord(s) for s in _SIGNS]] = True
    signs = sign[data]
    runs = signs[1:] & signs[:-1] & (row_of[1:] == row_of[:-1])
    out[:, 15] = np.bincount(row_of[1:][runs], minlength=n) / bytes_
    after = np.append(data[1:], 32)
    after[offsets[1:][offsets[1:] > 0] - 1] = 32
    ending = signs & ((after == 32) | (after == 10))
    out[:, 13] = np.bincount(row_of[ending], minlength=n) / words_
    upper = (data >= 65) & (data <= 90)
    both = upper[1:] & upper[:-1] & (row_of[1:] == row_of[:-1])
    out[:, 14] = np.bincount(row_of[1:][both], minlength=n) / words_
    out[:, 16:] = classes[:, [ord(s) for s in _SIGNS]] / bytes_[:, None]
    shares = [k for k in range(4, N_FEATURES) if k != 12]
    out[:, shares] = np.sqrt(out[:, shares])
    return out


@dataclass(frozen=True)
class QualityModel:
    """Weights of standardised features: ``score = sigmoid(clip((x - mean) / scale) . weights)``."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(standardised(x, self.mean, self.scale) @ self.weights)))


#: Standardised features are clipped here, so that no single text outweighs the others.
_CLIP = 8.0


def standardised(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - mean) / scale, -_CLIP, _CLIP)


def text_features(column: pa.Array) -> np.ndarray:
    data, offsets = text_buffer(column)
    parts = [
        features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for a, b in row_slices(offsets, _SLICE)
    ]
    return np.vstack(parts) if parts else np.zeros((0, N_FEATURES))


def extract(documents: DataFrame, text_column: str, kept: list[Column]) -> DataFrame:
    """``kept`` columns and ``x array<float>`` of every row; a null text counts as empty."""
    rows = documents.select(F.struct(*kept).alias("kept"), F.col(text_column).alias("text"))

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(1)).astype(np.float32)
            bounds = np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["kept", "x"])

    kind = rows.schema["kept"].dataType.simpleString()
    return map_arrow(rows, per_batch, f"kept {kind}, x array<float>").select("kept.*", "x")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_FEATURES).astype(float)


def _summed(rows: DataFrame, per_batch) -> np.ndarray:
    """Sum over all rows of the vectors that ``per_batch(positive, x)`` returns.

    Tasks add up their own rows; the driver sees one number per place of the vector.
    """

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0.0
        for batch in batches:
            if batch.num_rows:
                positive = batch.column(0).to_numpy(zero_copy_only=False).astype(bool)
                total = total + per_batch(positive, _matrix(batch.column(1)))
        if np.ndim(total):
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(total))), pa.array(total)], ["place", "value"]
            )

    sums = map_arrow(rows.select("positive", "x"), per_task, "place long, value double")
    found = sums.groupBy("place").agg(F.sum("value").alias("value")).toArrow()
    result = np.zeros(found.num_rows)
    result[found["place"].to_numpy()] = found["value"].to_numpy()
    return result


def fit(
    rows: DataFrame, prior: float, ridge: float = 0.01, most_steps: int = 14
) -> QualityModel:
    """Minimise the non-negative risk over all ``positive, x`` rows.

    Positive rows are trusted; all rows, positive ones included, are the unlabelled sample.
    Without rows or without positives all weights are 0, which scores every text 0.5.
    """
    d = N_FEATURES

    def moments(positive, x):
        return np.concatenate(([len(x), positive.sum()], x.sum(axis=0), (x * x).sum(axis=0)))

    sums = _summed(rows, moments)
    if not len(sums) or not sums[1]:
        return QualityModel(np.zeros(d), np.ones(d), np.zeros(d), prior)
    n_all, n_positive = sums[:2]
    mean = sums[2 : 2 + d] / n_all
    scale = np.sqrt(np.maximum(sums[2 + d :] / n_all - mean**2, 0))
    scale[scale < 1e-6] = 1
    mean[0], scale[0] = 0, 1
    weights = np.zeros(d)

    def passing(positive, x):
        z = standardised(x, mean, scale)
        g = z @ weights
        p = 1 / (1 + np.exp(-g))
        loss = np.logaddexp(0, g)  # of calling a row negative
        curve = (z * (p * (1 - p))[:, None]).T @ z
        return np.concatenate(
            (
                [loss.sum(), loss[positive].sum()],
                z[positive].sum(axis=0),
                (z * p[:, None]).sum(axis=0),
                curve.ravel(),
            )
        )

    previous = weights
    for _ in range(most_steps):
        sums = _summed(rows, passing)
        negative_risk = sums[0] / n_all - prior * sums[1] / n_positive
        if negative_risk < 0 and weights.any():
            weights = (weights + previous) / 2
            continue
        positive_mean, push = sums[2 : 2 + d] / n_positive, sums[2 + d : 2 + 2 * d] / n_all
        curve = sums[2 + 2 * d :].reshape(d, d) / n_all + ridge * np.eye(d)
        step = np.linalg.solve(curve, push - prior * positive_mean + ridge * weights)
        previous = weights
        weights = weights - step * min(1, 2 / np.abs(step).max())
        if np.abs(weights - previous).max() < 1e-3:
            break
    return QualityModel(mean, scale, weights, prior)


def positives(labels: DataFrame, id_column: str, label_column: str) -> tuple[DataFrame, float]:
    """Ids judged good, and the share of good ones among all judged: the class prior.

    An id judged more than once is good if any judgement is; null ids and judgements say nothing.
    """
    judged = (
        labels.filter(F.col(id_column).isNotNull() & F.col(label_column).isNotNull())
        .groupBy(id_column)
        .agg((F.max(label_column) == 1).alias("positive"))
    )
    n, good = judged.agg(F.count(F.lit(1)), F.count_if("positive")).first()
    # Kept off 0 and 1, where one of the two risks would vanish.
    return judged.filter("positive"), (good + 1) / (n + 2)


def train(
    documents: DataFrame,
    labels: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "quality",
    in_training: Column | None = None,
    staging: Staging | None = None,
) -> tuple[QualityModel, DataFrame]:
    """The model, and the staged features of all documents: ``<id>, training, positive, x``.

    ``in_training`` says which rows, of documents and of labels, may be learned from.
    """
    staging = staging or Staging(documents.sparkSession)
    chosen = F.lit(True) if in_training is None else in_training
    good, prior = positives(labels.filter(chosen), id_column, label_column)
    rows = extract(
        documents,
        text_column,
        [F.col(id_column).alias(id_column), F.coalesce(chosen, F.lit(False)).alias("training")],
    )
    # Features are joined, which are short; texts stay where they are.
    marked = rows.join(good, id_column, "left").withColumn(
        "positive", F.coalesce("positive", F.lit(False)) & F.col("training")
    )
    rows = staging.write(marked.select(id_column, "training", "positive", "x"), "features")
    return fit(rows.filter("training"), prior), rows


def score_features(rows: DataFrame, model: QualityModel) -> DataFrame:
    """``rows`` without ``x`` and with ``score``."""
    kept = [name for name in rows.columns if name != "x"]
    table = rows.select(F.struct(*kept).alias("kept"), "x")

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["kept", "score"])

    kind = table.schema["kept"].dataType.simpleString()
    return map_arrow(table, per_batch, f"kept {kind}, score double").select("kept.*", "score")


def score_texts(documents: DataFrame, model: QualityModel, text_column: str = "text") -> DataFrame:
    """Every row as struct ``kept`` with its ``score``; null and empty texts are scored too.

    Repeated rows get the same score; an empty table gives no rows.
    """
    rows = documents.select(F.struct("*").alias("kept"))
    place = documents.columns.index(text_column)

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = text_features(batch.column(0).field(place))
            score = model.score(x.astype(np.float32).astype(float))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["kept", "score"])

    kind = rows.schema["kept"].dataType.simpleString()
    return map_arrow(rows, per_batch, f"kept {kind}, score double")
