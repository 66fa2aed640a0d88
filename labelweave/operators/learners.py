"""Learners whose states merge: the class means of ``centroid``, and word counts per class."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from .centroid import TIE_BITS

#: Cells of the table of rows and classes that are worked out at once.
_CELLS = 1 << 22


@dataclass(frozen=True)
class ClassSums:
    """Rows per class, and the weights of every class and column, in the order of both."""

    labels: list[str]
    rows: np.ndarray
    classes: np.ndarray
    columns: np.ndarray
    sums: np.ndarray


def _narrow(numbers: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as they need."""
    return numbers.astype(np.min_scalar_type(int(numbers.max(initial=0))))


def _summed(labels, rows, classes, columns, sums) -> ClassSums:
    order = np.lexsort((columns, classes))
    classes, columns, sums = classes[order], columns[order], sums[order]
    if len(classes):
        fresh = np.ones(len(classes), dtype=bool)
        fresh[1:] = (classes[1:] != classes[:-1]) | (columns[1:] != columns[:-1])
        at = np.flatnonzero(fresh)
        classes, columns, sums = classes[at], columns[at], np.add.reduceat(sums, at)
    return ClassSums(labels, rows, _narrow(classes), _narrow(columns), sums)


def class_sums(rows) -> ClassSums:
    """The sums of some labelled rows."""
    labels, of = np.unique(rows.labels.astype(str), return_inverse=True)
    classes = np.repeat(of, np.diff(rows.starts))
    counts = np.bincount(of, minlength=len(labels)).astype(np.int64)
    return _summed(labels.tolist(), counts, classes, rows.columns, rows.weights)


def merged_sums(left: ClassSums, right: ClassSums) -> ClassSums:
    labels = sorted({*left.labels, *right.labels})
    place = {label: n for n, label in enumerate(labels)}
    counts = np.zeros(len(labels), np.int64)
    parts = []
    for side in (left, right):
        at = np.array([place[label] for label in side.labels], np.int64)
        np.add.at(counts, at, side.rows)
        parts.append((at[side.classes], side.columns, side.sums))
    return _summed(labels, counts, *(np.concatenate(c) for c in zip(*parts, strict=True)))


@dataclass(frozen=True)
class _Table:
    """Values of columns and classes, by column."""

    columns: np.ndarray
    starts: np.ndarray
    classes: np.ndarray
    values: np.ndarray

    @classmethod
    def of(cls, columns, classes, values) -> _Table:
        order = np.lexsort((classes, columns))
        found, first = np.unique(columns[order], return_index=True)
        starts = np.append(first, len(order))
        return cls(_narrow(found), _narrow(starts), _narrow(classes[order]), values[order])

    def products(self, rows, first: int, last: int, n_classes: int) -> np.ndarray:
        """Sums of weight times value for the rows from ``first`` to ``last`` and every class."""
        some = slice(rows.starts[first], rows.starts[last])
        columns, weights = rows.columns[some], rows.weights[some]
        row = np.repeat(np.arange(last - first), np.diff(rows.starts[first : last + 1]))
        if not len(self.columns) or not len(columns):
            return np.zeros((last - first, n_classes))
        # Looked for as numbers of the table's own kind, as the table would be converted else.
        asked = np.minimum(columns, self.columns[-1]).astype(self.columns.dtype)
        at = np.searchsorted(self.columns, asked)
        known = self.columns[at] == columns
        at, row, weights = at[known], row[known], weights[known]
        begin = self.starts[at].astype(np.int64)
        sizes = self.starts[at + 1] - begin
        shift = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes)
        held = np.arange(int(sizes.sum())) + shift
        cell = np.repeat(row, sizes) * n_classes + self.classes[held]
        values = np.repeat(weights, sizes) * self.values[held]
        total = np.bincount(cell, weights=values, minlength=(last - first) * n_classes)
        return total.reshape(last - first, n_classes)


def _steps(n_rows: int, n_classes: int):
    step = max(1, _CELLS // max(n_classes, 1))
    return ((at, min(at + step, n_rows)) for at in range(0, n_rows, step))


class CentroidLearner:
    """The nearest class mean, with the ties of the built-in classifier."""

    def partial(self, rows) -> ClassSums:
        return class_sums(rows)

    def merge(self, left: ClassSums, right: ClassSums) -> ClassSums:
        return merged_sums(left, right)

    def finish(self, state: ClassSums):
        means = state.sums / state.rows[state.classes]
        norms = np.bincount(state.classes, weights=means * means, minlength=len(state.labels))
        return state.labels, _Table.of(state.columns, state.classes, means), norms

    def labels(self, model) -> Sequence[str]:
        return model[0]

    def predict(self, model, rows) -> list[str]:
        labels, table, norms = model
        found: list[str] = []
        for first, last in _steps(len(rows), len(labels)):
            half = norms / 2 - table.products(rows, first, last, len(labels))
            size = np.maximum(norms, np.abs(half))
            step = np.ldexp(1.0, np.frexp(size)[1] - 1 - TIE_BITS)
            tie = np.where(size > 0, np.rint(half / step) * step, 0.0)
            found += [labels[c] for c in np.argmin(tie, axis=1)]
        return found


@dataclass(frozen=True)
class CountLearner:
    """Multinomial naive Bayes over the weights, none of which may be negative.

    ``smoothing`` is added to the weight of every column a class may hold; a column no training row
    holds says nothing.
    """

    smoothing: float = 1.0

    def partial(self, rows) -> ClassSums:
        if len(rows.weights) and rows.weights.min() < 0:
            raise ValueError("word counts cannot be negative")
        return class_sums(rows)

    def merge(self, left: ClassSums, right: ClassSums) -> ClassSums:
        return merged_sums(left, right)

    def finish(self, state: ClassSums):
        n = len(state.labels)
        known = len(np.unique(state.columns))
        totals = np.bincount(state.classes, weights=state.sums, minlength=n)
        floor = np.log(self.smoothing) - np.log(totals + self.smoothing * known)
        prior = np.log(state.rows / state.rows.sum())
        # What a class's own weight adds to the logarithm of a column it does not hold.
        more = np.log(state.sums + self.smoothing) - np.log(self.smoothing)
        every = _Table.of(np.unique(state.columns), np.zeros(known, np.int64), np.ones(known))
        return state.labels, _Table.of(state.columns, state.classes, more), floor, prior, every

    def labels(self, model) -> Sequence[str]:
        return model[0]

    def predict(self, model, rows) -> list[str]:
        labels, table, floor, prior, every = model
        found: list[str] = []
        for first, last in _steps(len(rows), len(labels)):
            weight = every.products(rows, first, last, 1)
            score = prior + weight * floor + table.products(rows, first, last, len(labels))
            found += [labels[c] for c in np.argmax(score, axis=1)]
        return found
