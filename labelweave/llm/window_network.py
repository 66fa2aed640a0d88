"""A bidirectional window network over classes of tokens, in numpy.

The network predicts the class of a token from the classes of the two tokens on either side: each
of the four has a row of weights, their sum goes through one hidden layer, which predicts a group of
classes and then the class within the group.  It is trained in rounds; every task trains a copy on
its own windows, and the copies are averaged by the windows behind them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .shipping import map_arrow

GROUPS = 32
GROUP_SIZE = 32
CLASSES = GROUPS * GROUP_SIZE
SIDE = 2
HIDDEN = 16
#: Every window is in one of so many rounds.
ROUNDS = 6
#: Most windows of a gradient step, and steps on the windows of a smaller block.
BATCH = 8192
STEPS = 16
#: A block of fewer windows is gone over until so many were seen.
LEAST = 1 << 14
#: Windows that are scored at once.
_AT_ONCE = 1 << 15
#: Weights that travel in a row, and how many copies are averaged first.
_SLOT = 4096
_MEMBERS = 64
_SHAPES = (
    (2 * SIDE, CLASSES, HIDDEN),
    (HIDDEN,),
    (HIDDEN, GROUPS),
    (GROUPS,),
    (GROUPS, HIDDEN, GROUP_SIZE),
    (GROUPS, GROUP_SIZE),
)


def _exponentials(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logits, their exponentials and the sums of those; large ones are shifted row by row first."""
    if logits.size and max(logits.max(), -logits.min()) > 60:
        logits = logits - logits.max(axis=1, keepdims=True)
    shares = np.exp(logits)
    return logits, shares, shares @ np.ones(shares.shape[1], shares.dtype)


def _log_share(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Logarithm of the share of one logit in every row."""
    logits, _, total = _exponentials(logits)
    return logits[np.arange(len(chosen)), chosen] - np.log(total)


def _errors(logits: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Shares, less one for the logit that is right."""
    _, shares, total = _exponentials(logits)
    shares *= (1 / total)[:, None]
    shares[np.arange(len(chosen)), chosen] -= 1
    return shares


@dataclass
class WindowNetwork:
    """Weights of the four places, of the hidden layer, of groups, and of classes within them."""

    places: np.ndarray
    hidden_bias: np.ndarray
    group: np.ndarray
    group_bias: np.ndarray
    within: np.ndarray
    within_bias: np.ndarray

    @staticmethod
    def start(class_counts: np.ndarray, seed: int = 11) -> WindowNetwork:
        """Of no window yet: what it predicts everywhere are the frequencies of the classes."""
        random = np.random.default_rng(seed)
        scales = (0.3, 0, 0.1, 0, 0.1, 0)
        weights = [
            (random.normal(0, 1, shape) * scale).astype(np.float32)
            for shape, scale in zip(_SHAPES, scales, strict=True)
        ]
        share = (class_counts + 0.5).reshape(GROUPS, GROUP_SIZE)
        weights[3] = np.log(share.sum(axis=1) / share.sum()).astype(np.float32)
        weights[5] = np.log(share / share.sum(axis=1, keepdims=True)).astype(np.float32)
        return WindowNetwork(*weights)

    def weights(self) -> list[np.ndarray]:
        return [
            self.places, self.hidden_bias, self.group,
            self.group_bias, self.within, self.within_bias,
        ]

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.weights()])

    @staticmethod
    def from_flat(values: np.ndarray) -> WindowNetwork:
        ends = np.cumsum([int(np.prod(shape)) for shape in _SHAPES])
        parts = np.split(values.astype(np.float32), ends[:-1])
        return WindowNetwork(*(p.reshape(s) for p, s in zip(parts, _SHAPES, strict=True)))

    def _hidden(self, context: np.ndarray) -> np.ndarray:
        # ``take`` gives the same rows as an index does, some times as fast.
        total = self.places[0].take(context[:, 0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.places[k].take(context[:, k], axis=0)
        return np.tanh(total + self.hidden_bias)

    def log_probabilities(self, context: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """Logarithm of the probability of each class given the four classes around it."""
        answer = np.empty(len(middle), np.float32)
        for first in range(0, len(middle), _AT_ONCE):
            some = slice(first, first + _AT_ONCE)
            order, runs, groups, places = _in_groups(middle[some])
            hidden = self._hidden(context[some].take(order, axis=0))
            found = _log_share(hidden @ self.group + self.group_bias, groups)
            for g, run in runs:
                inside = hidden[run] @ self.within[g] + self.within_bias[g]
                found[run] += _log_share(inside, places[run])
            answer[some][order] = found
        return answer

    def gradient(self, context: np.ndarray, middle: np.ndarray) -> list[np.ndarray]:
        """Of the mean negative log-probability of the classes in the middle."""
        n = len(middle)
        order, runs, groups, places = _in_groups(middle)
        context = context.take(order, axis=0)
        hidden = self._hidden(context)
        error = _errors(hidden @ self.group + self.group_bias, groups)
        back = error @ self.group.T
        within, within_bias = np.zeros_like(self.within), np.zeros_like(self.within_bias)
        for g, run in runs:
            inside = _errors(hidden[run] @ self.within[g] + self.within_bias[g], places[run])
            within[g], within_bias[g] = hidden[run].T @ inside, inside.sum(axis=0)
            back[run] += inside @ self.within[g].T
        back *= 1 - hidden**2
        # Sums by class and hidden unit; unit by unit this is far quicker than row by row.
        units = np.ascontiguousarray(back.T, dtype=float)
        rows = np.empty_like(self.places)
        for k in range(2 * SIDE):
            classes = context[:, k].astype(np.intp)
            for unit, values in enumerate(units):
                rows[k, :, unit] = np.bincount(classes, values, minlength=CLASSES)
        found = [
            rows, back.sum(axis=0), hidden.T @ error, error.sum(axis=0), within, within_bias
        ]
        return [g / np.float32(n) for g in found]


def _in_groups(classes: np.ndarray):
    """An order by groups, the run of each group in it, and groups and places in that order."""
    order = np.argsort(classes, kind="stable")
    groups, places = np.divmod(classes[order].astype(np.intp), GROUP_SIZE)
    ends = np.searchsorted(groups, np.arange(GROUPS), "right").tolist()
    runs = zip([0, *ends[:-1]], ends, strict=True)
    runs = [(g, slice(first, last)) for g, (first, last) in enumerate(runs) if last > first]
    return order, runs, groups, places


class Trainer:
    """Adam over windows, from the weights of a network."""

    def __init__(self, network: WindowNetwork, rate: float, seed: int) -> None:
        self.values = [w.copy() for w in network.weights()]
        self.first = [np.zeros_like(w) for w in self.values]
        self.second = [np.zeros_like(w) for w in self.values]
        self.random = np.random.default_rng(seed)
        self.rate, self.step = rate, 0

    def learn(self, context: np.ndarray, middle: np.ndarray) -> None:
        """Passes over the windows in random order, one if there are at least ``LEAST``."""
        size = min(max(len(middle) // STEPS, 32), BATCH)
        for _ in range(-(-LEAST // len(middle))):
            order = self.random.permutation(len(middle))
            for at in range(0, len(order), size):
                some = order[at : at + size]
                self._update(context.take(some, axis=0), middle.take(some))

    def _update(self, context: np.ndarray, middle: np.ndarray) -> None:
        self.step += 1
        gradient = WindowNetwork(*self.values).gradient(context, middle)
        scale = self.rate / (1 - 0.9**self.step)
        spread = 1 / (1 - 0.99**self.step)
        for value, g, m, v in zip(self.values, gradient, self.first, self.second, strict=True):
            m += np.float32(0.1) * (g - m)
            v += np.float32(0.01) * (g * g - v)
            value -= np.float32(scale) * m / (np.sqrt(v * np.float32(spread)) + np.float32(1e-8))

    def network(self) -> WindowNetwork:
        return WindowNetwork(*self.values)


def _average(table: pa.Table, member: bool) -> pa.Table:
    weight = table["weight"].to_numpy()
    total = sum(
        w * np.frombuffer(v.as_py(), np.float32).astype(float)
        for w, v in zip(weight, table["weights"], strict=True)
    )
    mean = (total / weight.sum()).astype(np.float32).tobytes()
    return pa.table(
        [
            table["slot"][:1],
            table["member"][:1] if member else pa.array([0], pa.int64()),
            pa.array([float(weight.sum())]),
            pa.array([mean], pa.binary()),
        ],
        ["slot", "member", "weight", "weights"],
    )


def train(
    blocks: DataFrame,
    windows: Callable[[pa.RecordBatch, int, slice], tuple[np.ndarray, np.ndarray]],
    class_counts: np.ndarray,
    rounds: int = ROUNDS,
) -> WindowNetwork:
    """A network trained on the windows of all blocks, each window in one of the rounds.

    ``windows(batch, row, some)`` gives the contexts and middles of some windows of a block, of
    which ``block`` is the first column.  A round brings the driver the averaged weights once; copies are averaged in two
    steps, so that no task gathers those of all tasks.
    """
    network = WindowNetwork.start(class_counts)
    if not class_counts.any():
        return network
    schema = "slot long, member long, weight double, weights binary"
    for number in range(rounds):
        shared = blocks.sparkSession.sparkContext.broadcast(network.flat())
        rate = 0.01 * 0.6**number

        def per_task(
            batches: Iterator[pa.RecordBatch], shared=shared, rate=rate, number=number
        ) -> Iterator[pa.RecordBatch]:
            trainer, seen, member = None, 0, 0
            for batch in batches:
                for row in range(batch.num_rows):
                    context, middle = windows(batch, row, slice(number, None, rounds))
                    if not len(middle):
                        continue
                    if trainer is None:
                        member = batch.column(0)[row].as_py()
                        trainer = Trainer(WindowNetwork.from_flat(shared.value), rate, number)
                    trainer.learn(context, middle)
                    seen += len(middle)
            if trainer is None:
                return
            flat = trainer.network().flat()
            slots = range(-(-len(flat) // _SLOT))
            # Blocks are numbered within a partition from a high bit on.
            member = (member ^ (member >> 24)) % _MEMBERS
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(slots, pa.int64()),
                    pa.array([member] * len(slots), pa.int64()),
                    pa.array([float(seen)] * len(slots)),
                    pa.array([flat[s * _SLOT : (s + 1) * _SLOT].tobytes() for s in slots]),
                ],
                ["slot", "member", "weight", "weights"],
            )

        copies = map_arrow(blocks, per_task, schema)
        some = copies.groupBy("slot", "member").applyInArrow(lambda t: _average(t, True), schema)
        mean = some.groupBy("slot").applyInArrow(lambda t: _average(t, False), schema).toArrow()
        parts = sorted(zip(mean["slot"].to_pylist(), mean["weights"].to_pylist(), strict=True))
        if parts:  # a round may fall between the windows of a very small corpus
            flat = np.concatenate([np.frombuffer(p, np.float32) for _, p in parts])
            network = WindowNetwork.from_flat(flat)
        shared.unpersist()
    return network
