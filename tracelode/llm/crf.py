"""Linear-chain conditional random field with two labels, many chains at a time.

Chains lie one after another in flat arrays.  With two labels, forward and backward
messages are one log-ratio for each position, and a step of the recurrence is done for all
chains at once (the longest first, so that the chains that still run are a prefix).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chains:
    """Flat positions [starts[i], starts[i] + lengths[i]) of each chain."""

    starts: np.ndarray
    lengths: np.ndarray
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        keep = np.flatnonzero(self.lengths > 0)
        self.order = keep[np.argsort(-self.lengths[keep], kind="stable")]

    def steps(self):
        """For t = 0, 1, ...: the flat positions of the t-th members of all chains that reach so far."""
        starts, lengths = self.starts[self.order], self.lengths[self.order]
        if not len(lengths):
            return
        alive = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
        for t, n in enumerate(alive):
            yield starts[:n] + t


@dataclass
class Features:
    """Feature numbers of each position, any number of them: ``numbers`` one after another and ``owner``, the position of each."""

    numbers: np.ndarray
    owner: np.ndarray
    positions: int

    @classmethod
    def of(cls, lists: list[list[int]]) -> Features:
        numbers = np.fromiter((x for own in lists for x in own), dtype=np.int64)
        return cls(numbers, np.repeat(np.arange(len(lists)), [len(own) for own in lists]), len(lists))

    def sums(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner, weights=weights[self.numbers], minlength=self.positions)


def _through(ratio: np.ndarray, w00: float, w10: float, w01: float, w11: float) -> np.ndarray:
    """log((e^w01 + e^(ratio + w11)) / (e^w00 + e^(ratio + w10)))."""
    return np.logaddexp(w01, ratio + w11) - np.logaddexp(w00, ratio + w10)


@dataclass
class Model:
    """``bias`` of label 1 at a chain's begin; ``moves[i, j]`` scores label i followed by j; ``weights`` by feature."""

    weights: np.ndarray
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    bias: float = 0.0

    def messages(self, delta: np.ndarray, chains: Chains) -> tuple[np.ndarray, np.ndarray]:
        m, ahead, behind = self.moves, np.array(delta, dtype=np.float64), np.zeros(len(delta))
        steps = list(chains.steps())
        for t, at in enumerate(steps):
            ahead[at] += self.bias if not t else _through(ahead[at - 1], m[0, 0], m[1, 0], m[0, 1], m[1, 1])
        for at in reversed(steps[1:]):
            behind[at - 1] = _through(delta[at] + behind[at], m[0, 0], m[0, 1], m[1, 0], m[1, 1])
        return ahead, behind

    def marginals(self, delta: np.ndarray, chains: Chains) -> np.ndarray:
        """P(label 1) at each position by forward-backward."""
        ahead, behind = self.messages(delta, chains)
        return 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))

    def viterbi(self, delta: np.ndarray, chains: Chains) -> np.ndarray:
        """The best labels; ties go to label 0."""
        m, n = self.moves, len(delta)
        best, back = np.zeros((n, 2)), np.zeros((n, 2), dtype=np.int8)
        steps = list(chains.steps())
        for t, at in enumerate(steps):
            if not t:
                best[at, 1] = delta[at] + self.bias
                continue
            from0, from1 = best[at - 1, 0], best[at - 1, 1]
            for j in (0, 1):
                a, b = from0 + m[0, j], from1 + m[1, j]
                back[at, j] = b > a
                best[at, j] = np.maximum(a, b) + (delta[at] if j else 0)
        labels = np.zeros(n, dtype=np.int8)
        if n:
            ends = chains.starts[chains.order] + chains.lengths[chains.order] - 1
            labels[ends] = best[ends, 1] > best[ends, 0]
        for at in reversed(steps[1:]):
            labels[at - 1] = back[at, labels[at]]
        return labels


def fit(features: Features | np.ndarray, labels: np.ndarray, chains: Chains, size: int, rounds: int = 60, rate: float = 0.3, penalty: float = 1e-4) -> Model:
    """Maximum conditional likelihood by full-batch Adagrad; feature numbers are under ``size``.  A matrix (positions x features) will do."""
    if isinstance(features, np.ndarray):
        features = Features.of(features.tolist())
    model = Model(np.zeros(size))
    squares, move_squares, bias_square = np.full(size, 1e-8), np.full((2, 2), 1e-8), 1e-8
    first = chains.starts[chains.order]
    inner = np.ones(len(labels), dtype=bool)
    inner[first] = False
    later = np.flatnonzero(inner)
    y = labels.astype(np.float64)
    seen = np.zeros((2, 2))
    np.add.at(seen, (labels[later - 1], labels[later]), 1)
    for _ in range(rounds):
        delta = features.sums(model.weights)
        ahead, behind = model.messages(delta, chains)
        p = 1 / (1 + np.exp(-np.clip(ahead + behind, -60, 60)))
        right = delta[later] + behind[later]
        pair = np.stack([np.full(len(later), model.moves[0, 0]), model.moves[0, 1] + right, model.moves[1, 0] + ahead[later - 1], model.moves[1, 1] + ahead[later - 1] + right])
        pair = np.exp(pair - pair.max(axis=0))
        expected = (pair / pair.sum(axis=0)).sum(axis=1).reshape(2, 2)
        miss = y - p
        gradient = np.bincount(features.numbers, weights=miss[features.owner], minlength=size) / len(first) - penalty * model.weights
        squares += gradient**2
        model.weights += rate * gradient / np.sqrt(squares)
        gradient = (seen - expected) / len(first)
        move_squares += gradient**2
        model.moves += rate * gradient / np.sqrt(move_squares)
        gradient = miss[first].sum() / len(first)
        bias_square += gradient**2
        model.bias += rate * gradient / np.sqrt(bias_square)
    return model
