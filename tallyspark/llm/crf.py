"""Linear-chain conditional random field: fitting by L-BFGS, decoding by Viterbi."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: A feature has to occur in so many sequences to get a weight.
LEAST_SEQUENCES = 2


@dataclass(frozen=True)
class Crf:
    """Weights by feature and label; ``first`` by the first label; ``steps`` by label and next label."""

    weights: dict[str, tuple[float, ...]]
    first: tuple[float, ...]
    steps: tuple[tuple[float, ...], ...]

    def score(self, features) -> list[float]:
        """Sum of the weights of the features, by label; features not learned count nothing."""
        total = [0.0] * len(self.first)
        for feature in features:
            for label, weight in enumerate(self.weights.get(feature, ())):
                total[label] += weight
        return total

    def decode(self, scores: Sequence[Sequence[float]]) -> list[int]:
        """The most likely labels of a sequence of items with these scores; ties to the lower label."""
        if not scores:
            return []
        labels = range(len(self.first))
        best = [self.first[y] + scores[0][y] for y in labels]
        came = []
        for item in scores[1:]:
            before = [max(labels, key=lambda x, y=y: (best[x] + self.steps[x][y], -x)) for y in labels]
            best = [best[x] + self.steps[x][y] + item[y] for y, x in enumerate(before)]
            came.append(before)
        label = max(labels, key=lambda y: (best[y], -y))
        path = [label]
        for before in reversed(came):
            label = before[label]
            path.append(label)
        return path[::-1]


class Likelihood:
    """Negative log-likelihood of labelled sequences, with an L2 penalty, and its gradient.

    Sequences are worked through side by side, longest first, one item of each at a time.
    """

    def __init__(self, sequences: Sequence[Sequence[Sequence[int]]], labels: Sequence[Sequence[int]], features: int, kinds: int, l2: float):
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        sequences, labels = [sequences[i] for i in order], [labels[i] for i in order]
        self.features, self.kinds, self.l2 = features, kinds, l2
        sizes = np.array([len(s) for s in sequences])
        self.alive = [int((sizes > t).sum()) for t in range(int(sizes.max(initial=0)))]
        # items by place, then sequence
        items = [sequences[s][t] for t, n in enumerate(self.alive) for s in range(n)]
        self.gold = np.array([labels[s][t] for t, n in enumerate(self.alive) for s in range(n)], np.int64)
        self.feature = np.array([f for item in items for f in item], np.int64)
        self.item = np.repeat(np.arange(len(items)), [len(item) for item in items])
        self.begin = np.concatenate([[0], np.cumsum(self.alive)]).astype(np.int64)
        pairs = np.zeros((kinds, kinds))
        for t in range(1, len(self.alive)):
            n = self.alive[t]
            np.add.at(pairs, (self.gold[self.begin[t - 1] :][:n], self.gold[self.begin[t] :][:n]), 1)
        self.gold_pairs = pairs
        self.size = features * kinds + kinds + kinds * kinds

    def parts(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cut = self.features * self.kinds
        return (
            x[:cut].reshape(self.features, self.kinds),
            x[cut : cut + self.kinds],
            x[cut + self.kinds :].reshape(self.kinds, self.kinds),
        )

    def __call__(self, x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, first, steps = self.parts(x)
        n, kinds = len(self.gold), self.kinds
        scores = np.stack(
            [np.bincount(self.item, weights=weights[self.feature, y], minlength=n) for y in range(kinds)], 1
        )
        forward, backward = np.empty((n, kinds)), np.zeros((n, kinds))
        last = len(self.alive) - 1
        for t in range(last + 1):
            here = slice(self.begin[t], self.begin[t + 1])
            if t == 0:
                forward[here] = first + scores[here]
                continue
            before = forward[self.begin[t - 1] :][: self.alive[t]]
            forward[here] = np.logaddexp.reduce(before[:, :, None] + steps[None], axis=1) + scores[here]
        total, pair = 0.0, np.zeros((kinds, kinds))
        for t in range(last, -1, -1):
            alive = self.alive[t]
            ends = self.alive[t + 1] if t < last else 0
            a, b = self.begin[t], self.begin[t + 1]
            total += np.logaddexp.reduce(forward[a + ends : b], axis=1).sum()
            if ends:
                after = (scores[b : b + ends] + backward[b : b + ends])[:, None, :] + steps[None]
                backward[a : a + ends] = np.logaddexp.reduce(after, axis=2)
                whole = np.logaddexp.reduce(forward[a : a + ends] + backward[a : a + ends], axis=1)
                pair += np.exp(forward[a : a + ends, :, None] + after - whole[:, None, None]).sum(0)
            assert alive >= ends
        joint = forward + backward
        chance = np.exp(joint - np.logaddexp.reduce(joint, axis=1)[:, None])
        chosen = np.arange(n)
        gold = scores[chosen, self.gold].sum() + (self.gold_pairs * steps).sum()
        starts = self.alive[0] if self.alive else 0
        gold += first[self.gold[:starts]].sum()
        excess = chance.copy()
        excess[chosen, self.gold] -= 1
        by_feature = np.stack(
            [np.bincount(self.feature, weights=excess[self.item, y], minlength=self.features) for y in range(kinds)], 1
        )
        gradient = np.concatenate([by_feature.ravel(), excess[:starts].sum(0), (pair - self.gold_pairs).ravel()])
        return float(total - gold + self.l2 / 2 * (x @ x)), gradient + self.l2 * x


def minimise(f: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int = 80, memory: int = 8) -> np.ndarray:
    """L-BFGS with a backtracking line search, for a convex function with its gradient."""
    value, gradient = f(x)
    moves: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        direction, alphas = gradient.copy(), []
        for s, y, rho in reversed(moves):
            alphas.append(rho * (s @ direction))
            direction -= alphas[-1] * y
        if moves:
            s, y, _ = moves[-1]
            direction *= (s @ y) / (y @ y)
        for (s, y, rho), alpha in zip(moves, reversed(alphas), strict=True):
            direction += (alpha - rho * (y @ direction)) * s
        slope = gradient @ direction
        step = 1.0 if moves else 1.0 / max(1.0, float(np.abs(gradient).max()))
        while step > 1e-10:
            x_new = x - step * direction
            value_new, gradient_new = f(x_new)
            if value_new <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            return x
        s, y = x_new - x, gradient_new - gradient
        if s @ y > 1e-12:
            moves = [*moves, (s, y, 1 / (s @ y))][-memory:]
        done = value - value_new <= 1e-6 * max(1.0, abs(value))
        x, value, gradient = x_new, value_new, gradient_new
        if done:
            return x
    return x


def fit(sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[int]], kinds: int = 2, l2: float = 0.5) -> Crf:
    """A field over the features that occur in two sequences at least; empty sequences teach nothing."""
    seen: dict[str, int] = {}
    for sequence in sequences:
        for feature in {f for item in sequence for f in item}:
            seen[feature] = seen.get(feature, 0) + 1
    names = sorted(f for f, n in seen.items() if n >= LEAST_SEQUENCES)
    number = {f: i for i, f in enumerate(names)}
    used = [i for i, sequence in enumerate(sequences) if len(sequence)]
    coded = [[[number[f] for f in item if f in number] for item in sequences[i]] for i in used]
    loss = Likelihood(coded, [labels[i] for i in used], len(names), kinds, l2)
    weights, first, steps = loss.parts(minimise(loss, np.zeros(loss.size)))
    return Crf(
        {f: tuple(weights[i].tolist()) for f, i in number.items()},
        tuple(first.tolist()),
        tuple(tuple(row) for row in steps.tolist()),
    )
