"""Label models: reliabilities of noisy labelling functions by expectation maximisation, from counts of vote patterns.

A vote is 1 (yes), 0 (no) or -1 (abstains). Only the distinct patterns of votes and their counts reach the driver; with
v functions there are at most 3 ** v of them, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def fit(patterns: np.ndarray, counts: np.ndarray, prior: float = 0.1, rounds: int = 60, right: float = 0.9, most: float = 0.5) -> tuple[float, np.ndarray]:
    """Share of the class, and table [function, class, vote + 1] of vote probabilities. Starts from functions that are right mostly."""
    v = patterns.shape[1]
    table = np.empty((v, 2, 3))
    for j in range(v):
        speaks = np.clip(counts[patterns[:, j] >= 0].sum() / max(counts.sum(), 1), 0.01, 0.99)
        table[j, 0] = [1 - speaks, speaks * right, speaks * (1 - right)]
        table[j, 1] = [1 - speaks, speaks * (1 - right), speaks * right]
    for _ in range(rounds):
        p = posterior(patterns, prior, table)
        weight = np.stack([(1 - p) * counts, p * counts])
        prior = float(np.clip((weight[1].sum() + 0.5) / (counts.sum() + 1), 1e-5, most))
        for j in range(v):
            for c in (0, 1):
                n = np.array([weight[c, patterns[:, j] == vote].sum() for vote in (-1, 0, 1)])
                start = np.array([0.4, 0.5, 0.1]) if c == 0 else np.array([0.4, 0.1, 0.5])
                new = (n + 20 * start) / (n.sum() + 20)
                # A yes must not speak against the class, nor a no for it.
                table[j, c] = new
            yes, no = table[j, :, 2], table[j, :, 1]
            if yes[1] < yes[0]:
                table[j, :, 2] = yes.mean()
            if no[0] < no[1]:
                table[j, :, 1] = no.mean()
    return prior, table


def posterior(patterns: np.ndarray, prior: float, table: np.ndarray) -> np.ndarray:
    log = np.log(np.array([1 - prior, prior]))[None, :].repeat(len(patterns), 0)
    for j in range(patterns.shape[1]):
        log = log + np.log(table[j][:, patterns[:, j] + 1].T)
    log -= log.max(axis=1, keepdims=True)
    e = np.exp(log)
    return e[:, 1] / e.sum(axis=1)


def cutoff(p: np.ndarray, counts: np.ndarray, judge: np.ndarray | None = None) -> float:
    """The posterior from which on the expected F1 is best; never under one half. With judge, what is true is what that says,
    the posteriors of a model that was fitted on other rows."""
    judge = p if judge is None else judge
    order = np.argsort(-p, kind="stable")
    hit, all_ = np.cumsum((judge * counts)[order]), np.cumsum(counts[order])
    f1 = 2 * hit / np.maximum(all_ + (judge * counts).sum(), 1e-9)
    return max(0.5, float(p[order][int(np.argmax(f1))])) if len(p) else 0.5


class Ngrams:
    """Logistic regression over hashed features, by Adagrad steps over shuffled batches."""

    def __init__(self, bits: int = 17, seed: int = 5):
        self.size, self.seed = 1 << bits, seed
        self.w = np.zeros(self.size)

    def fit(self, rows: np.ndarray, y: np.ndarray, rounds: int = 6, rate: float = 0.4, weight: np.ndarray | None = None) -> Ngrams:
        """rows: the same number of feature indices for each row."""
        rng, seen = np.random.default_rng(self.seed), np.full(self.size, 1e-6)
        weight = np.ones(len(y)) if weight is None else weight
        for _ in range(rounds):
            order = rng.permutation(len(y))
            for a in range(0, len(order), 64):
                at = order[a : a + 64]
                g = (self.score(rows[at]) - y[at]) * weight[at]
                step = np.zeros(0)
                where = rows[at].ravel()
                step = np.repeat(g, rows.shape[1])
                total = np.bincount(np.unique(where, return_inverse=True)[1], step)
                where = np.unique(where)
                seen[where] += total**2
                self.w[where] -= rate * total / np.sqrt(seen[where])
        return self

    def score(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.w[rows].sum(axis=1), -30, 30)))


#: Slopes and losses are summed as whole parts of these, so that sums are the same in any order.
_SLOPE, _LOSS = 1 << 30, 1 << 20


def slope(w: np.ndarray, rows: np.ndarray, y: np.ndarray, most: int = 100_000) -> np.ndarray:
    """Of the logistic loss of these rows at w: the slope at each feature and, last, the loss, both in whole parts."""
    out = np.zeros(len(w) + 1, np.int64)
    for a in range(0, len(y), most):
        x, t = rows[a : a + most], y[a : a + most]
        z = np.clip(w[x].sum(axis=1), -30, 30)
        g = np.rint((1 / (1 + np.exp(-z)) - t) * _SLOPE)
        out[:-1] += np.bincount(x.ravel(), np.repeat(g, x.shape[1]), len(w)).astype(np.int64)
        out[-1] += np.rint(np.logaddexp(0, np.where(t > 0, -z, z)) * _LOSS).astype(np.int64).sum()
    return out


def logistic(slopes: Callable[[np.ndarray], np.ndarray], bits: int = 17, ridge: float = 0.1, passes: int = 40, kept: int = 8) -> np.ndarray:
    """Weights of the least logistic loss with ridge / 2 times their squares, by L-BFGS; slopes(w): the sum of slope() over all rows.

    Steps are measured by the curvature at the start, a quarter of the rows of each feature: at weights without bound the slope
    counts the rows of no, from which, with that at 0, those of yes follow.
    """

    def at(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = slopes(w)
        return s[-1] / _LOSS + ridge / 2 * float(w @ w), s[:-1] / _SLOPE + ridge * w

    w = np.zeros(1 << bits)
    f, g = at(w)
    curve = (slopes(w + 1e3)[:-1] / _SLOPE - g) / 2 + ridge
    least, past, used = 1e-3 * float(np.sqrt(g @ (g / curve))), [], 2
    while used < passes and np.sqrt(g @ (g / curve)) > least:
        d, a = g.copy(), []
        for s, y, r in reversed(past):
            a.append(r * float(s @ d))
            d -= a[-1] * y
        d /= curve
        if past:
            s, y, _ = past[-1]
            d *= float(s @ y) / float(y @ (y / curve))
        for (s, y, r), b in zip(past, reversed(a)):
            d += (b - r * float(y @ d)) * s
        step, down = 1.0, float(g @ d)
        while True:
            new = w - step * d
            value, turn = at(new)
            used += 1
            if value <= f - 1e-4 * step * down or used >= passes or step < 1e-6:
                break
            step /= 2
        if value >= f:
            break
        s, y = new - w, turn - g
        if float(s @ y) > 0:
            past = [*past, (s, y, 1 / float(s @ y))][-kept:]
        w, f, g = new, value, turn
    return w
