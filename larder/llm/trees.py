"""Boosted regression trees for binary labels, on binned features, in numpy.

Trees are complete and of fixed depth; split gains follow the second-order expansion of
the logistic loss. A split needs only sums per node, feature and bin, and a calibration only
counts per margin, so the rows themselves may be spread over any number of tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Trees:
    """feature and edge: (trees, inner nodes); leaf: (trees, leaves); scale and shift calibrate."""

    feature: np.ndarray
    edge: np.ndarray
    leaf: np.ndarray
    start: float
    scale: float = 1.0
    shift: float = 0.0
    #: Margins are rounded to this part before they are calibrated, 0 leaves them whole.
    parts: int = 0

    def margin(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, edge, leaf in zip(self.feature, self.edge, self.leaf):
            node = np.zeros(len(x), np.int64)
            while inner and len(x) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > edge[node])
            out += leaf[node - inner]
        return np.rint(out * self.parts) / self.parts if self.parts else out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.scale * self.margin(x) + self.shift)


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="lower"))
    return values[:-1].astype(np.float64) + np.diff(values) / 2


def _placed(cells: np.ndarray, feature: np.ndarray, cut: np.ndarray, levels: int) -> np.ndarray:
    """Node of each row after some levels of a tree."""
    flat, first = cells.ravel(), np.arange(len(cells)) * cells.shape[1]
    node = np.zeros(len(cells), np.int64)
    for _ in range(levels):
        node = 2 * node + 1 + (flat.take(first + feature.take(node)) > cut.take(node))
    return node


def advanced(cells: np.ndarray, margin: np.ndarray, grown: list) -> np.ndarray:
    """Margins of rows once further trees are added."""
    for feature, cut, leaf in grown:
        margin = margin + leaf[_placed(cells, feature, cut, int(len(leaf)).bit_length() - 1) - len(feature)]
    return margin


def sums(cells: np.ndarray, y: np.ndarray, n: np.ndarray, margin: np.ndarray, tree: tuple, level: int, bins: int) -> np.ndarray:
    """(2, nodes, features, bins): gradients and curvatures of one level of a tree, in 2^-20.

    Whole numbers, so sums over parts of the rows are the same in any order. ``cells`` are
    binned features, n says how often each row stands, margins are those of the trees before.
    """
    p = sigmoid(margin)
    both = [np.rint(v * (1 << 20)) * n for v in (y - p, p * (1 - p))]
    base, nodes = 2 ** level - 1, 2 ** level
    place = (_placed(cells, *tree, level) - base) * bins
    return np.stack([np.stack([np.bincount(place + cells[:, f], v, nodes * bins).reshape(nodes, bins)
                               for f in range(cells.shape[1])], axis=1) for v in both]).astype(np.int64)


def grow(level_sums, bins: int, share: float, rounds: int = 60, depth: int = 4, rate: float = 0.2,
         ridge: float = 1.0) -> tuple[list, float]:
    """(trees as feature, last bin that goes left, leaf values; the margin they start from).

    ``level_sums(grown, tree, level, start)`` gives ``sums`` over all rows: nothing else of
    the rows is needed, so they may lie anywhere. ``share`` is that of the positive ones.
    """
    inner = 2 ** depth - 1
    share = min(max(share, 1e-3), 1 - 1e-3)
    start, grown = float(np.log(share / (1 - share))), []
    for _ in range(rounds):
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins)
        for level in range(depth):
            base, nodes = 2 ** level - 1, 2 ** level
            g, h = level_sums(grown, (feature, cut), level, start).cumsum(axis=3) / (1 << 20)
            score = lambda a, b: a ** 2 / (b + ridge)
            gain = score(g[..., :-1], h[..., :-1]) + score(g[..., -1:] - g[..., :-1], h[..., -1:] - h[..., :-1]) - score(
                g[..., -1:], h[..., -1:])
            flat = gain.reshape(nodes, -1)
            at, every = flat.argmax(axis=1), np.arange(nodes)
            better = flat[every, at] > 1e-9
            feature[base:][:nodes][better] = (at // (bins - 1))[better]
            cut[base:][:nodes][better] = (at % (bins - 1))[better]
        # what goes left and right at the last level is what its leaves hold
        to = np.minimum(cut[base:], bins - 1)
        left, whole = (np.stack([v[every, feature[base:], i] for v in (g, h)]) for i in (to, np.full(nodes, bins - 1)))
        leaf = np.stack([left, whole - left], axis=2)
        grown.append((feature, cut, rate * (leaf[0] / (leaf[1] + ridge)).ravel()))
    return grown, start


def on_values(grown: list, start: float, edges: list[np.ndarray]) -> Trees:
    """Trees over bins as trees over values; ``edges`` are those of each feature."""
    edge = [[edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, cut)] for feature, cut, _ in grown]
    return Trees(np.array([t[0] for t in grown]), np.array(edge, float), np.array([t[2] for t in grown]), start)


def fit(x: np.ndarray, y: np.ndarray, bins: int = 32, **options) -> Trees:
    """Trees for labels y in {0, 1} of rows at hand; x is rows by features."""
    edges = [_edges(x[:, f], bins) for f in range(x.shape[1])]
    cells = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    ones = np.ones(len(y))
    grown, start = grow(lambda grown, tree, level, start: sums(
        cells, y, ones, advanced(cells, start * ones, grown), tree, level, bins), bins, y.mean(), **options)
    return on_values(grown, start, edges)


def platt(z: np.ndarray, y: np.ndarray, n: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Scale and shift of margins z that fit labels best, by Newton steps; n says how often each row stands."""
    ones, all_ = (n * y).sum(), n.sum()
    # labels pulled in from 0 and 1 by the counts keep the fit finite when classes are apart
    target = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (all_ - ones + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * z + b)
        w = n * np.maximum(p * (1 - p), 1e-9)
        hessian = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hessian, [(n * (target - p) * z).sum(), (n * (target - p)).sum()])
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -1, 1))
    return max(a, 1e-3), b


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> Trees:
    """The same trees, calibrated on held-out rows at hand."""
    return replace(model, **dict(zip(("scale", "shift"), platt(model.margin(x), y, np.ones(len(y))))))
