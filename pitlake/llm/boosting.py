"""Gradient-boosted trees fitted on sums that any number of tasks can add up, small enough to be sent to every task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Gradients are whole multiples of 1 / SCALE, so their sums don't depend on the order of rows or on where they are added.
SCALE = 1 << 24
#: A bin that nothing lies above.
NEVER = 255


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def coarse(x: np.ndarray) -> np.ndarray:
    """Values cut to nine significant bits, in the same order, so that a column has few different ones."""
    return (np.ascontiguousarray(x, dtype=np.float64).view(np.int64) >> 44 << 44).view(np.float64)


def quantiles(values: np.ndarray, counts: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``np.quantile`` of values that occur ``counts`` times each."""
    order = np.argsort(values)
    values, ends = values[order], np.cumsum(counts[order])
    place = q * (ends[-1] - 1)
    low, high = (values[np.searchsorted(ends, at, side="right")] for at in (np.floor(place), np.ceil(place)))
    return low + (high - low) * (place - np.floor(place))


class BoostedTrees:
    """Logistic boosting; each tree splits all nodes of a level, at quantiles of the features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 16, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.start = 0.0
        self.cuts: list[np.ndarray] = []
        self.trees: list[tuple[list[tuple[int, int]], np.ndarray]] = []

    def cut(self, histograms: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Take the limits of the bins from each feature's values and their counts."""
        self.cuts = [np.unique(quantiles(v, n, np.linspace(0, 1, self.bins + 1)[1:-1])) for v, n in histograms]

    def binned(self, x: np.ndarray) -> np.ndarray:
        """For each value the number of limits under it."""
        return np.stack([np.searchsorted(c, column, side="left") for c, column in zip(self.cuts, x.T, strict=True)], axis=1).astype(np.uint8)

    def shape(self, splits: list) -> tuple[int, int, int, int]:
        return 3, 1 << len(splits), len(self.cuts), self.bins

    def level(self, bins: np.ndarray, right: np.ndarray, wrong: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        """Rows, gradients and curvatures by node, feature and bin, for a tree that has ``splits`` so far; a row of ``bins`` stands for ``right`` and ``wrong`` examples."""
        p = self.predict_binned(bins)
        share, curve = np.rint(p * SCALE), np.rint(p * (1 - p) * SCALE)
        weights = right + wrong, right * (SCALE - share) - wrong * share, (right + wrong) * curve
        _, nodes, features, each = self.shape(splits)
        at = (self._leaf(bins, splits)[:, None] * features + np.arange(features)) * each + bins
        return np.stack([np.bincount(at.ravel(), np.repeat(w, features), nodes * features * each) for w in weights]).astype(np.int64).reshape(self.shape(splits))

    def fit(self, share: float, sums: Callable[[list[tuple[int, int]]], np.ndarray]) -> BoostedTrees:
        """Trees from ``sums(splits)``, the sum of :meth:`level` over all rows, and the ``share`` of right examples."""
        share = np.clip(share, 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        for _ in range(self.rounds):
            splits: list[tuple[int, int]] = []
            for _ in range(self.depth):
                n, g, h = sums(splits) / np.array([1, SCALE, SCALE])[:, None, None, None]
                f, above = self._split(n, g, h)
                splits.append((f, above))
                over = [x[:, f, above + 1 :].sum(axis=1) for x in (g, h)]
                whole = [x[:, f].sum(axis=1) for x in (g, h)]
            sides = [np.stack([w - o, o], axis=1).ravel() for w, o in zip(whole, over, strict=True)]
            self.trees.append((splits, self.rate * sides[0] / (sides[1] + 1)))
        return self

    def _split(self, n: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int]:
        """The split of a level that gains most over all nodes together: a feature, and the bin that the others lie above."""
        over = lambda x: x[..., ::-1].cumsum(axis=2)[..., ::-1][..., 1:]
        total, rows, whole_g, whole_h = n[:, 0].sum(), over(n).sum(axis=0), g.sum(axis=2)[..., None], h.sum(axis=2)[..., None]
        gr, hr = over(g), over(h)
        gain = (gr**2 / (hr + 1) + (whole_g - gr) ** 2 / (whole_h - hr + 1) - whole_g**2 / (whole_h + 1)).sum(axis=0)
        best = (0.0, 0, NEVER)
        for f, cuts in enumerate(self.cuts):
            for at in range(len(cuts)):
                if self.least <= rows[f, at] <= total - self.least and gain[f, at] > best[0] + 1e-9:
                    best = float(gain[f, at]), f, at
        return best[1:]

    @staticmethod
    def _leaf(bins: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
        node = np.zeros(len(bins), dtype=np.int64)
        for f, at in splits:
            node = 2 * node + (bins[:, f] > at)
        return node

    def predict_binned(self, bins: np.ndarray) -> np.ndarray:
        raw = np.full(len(bins), self.start)
        for splits, leaf in self.trees:
            raw += leaf[self._leaf(bins, splits)]
        return _sigmoid(raw)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.predict_binned(self.binned(x))
