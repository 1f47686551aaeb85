"""Random forests of regression trees in NumPy, for the bounded samples that calibration is studied on.

All trees grow at once, a level at a time: rows lie sorted by (node, feature), so the best split of every node
of every tree comes from running sums and one maximum a node, and a level costs a few passes over trees x rows.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """Mean of trees fitted to bootstrap samples; splits minimise squared error, leaves hold `leaf` rows at least.

    features: share of the features that each node may split on (1: all), or None for their square root."""

    def __init__(self, trees: int = 200, leaf: int = 2, features: float | None = 1.0, seed: int = 0):
        self.trees, self.leaf, self.features, self.seed = trees, leaf, features, seed

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        n, d = x.shape
        few = d if self.features == 1.0 else max(1, int(np.sqrt(d) if self.features is None else self.features * d))
        drawn = rng.integers(0, n, (self.trees, n))
        self.in_bag = np.zeros((self.trees, n), bool)
        np.put_along_axis(self.in_bag, drawn, True, axis=1)
        row, node = drawn.ravel(), np.repeat(np.arange(self.trees), n)
        self.feature = np.full(self.trees, -1)
        self.limit, self.left = np.zeros(self.trees), np.zeros(self.trees, np.int64)
        self.value = np.bincount(node, y[row], self.trees) / n
        orders = [np.lexsort((x[row, f], node)) for f in range(d)]
        while len(orders[0]):
            best, at, which = self._splits(x, y, row, node, orders, rng, few)
            split = np.flatnonzero(np.isfinite(best))
            if not len(split):
                break
            first = len(self.feature)  # the children of the k-th split node are first + 2 k and one more
            ids = self._ids[split]
            self.feature[ids], self.limit[ids], self.left[ids] = which[split], at[split], first + 2 * np.arange(len(split))
            grown = 2 * len(split)
            self.feature = np.append(self.feature, np.full(grown, -1))
            self.limit, self.left = np.append(self.limit, np.zeros(grown)), np.append(self.left, np.zeros(grown, np.int64))
            alive = self.feature[node] >= 0  # rows of leaves drop out
            move = np.flatnonzero(alive & (self.left[node] >= first))
            f = self.feature[node[move]]
            node = node.copy()
            node[move] = self.left[node[move]] + (x[row[move], f] > self.limit[node[move]])
            stay = np.zeros(len(node), bool)
            stay[move] = True
            size = np.bincount(node[move] - first, minlength=grown)
            self.value = np.append(self.value, np.bincount(node[move] - first, y[row[move]], grown) / size)
            orders = [o[stay[o]] for o in orders]
            orders = [o[np.argsort(node[o], kind="stable")] for o in orders]
        del self._ids
        return self

    def _splits(self, x, y, row, node, orders, rng, few) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """By node that still has rows: the gain of its best split (-inf: none), the limit and the feature."""
        lined = node[orders[0]]
        starts = np.flatnonzero(np.append(True, lined[1:] != lined[:-1]))
        size = np.diff(np.append(starts, len(lined)))
        self._ids = lined[starts]
        of, place = np.repeat(np.arange(len(starts)), size), np.arange(len(lined))
        n_left = place - starts[of] + 1
        n_right = size[of] - n_left
        room = (n_left >= self.leaf) & (n_right >= self.leaf)
        best, at, which = np.full(len(starts), -np.inf), np.zeros(len(starts)), np.zeros(len(starts), np.int64)
        asked = np.argsort(rng.random((len(starts), len(orders))), axis=1) < few if few < len(orders) else None
        for f, order in enumerate(orders):
            v, total = x[row[order], f], np.cumsum(y[row[order]])
            before = np.append(0.0, total)[starts]
            whole = total[starts + size - 1] - before
            s_left = total - before[of]
            ok = room.copy()
            ok[:-1] &= v[1:] > v[:-1]
            ok[-1] = False
            if asked is not None:
                ok &= asked[of, f]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(ok, s_left**2 / n_left + (whole[of] - s_left) ** 2 / n_right - (whole**2 / size)[of], -np.inf)
            top = np.maximum.reduceat(gain, starts)
            first = np.minimum.reduceat(np.where(gain == top[of], place, len(place)), starts)
            better = (top > best + 1e-12) & (top > 1e-12)
            cut = np.minimum(first, len(v) - 2)
            at = np.where(better, (v[cut] + v[cut + 1]) / 2, at)
            which, best = np.where(better, f, which), np.where(better, top, best)
        return best, at, which

    def each(self, x: np.ndarray) -> np.ndarray:
        """rows x trees: every tree's prediction."""
        node = np.tile(np.arange(self.trees), (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[node]
            inner = f >= 0
            if not inner.any():
                return self.value[node]
            node = np.where(inner, self.left[node] + (x[rows, np.maximum(f, 0)] > self.limit[node]), node)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.each(x).mean(axis=1)

    def out_of_bag(self, x: np.ndarray) -> np.ndarray:
        """Predictions of the fitted rows by the trees that did not see them (by all, where each tree did)."""
        free = ~self.in_bag.T
        every = self.each(x)
        n = free.sum(axis=1)
        return np.where(n > 0, (every * free).sum(axis=1) / np.maximum(n, 1), every.mean(axis=1))


class Filler:
    """Medians for missing values, and a column for each feature that had some."""

    def __init__(self, x: np.ndarray):
        missing = np.isnan(x)
        self.median = np.array([np.median(c[~m]) if (~m).any() else 0.0 for c, m in zip(x.T, missing.T, strict=True)])
        self.marked = np.flatnonzero(missing.any(axis=0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        missing = np.isnan(x)
        return np.hstack((np.where(missing, self.median, x), missing[:, self.marked].astype(float)))
