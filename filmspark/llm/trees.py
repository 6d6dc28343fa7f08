"""Gradient-boosted trees with a logistic loss and monotonic constraints, as flat arrays of nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Nodes of all trees, one after the other. A leaf points to itself. `roots` are the first nodes; every path has at most `depth` splits."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sums of the leaves that rows of `x` fall into: a step down in all trees at once for all rows."""
        out = np.full(len(x), self.bias)
        # small slices stay in the cache
        for a in range(0, len(x), 1024):
            part = x[a : a + 1024]
            row = np.arange(len(part))[:, None]
            node = np.broadcast_to(self.roots, (len(part), len(self.roots)))
            for _ in range(self.depth):
                node = np.where(part[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
            out[a : a + 1024] += self.value[node].sum(1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def _leaf(g: np.ndarray, h: np.ndarray, lo: np.ndarray, hi: np.ndarray, l2: float) -> np.ndarray:
    return np.clip(-g / (h + l2), lo, hi)


def _gain(g: np.ndarray, h: np.ndarray, v: np.ndarray, l2: float) -> np.ndarray:
    return -(g * v + 0.5 * (h + l2) * v * v)


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.1, bins: int = 64, least_rows: int = 10, l2: float = 1.0, least_gain: float = 1e-3) -> Trees:
    """x: rows by features; y: 0 or 1; monotone: 1, -1 or 0 for each feature: whether the score may only rise with it, only fall, or both.

    Splits are sought on histograms of at most `bins` quantile bins, a level of a tree at a time. A constraint forbids splits whose leaves are in the wrong order, and the
    middle of both leaves bounds everything below them, so whole trees, and their sum, keep to it. Without rows, or with one label only, there are no trees.
    """
    n, m = x.shape
    bias = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if n else np.zeros(0) for f in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1) if m else np.zeros((n, 0), int)
    flat = codes + np.arange(m) * bins
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def new(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        right.append(len(right))
        value.append(v)
        return len(value) - 1

    margin = np.full(n, bias)
    for _ in range(trees if 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        lo, hi = np.array([-np.inf]), np.array([np.inf])
        level = np.array([new(float(_leaf(g.sum(), h.sum(), -np.inf, np.inf, l2)) * rate)])
        roots.append(int(level[0]))
        at = np.zeros(n, np.int64)  # place of each row's node in the level; -1: in a leaf
        end = np.full(n, level[0])
        for _ in range(depth):
            live = at >= 0
            key = (at[live, None] * (m * bins) + flat[live]).ravel()
            shape = (len(level), m, bins)
            size = len(level) * m * bins
            gs, hs = (np.bincount(key, np.repeat(w[live], m), size).reshape(shape) for w in (g, h))
            ns = np.bincount(key, minlength=size).reshape(shape)
            gl, hl, nl = (a.cumsum(2) for a in (gs, hs, ns))
            gt, ht, nt = gl[:, :1, -1:], hl[:, :1, -1:], nl[:, :1, -1:]
            low, high = lo[:, None, None], hi[:, None, None]
            vl, vr, v = _leaf(gl, hl, low, high, l2), _leaf(gt - gl, ht - hl, low, high, l2), _leaf(gt, ht, low, high, l2)
            gain = _gain(gl, hl, vl, l2) + _gain(gt - gl, ht - hl, vr, l2) - _gain(gt, ht, v, l2)
            wrong = monotone[None, :, None] * (vl - vr) > 0
            gain[wrong | (nl < least_rows) | (nt - nl < least_rows)] = -np.inf
            best = gain.reshape(len(level), -1).argmax(1)
            f, b = best // bins, best % bins
            every = np.arange(len(level))
            split = gain[every, f, b] > least_gain
            if not split.any():
                break
            a, z = vl[every, f, b], vr[every, f, b]
            fresh, lows, highs, to = [], [], [], np.full((len(level), 2), -1)
            for k in np.flatnonzero(split):
                node, sign, mid = level[k], monotone[f[k]], (a[k] + z[k]) / 2
                feature[node], threshold[node] = int(f[k]), float(cuts[f[k]][b[k]])
                bounds = {0: ((lo[k], hi[k]), (lo[k], hi[k])), 1: ((lo[k], mid), (mid, hi[k])), -1: ((mid, hi[k]), (lo[k], mid))}[int(sign)]
                for side, leaf in enumerate((a[k], z[k])):
                    to[k, side] = len(fresh)
                    fresh.append(new(float(leaf) * rate))
                    lows.append(bounds[side][0])
                    highs.append(bounds[side][1])
                left[node], right[node] = fresh[-2], fresh[-1]
            rows = np.flatnonzero(live)
            k = at[rows]
            at[rows] = to[k, (codes[rows, f[k]] > b[k]).astype(int)]
            level, lo, hi = np.array(fresh), np.array(lows), np.array(highs)
            on = at >= 0
            end[on] = level[at[on]]
        margin += np.array(value)[end]
    kind = lambda a, t: np.array(a, t)
    return Trees(kind(feature, np.int32), kind(threshold, np.float64), kind(left, np.int32), kind(right, np.int32), kind(value, np.float64), kind(roots, np.int32), depth, bias)
