"""Histogram gradient-boosted trees in numpy, with optional monotonic constraints.

Training bins every feature at sample quantiles and grows depth-wise trees from
gradient and hessian histograms.  The trained forest is a few flat arrays
(``Forest``): complete binary trees, node ``i`` with children ``2i + 1`` and ``2i + 2``,
so that scoring walks all rows down one level per numpy step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature``/``cut``: (trees, inner nodes), a row goes right if x[feature] > cut; ``leaf``: (trees, leaves)."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values: log odds of label 1."""
        rows, out = np.arange(len(x)), np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - inner]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def constant(probability: float) -> Forest:
    """A forest without trees."""
    p = min(max(probability, 1e-6), 1 - 1e-6)
    return Forest(np.zeros((0, 0), np.int64), np.zeros((0, 0)), np.zeros((0, 1)), float(np.log(p / (1 - p))))


def train(
    x: np.ndarray,
    y: np.ndarray,
    *,
    trees: int = 60,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    l2: float = 1.0,
    least_hessian: float = 1.0,
    balance: bool = True,
    monotone: dict[int, int] | None = None,
) -> Forest:
    """Fits log loss.

    ``monotone`` maps a feature to +1 (score may only rise with it) or -1 (only fall).
    A split on such a feature is allowed only if its two leaf values are in that
    order, and the mid value then bounds both subtrees, so whole trees obey it.
    ``balance`` weights both classes equally.  With no rows, or one class only, the
    forest is constant.
    """
    if not len(y) or y.min() == y.max():
        return constant(float(y.mean()) if len(y) else 0.5)
    n, f = x.shape
    share = y.mean()
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) if balance else np.ones(n)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    width = bins
    sign = np.zeros(f)
    for j, s in (monotone or {}).items():
        sign[j] = s
    inner, leaves = 2**depth - 1, 2**depth
    bias = 0.0 if balance else float(np.log(share / (1 - share)))
    margin = np.full(n, bias)
    all_feature, all_cut, all_leaf = [], [], []
    offset = np.arange(f) * width
    usable = np.zeros((f, width), bool)
    for j, e in enumerate(edges):
        usable[j, : len(e)] = True
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, cut, cut_bin = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, width)
        low, high = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for level in range(depth):
            k, base = 2**level, 2**level - 1
            cell = ((node - base)[:, None] * (f * width) + offset + binned).ravel()
            shape = (k, f, width)
            gh = np.bincount(cell, np.repeat(g, f), k * f * width).reshape(shape).cumsum(2)
            hh = np.bincount(cell, np.repeat(h, f), k * f * width).reshape(shape).cumsum(2)
            gt, ht = gh[:, :1, -1:], hh[:, :1, -1:]
            lo, hi = low[base : base + k, None, None], high[base : base + k, None, None]
            left = np.clip(-gh / (hh + l2), lo, hi)
            right = np.clip(-(gt - gh) / (ht - hh + l2), lo, hi)
            loss = lambda a, b, v: a * v + 0.5 * (b + l2) * v * v
            gain = loss(gt, ht, np.clip(-gt / (ht + l2), lo, hi)) - loss(gh, hh, left) - loss(gt - gh, ht - hh, right)
            bad = ~usable | (hh < least_hessian) | (ht - hh < least_hessian) | ((right - left) * sign[:, None] < 0)
            gain = np.where(bad, -1.0, gain).reshape(k, -1)
            best = gain.argmax(1)
            for i, b in enumerate(best):
                at, (j, c) = base + i, divmod(int(b), width)
                low[2 * at + 1 : 2 * at + 3], high[2 * at + 1 : 2 * at + 3] = low[at], high[at]
                if gain[i, b] <= 1e-9:
                    continue
                feature[at], cut[at], cut_bin[at] = j, edges[j][c], c
                if sign[j]:
                    mid = (left[i, j, c] + right[i, j, c]) / 2
                    for child, up in ((2 * at + 1, sign[j] > 0), (2 * at + 2, sign[j] < 0)):
                        (high if up else low)[child] = min(high[at], mid) if up else max(low[at], mid)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut_bin[node])
        at = node - inner
        value = -np.bincount(at, g, leaves) / (np.bincount(at, h, leaves) + l2)
        leaf = rate * np.clip(value, low[inner:], high[inner:])
        margin += leaf[at]
        all_feature.append(feature)
        all_cut.append(cut)
        all_leaf.append(leaf)
    return Forest(np.array(all_feature), np.array(all_cut), np.array(all_leaf), bias)
