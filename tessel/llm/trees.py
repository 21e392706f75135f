"""Gradient-boosted regression trees for a logistic loss, on binned features."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np


class BoostedTrees:
    """Trees as flat arrays; a node whose feature is -1 is a leaf."""

    def __init__(self, base: float, trees: list[dict[str, list]]):
        self.base = base
        self.trees = [{k: np.array(v, dtype=np.float64 if k in ("threshold", "value") else np.int64) for k, v in t.items()} for t in trees]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            while (inner := t["feature"][at] >= 0).any():
                low = x[rows, np.maximum(t["feature"][at], 0)] <= t["threshold"][at]
                at = np.where(inner, np.where(low, t["low"][at], t["high"][at]), at)
            out += t["value"][at]
        return out

    def save(self, path: Path) -> None:
        trees = [{k: [round(float(v), 5) if k in ("threshold", "value") else int(v) for v in a] for k, a in t.items()} for t in self.trees]
        path.write_text(json.dumps({"base": round(self.base, 5), "trees": trees}, separators=(",", ":")) + "\n")

    @classmethod
    def load(cls, text: str) -> BoostedTrees:
        spec = json.loads(text)
        return cls(spec["base"], spec["trees"])


def _split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, at: np.ndarray, bins: int, least: float, ridge: float):
    """Best (gain, feature, bin) of the rows."""
    gs, hs = g[at], h[at]
    total_g, total_h = gs.sum(), hs.sum()
    best = (1e-6, -1, -1)
    for f in range(binned.shape[1]):
        b = binned[at, f]
        cg, ch = np.cumsum(np.bincount(b, gs, bins))[:-1], np.cumsum(np.bincount(b, hs, bins))[:-1]
        fine = (ch >= least) & (total_h - ch >= least)
        if not fine.any():
            continue
        gain = cg**2 / (ch + ridge) + (total_g - cg) ** 2 / (total_h - ch + ridge) - total_g**2 / (total_h + ridge)
        gain[~fine] = -np.inf
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), f, k)
    return best


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 4, rate: float = 0.25, bins: int = 32, least: float = 2.0, ridge: float = 1.0) -> BoostedTrees:
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base = float(np.log(share / (1 - share)))
    margin, out = np.full(len(x), base), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        tree = {"feature": [], "threshold": [], "low": [], "high": [], "value": []}

        def grow(at: np.ndarray, left: int) -> int:
            node = len(tree["feature"])
            for k, v in (("feature", -1), ("threshold", 0.0), ("low", 0), ("high", 0), ("value", -rate * g[at].sum() / (h[at].sum() + ridge))):
                tree[k].append(v)
            if left:
                _, f, b = _split(binned, g, h, at, bins, least, ridge)
                if f >= 0:
                    low = binned[at, f] <= b
                    tree["feature"][node], tree["threshold"][node] = f, float(cuts[f][b])
                    tree["low"][node] = grow(at[low], left - 1)
                    tree["high"][node] = grow(at[~low], left - 1)
                    return node
            margin[at] += tree["value"][node]
            return node

        grow(np.arange(len(x)), depth)
        out.append(tree)
    return BoostedTrees(base, out)
