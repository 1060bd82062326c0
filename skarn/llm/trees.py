"""Small tree learners in numpy: boosted regression trees, a random forest, isotonic calibration."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 32


def edges_of(x: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Cut points of each column between its distinct quantiles."""
    out = []
    for c in x.T:
        q = np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)))
        out.append((q[1:] + q[:-1]) / 2 if len(q) > 1 else np.zeros(0))
    return out


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(e, c, "right") for c, e in zip(x.T, edges)]).astype(np.int64)


@dataclass
class Tree:
    """Nodes in level order: node i has children 2i+1 and 2i+2; feature -1 marks a leaf."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.feature) + 1))):
            f = self.feature[at]
            go = 2 * at + 1 + (x[rows, np.maximum(f, 0)] > self.cut[at])
            at = np.where(f >= 0, go, at)
        return self.value[at]


def grow(b: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, ridge: float, least: float, rng=None, tried: int | None = None) -> Tree:
    """A tree on binned rows for gradients g and weights h: each split gains most in sum(g)^2 / (sum(h) + ridge)."""
    size = 2 ** (depth + 1) - 1
    t = Tree(np.full(size, -1), np.zeros(size), np.zeros(size))
    held = {0: np.arange(len(b))}
    for node in range(size):
        rows = held.pop(node, None)
        if rows is None:
            continue
        gs, hs = g[rows].sum(), h[rows].sum()
        t.value[node] = gs / (hs + ridge)
        if 2 * node + 2 >= size or hs < 2 * least:
            continue
        best = (1e-9, -1, 0)
        cols = range(b.shape[1]) if rng is None else rng.choice(b.shape[1], tried, replace=False)
        for f in cols:
            n = len(edges[f]) + 1
            if n < 2:
                continue
            gl = np.cumsum(np.bincount(b[rows, f], g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(b[rows, f], h[rows], n))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(hl < least) | (hs - hl < least)] = -1
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (gain[k], f, k)
        if best[1] < 0:
            continue
        t.feature[node], t.cut[node] = best[1], edges[best[1]][best[2]]
        right = b[rows, best[1]] > best[2]
        held[2 * node + 1], held[2 * node + 2] = rows[~right], rows[right]
    return t


@dataclass
class Boosted:
    """Logistic boosting with shrunken trees."""

    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), rate)
    edges = edges_of(x)
    b = binned(x, edges)
    m = np.full(len(y), model.base)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-m))
        t = grow(b, edges, y - q, np.maximum(q * (1 - q), 1e-6), depth, ridge, least)
        model.trees.append(t)
        m += rate * t.predict(x)
    return model


@dataclass
class Forest:
    trees: list[Tree]

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(sum((t.predict(x) for t in self.trees), np.zeros(len(x))) / len(self.trees), 0, 1)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 7, seed: int = 7) -> Forest:
    """Bootstrapped trees, each split over the root of the number of columns."""
    rng = np.random.default_rng(seed)
    edges = edges_of(x)
    b = binned(x, edges)
    tried = max(2, int(np.sqrt(x.shape[1]) + 0.5))
    grown = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        grown.append(grow(b, edges, w * y, w, depth, 1e-9, 1.0, rng, tried))
    return Forest(grown)


@dataclass
class Isotonic:
    """A rising step function, joined by lines; the end blocks are pulled towards the middle by one pseudo row."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, m: np.ndarray) -> np.ndarray:
        return np.interp(m, self.at, self.value)


def isotonic(m: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators over margins m and labels y."""
    order = np.argsort(m, kind="stable")
    at, inv = np.unique(m[order], return_inverse=True)
    total, weight = np.bincount(inv, y[order]), np.bincount(inv).astype(float)
    blocks: list[list[float]] = []  # sum, weight, first, last
    for a, s, w in zip(at, total, weight):
        blocks.append([s, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s2, w2, _, last = blocks.pop()
            blocks[-1][0] += s2
            blocks[-1][1] += w2
            blocks[-1][3] = last
    xs, ys = [], []
    for s, w, a, z in blocks:
        v = (s + 0.5) / (w + 1)
        xs += [a, z] if z > a else [a]
        ys += [v, v] if z > a else [v]
    return Isotonic(np.array(xs), np.maximum.accumulate(ys))
