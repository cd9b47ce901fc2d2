"""Small gradient-boosted trees: logistic loss, histogram splits, numpy only.

Trees are plain tuples, so they travel in closures and can be written as SQL:
a leaf is a float, an inner node is (feature, threshold, low, high), low for x <= threshold.
"""

from __future__ import annotations

import numpy as np

Tree = "float | tuple[int, float, Tree, Tree]"


def bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    values = np.unique(column)
    if len(values) <= bins:
        return (values[1:] + values[:-1]) / 2
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 40, depth: int = 3, rate: float = 0.2, least: int = 8, bins: int = 32, ridge: float = 1.0) -> tuple[float, list]:
    """(start, trees): the log-odds of a row is start plus the leaves it falls in."""
    n, m = x.shape
    share = min(max(float(y.mean()) if n else 0.0, 1e-4), 1 - 1e-4)
    start = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return start, []
    edges = [bin_edges(x[:, j], bins) for j in range(m)]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)])
    score, grown = np.full(n, start), []

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(rate * gs / (hs + ridge))
        if level == 0 or len(rows) < 2 * least:
            return leaf
        best, cut = 1e-6, None
        for j in range(m):
            if not len(edges[j]):
                continue
            c = code[j, rows]
            size = len(edges[j]) + 1
            gl = np.cumsum(np.bincount(c, g[rows], size))[:-1]
            hl = np.cumsum(np.bincount(c, h[rows], size))[:-1]
            nl = np.cumsum(np.bincount(c, minlength=size))[:-1]
            gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
            gain[(nl < least) | (len(rows) - nl < least)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, cut = float(gain[k]), (j, k)
        if cut is None:
            return leaf
        j, k = cut
        low = code[j, rows] <= k
        return (j, float(edges[j][k]), grow(rows[low], g, h, level - 1), grow(rows[~low], g, h, level - 1))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        tree = grow(np.arange(n), y - p, p * (1 - p), depth)
        grown.append(tree)
        score += leaves(tree, x)
    return start, grown


def leaves(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    j, t, low, high = tree
    return np.where(x[:, j] <= t, leaves(low, x), leaves(high, x))


def log_odds(model: tuple[float, list], x: np.ndarray) -> np.ndarray:
    start, trees = model
    out = np.full(len(x), start)
    for tree in trees:
        out += leaves(tree, x)
    return out


def as_sql(tree, names: list[str]) -> str:
    if not isinstance(tree, tuple):
        return f"{tree!r}D"
    j, t, low, high = tree
    return f"CASE WHEN {names[j]} <= {t!r}D THEN {as_sql(low, names)} ELSE {as_sql(high, names)} END"


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (scores, rising shares of y) to interpolate between."""
    order = np.argsort(score, kind="stable")
    pools: list[list[float]] = []  # sum of y, rows, lowest score, highest score
    for s, v in zip(score[order].tolist(), y[order].tolist(), strict=True):
        pools.append([v, 1.0, s, s])
        while len(pools) > 1 and (pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1] or pools[-2][3] == pools[-1][2]):
            top = pools.pop()
            pools[-1] = [pools[-1][0] + top[0], pools[-1][1] + top[1], pools[-1][2], top[3]]
    at, share = [], []
    for total, n, low, high in pools:
        at += [low, high]
        share += [total / n] * 2
    return np.array(at), np.array(share)


def calibrated(curve: tuple[np.ndarray, np.ndarray], score: np.ndarray) -> np.ndarray:
    at, share = curve
    return np.interp(score, at, share) if len(at) else np.zeros(len(score))
