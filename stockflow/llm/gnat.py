"""Exact search in score windows by a multiway hyperplane tree.

Rows are integer vectors; a query asks for the rows of highest inner product
within a window of scores. An inner product and the two norms give a distance,
so a window of scores is an annulus of distances around the query. A node of
the tree has split points, and every row goes to the nearest of them. The node
keeps, for each split point and each subtree, the least and largest distance
between them: a subtree is passed over when, for some split point, that range
allows no distance within the annulus. Rows in leaves are scored exactly.
"""

from __future__ import annotations

import numpy as np

FANOUT = 16
LEAF = 256
CELLS = 1 << 21         # scores computed at once
NONE = -(1 << 62)       # key of "no row"
SLACK = 1e-9            # relative allowance for rounded square roots


def far_points(rows: np.ndarray, k: int) -> np.ndarray:
    """Indexes of up to ``k`` rows, each the farthest from those before it;
    fewer where no others differ from them."""
    picked = [0]
    least = squared(rows, rows[:1])[:, 0]
    while len(picked) < k:
        i = int(least.argmax())
        if least[i] <= 0:
            break
        picked.append(i)
        least = np.minimum(least, squared(rows, rows[i:i + 1])[:, 0])
    return np.array(picked)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances between all of ``a`` and all of ``b``. Components
    are whole numbers, so products stay exact in floating point (the caller
    bounds them, see ``exact``)."""
    return (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)


def exact(vectors: np.ndarray) -> bool:
    """Whether sums of products of these whole numbers stay below 2**44, so
    that scores, squared distances and keys are exact."""
    return vectors.size == 0 or vectors.shape[1] * float(np.abs(vectors).max()) ** 2 < 2.0 ** 44


def excluded(to_points: np.ndarray, low: np.ndarray, high: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """(queries x subtrees): whether a subtree has no row within a query's
    annulus. ``to_points``: queries x points; ``low``/``high``: points x
    subtrees; ``inner``/``outer``: queries x subtrees, outer < 0: empty."""
    d = to_points[:, :, None]
    slack = SLACK * (1 + d + high[None])
    nearest = np.maximum(low[None] - d, d - high[None]) - slack
    farthest = d + high[None] + slack
    return (nearest.max(axis=1) > outer) | (farthest.min(axis=1) < inner) | (outer < 0)


def annulus(norm: np.ndarray, least: np.ndarray, most: np.ndarray, norm_low: np.ndarray, norm_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances at which rows with squared norms in [norm_low, norm_high]
    have scores in [least, most]: (queries x subtrees) each."""
    inner = np.sqrt(np.maximum(norm[:, None] + norm_low[None] - 2 * most[:, None], 0)) * (1 - SLACK)
    far = norm[:, None] + norm_high[None] - 2 * least[:, None]
    return inner, np.where((far < 0) | (least > most)[:, None], -1.0, np.sqrt(np.maximum(far, 0)) * (1 + SLACK) + SLACK)


class Tree:
    """A tree over rows in the order in which ties are broken."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray):
        self.rows, self.labels = rows, labels
        self.norms = (rows * rows).sum(axis=1)
        self.root = self._node(np.arange(len(rows)))

    def _node(self, index: np.ndarray) -> dict:
        points = np.empty(0)
        if len(index) > LEAF:
            sample = self.rows[index[:: max(1, len(index) // (64 * FANOUT))]]
            points = sample[far_points(sample, FANOUT)]
        if len(points) < 2:
            return {"rows": index}
        apart = np.sqrt(np.maximum(squared(self.rows[index], points), 0))
        owner = apart.argmin(axis=1)
        parts = [index[owner == j] for j in range(len(points))]
        if max(map(len, parts)) == len(index):  # nothing told apart
            return {"rows": index}
        low, high = np.full((2, len(points), len(points)), np.inf)
        high[:] = 0
        norm_low, norm_high = np.zeros((2, len(points)))
        for j, part in enumerate(parts):
            if len(part):
                low[:, j], high[:, j] = apart[owner == j].min(axis=0), apart[owner == j].max(axis=0)
                norm_low[j], norm_high[j] = self.norms[part].min(), self.norms[part].max()
        return {"points": points, "low": low, "high": high, "norms": (norm_low, norm_high),
                "below": [self._node(part) if len(part) else None for part in parts]}

    def search(self, queries: np.ndarray, least: np.ndarray, most: np.ndarray, label: np.ndarray, same: bool,
               skip: np.ndarray, k: int) -> np.ndarray:
        """Keys (queries x k) of the ``k`` best rows per query with a score in
        [least, most], and with the query's label (``same``) or another one;
        ``skip``: a row left out, -1 for none. A key is score * rows - place,
        so that the larger is the better; ``NONE`` where there are fewer."""
        self.q, self.least, self.most, self.label, self.same, self.skip, self.k = queries, least.astype(np.float64), most.astype(np.float64), label, same, skip, k
        self.q_norms = (queries * queries).sum(axis=1)
        self.best = np.full((len(queries), k), NONE, np.int64)
        self.visited = 0
        if len(queries) and len(self.rows):
            self._visit(self.root, np.arange(len(queries)))
        return self.best

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, place) of keys."""
        n = max(1, len(self.rows))
        score = -(-keys // n)
        return score, score * n - keys

    def _bound(self, who: np.ndarray) -> np.ndarray:
        """Least score that can still count: the window's, or the k-th best's."""
        last = self.best[who, -1]
        return np.where(last == NONE, self.least[who], np.maximum(self.least[who], self.found(last)[0]))

    def _visit(self, node: dict, who: np.ndarray) -> None:
        if "rows" in node:
            step = max(1, CELLS // max(1, len(who)))
            for at in range(0, len(node["rows"]), step):
                self._leaf(node["rows"][at:at + step], who)
            return
        to_points = np.sqrt(np.maximum(squared(self.q[who], node["points"]), 0))
        for j in np.argsort(to_points.mean(axis=0)):  # those near to most queries first
            if node["below"][j] is None or not len(who):
                continue
            pick = slice(j, j + 1)
            inner, outer = annulus(self.q_norms[who], self._bound(who), self.most[who], node["norms"][0][pick], node["norms"][1][pick])
            stay = ~excluded(to_points, node["low"][:, pick], node["high"][:, pick], inner, outer)[:, 0]
            if stay.any():
                self._visit(node["below"][j], who[stay])

    def _leaf(self, rows: np.ndarray, who: np.ndarray) -> None:
        self.visited += len(rows) * len(who)
        score = self.q[who] @ self.rows[rows].T
        fits = (self.labels[rows][None, :] == self.label[who][:, None]) == self.same
        fits &= (score >= self._bound(who)[:, None]) & (score <= self.most[who][:, None]) & (rows[None, :] != self.skip[who][:, None])
        some = fits.any(axis=1)
        if not some.any():
            return
        key = np.where(fits[some], score[some].astype(np.int64) * len(self.rows) - rows[None, :], NONE)
        both = np.concatenate([self.best[who[some]], key], axis=1)
        both = -np.partition(-both, self.k - 1, axis=1)[:, :self.k] if both.shape[1] > self.k else both
        self.best[who[some]] = -np.sort(-both, axis=1)[:, :self.k]
