"""Segment costs on a (T, D) signal; ``cost(starts, end)`` prices many segments at once."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np


class Cost:
    def __init__(self, x: np.ndarray):
        self.x = np.asarray(x, float).reshape(len(x), -1)
        self.n = len(self.x)

    def __call__(self, starts: np.ndarray, end: int) -> np.ndarray:
        raise NotImplementedError

    def one(self, start: int, end: int) -> float:
        return float(self(np.array([start]), end)[0])

    def many(self, start: int, ends: np.ndarray) -> np.ndarray:
        """Prices of segments with one start."""
        return np.array([self.one(start, e) for e in ends])


class L2(Cost):
    """Squared distance to the mean, from prefix sums."""

    def __init__(self, x):
        super().__init__(x)
        self.x = self.x - self.x.mean(axis=0)
        self.s = np.vstack([np.zeros(self.x.shape[1]), np.cumsum(self.x, axis=0)])
        self.q = np.append(0.0, np.cumsum((self.x**2).sum(axis=1)))

    def __call__(self, starts, end):
        d = self.s[end] - self.s[starts]
        return np.maximum(0.0, self.q[end] - self.q[starts] - (d**2).sum(axis=1) / (end - starts))


class L1(Cost):
    """Absolute distance to the median."""

    #: Series up to this length keep their prices: a sweep of penalties asks for the same ones again.
    KEPT = 2000

    def __init__(self, x):
        super().__init__(x)
        self.known: dict[int, np.ndarray] = {}

    def _grown(self, x: np.ndarray) -> np.ndarray:
        """Prices of the segments that hold the first 1, 2, ... of ``x``: two heaps hold the halves around the median."""
        out = np.zeros(len(x))
        for v in x.T.tolist():
            low: list[float] = []
            high: list[float] = []
            below = above = 0.0
            for a, y in enumerate(v):
                if low and y <= -low[0]:
                    heappush(low, -y)
                    below += y
                else:
                    heappush(high, y)
                    above += y
                if len(low) > len(high) + 1:
                    y = -heappop(low)
                    heappush(high, y)
                    below, above = below - y, above + y
                elif len(high) > len(low):
                    y = heappop(high)
                    heappush(low, -y)
                    below, above = below + y, above - y
                out[a] += above - below + (-low[0] if len(low) > len(high) else 0.0)
        return out

    def __call__(self, starts, end):
        if self.n > self.KEPT:
            first = int(starts.min())
            return self._grown(self.x[first:end][::-1])[::-1][starts - first]
        if end not in self.known:
            self.known[end] = self._grown(self.x[:end][::-1])[::-1]
        return self.known[end][starts]

    def many(self, start, ends):
        if self.n <= self.KEPT:
            return super().many(start, ends)
        return self._grown(self.x[start : int(ends.max())])[ends - start - 1]


class Kernel(Cost):
    """Spread in the feature space of a kernel, from two-dimensional prefix sums of its Gram matrix.

    Signals of more than ``DENSE`` frames keep the sums only for every so many columns, ``ROOM`` values in all,
    and add the kernel's own columns in between, so memory doesn't grow with the square of the length.
    """

    DENSE = 4000
    ROOM = 40_000_000

    def __init__(self, x):
        super().__init__(x)
        self.prepare()
        if self.n <= self.DENSE:
            g = self.gram()
            self.diag = np.append(0.0, np.cumsum(np.diag(g)))
            self.sums = np.zeros((self.n + 1, self.n + 1))
            self.sums[1:, 1:] = g.cumsum(axis=0).cumsum(axis=1)
            return
        self.step = max(64, -(-self.n * self.n // self.ROOM))
        # kept[k, a]: sum over the first a rows and the first k * step columns; square[a]: over the first a of both
        self.kept = np.zeros((self.n // self.step + 1, self.n + 1))
        below, own, diag = np.zeros(self.n), np.zeros(self.n), np.zeros(self.n)
        for k, c in enumerate(range(0, self.n, self.step)):
            d = min(c + self.step, self.n)
            g = self.block(c, d, c, d)
            diag[c:d] = np.diag(g)
            own[c:d] = diag[c:d] + 2 * (below[c:d] + np.tril(g, -1).sum(axis=1))
            if d == c + self.step:
                below += self.rows(0, self.n, c, d)
                self.kept[k + 1, 1:] = np.cumsum(below)
        self.diag = np.append(0.0, np.cumsum(diag))
        self.square = np.append(0.0, np.cumsum(own))
        self.at, self.between = 0, np.zeros(self.n)

    def prepare(self) -> None:
        """What the kernel needs of the whole signal."""

    def block(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Rows a to b and columns c to d of the Gram matrix."""
        raise NotImplementedError

    def gram(self) -> np.ndarray:
        return self.block(0, self.n, 0, self.n)

    def rows(self, a: int, b: int, c: int, d: int) -> np.ndarray:
        """Row sums of a block, in portions."""
        size = max(1, 2_000_000 // max(1, d - c))
        return np.concatenate([self.block(r, min(r + size, b), c, d).sum(axis=1) for r in range(a, b, size)]) if b > a else np.zeros(0)

    def upto(self, end: int) -> np.ndarray:
        """Sums over the first a rows and the first ``end`` columns, for every a up to the signal's length."""
        c = end // self.step * self.step
        if not c <= self.at <= end:
            self.at, self.between = c, np.zeros(self.n)
        if self.at < end:
            self.between = self.between + self.rows(0, self.n, self.at, end)
            self.at = end
        return self.kept[end // self.step] + np.append(0.0, np.cumsum(self.between))

    def price(self, starts, ends, cross):
        total = self.square[ends] - 2 * cross + self.square[starts]
        return np.maximum(0.0, self.diag[ends] - self.diag[starts] - total / (ends - starts))

    def __call__(self, starts, end):
        if self.n > self.DENSE:
            return self.price(starts, end, self.upto(end)[starts])
        s = self.sums
        block = s[end, end] - s[starts, end] - s[end, starts] + s[starts, starts]
        return np.maximum(0.0, self.diag[end] - self.diag[starts] - block / (end - starts))

    def many(self, start, ends):
        return self.price(start, ends, self.upto(start)[ends]) if self.n > self.DENSE else super().many(start, ends)

    def one(self, start, end):
        if self.n <= self.DENSE:
            return super().one(start, end)
        if end - start <= self.step:
            return max(0.0, float(self.diag[end] - self.diag[start] - self.rows(start, end, start, end).sum() / (end - start)))
        k, m = start // self.step, end // self.step
        a, b = k * self.step, m * self.step
        cross = self.kept[m, start] + self.kept[k, end] - self.kept[k, b] + self.rows(a, start, b, end).sum()
        return float(self.price(start, end, cross))


class RBF(Kernel):
    """Gaussian kernel; its width from the median squared distance."""

    def prepare(self):
        self.mid = 0.0
        self.q = (self.x**2).sum(axis=1)
        self.mid = middle(self.pairs, self.n * (self.n - 1) // 2, self.n <= self.DENSE)

    def squared(self, a, b, c, d):
        return np.maximum(0.0, self.q[a:b, None] + self.q[None, c:d] - 2 * self.x[a:b] @ self.x[c:d].T)

    def pairs(self):
        """Squared distances of all pairs, in portions."""
        size = self.n if self.n <= self.DENSE else 512
        for a in range(0, self.n, size):
            b = min(a + size, self.n)
            yield self.squared(a, b, a, b)[np.triu_indices(b - a, 1)]
            for c in range(b, self.n, 8192):
                yield self.squared(a, b, c, min(c + 8192, self.n)).ravel()

    def block(self, a, b, c, d):
        e = self.squared(a, b, c, d)
        e = np.clip(e / self.mid if self.mid > 0 else e, 1e-2, 1e2)
        i = np.arange(max(a, c), min(b, d))
        e[i - a, i - c] = 0.0
        return np.exp(-e)


class Cosine(Kernel):
    def prepare(self):
        self.unit = self.x / np.maximum(np.linalg.norm(self.x, axis=1, keepdims=True), 1e-12)

    def block(self, a, b, c, d):
        return self.unit[a:b] @ self.unit[c:d].T


def middle(portions, n: int, small: bool, room: int = 4_000_000) -> float:
    """The exact median of ``n`` values that come in portions: counts in ever narrower bins until the middle ones fit in memory."""
    if not n:
        return 0.0
    if small:
        return float(np.median(np.concatenate(list(portions()))))
    lo, hi = np.inf, -np.inf
    for v in portions():
        if len(v):
            lo, hi = min(lo, v.min()), max(hi, v.max())
    ranks = ((n - 1) // 2, n // 2)
    below, inside = 0, n
    while inside > room and lo < hi:
        edges = np.unique(np.linspace(lo, hi, 4097))
        if len(edges) == 2:
            edges = np.array([lo, hi, np.nextafter(hi, np.inf)])
        under = np.zeros(len(edges) - 1, dtype=np.int64)
        for v in portions():
            under += np.searchsorted(np.sort(v), edges[:-1], "left")
        k, m = (int(np.searchsorted(under, r, "right")) - 1 for r in ranks)
        if k < m:
            # the middle two are parted by an edge, with nothing between them
            return float((max(v[v < edges[m]].max(initial=-np.inf) for v in portions()) + min(v[v >= edges[m]].min(initial=np.inf) for v in portions())) / 2)
        last = k + 1 == len(under)
        below, inside = int(under[k]), 0
        at, end, lo, hi = edges[k], edges[k + 1], np.inf, -np.inf
        for v in portions():
            w = v[(v >= at) & ((v <= end) if last else (v < end))]
            if len(w):
                inside, lo, hi = inside + len(w), min(lo, w.min()), max(hi, w.max())
    if lo == hi:
        return float(lo)
    near = np.sort(np.concatenate([v[(v >= lo) & (v <= hi)] for v in portions()]))
    return float((near[ranks[0] - below] + near[ranks[1] - below]) / 2)


COSTS = {"l2": L2, "l1": L1, "rbf": RBF, "cosine": Cosine}


def make_cost(model: str, x: np.ndarray) -> Cost:
    if model not in COSTS:
        raise ValueError(f"unknown cost model {model!r}")
    return COSTS[model](x)
