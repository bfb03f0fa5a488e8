"""Further segmenters on a (T, D) signal: classification score profile, Bayesian online detection, outlier runs."""

from __future__ import annotations

import math

import numpy as np

AVAILABLE = ("clasp", "binseg", "ggs", "bocpd", "stray")

#: Distances held at once.
PORTION = 4_000_000
#: Differences of all pairs of windows beyond which their distances come from products.
FAR = 1e10


def label_changes(labels: np.ndarray) -> list[int]:
    labels = np.asarray(labels)
    return (np.flatnonzero(labels[1:] != labels[:-1]) + 1).tolist()


def as_boundaries(found, n: int) -> list[int]:
    """Any of a segmenter's outputs as interior boundaries: one value per frame is labels, a short list is positions."""
    a = np.asarray(found)
    if a.ndim == 0 or not len(a):
        return []
    own = label_changes(a) if len(a) == n else [int(v) for v in a]
    return sorted({b for b in own if 0 < b < n})


def clasp(x: np.ndarray, n_cps: int, period: int, k: int = 3) -> list[int]:
    """Splits where windows before and after are told apart best by their nearest neighbours (first channel)."""
    v = np.asarray(x, float).reshape(len(x), -1)[:, 0]
    n = len(v)
    w = max(2, min(period, n // 4))
    if n < 4 * w:
        return []
    h = np.lib.stride_tricks.sliding_window_view(v, w)
    z = (h - h.mean(axis=1, keepdims=True)) / np.maximum(h.std(axis=1, keepdims=True), 1e-9)

    def best(a: int, b: int) -> tuple[float, int]:
        m = b - a - w + 1
        if m < 4 * w:
            return -1.0, -1
        own = z[a : a + m]
        near = np.empty((m, k), int)
        long = m * m * w > FAR
        norm = (own**2).sum(axis=1)
        size = max(1, PORTION // (m if long else m * w))
        for r in range(0, m, size):
            if long:
                d = norm[r : r + size, None] + norm - 2 * own[r : r + size] @ own.T
            else:
                d = ((own[r : r + size, None] - own[None]) ** 2).sum(axis=2)
            d[np.abs(np.subtract.outer(np.arange(r, r + len(d)), np.arange(m))) < max(1, w // 2)] = np.inf
            near[r : r + size] = np.argsort(d, axis=1, kind="stable")[:, :k]
        scores = np.full(m, -1.0)
        for s in range(w, m - w):
            right = near >= s
            guess = right.sum(axis=1) * 2 > k
            truth = np.arange(m) >= s
            f1 = []
            for cls in (False, True):
                tp = ((guess == cls) & (truth == cls)).sum()
                f1.append(2 * tp / max(1, (guess == cls).sum() + (truth == cls).sum()))
            scores[s] = sum(f1) / 2
        s = int(np.argmax(scores))
        return float(scores[s]), a + s

    parts = {(0, n): best(0, n)}
    out: list[int] = []
    while len(out) < n_cps:
        (a, b), (score, at) = max(parts.items(), key=lambda kv: kv[1][0])
        if at < 0 or score <= 0.5:
            break
        out.append(at)
        del parts[(a, b)]
        parts[(a, at)], parts[(at, b)] = best(a, at), best(at, b)
    return sorted(out)


def bocpd(x: np.ndarray, hazard: float = 1 / 100.0) -> list[int]:
    """Frames at which the most likely run since the last change starts anew (normal-gamma model per channel)."""
    v = np.asarray(x, float).reshape(len(x), -1)
    v = (v - v.mean(axis=0)) / np.maximum(v.std(axis=0), 1e-9)
    n, d = v.shape
    # a run of i frames has nu = 2 + i
    ratio = np.array([math.lgamma((i + 3) / 2) - math.lgamma((i + 2) / 2) for i in range(n)])[:, None]
    log_r = np.array([0.0])
    mu, kappa, alpha, beta = np.zeros((1, d)), np.ones(1), np.ones(1), np.ones((1, d))
    start = np.zeros(n, int)
    for t in range(n):
        scale = beta * (kappa + 1)[:, None] / (alpha * kappa)[:, None]
        nu = (2 * alpha)[:, None]
        log_p = (ratio[: t + 1] - 0.5 * np.log(np.pi * nu * scale) - (nu + 1) / 2 * np.log1p((v[t] - mu) ** 2 / (nu * scale))).sum(axis=1)
        grow = log_r + log_p + math.log(1 - hazard)
        both = log_r + log_p + math.log(hazard)
        new = np.logaddexp.reduce(both)
        log_r = np.append(new, grow)
        log_r -= np.logaddexp.reduce(log_r)
        delta = v[t] - mu
        beta = np.vstack([np.ones((1, d)), beta + (kappa / (2 * (kappa + 1)))[:, None] * delta**2])
        mu = np.vstack([np.zeros((1, d)), (kappa[:, None] * mu + v[t]) / (kappa + 1)[:, None]])
        kappa, alpha = np.append(1.0, kappa + 1), np.append(1.0, alpha + 0.5)
        start[t] = t + 1 - int(np.argmax(log_r))
    return sorted({int(s) for s in start if 0 < s < n})


def stray(x: np.ndarray, k: int = 10, alpha: float = 0.01, share: float = 0.5) -> list[int]:
    """Borders of runs of outliers: points whose largest gap among neighbour distances lies beyond an exponential tail."""
    v = np.asarray(x, float).reshape(len(x), -1)
    span = v.max(axis=0) - v.min(axis=0)
    v = (v - v.min(axis=0)) / np.where(span > 0, span, 1.0)
    n = len(v)
    k = min(k, n - 1)
    if k < 1:
        return []
    size = max(1, PORTION // v.size)
    near = np.concatenate([np.sort(np.sqrt(((v[r : r + size, None] - v[None]) ** 2).sum(axis=2)), axis=1)[:, : k + 1].copy() for r in range(0, n, size)])
    score = near[np.arange(n), 1 + np.argmax(np.diff(near, axis=1), axis=1)]
    order = np.argsort(score, kind="stable")
    s = score[order]
    gaps = np.diff(s, prepend=s[0])
    odd = np.zeros(n, bool)
    back = max(min(50, n // 4), 2)
    weight = np.arange(2, back + 1) / (back - 1)
    for i in range(max(int(n * share), back), n):
        # spacings of an exponential tail: the expected next gap from the weighted ones before it
        expected = (weight * gaps[i - np.arange(2, back + 1) + 1]).sum()
        if gaps[i] > max(math.log(1 / alpha) * expected, 1e-12):
            odd[order[i:]] = True
            break
    return label_changes(odd)


def run_segmenter(name: str, x: np.ndarray, n_segments: int) -> list[int]:
    """Boundaries of one segmenter with its parameters from the expected number of segments; failures give none."""
    from kinegrain.functions.changepoints import binary_segmentation
    from kinegrain.functions.costs import make_cost

    n = len(x)
    try:
        if name == "clasp":
            return as_boundaries(clasp(x, max(1, n_segments - 1), max(2, n // 20)), n)
        if name == "binseg":
            return as_boundaries(binary_segmentation(make_cost("l2", x), max(1, n_segments - 1), 2), n)
        if name == "bocpd":
            return as_boundaries(bocpd(x), n)
        if name == "stray":
            return as_boundaries(stray(x), n)
    except Exception:  # noqa: BLE001 - the method's contract: no result
        return []
    return []  # greedy Gaussian segmentation yields nothing by contract; unknown names too
