"""Recurring primitives: Toeplitz inverse-covariance clustering of windows with a switching cost."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class PrimitiveConfig:
    window: int = 10
    k: int | str = "auto"
    max_k: int = 10
    lam: float = 0.11
    beta: float = 400.0
    max_iter: int = 100
    seed: int = 42


def graphical_lasso(s: np.ndarray, lam: float, blocks: int, rho: float = 1.0, rounds: int = 100, tol: float = 1e-4) -> np.ndarray:
    """Sparse inverse covariance whose blocks of equal lag are equal, by alternating directions."""
    n = len(s)
    d = n // blocks
    z, u = np.eye(n), np.zeros((n, n))
    for _ in range(rounds):
        val, vec = np.linalg.eigh(rho * (z - u) - s)
        theta = (vec * ((val + np.sqrt(val**2 + 4 * rho)) / (2 * rho))) @ vec.T
        a = theta + u
        new = np.zeros_like(a)
        for k in range(blocks):
            own = [a[i * d : (i + 1) * d, (i + k) * d : (i + k + 1) * d] for i in range(blocks - k)]
            m = np.mean(own, axis=0)
            if k == 0:
                m = (m + m.T) / 2
                soft = np.sign(m) * np.maximum(np.abs(m) - lam / rho, 0)
                np.fill_diagonal(soft, np.diag(m))
            else:
                soft = np.sign(m) * np.maximum(np.abs(m) - lam / rho, 0)
            for i in range(blocks - k):
                new[i * d : (i + 1) * d, (i + k) * d : (i + k + 1) * d] = soft
                new[(i + k) * d : (i + k + 1) * d, i * d : (i + 1) * d] = soft.T
        change = np.abs(new - z).max()
        z = new
        u = u + theta - z
        if change < tol:
            break
    val, vec = np.linalg.eigh(z)
    return (vec * np.maximum(val, 1e-3)) @ vec.T


def switch_path(cost: np.ndarray, beta: float) -> np.ndarray:
    """Labels of least cost plus ``beta`` per change."""
    n, k = cost.shape
    total = cost[0].copy()
    back = np.zeros((n, k), int)
    for t in range(1, n):
        j = int(np.argmin(total))
        stay = total <= total[j] + beta
        back[t] = np.where(stay, np.arange(k), j)
        total = np.where(stay, total, total[j] + beta) + cost[t]
    out = np.zeros(n, int)
    out[-1] = int(np.argmin(total))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


def start_labels(h: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Nearest of k means, the first guesses being the points farthest from those before."""
    mid = [h[int(np.argmin(((h - h.mean(axis=0)) ** 2).sum(axis=1)))]]
    while len(mid) < k:
        mid.append(h[int(np.argmax(np.min([((h - m) ** 2).sum(axis=1) for m in mid], axis=0)))])
    centres = np.array(mid)
    label = np.full(len(h), -1)
    for _ in range(rounds):
        new = np.argmin(((h[:, None] - centres[None]) ** 2).sum(axis=2), axis=1)
        if np.array_equal(new, label):
            break
        label = new
        centres = np.array([h[label == c].mean(axis=0) if (label == c).any() else centres[c] for c in range(k)])
    return label


def cluster_windows(x: np.ndarray, k: int, config: PrimitiveConfig) -> np.ndarray:
    """One label per frame of ``x`` (T, D)."""
    t, d = x.shape
    w = min(config.window, t)
    if t - w + 1 < 2 * k:
        raise ValueError("too few windows for the clusters")
    h = np.lib.stride_tricks.sliding_window_view(x, w, axis=0).transpose(0, 2, 1).reshape(t - w + 1, w * d)
    label = start_labels(h, k)
    rng = np.random.default_rng(config.seed)
    for _ in range(config.max_iter):
        cost = np.zeros((len(h), k))
        for c in range(k):
            own = h[label == c]
            if len(own) < 2:
                own = h[rng.choice(len(h), size=min(len(h), 2 * w), replace=False)]
            mean = own.mean(axis=0)
            theta = graphical_lasso(np.cov(own.T, bias=True).reshape(w * d, w * d), config.lam, w)
            r = h - mean
            cost[:, c] = 0.5 * np.einsum("ij,jk,ik->i", r, theta, r) - 0.5 * np.linalg.slogdet(theta)[1]
        new = switch_path(cost, config.beta)
        if np.array_equal(new, label):
            break
        label = new
    return np.append(label, np.full(w - 1, label[-1]))


def silhouette(points: np.ndarray, labels: np.ndarray) -> float | None:
    """Mean silhouette of Euclidean distances; None with fewer than two clusters or one point per cluster."""
    kinds = np.unique(labels)
    if not 2 <= len(kinds) < len(points):
        return None
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    score = np.zeros(len(points))
    for i in range(len(points)):
        own = labels == labels[i]
        if own.sum() == 1:
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, labels == c].mean() for c in kinds if c != labels[i])
        score[i] = (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return float(score.mean())


def downsample(segment: np.ndarray, w: int) -> np.ndarray:
    """``w`` rows at even distances (halves to even); shorter segments are padded with their last row."""
    n = len(segment)
    if n >= w:
        return segment[np.rint(np.linspace(0, n - 1, w)).astype(int)]
    return np.concatenate([segment, np.repeat(segment[-1:], w - n, axis=0)])


def describe(parts: list[np.ndarray], labels: np.ndarray, k: int) -> dict:
    """Sizes of the clusters, transitions between neighbouring segments as shares of their row, and the segment nearest to each cluster's mean."""
    means = np.array([p.mean(axis=0) for p in parts])
    steps = np.zeros((k, k))
    np.add.at(steps, (labels[:-1], labels[1:]), 1.0)
    total = steps.sum(axis=1, keepdims=True)
    near = []
    for c in range(k):
        own = np.flatnonzero(labels == c)
        far = np.linalg.norm(means[own] - means[own].mean(axis=0), axis=1) if len(own) else np.empty(0)
        near.append(int(own[np.argmin(far)]) if len(own) else None)
    return {"sizes": np.bincount(labels, minlength=k).tolist(), "transitions": (steps / np.maximum(total, 1.0)).tolist(), "representatives": near}


def segment_labels(frame_labels: np.ndarray, lengths: list[int], gap: int) -> np.ndarray:
    """Most frequent label of each segment; frames of the gaps between don't count."""
    out, at = [], 0
    for n in lengths:
        out.append(int(np.argmax(np.bincount(frame_labels[at : at + n]))))
        at += n + gap
    return np.array(out)


def discover(x: np.ndarray, boundaries: list[int], config: PrimitiveConfig) -> dict | None:
    """Primitive of each segment between the boundaries; None with fewer than two segments or no fit."""
    edges = [0, *boundaries, len(x)]
    parts = [x[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]
    if len(parts) < 2:
        return None
    w = config.window
    gap = np.zeros((w, x.shape[1]))
    joined = np.concatenate([p for s in parts for p in (s, gap)][:-1])
    means = np.array([p.mean(axis=0) for p in parts])
    lengths = [len(p) for p in parts]
    tries = range(2, max(3, min(config.max_k + 1, len(parts)))) if config.k == "auto" else [int(config.k)]
    best: dict | None = None
    for k in tries:
        try:
            labels = segment_labels(cluster_windows(joined, k, config), lengths, w)
        except Exception:  # noqa: BLE001 - this k can't be fitted
            continue
        s = silhouette(means, labels)
        if best is None or (s is not None and (best["silhouette"] is None or s > best["silhouette"])):
            best = {"k": k, "labels": labels.tolist(), "silhouette": s, **describe(parts, labels, k)}
    return best
