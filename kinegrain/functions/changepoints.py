"""Change-point searches over a segment cost. All return sorted interior boundaries.

The penalised optimum is exact: of equal sums the earlier start wins. Ends lie on multiples of ``jump``
and at the end of the signal; no segment is shorter than ``min_size``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np

from kinegrain.functions.costs import Cost, make_cost


@dataclass(frozen=True)
class ChangeConfig:
    model: str = "rbf"
    min_size: int = 5
    jump: int = 1
    penalty: float | str = "auto"
    penalty_range: tuple[float, float] = (0.5, 200.0)
    penalty_steps: int = 40
    max_n_bkps: int = 30
    min_gap_frames: int = 0
    fallback_penalty: float = 10.0
    width: int = 100


def pelt(cost: Cost, penalty: float, min_size: int = 5, jump: int = 1) -> list[int]:
    """Least cost plus ``penalty`` per boundary, with starts dropped once they can't win any more."""
    n = cost.n
    ends = [e for e in range(jump, n, jump) if e >= min_size] + ([n] if n >= min_size else [])
    best = np.full(n + 1, np.inf)
    best[0] = -penalty
    back = np.full(n + 1, -1)
    # a beaten start still serves ends closer than min_size to the one that beat it
    until = np.full(n + 1, n + 1)
    known = np.zeros(n + 1, bool)
    known[0] = True
    for e in ends:
        last = e - min_size + 1
        able = np.flatnonzero(known[:last] & (until[:last] > e))
        if not len(able):
            continue
        own = best[able] + cost(able, e)
        k = int(np.argmin(own))
        best[e], back[e], known[e] = own[k] + penalty, able[k], True
        beaten = able[own > best[e]]
        until[beaten] = np.minimum(until[beaten], e + min_size)
    out, e = [], n
    while back[e] >= 0:
        e = int(back[e])
        if e:
            out.append(e)
    return sorted(out)


def binary_segmentation(cost: Cost, n_bkps: int, min_size: int = 5, jump: int = 1) -> list[int]:
    """The ``n_bkps`` splits that each lower the cost most, one after the other."""

    def split(a: int, b: int) -> tuple[float, int]:
        at = np.array([s for s in range(a + min_size, b - min_size + 1) if s % jump == 0], dtype=int)
        if not len(at):
            return -np.inf, -1
        gain = cost.one(a, b) - cost.many(a, at) - cost(at, b)
        k = int(np.argmax(gain))
        return float(gain[k]), int(at[k])

    parts = {(0, cost.n): split(0, cost.n)}
    out: list[int] = []
    while len(out) < n_bkps:
        (a, b), (gain, at) = max(parts.items(), key=lambda kv: (kv[1][0], -kv[0][0]))
        if at < 0:
            break
        out.append(at)
        del parts[(a, b)]
        parts[(a, at)], parts[(at, b)] = split(a, at), split(at, b)
    return sorted(out)


def bottom_up(cost: Cost, penalty: float, min_size: int = 5, jump: int = 1) -> list[int]:
    """Merge the neighbours whose union costs least more, while that is below the penalty."""
    step = max(min_size, jump)
    step += -step % jump
    cuts = [0, *[c for c in range(step, cost.n - min_size + 1, step)], cost.n]
    rise = [cost.one(cuts[k - 1], cuts[k + 1]) - cost.one(cuts[k - 1], cuts[k]) - cost.one(cuts[k], cuts[k + 1]) for k in range(1, len(cuts) - 1)]
    while rise:
        k = int(np.argmin(rise))
        if rise[k] >= penalty:
            break
        del cuts[k + 1], rise[k]
        for j in (k - 1, k):
            if 0 <= j < len(rise):
                a, m, b = cuts[j], cuts[j + 1], cuts[j + 2]
                rise[j] = cost.one(a, b) - cost.one(a, m) - cost.one(m, b)
    return cuts[1:-1]


def sliding_window(cost: Cost, penalty: float, width: int = 100, min_size: int = 5, jump: int = 1) -> list[int]:
    """Peaks of the discrepancy between the two halves of a window, taken in order of height while each lowers the cost by more than the penalty."""
    half = max(min_size, min(width, cost.n) // 2)
    at = [s for s in range(0, cost.n + 1, jump) if half <= s <= cost.n - half]
    if not at:
        return []
    d = np.array([cost.one(s - half, s + half) - cost.one(s - half, s) - cost.one(s, s + half) for s in at])
    peaks = [k for k in range(len(at)) if d[k] == d[max(0, k - half) : k + half + 1].max()]
    out: list[int] = []
    for k in sorted(peaks, key=lambda k: (-d[k], at[k])):
        edges = [0, *sorted(out), cost.n]
        a = max(e for e in edges if e <= at[k])
        b = min(e for e in edges if e > at[k])
        if at[k] - a < min_size or b - at[k] < min_size:
            continue
        if cost.one(a, b) - cost.one(a, at[k]) - cost.one(at[k], b) <= penalty:
            break
        out.append(at[k])
    return sorted(out)


def elbow(counts: np.ndarray) -> int:
    """Index of the sharpest bend (first of the largest absolute second difference); the middle where there is none."""
    if len(counts) < 3 or np.all(counts == counts[0]):
        return len(counts) // 2
    return int(np.argmax(np.abs(np.gradient(np.gradient(counts.astype(float))))))


#: Up to this length a sweep prices all segments once and searches for every penalty at the same time.
TABLE = 2000


def optimum_sizes(cost: Cost, penalties: np.ndarray, min_size: int = 5, jump: int = 1) -> np.ndarray:
    """Number of boundaries of the penalised optimum for each of many penalties."""
    n = cost.n
    if n > TABLE:
        return np.array([len(pelt(cost, float(p), min_size, jump)) for p in penalties])
    ends = [e for e in range(jump, n, jump) if e >= min_size] + ([n] if n >= min_size else [])
    best = np.full((len(penalties), n + 1), np.inf)
    best[:, 0] = -penalties
    count = np.zeros((len(penalties), n + 1), int)
    starts = np.array([0, *ends])
    rows = np.arange(len(penalties))
    for e in ends:
        able = starts[starts <= e - min_size]
        own = best[:, able] + cost(able, e)
        k = np.argmin(own, axis=1)
        best[:, e] = own[rows, k] + penalties
        count[:, e] = count[rows, able[k]] + (able[k] > 0)
    return count[:, n]


def penalty_sweep(cost: Cost, config: ChangeConfig) -> tuple[float, np.ndarray, np.ndarray]:
    """Chosen penalty, the penalties tried and the number of boundaries of each."""
    lo, hi = max(config.penalty_range[0], 1e-6), config.penalty_range[1]
    tried = np.logspace(np.log10(lo), np.log10(hi), config.penalty_steps)
    counts = optimum_sizes(cost, tried, config.min_size, config.jump)
    return float(tried[elbow(counts)]), tried, counts


def tidy(found: list[int], n: int, gap: int = 0) -> list[int]:
    """Sorted, distinct, interior; each at least ``gap`` after the last one kept."""
    out: list[int] = []
    for b in sorted({int(x) for x in found if 0 < x < n}):
        if not out or gap <= 0 or b - out[-1] >= gap:
            out.append(b)
    return out


def run_methods(x: np.ndarray, config: ChangeConfig, methods: tuple[str, ...] = ("pelt", "binseg")) -> dict[str, list[int]]:
    """Boundaries of several methods on one signal; the cost and the penalty are worked out once."""
    cost = make_cost(config.model, x)
    penalty = config.penalty
    if penalty == "auto":
        try:
            penalty = penalty_sweep(cost, config)[0]
        except Exception:  # noqa: BLE001
            penalty = config.fallback_penalty
    own = pelt(cost, float(penalty), config.min_size, config.jump)
    runs: dict[str, Callable[[], list[int]]] = {
        "pelt": lambda: own,
        "binseg": lambda: binary_segmentation(cost, min(max(len(own), 1), config.max_n_bkps), config.min_size, config.jump),
        "window": lambda: sliding_window(cost, float(penalty), config.width, config.min_size, config.jump),
        "bottomup": lambda: bottom_up(cost, float(penalty), config.min_size, config.jump),
    }
    return {m: tidy(runs[m](), cost.n, config.min_gap_frames) if m in runs else [] for m in methods}
