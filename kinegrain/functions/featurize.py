"""Feature matrices of one recording: resampled, smoothed, differentiated, scaled and weighted blocks.

What a modality holds is a table of recipes: blocks of (name, source, order of derivative). Groups of
joints repeat the recipes over their own channels, with the group in the names of blocks and features.
"""

from __future__ import annotations

import math

import numpy as np

from kinegrain.functions.signals import lowpass

JOINT = ("joint", (("q", "q", 0), ("dq", "q", 1), ("ddq", "q", 2)))
COMMAND = ("command", (("q_cmd", "cmd", 0), ("q_err", "err", 0)))
POSITION = (("pos", "pos", 0), ("dpos", "pos", 1), ("ddpos", "pos", 2))
ROTATION = (("rotvec", "rot", 0), ("drot", "rot", 1), ("ddrot", "rot", 2))
RECIPES = {"joint": (JOINT,), "joint_command": (JOINT, COMMAND), "cartesian": (("cartesian", (*POSITION, *ROTATION)),)}


def resample(t: np.ndarray, x: np.ndarray, dt: float | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Times t0, t0 + dt, ... up to half a step beyond the last one, and ``x`` (T, D) there; ``dt`` is the median positive step unless given."""
    if len(t) < 2:
        raise ValueError("fewer than two rows")
    step = np.diff(t)
    if not (step > 0).all():
        raise ValueError("times don't rise")
    dt = float(np.median(step)) if dt is None else float(dt)
    if not dt > 0:
        raise ValueError("dt must be positive")
    s = t - t[0]
    at = np.arange(math.ceil((s[-1] + 0.5 * dt) / dt)) * dt
    return t[0] + at, np.column_stack([np.interp(at, s, c) for c in x.T]) if x.shape[1] else np.empty((len(at), 0)), dt


def _moving_average(x: np.ndarray, k: int) -> np.ndarray:
    k = max(3, k) | 1
    e = np.pad(x, ((k // 2, k // 2), (0, 0)), mode="edge")
    sums = np.cumsum(np.vstack([np.zeros((1, x.shape[1])), e]), axis=0)
    return (sums[k:] - sums[:-k]) / k


def _savgol(x: np.ndarray, window: int, polyorder: int) -> np.ndarray:
    """Local polynomials, the ends by the fit of the first and last window; too short series by a moving average of five."""
    n = len(x)
    window = max(5, window) | 1
    own = window if n >= window else n - 1 + n % 2
    if n < 5 or own <= polyorder:
        return _moving_average(x, 5)
    at = np.arange(own) - own // 2
    v = np.vander(at, polyorder + 1, increasing=True).astype(float)
    fit = v @ np.linalg.pinv(v)
    half = own // 2
    out = np.empty_like(x)
    out[half : n - half] = np.einsum("tdw,w->td", np.lib.stride_tricks.sliding_window_view(x, own, axis=0), fit[half])
    out[:half] = fit[:half] @ x[:own]
    out[n - half :] = fit[half + 1 :] @ x[n - own :]
    return out


def smooth(x: np.ndarray, method: str, window: int, polyorder: int, rate: float, cutoff: float = 8.0) -> np.ndarray:
    if method == "none" or not x.shape[1]:
        return x
    if method == "savgol":
        return _savgol(x, window, polyorder)
    if method == "moving_average":
        return _moving_average(x, window)
    if method == "lowpass":
        return _moving_average(x, 5) if len(x) < 8 else np.column_stack([lowpass(c, rate, cutoff) for c in x.T])
    raise ValueError(f"unknown smoothing {method!r}")


def derivative(x: np.ndarray, dt: float, order: int) -> np.ndarray:
    for _ in range(order):
        x = np.gradient(x, dt, axis=0) if len(x) > 1 else np.zeros_like(x)
    return x


def scale(x: np.ndarray, method: str) -> np.ndarray:
    """(x - median) / spread of every channel; spreads near zero are one."""
    if method == "none" or not x.size:
        return x
    mid = np.median(x, axis=0)
    if method == "mad":
        spread = 1.4826 * np.median(np.abs(x - mid), axis=0)
    elif method == "iqr":
        spread = np.percentile(x, 75, axis=0) - np.percentile(x, 25, axis=0)
    else:
        raise ValueError(f"unknown normalisation {method!r}")
    return (x - mid) / np.where(np.abs(spread) < 1e-8, 1.0, spread)


def rotation_vectors(quat: np.ndarray) -> np.ndarray:
    """Rotation vectors (T, 3) of quaternions (x, y, z, w), each negated where it lies more than pi from the fixed one before."""
    q = quat / np.maximum(np.linalg.norm(quat, axis=1, keepdims=True), 1e-12)
    q = np.where(q[:, 3:] < 0, -q, q)
    part = np.linalg.norm(q[:, :3], axis=1)
    factor = np.where(part < 1e-12, 2.0, 2 * np.arctan2(part, q[:, 3]) / np.maximum(part, 1e-300))
    out = q[:, :3] * factor[:, None]
    # whether a vector is turned against its predecessor as it stands, and against that one negated
    apart = np.linalg.norm(out[1:] - out[:-1], axis=1) > math.pi
    against = np.linalg.norm(out[1:] + out[:-1], axis=1) > math.pi
    sign = False
    for i in np.flatnonzero(apart | against) + 1:
        # between these places both choices keep a vector as it is
        sign = False if i > 1 and not (apart[i - 2] or against[i - 2]) else sign
        sign = bool(against[i - 1] if sign else apart[i - 1])
        if sign:
            out[i] = -out[i]
    return out + 0.0


def group_channels(names: list[str], groups: dict[str, list[str]]) -> dict[str, list[int]]:
    """Channels of each group by their names; names that aren't there are passed over, and so are groups without any."""
    at = {n: k for k, n in enumerate(names)}
    found = {g: [at[n] for n in own if n in at] for g, own in groups.items()}
    return {g: own for g, own in found.items() if own}


def layout(modality: str, width: int, rotated: bool = True, groups: dict[str, list[int]] | None = None) -> list[tuple[str, str, str, int, list[int]]]:
    """(block, feature prefix, source, derivative, channels) of every part of a matrix, in order."""
    recipes = RECIPES[modality]
    if modality == "cartesian":
        return [(b, p, s, d, [0, 1, 2]) for b, parts in recipes for p, s, d in parts if rotated or s != "rot"]
    if groups is None:
        return [(b, p, s, d, list(range(width))) for b, parts in recipes for p, s, d in parts]
    return [(g if b == "joint" else f"{b}_{g}", f"{p}_{g}", s, d, own) for g, own in groups.items() for b, parts in recipes for p, s, d in parts]


def names_of(parts: list[tuple[str, str, str, int, list[int]]]) -> list[str]:
    return [f"{p}_{k}" for _, p, _, _, own in parts for k in range(len(own))]


def feature_matrix(t: np.ndarray, sources: dict[str, np.ndarray], parts, config, weight_of) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Grid times, features and the same before scaling and weighting.

    ``sources`` are q and cmd, or pos and rot; ``weight_of`` gives the weight of a feature's name. The error
    of a command is taken after smoothing. Without any part the matrix has no column and the times stay.
    """
    if not parts:
        return t, np.empty((len(t), 0)), np.empty((len(t), 0))
    if "cmd" in sources and sources["cmd"].shape != sources["q"].shape:
        raise ValueError("state and command differ in width")
    names = list(sources)
    widths = [sources[n].shape[1] for n in names]
    at, every, dt = resample(t, np.column_stack([sources[n] for n in names]), config.dt)
    every = smooth(every, config.smoothing, config.window, config.polyorder, 1 / dt, config.cutoff)
    flat = dict(zip(names, np.split(every, np.cumsum(widths)[:-1], axis=1), strict=True))
    if "cmd" in flat:
        flat["err"] = flat["cmd"] - flat["q"]
    made: dict[tuple[str, int], np.ndarray] = {}
    for _, _, s, d, _ in parts:
        if (s, d) not in made:
            made[s, d] = derivative(flat[s], dt, d)
    raw = np.concatenate([made[s, d][:, own] for _, _, s, d, own in parts], axis=1)
    weights = np.array([config.block_weights.get(b, 1.0) for b, _, _, _, own in parts for _ in own]) * np.array([weight_of(n) for n in names_of(parts)])
    return at, scale(raw, config.normalize) * weights, raw
