"""Numeric kernels: Butterworth low-pass without phase, URDF chains and forward kinematics."""

from __future__ import annotations

import math
import xml.etree.ElementTree as ET
from dataclasses import dataclass

import numpy as np


def butterworth(order: int, wn: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital low-pass; ``wn`` is a fraction of the Nyquist rate."""
    warped = 4 * math.tan(math.pi * wn / 2)
    poles = warped * np.exp(1j * math.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    z = (4 + poles) / (4 - poles)
    gain = (warped**order / np.prod(4 - poles)).real
    return gain * np.poly(-np.ones(order)).real, np.poly(z).real


def _filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    y = np.empty_like(x)
    z = state.copy()
    for i, v in enumerate(x):
        y[i] = b[0] * v + z[0]
        z[:-1] = b[1:-1] * v + z[1:] - a[1:-1] * y[i]
        z[-1] = b[-1] * v - a[-1] * y[i]
    return y


def lowpass(x: np.ndarray, rate: float, cutoff: float = 8.0, order: int = 3) -> np.ndarray:
    """Forward and backward filter of one series with odd padding of 3 (order + 1) values; a shorter series raises ValueError."""
    x = np.asarray(x, float)
    pad = 3 * (order + 1)
    if len(x) <= pad:
        raise ValueError(f"a series of {len(x)} values is too short")
    b, a = butterworth(order, float(np.clip(cutoff / (rate / 2), 1e-5, 0.99)))
    m = np.eye(order) - np.vstack([np.column_stack([-a[1:order], np.eye(order - 1)]), np.append(-a[order], np.zeros(order - 1))])
    rest = np.linalg.solve(m, b[1:] - a[1:] * b[0])
    e = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y = _filter(b, a, e, rest * e[0])
    y = _filter(b, a, y[::-1], rest * y[-1])[::-1]
    return y[pad:-pad]


@dataclass(frozen=True)
class Joint:
    name: str
    kind: str
    parent: str
    child: str
    xyz: tuple[float, float, float]
    rpy: tuple[float, float, float]
    axis: tuple[float, float, float]


def rpy_matrix(r: float, p: float, y: float) -> np.ndarray:
    cr, sr, cp, sp, cy, sy = math.cos(r), math.sin(r), math.cos(p), math.sin(p), math.cos(y), math.sin(y)
    return np.array([[cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr], [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr], [-sp, cp * sr, cp * cr]])


class Model:
    """A robot's tree of joints, from a URDF text."""

    def __init__(self, urdf: str):
        triple = lambda s, d: tuple(float(v) for v in s.split()) if s else d
        self.joints = []
        for j in ET.fromstring(urdf).iter("joint"):
            if j.find("parent") is None:
                continue
            o, ax = j.find("origin"), j.find("axis")
            get = lambda e, k: e.get(k) if e is not None else None
            self.joints.append(Joint(j.get("name"), j.get("type"), j.find("parent").get("link"), j.find("child").get("link"), triple(get(o, "xyz"), (0, 0, 0)), triple(get(o, "rpy"), (0, 0, 0)), triple(get(ax, "xyz"), (1, 0, 0))))
        self.moving = [j.name for j in self.joints if j.kind in ("revolute", "continuous", "prismatic")]
        self.index = {n: k for k, n in enumerate(self.moving)}
        self.into = {j.child: j for j in self.joints}

    def chain(self, frame: str) -> list[Joint]:
        out, at = [], frame
        named = {j.name: j.child for j in self.joints}
        at = named.get(frame, frame)
        if at not in self.into and at not in {j.parent for j in self.joints}:
            raise KeyError(f"no frame {frame!r}")
        while at in self.into:
            out.append(self.into[at])
            at = self.into[at].parent
        return out[::-1]

    def q_of(self, state: np.ndarray, names: list[str], extra: dict[str, int] | None = None) -> np.ndarray:
        """Model configurations (T, n) of state vectors (T, D): named joints, then ``extra`` joints by position; others stay zero."""
        q = np.zeros((len(state), len(self.moving)))
        for k, n in enumerate(names):
            if n in self.index and k < state.shape[1]:
                q[:, self.index[n]] = state[:, k]
        for n, k in (extra or {}).items():
            if n in self.index and k < state.shape[1]:
                q[:, self.index[n]] = state[:, k]
        return q

    def forward(self, q: np.ndarray, frame: str) -> tuple[np.ndarray, np.ndarray]:
        """Positions (T, 3) and rotations (T, 3, 3) of a frame."""
        t = len(q)
        pos, rot = np.zeros((t, 3)), np.broadcast_to(np.eye(3), (t, 3, 3)).copy()
        for j in self.chain(frame):
            pos = pos + rot @ np.array(j.xyz)
            rot = rot @ rpy_matrix(*j.rpy)
            if j.name in self.index:
                v = q[:, self.index[j.name]]
                axis = np.array(j.axis) / max(np.linalg.norm(j.axis), 1e-12)
                if j.kind == "prismatic":
                    pos = pos + (rot @ axis) * v[:, None]
                else:
                    k = np.array([[0, -axis[2], axis[1]], [axis[2], 0, -axis[0]], [-axis[1], axis[0], 0]])
                    turn = np.eye(3) + np.sin(v)[:, None, None] * k + (1 - np.cos(v))[:, None, None] * (k @ k)
                    rot = rot @ turn
        return pos, rot


def rotation_to_rpy(r: np.ndarray) -> np.ndarray:
    return np.stack([np.arctan2(r[:, 2, 1], r[:, 2, 2]), np.arctan2(-r[:, 2, 0], np.hypot(r[:, 0, 0], r[:, 1, 0])), np.arctan2(r[:, 1, 0], r[:, 0, 0])], axis=1)


def rotation_to_quat(r: np.ndarray) -> np.ndarray:
    """Quaternions (x, y, z, w) with w not negative, from the dominant component."""
    xx, yy, zz = r[:, 0, 0], r[:, 1, 1], r[:, 2, 2]
    sq = np.maximum(0.0, np.stack([1 + xx - yy - zz, 1 - xx + yy - zz, 1 - xx - yy + zz, 1 + xx + yy + zz], axis=1)) / 4
    m = np.argmax(sq, axis=1)
    a = np.sqrt(np.take_along_axis(sq, m[:, None], axis=1)[:, 0])
    # symmetric sums and antisymmetric differences of the off-diagonal elements
    sxy, sxz, syz = r[:, 0, 1] + r[:, 1, 0], r[:, 0, 2] + r[:, 2, 0], r[:, 1, 2] + r[:, 2, 1]
    dx, dy, dz = r[:, 2, 1] - r[:, 1, 2], r[:, 0, 2] - r[:, 2, 0], r[:, 1, 0] - r[:, 0, 1]
    square = 4 * a * a
    rows = np.array([[square, sxy, sxz, dx], [sxy, square, syz, dy], [sxz, syz, square, dz], [dx, dy, dz, square]])
    out = rows[m, :, np.arange(len(r))] / (4 * a)[:, None]
    return np.where(out[:, 3:] < 0, -out, out)
