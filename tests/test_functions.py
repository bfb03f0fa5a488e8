"""Numeric kernels against brute force and closed forms."""

import itertools
import math

import numpy as np
import pytest

from kinegrain.functions.changepoints import ChangeConfig, binary_segmentation, bottom_up, elbow, optimum_sizes, pelt, run_methods, sliding_window, tidy
from kinegrain.functions.costs import make_cost
from kinegrain.functions.primitives import PrimitiveConfig, discover, silhouette, switch_path
from kinegrain.functions.segmenters import as_boundaries, bocpd, clasp, run_segmenter, stray
from kinegrain.functions.signals import Model, butterworth, lowpass, rotation_to_quat, rpy_matrix


def plain_cost(model, x, a, b):
    s = x[a:b]
    if model == "l2":
        return ((s - s.mean(axis=0)) ** 2).sum()
    if model == "l1":
        return np.abs(s - np.median(s, axis=0)).sum()
    c = make_cost(model, x)
    g = c.gram()[a:b, a:b]
    return np.trace(g) - g.sum() / (b - a)


@pytest.mark.parametrize("model", ["l2", "l1", "rbf", "cosine"])
def test_costs_equal_their_definition(model):
    x = np.random.default_rng(1).normal(size=(23, 3))
    c = make_cost(model, x)
    for a, b in [(0, 23), (3, 4), (5, 17), (0, 2)]:
        assert c.one(a, b) == pytest.approx(plain_cost(model, x, a, b), abs=1e-9)


@pytest.mark.parametrize("model", ["l2", "l1", "rbf", "cosine"])
@pytest.mark.parametrize("seed", range(4))
def test_pelt_is_the_optimum(model, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(m, 1, size=(4, 2)) for m in (0, 3, -2)])
    c = make_cost(model, x)
    for penalty, least in [(0.3, 1), (1.0, 2), (3.0, 3), (8.0, 2)]:
        best = math.inf
        for k in range(len(x)):
            for cuts in itertools.combinations(range(1, len(x)), k):
                e = [0, *cuts, len(x)]
                if min(np.diff(e)) >= least:
                    best = min(best, sum(c.one(a, b) for a, b in zip(e[:-1], e[1:], strict=True)) + penalty * k)
        e = [0, *pelt(c, penalty, least), len(x)]
        own = sum(c.one(a, b) for a, b in zip(e[:-1], e[1:], strict=True)) + penalty * (len(e) - 2)
        assert own == pytest.approx(best)
        assert min(np.diff(e)) >= least


def test_step_is_found_by_every_search():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, (80, 4)), rng.normal(3, 0.1, (80, 4))])
    c = make_cost("l2", x)
    assert pelt(c, 50.0) == [80]
    assert binary_segmentation(c, 1) == [80]
    assert bottom_up(c, 50.0) == [80]
    assert sliding_window(c, 50.0, 40) == [80]
    out = run_methods(x, ChangeConfig(model="rbf"), ("pelt", "binseg", "unknown"))
    assert out["pelt"] == [80] and 80 in out["binseg"] and out["unknown"] == []


def test_short_and_constant_signals():
    for n in (1, 2, 4, 5, 9):
        x = np.zeros((n, 1))
        for model in ("l2", "l1", "rbf", "cosine"):
            assert pelt(make_cost(model, x), 1.0) == []
    assert tidy([0, 5, 5, 3, 9, 10], 10, 0) == [3, 5, 9]
    assert tidy([3, 5, 9], 10, 4) == [3, 9]
    assert elbow(np.array([3, 3, 3])) == 1
    assert elbow(np.array([9, 9, 9, 2, 1, 1, 1, 1])) == 2


def test_segmenters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 0.1, 60), rng.normal(5, 0.1, 60)])[:, None]
    assert any(abs(b - 60) <= 3 for b in bocpd(x))
    t = np.arange(200)
    wave = np.concatenate([np.sin(t[:100] / 2), np.sign(np.sin(t[100:] / 4))])[:, None]
    found = clasp(wave, 1, 10)
    assert found and abs(found[0] - 100) <= 15
    y = rng.normal(0, 0.01, 80)
    y[40:43] += 10
    assert stray(y[:, None]) == [40, 43]
    assert as_boundaries([0, 0, 1, 1, 1], 5) == [2] and as_boundaries([3, 0, 9], 9) == [3] and as_boundaries([], 4) == []
    assert run_segmenter("ggs", x, 3) == [] and run_segmenter("nothing", x, 3) == []
    assert run_segmenter("binseg", x, 2) == [60]


def test_primitives():
    rng = np.random.default_rng(0)
    a, b = rng.normal(0, 0.1, (40, 2)), rng.normal(0, 0.1, (40, 2)) + [5, -5]
    x = np.concatenate([a, b, a + 0.01, b])
    got = discover(x, [40, 80, 120], PrimitiveConfig(window=3, k=2, beta=5, max_iter=20))
    assert got["labels"][0] == got["labels"][2] != got["labels"][1] == got["labels"][3]
    assert discover(np.zeros((10, 3)), [], PrimitiveConfig(k=2)) is None
    assert silhouette(np.zeros((3, 1)), np.array([0, 0, 0])) is None
    assert silhouette(np.array([[0.0], [0.1], [9.0], [9.1]]), np.array([0, 0, 1, 1])) > 0.9
    assert switch_path(np.array([[0, 1], [1, 0], [0, 1]]), 5.0).tolist() == [0, 0, 0]


def test_lowpass():
    b, a = butterworth(3, 0.3)
    assert b.sum() / a.sum() == pytest.approx(1.0)
    w = np.exp(-1j * math.pi * 0.3 * np.arange(4))
    assert abs((b * w).sum() / (a * w).sum()) == pytest.approx(1 / math.sqrt(2))
    assert lowpass(np.full(40, 2.5), 30.0) == pytest.approx(np.full(40, 2.5))
    t = np.arange(300) / 30
    slow, fast = np.sin(2 * math.pi * 0.5 * t), np.sin(2 * math.pi * 14 * t)
    assert np.abs(lowpass(slow + fast, 30.0) - slow)[30:-30].max() < 0.02
    with pytest.raises(ValueError):
        lowpass(np.zeros(12), 30.0)


def test_kinematics():
    from kinegrain.plans.segment_queries import ARM

    m = Model(ARM)
    q = m.q_of(np.array([[0.0, 0.0], [math.pi / 2, 0.0], [0.3, -0.7]]), ["j1", "j2"])
    pos, rot = m.forward(q, "tip")
    assert pos[:, :2] == pytest.approx(np.array([[1.5, 0], [0, 1.5], [math.cos(0.3) + 0.5 * math.cos(-0.4), math.sin(0.3) + 0.5 * math.sin(-0.4)]]))
    with pytest.raises(KeyError):
        m.chain("nowhere")
    for r, p, y in [(0, 0, 0), (math.pi, 0, 0), (0.1, -1.2, 3.0), (0, math.pi, 0.2), (0, 0, math.pi)]:
        mat = rpy_matrix(r, p, y)
        x, yy, z, w = rotation_to_quat(mat[None])[0]
        back = np.array([[1 - 2 * (yy * yy + z * z), 2 * (x * yy - z * w), 2 * (x * z + yy * w)], [2 * (x * yy + z * w), 1 - 2 * (x * x + z * z), 2 * (yy * z - x * w)], [2 * (x * z - yy * w), 2 * (yy * z + x * w), 1 - 2 * (x * x + yy * yy)]])
        assert back == pytest.approx(mat, abs=1e-9)


@pytest.mark.parametrize("model", ["l2", "l1", "rbf", "cosine"])
def test_sweep_equals_single_searches(model):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(m, 1, size=(11, 2)) for m in (0, 4, 1)])
    tried = np.logspace(-1, 2, 15)
    for least, jump in [(1, 1), (5, 1), (2, 3)]:
        c = make_cost(model, x)
        assert optimum_sizes(c, tried, least, jump).tolist() == [len(pelt(c, float(p), least, jump)) for p in tried]
    assert optimum_sizes(make_cost(model, x[:3]), tried, 5).tolist() == [0] * 15


def test_kernels_without_their_square_equal_those_with_it():
    from kinegrain.functions import costs as C

    rng = np.random.default_rng(4)
    for x in (rng.normal(size=(900, 2)).cumsum(axis=0), np.repeat(rng.integers(0, 3, size=30), 30).astype(float)):
        for cost in (C.RBF, C.Cosine):
            whole, parts = cost(x), type("Parts", (cost,), {"DENSE": 100, "ROOM": 900 * 10})(x)
            for end in (900, 5, 6, 70, 640, 641, 899):
                starts = np.arange(end)
                assert np.allclose(parts(starts, end), whole(starts, end), atol=1e-7)
                assert np.allclose([parts.one(a, end) for a in (0, end - 1, end // 2)], [whole.one(a, end) for a in (0, end - 1, end // 2)], atol=1e-7)
            assert np.allclose(parts.many(77, np.arange(78, 901)), whole.many(77, np.arange(78, 901)), atol=1e-7)


def test_middle_of_portions_is_exact():
    from kinegrain.functions import costs as C

    rng = np.random.default_rng(5)
    for v in (rng.normal(size=20_001), rng.normal(size=5000), np.repeat([1.0, 2.0], 3000), np.zeros(4000), np.append(rng.exponential(size=4000) ** 9, 1e12), np.repeat([0.0, 5.0, 7.0], 2000), np.repeat([1.0, np.nextafter(1.0, 2)], [2000, 2500])):
        assert C.middle(lambda: iter(np.array_split(v, 7)), len(v), False, room=50) == np.median(v)


def test_segmenters_in_portions(monkeypatch):
    from kinegrain.functions import segmenters as S

    x = np.random.default_rng(6).normal(size=(400, 2)) + np.repeat([0, 4], 200)[:, None]
    whole = S.clasp(x, 2, 20), S.stray(x)
    monkeypatch.setattr(S, "PORTION", 5000)
    assert (S.clasp(x, 2, 20), S.stray(x)) == whole
    monkeypatch.setattr(S, "FAR", 0)
    assert S.clasp(x, 2, 20) == whole[0]
