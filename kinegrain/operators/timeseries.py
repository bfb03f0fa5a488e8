"""Cleaning, resampling, smoothing and differentiation of ordered series.

All operators take rows of (key columns, an order column, a time column, values). One window per key
serves every step, so a chain of them shares one shuffle. Keys are recordings; a window streams its rows
and spills, it isn't collected.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def present(x: Column) -> Column:
    """NaN as null: the engine orders NaN above all numbers, the series' rules mean neither."""
    return F.when(~F.isnan(x), x)


def forward_fill(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Last value seen so far in each column; leading gaps stay null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(present(F.col(c)), ignorenulls=True).over(w) for c in columns})


def clean_rows(df: DataFrame, keys: list[str], order: str, columns: list[str], policy: str = "ffill_drop") -> DataFrame:
    """Fill forward (unless the policy is ``none``), then drop rows that still miss any value."""
    if policy not in ("ffill_drop", "none"):
        raise ValueError(f"unknown fill policy {policy!r}")
    out = forward_fill(df, keys, order, columns) if policy == "ffill_drop" else df.withColumns({c: present(F.col(c)) for c in columns})
    return out.dropna(subset=columns)


def median_dt(df: DataFrame, keys: list[str], order: str, time: str = "t") -> DataFrame:
    """``dt`` of each key: exact median of its positive time steps; null without one."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("__step", step).groupBy(*keys).agg(F.median(F.when(F.col("__step") > 0, F.col("__step"))).alias("dt"))


def resample_linear(df: DataFrame, keys: list[str], order: str, columns: list[str], time: str = "t", dt: float | None = None) -> DataFrame:
    """Linear interpolation at t0, t0 + dt, ... up to the last time plus half a step.

    Rows come out as (keys, k, t, columns, dt). Each interval between neighbouring rows makes the grid
    points it holds, so nothing is joined. Keys with fewer than two rows or times that don't rise have
    no rows here; ``resample_status`` names them.
    """
    if dt is not None and not dt > 0:
        raise ValueError("dt must be positive")
    if dt is None:
        steps = F.median(F.when(F.col("__step") > 0, F.col("__step"))).over(Window.partitionBy(*keys))
    else:
        steps = F.lit(float(dt))
    w = Window.partitionBy(*keys).orderBy(order)
    every = Window.partitionBy(*keys)
    base = (
        df.withColumn("__t0", F.min(time).over(every))
        .withColumn("__s", F.col(time) - F.col("__t0"))
        .withColumn("__step", F.col("__s") - F.lag("__s").over(w))
        .withColumn("__dt", steps)
        .withColumn("__bad", F.max(F.when(F.col("__step") <= 0, 1).otherwise(0)).over(every))
        .withColumn("__rows", F.count(F.lit(1)).over(every))
        .where("__bad = 0 and __rows > 1 and __dt > 0")
        .withColumn("__s1", F.lead("__s").over(w))
        .withColumns({f"__v1_{i}": F.lead(c).over(w) for i, c in enumerate(columns)})
    )
    first = F.ceil(F.col("__s") / F.col("__dt")).cast("bigint")
    size = F.ceil((F.col("__s") + 0.5 * F.col("__dt")) / F.col("__dt")).cast("bigint")
    stop = F.when(F.col("__s1").isNull(), size).otherwise(F.ceil(F.col("__s1") / F.col("__dt")).cast("bigint"))
    points = base.withColumn("__n", stop - first).where("__n > 0").withColumn("k", F.explode(F.sequence(first, stop - 1)))
    at = F.col("k") * F.col("__dt")
    share = F.when(F.col("__s1").isNull(), 0.0).otherwise((at - F.col("__s")) / (F.col("__s1") - F.col("__s")))
    mixed = [F.when(F.col("__s1").isNull(), F.col(c)).otherwise(F.col(c) + (F.col(f"__v1_{i}") - F.col(c)) * share).alias(c) for i, c in enumerate(columns)]
    return points.select(*keys, "k", (F.col("__t0") + at).alias(time), *mixed, F.col("__dt").alias("dt"))


def resample_status(df: DataFrame, keys: list[str], order: str, time: str = "t") -> DataFrame:
    """``status`` and ``reason`` of each key: error where resampling isn't possible."""
    step = F.col(time) - F.lag(time).over(Window.partitionBy(*keys).orderBy(order))
    g = df.withColumn("__step", step).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("__step").alias("least"))
    reason = F.when(F.col("n") < 2, "fewer than two rows").when(F.col("least") <= 0, "times don't rise")
    return g.select(*keys, F.when(reason.isNull(), "success").otherwise("error").alias("status"), reason.alias("reason"))


def gradient(df: DataFrame, keys: list[str], order: str, column: str, out: str, dt: Column | float = 1.0) -> DataFrame:
    """Central differences inside, one-sided ones at the ends, over ``dt``; zero for a single row."""
    step = dt if isinstance(dt, Column) else F.lit(float(dt))
    w = Window.partitionBy(*keys).orderBy(order)
    before, after, x = F.lag(column).over(w), F.lead(column).over(w), F.col(column)
    d = F.when(before.isNull() & after.isNull(), 0.0).when(before.isNull(), (after - x) / step).when(after.isNull(), (x - before) / step).otherwise((after - before) / (2 * step))
    return df.withColumn(out, d)


# ---- stencils --------------------------------------------------------------------------------


def _reach(df: DataFrame, keys: list[str], order: str, column: str, radius: int) -> DataFrame:
    """Adds position, count and the values within ``radius`` (``__near``, from position ``__lo``)."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumns(
        {
            "__p": F.row_number().over(w) - 1,
            "__n": F.count(F.lit(1)).over(Window.partitionBy(*keys)).cast("int"),
            "__near": F.collect_list(F.coalesce(F.col(column), F.lit(float("nan")))).over(w.rowsBetween(-radius, radius)),
        }
    ).withColumn("__lo", F.greatest(F.lit(0), F.col("__p") - radius))


def _index(offset: Column, boundary: str) -> Column:
    at, n = F.col("__p") + offset, F.col("__n")
    if boundary == "clamp":
        return F.greatest(F.lit(0), F.least(n - 1, at))
    if boundary == "reflect":
        m = F.pmod(at, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    raise ValueError(f"unknown boundary {boundary!r}")


def stencil(df: DataFrame, keys: list[str], order: str, column: str, weights: list[float], boundary: str = "clamp", reducer: str = "dot", out: str | None = None) -> DataFrame:
    """Weighted sum (``dot``) or ``median`` of the neighbourhood of every row."""
    radius = len(weights) // 2
    near = _reach(df, keys, order, column, radius)
    value = lambda o: F.element_at("__near", (_index(o, boundary) - F.col("__lo") + 1).cast("int"))
    offsets = F.array(*[F.lit(k) for k in range(-radius, radius + 1)])
    if reducer == "dot":
        w = F.array(*[F.lit(float(x)) for x in weights])
        y = F.aggregate(F.zip_with(offsets, w, lambda o, x: value(o) * x), F.lit(0.0), lambda a, x: a + x)
    elif reducer == "median":
        y = F.element_at(F.array_sort(F.transform(offsets, value)), radius + 1)
    else:
        raise ValueError(f"unknown reducer {reducer!r}")
    return near.withColumn(out or column, y).drop("__near", "__p", "__n", "__lo")


def odd_window(k: int, least: int) -> int:
    k = max(least, int(k))
    return k + 1 if k % 2 == 0 else k


def moving_average(df: DataFrame, keys: list[str], order: str, column: str, k: int = 5, out: str | None = None) -> DataFrame:
    k = odd_window(k, 3)
    return stencil(df, keys, order, column, [1.0 / k] * k, "clamp", out=out)


def gaussian_weights(sigma: float) -> list[float]:
    radius = int(4 * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gaussian_smooth(df: DataFrame, keys: list[str], order: str, column: str, sigma: float, out: str | None = None) -> DataFrame:
    return stencil(df, keys, order, column, gaussian_weights(sigma), "reflect", out=out)


def median_filter(df: DataFrame, keys: list[str], order: str, column: str, k: int = 5, out: str | None = None) -> DataFrame:
    return stencil(df, keys, order, column, [1.0] * odd_window(k, 1), "reflect", "median", out=out)


def gripper_aperture(df: DataFrame, keys: list[str], order: str, vector: str, hand: str = "right", right: int = 20, left: int = 32, k: int = 5, out: str = "aperture") -> DataFrame:
    """Adds ``out``: the median-filtered channel of the active hand (``right`` and ``left`` are channels of ``vector``)."""
    if hand not in ("right", "left"):
        raise ValueError(f"unknown hand {hand!r}")
    own = df.withColumn(out, F.try_element_at(vector, F.lit((right if hand == "right" else left) + 1)))
    return median_filter(own, keys, order, out, k)


def savgol_matrix(window: int, polyorder: int) -> np.ndarray:
    """Row p: the weights of a window's values for the fitted polynomial at its position p."""
    x = np.arange(window) - window // 2
    v = np.vander(x, polyorder + 1, increasing=True).astype(float)
    return v @ np.linalg.pinv(v)


def savgol(df: DataFrame, keys: list[str], order: str, column: str, window: int = 11, polyorder: int = 3, out: str | None = None) -> DataFrame:
    """Local polynomial smoothing; the ends take the fit of the first and last window.

    Series shorter than the window use the largest odd window that fits; those with fewer than five rows,
    or no window above the order, use a moving average of five.
    """
    window = odd_window(window, 5)
    half = window // 2
    near = _reach(df, keys, order, column, 2 * half)
    n, p = F.col("__n"), F.col("__p")
    own = F.when(n >= window, window).when(n % 2 == 1, n).otherwise(n - 1).cast("int")
    sizes = [s for s in range(polyorder + 1 + polyorder % 2, window + 1) if s % 2 == 1 and s > polyorder and s >= 5]
    tables = F.create_map(*[x for s in sizes for x in (F.lit(s), F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in savgol_matrix(s, polyorder)]))])
    h = F.floor(own / 2).cast("int")
    row = F.when(p < h, p).when(p >= n - h, own - (n - p)).otherwise(h).cast("int")
    start = F.greatest(F.lit(0), F.least(n - own, p - h)).cast("int")
    weights = F.element_at(F.try_element_at(tables, own), row + 1)
    values = F.slice("__near", start - F.col("__lo") + 1, own)
    fit = F.aggregate(F.zip_with(values, weights, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    five = F.transform(F.array(*[F.lit(k) for k in range(-2, 3)]), lambda o: F.element_at("__near", (F.greatest(F.lit(0), F.least(n - 1, p + o)) - F.col("__lo") + 1).cast("int")) * 0.2)
    mean = F.aggregate(five, F.lit(0.0), lambda a, x: a + x)
    return near.withColumn(out or column, F.when((n < 5) | ~own.isin(*sizes), mean).otherwise(fit)).drop("__near", "__p", "__n", "__lo")


def smooth(df: DataFrame, keys: list[str], order: str, column: str, method: str = "savgol", window: int = 11, polyorder: int = 3) -> DataFrame:
    if method == "none":
        return df
    if method == "savgol":
        return savgol(df, keys, order, column, window, polyorder)
    if method == "moving_average":
        return moving_average(df, keys, order, column, window)
    raise ValueError(f"unknown smoothing {method!r}; lowpass is in kinegrain.operators.kernels")


def effector_speed(df: DataFrame, keys: list[str], order: str, position: list[str], time: str = "t", sigma_position: float = 3.0, sigma_speed: float = 5.0) -> DataFrame:
    """``speed``: norm of the differentiated, smoothed position, smoothed again. The last row repeats its predecessor's velocity; a step of no time counts as 1e-6."""
    out = df
    for c in position:
        out = gaussian_smooth(out, keys, order, c, sigma_position, out=f"__s_{c}")
    w = Window.partitionBy(*keys).orderBy(order)
    step = F.lead(time).over(w) - F.col(time)
    step = F.when(step == 0, 1e-6).otherwise(step)
    out = out.withColumns({f"__v_{c}": (F.lead(f"__s_{c}").over(w) - F.col(f"__s_{c}")) / step for c in position})
    out = out.withColumns({f"__v_{c}": F.coalesce(F.col(f"__v_{c}"), F.lag(f"__v_{c}").over(w), F.lit(0.0)) for c in position})
    norm = F.sqrt(sum((F.col(f"__v_{c}") * F.col(f"__v_{c}") for c in position), F.lit(0.0)))
    out = gaussian_smooth(out.withColumn("speed", norm), keys, order, "speed", sigma_speed)
    return out.drop(*[f"__s_{c}" for c in position], *[f"__v_{c}" for c in position])


def robust_scale(df: DataFrame, keys: list[str], column: str, method: str = "mad", out: str | None = None) -> DataFrame:
    """(x - median) / spread per key; spread is 1.4826 MAD or the interquartile range, one where tiny."""
    out = out or column
    w = Window.partitionBy(*keys)
    x = F.col(column)
    if method == "none":
        return df.withColumn(out, x)
    if method not in ("mad", "iqr"):
        raise ValueError(f"unknown normalisation {method!r}")
    d = df.withColumn("__m", F.median(x).over(w))
    if method == "mad":
        d = d.withColumn("__s", 1.4826 * F.median(F.abs(x - F.col("__m"))).over(w))
    else:
        d = d.withColumn("__s", F.percentile(x, F.lit(0.75)).over(w) - F.percentile(x, F.lit(0.25)).over(w))
    spread = F.when(F.abs("__s") < 1e-8, 1.0).otherwise(F.col("__s"))
    return d.withColumn(out, (x - F.col("__m")) / spread).drop("__m", "__s")
