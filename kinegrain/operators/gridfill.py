"""Irregular readings onto a regular grid, gaps filled by singular-spectrum imputation.

Per source (episode) the slot of a reading is ``round((t - t0) * fps)``. Readings of one slot are
averaged channel by channel. Missing slots and missing elements are filled by iterating: embed the
series of all channels (standardised) into Hankel trajectories, keep the leading singular vectors,
average the anti-diagonals, replace the missing entries, until what is left to go (as told by the rate at
which the changes shrink) is less than ``tolerance`` standard deviations. Filled slots are marked, and so are those whose iteration was given up after
``MOST_ROUNDS`` rounds before it converged.

Execution: the first time of every source comes from a partially aggregated pre-pass. Sources are cut
into pieces of ``PIECE`` seconds of absolute time, with ``HALO`` seconds of context on both sides, so
that a source of any length is spread over many tasks; a piece also owns the gap before its first
reading; where that starts comes from the pre-pass, and where it reaches beyond the context, the reading
before it is looked up and joins the piece. One shuffle, on source and piece, moves the readings. A piece of
more than ``PORTION`` slots (a high rate) is filled in portions that start at readings and have ``CONTEXT`` slots
of context on both sides; a single gap of more than ``PORTION`` slots is a straight line between its ends.

Defined cases: readings whose time is null or not finite, or that have no element at all, take no slot,
though a time without elements can still be the first time; repeated readings count once (they average
to themselves); a missing, null or not positive fps is 30; sources without any reading have no slots; a
piece with fewer than eight slots, or channels with fewer than four readings, is filled by straight lines;
channels without any reading stay null; empty input gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.operators.anomalies import _columns_of
from kinegrain.runtime import materialize
from kinegrain.sources.tables import STATE, c, clean_episodes, resolve_episodes

PIECE = 600.0
HALO = 4.0
WINDOW = 10
RANK = 2
TOLERANCE = 1e-3
MOST_ROUNDS = 20_000
#: Slots that are filled in one go; longer gaps are straight lines.
PORTION = 50_000
CONTEXT = 50 * WINDOW


def ssa_fill(x: np.ndarray, window: int = WINDOW, rank: int = RANK, tolerance: float = TOLERANCE, rounds: int = MOST_ROUNDS) -> tuple[np.ndarray, bool]:
    """``x`` (slots, channels) with NaN filled, and whether that converged; observed entries keep their values."""
    n, k = x.shape
    gone = np.isnan(x)
    if not gone.any():
        return x, True
    seen = (~gone).sum(axis=0)
    y = x.copy()
    at = np.arange(n)
    for j in range(k):
        if seen[j] and gone[:, j].any():
            ok = ~gone[:, j]
            y[~ok, j] = np.interp(at[~ok], at[ok], x[ok, j])
    use = np.flatnonzero((seen >= 4) & gone.any(axis=0))
    window = min(window, n // 2)
    if n < 8 or not len(use):
        return y, True
    every = np.flatnonzero(seen >= 4)
    z = y[:, every]
    mean, dev = z.mean(axis=0), z.std(axis=0)
    dev = np.where(dev > 1e-12, dev, 1.0)
    z = (z - mean) / dev
    hole = gone[:, every]
    # only windows that touch a hole change and have to be rebuilt
    touched = np.zeros(n, bool)
    touched[np.unique(np.nonzero(hole)[0])] = True
    m = n - window + 1
    span = np.convolve(touched, np.ones(window, int), "valid")[:m] > 0
    rows = np.flatnonzero(span)
    views = np.lib.stride_tricks.sliding_window_view(z, window, axis=0)  # (m, channels, window)
    rest = np.zeros((window, window))
    others = np.flatnonzero(~span)
    for a in range(0, len(others), 8192):
        flat = views[others[a : a + 8192]].reshape(-1, window)
        rest += flat.T @ flat
    count = np.zeros(n)
    for o in range(window):
        count[rows + o] += 1.0  # rows are distinct
    count = np.maximum(count, 1.0)[:, None]
    rank = min(rank, window)
    left, before = np.inf, 0.0
    for r in range(rounds):
        flat = views[rows].reshape(-1, window)
        _, vec = np.linalg.eigh(rest + flat.T @ flat)
        lead = vec[:, -rank:]
        back = ((flat @ lead) @ lead.T).reshape(len(rows), -1, window)
        total = np.zeros_like(z)
        for o in range(window):
            total[rows + o] += back[:, :, o]  # rows are distinct
        step = (total / count)[hole] - z[hole]
        size = float(np.sqrt(step @ step))
        rate = min(size / before, 0.98) if before else 0.5
        before = size
        # steps shrink by a rate, so what is left is their geometric sum
        left = np.abs(step).max() / (1 - rate)
        z[hole] += step
        if left < tolerance:
            break
        if r % 8 == 7:
            z[hole] += step * rate / (1 - rate)
            before = 0.0
    out = y.copy()
    out[:, every] = np.where(hole, z * dev + mean, y[:, every])
    return out, bool(left < tolerance)


_GRID = pa.schema([("episode_index", pa.int64()), ("slot_index", pa.int64()), ("grid_time", pa.float64()), ("state", pa.list_(pa.float64())), ("filled", pa.bool_()), ("n_readings", pa.int32()), ("converged", pa.bool_())])
GRID_DDL = "episode_index bigint, slot_index bigint, grid_time double, state array<double>, filled boolean, n_readings int, converged boolean"


def _as_batch(ep: int, slot: np.ndarray, t0: float, fps: float, state: np.ndarray, count: np.ndarray, converged: bool) -> pa.RecordBatch:
    n, k = state.shape
    flat = pa.array(state.ravel(), pa.float64(), from_pandas=True)  # NaN is null
    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), flat)
    cols = [pa.array(np.full(n, ep)), pa.array(slot), pa.array(t0 + slot / fps), lists, pa.array(count == 0), pa.array(count.astype(np.int32)), pa.array(np.full(n, converged))]
    return pa.RecordBatch.from_arrays(cols, schema=_GRID)


def _fill_piece(ep: int, t0: float, fps: float, before: int | None, slot: np.ndarray, state: np.ndarray, mine: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All slots that a piece owns: after ``before`` (its predecessor's last slot) to its own last one."""
    if not mine.any():
        return
    own = slot[mine]
    first = int(own.min()) if before is None else before + 1
    last = int(own.max())
    if last < first:
        return
    near = (slot >= first - CONTEXT) & (slot <= last + CONTEXT)
    slot, state = slot[near], state[near]
    order = np.argsort(slot, kind="stable")
    slot, state = slot[order], state[order]
    k = state.shape[1]

    def out(at: np.ndarray, grid: np.ndarray, count: np.ndarray, converged: bool) -> Iterator[pa.RecordBatch]:
        keep = (at >= first) & (at <= last)
        if keep.any():
            yield _as_batch(ep, at[keep], t0, fps, grid[keep], count[keep], converged)

    before_gap: int | None = None
    for occupied in np.split(np.unique(slot), np.flatnonzero(np.diff(np.unique(slot)) > PORTION) + 1):
        a, b = int(occupied[0]), int(occupied[-1]) + 1
        if before_gap is not None:
            one, other = _ends(state[slot <= before_gap][::-1]), _ends(state[slot >= a])
            one, other = np.where(np.isnan(one), other, one), np.where(np.isnan(other), one, other)
            for s in range(before_gap + 1, a, PORTION):
                at = np.arange(s, min(s + PORTION, a))
                w = ((at - before_gap) / (a - before_gap))[:, None]
                yield from out(at, one * (1 - w) + other * w, np.zeros(len(at), np.int64), True)
        before_gap = b - 1
        s = a
        while s < b:
            at = np.searchsorted(occupied, s + PORTION)
            e = int(occupied[at]) if at < len(occupied) else b
            # the context starts and ends at a reading too
            lo = int(occupied[max(0, np.searchsorted(occupied, s - CONTEXT, side="right") - 1)])
            hi = int(occupied[min(len(occupied) - 1, np.searchsorted(occupied, e + CONTEXT))]) + 1
            i, j = np.searchsorted(slot, lo), np.searchsorted(slot, hi)
            total, seen, count = np.zeros((hi - lo, k)), np.zeros((hi - lo, k)), np.zeros(hi - lo, np.int64)
            ok = np.isfinite(state[i:j])
            np.add.at(total, slot[i:j] - lo, np.where(ok, state[i:j], 0.0))
            np.add.at(seen, slot[i:j] - lo, ok)
            np.add.at(count, slot[i:j] - lo, 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                grid, converged = ssa_fill(np.where(seen > 0, total / seen, np.nan))
            yield from out(np.arange(s, e), grid[s - lo : e - lo], count[s - lo : e - lo], converged)
            s = e


def _ends(rows: np.ndarray) -> np.ndarray:
    """The first reading of each channel; NaN where there is none."""
    ok = np.isfinite(rows)
    return np.where(ok.any(axis=0), rows[ok.argmax(axis=0), np.arange(rows.shape[1])], np.nan)


def _grid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    carried: pa.Table | None = None
    pending: list[pa.RecordBatch] = []

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        t = t.combine_chunks()
        ep, piece = t.column("episode_index").to_numpy(), t.column("piece").to_numpy()
        slot, own, t0, fps = (t.column(x).to_numpy() for x in ("slot", "own", "t0", "fps"))
        before = t.column("before").to_pylist()
        lists = t.column("state").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        wide = int(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max())
        state = _columns_of(lists, wide).T
        cut = np.append(np.flatnonzero(np.append(True, (ep[1:] != ep[:-1]) | (piece[1:] != piece[:-1]))), len(ep))
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield from _fill_piece(int(ep[a]), float(t0[a]), float(fps[a]), before[a], slot[a:b], state[a:b], own[a:b] == piece[a])

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carried is not None:
            t = pa.concat_tables([carried, t])
        ep, piece = t.column("episode_index").to_numpy(), t.column("piece").to_numpy()
        other = np.flatnonzero((ep != ep[-1]) | (piece != piece[-1]))
        last = int(other[-1]) + 1 if len(other) else 0
        if last:
            pending += list(work(t.slice(0, last)))
            yield from pa.Table.from_batches(pending, _GRID).combine_chunks().to_batches()
            pending = []
        carried = t.slice(last)
    if carried is not None and carried.num_rows:
        pending = list(work(carried))
        if pending:
            yield from pa.Table.from_batches(pending, _GRID).combine_chunks().to_batches()


def regular_grid(frames: DataFrame, files: DataFrame, episodes: DataFrame) -> DataFrame:
    """Every slot of every episode's grid: time, state, whether it was filled, and its number of readings."""
    f = resolve_episodes(frames, files, ["episode_index", "frame_index", "timestamp", STATE])
    ts = F.col("timestamp")
    good = ts.isNotNull() & ~F.isnan(ts) & (F.abs(ts) < 1e15)
    f = f.where(F.col("episode_index").isNotNull() & good).select("episode_index", ts.alias("t"), c(STATE).cast("array<double>").alias("state"))
    counts = F.exists("state", lambda v: v.isNotNull() & ~F.isnan(v))
    own = F.floor(F.col("t") / PIECE).cast("bigint")
    f = f.withColumn("own", own).withColumn("counts", F.coalesce(counts, F.lit(False)))
    # one row per episode and piece: small beside the frames
    spans = f.groupBy("episode_index", "own").agg(F.min("t").alias("t0"), F.max(F.when(F.col("counts"), F.col("t"))).alias("last"))
    w = Window.partitionBy("episode_index")
    meta = (
        spans.join(clean_episodes(episodes).select("episode_index", "fps"), "episode_index", "left")
        .withColumn("fps", F.coalesce("fps", F.lit(30.0)))
        .withColumn("t0", F.min("t0").over(w))
        .withColumn("before", F.max("last").over(w.orderBy("own").rowsBetween(Window.unboundedPreceding, -1)))
        .select("episode_index", F.col("own").alias("piece"), "t0", "fps", F.round((F.col("before") - F.col("t0")) * F.col("fps")).cast("bigint").alias("before"), F.col("before").alias("t"))
    )
    meta = materialize(meta, "pieces")
    far = materialize(meta.where(F.col("t") < F.col("piece") * PIECE - HALO + 1e-3).select("episode_index", "piece", "t"), "far")
    inside = F.col("t") - F.col("own") * PIECE
    pieces = F.when(inside < HALO, F.array(F.col("own"), F.col("own") - 1)).when(inside > PIECE - HALO, F.array(F.col("own"), F.col("own") + 1)).otherwise(F.array("own"))
    moved = f.where("counts").select("episode_index", "t", "state", "own", F.explode(pieces).alias("piece"))
    if not far.isEmpty():
        moved = moved.unionByName(f.where("counts").join(far, ["episode_index", "t"]).select("episode_index", "t", "state", "own", "piece"))
    ready = (
        moved.join(meta.drop("t"), ["episode_index", "piece"])
        .select("episode_index", "piece", "own", "t0", "fps", "before", F.round((F.col("t") - F.col("t0")) * F.col("fps")).cast("bigint").alias("slot"), "state")
        .repartition("episode_index", "piece")
        .sortWithinPartitions("episode_index", "piece", "slot")
    )
    return ready.mapInArrow(_grid, GRID_DDL)
