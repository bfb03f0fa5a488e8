"""Implausible readings: a hidden Markov model per source and channel with hard bounds.

Every channel of a recording is read as a chain of four states: *normal*, *spike*, *stuck* and
*out of range*. What is normal is learnt per source (robot) and channel from all of its frames:

* ``scale``, the 99th percentile of the absolute movement between neighbouring readings, where a step from one
  level that lasts (longer than a spike may) to another counts as none: a channel driven in steps has no
  movement that an excursion could be taken for;
* ``rest``, the longest run of one unchanging value that normal work knows: the longest runs of all recordings
  make a distribution, of which one recording and five in a hundred more may be faults, and the next
  longest run is the rest (the only one, where there is but one recording);
* ``fixed``, whether most recordings hold one value throughout.

Emissions per reading:

* out of range, when the reading lies outside its hard bounds or isn't finite (certain);
* spike, from the height of the reading above the straight line between the readings just before
  and after an excursion of at most three readings, in units of ``scale``; excursions after which
  the signal isn't back at its former course have no height;
* stuck, from standing still: each reading of a run is worth ``cost / (2.5 * rest)`` nats, so that
  a run outweighs the cost of entering and leaving the state when it is 2.5 times as long as the
  source ever rests (eight readings at least; two rests in a row may look like one, two and a half can't).
  Fixed channels never get stuck.

Forward-backward probabilities of the states give the flags; a run is stuck as a whole or not at all, and a chain goes from spike to spike within one excursion only. Chains in which no reading speaks
against *normal* can't leave that state and are not run through. A frame in which several channels leave their
course at once is as much a spike of each.

Execution: frames are packed once into one row per block of a recording (one shuffle on recording
and block, so no key can fill a task: a recording longer than ``BLOCK`` frames is cut, with
``HALO`` frames of context on either side), written to the shared folder, summed up per source, and
scored. The parameters of the sources are joined as a table whose size the planner knows. Where a source rests
for longer than the context, the lengths of the runs that cross the borders of blocks are added up first.

Defined cases: null and NaN elements are no readings; whole-null arrays, missing channels and frames
without an episode or frame number give no flags; a frame held several times counts once; a source
without bounds has no out-of-range state except for infinite readings; an unknown source is one
source of its own; empty input gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinegrain.runtime import materialize
from kinegrain.sources.tables import c, clean_episodes, resolve_episodes

FIELDS = ("observation.state", "action", "gripper")
BLOCK = 16384
HALO = 1024
BINS_PER_DECADE = 40
BIN_ZERO = 500
LEAST_STILL = 8.0
#: Share of the recordings, besides one, whose longest run may be a fault.
FAULTY = 0.05
REST_FACTOR = 2.5
RETURNED = 0.5
LONGEST_SPIKE = 3

_PACKED = pa.schema(
    [
        ("episode_index", pa.int64()), ("block", pa.int64()), ("source", pa.string()), ("n", pa.int32()), ("widths", pa.list_(pa.int32())), ("frames", pa.binary()), ("vals", pa.binary()),
        ("rest", pa.list_(pa.float64())), ("whole", pa.list_(pa.int32())), ("cells", pa.list_(pa.int64())), ("cell_n", pa.list_(pa.int64())), ("edges", pa.list_(pa.float64())),
    ]
)
PACKED_DDL = "episode_index bigint, block bigint, source string, n int, widths array<int>, frames binary, vals binary, rest array<double>, whole array<int>, cells array<bigint>, cell_n array<bigint>, edges array<double>"


def _codes(widths: list[int]) -> np.ndarray:
    """Numbers of the channels of all fields: channel times the number of fields, plus the field."""
    return np.concatenate([np.arange(w, dtype=np.int64) * len(FIELDS) + k for k, w in enumerate(widths)])


def _columns_of(values: pa.Array, width: int) -> np.ndarray:
    """A list array as (width, rows); null lists, null elements and missing tails are NaN."""
    n = len(values)
    out = np.full((width, n), np.nan)
    if width and n:
        sizes = np.asarray(values.value_lengths().fill_null(0), dtype=np.int64)
        flat = np.asarray(values.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
        row = np.repeat(np.arange(n), sizes)
        pos = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ok = pos < width
        out[pos[ok], row[ok]] = flat[ok]
    return out


def _bins(moves: np.ndarray) -> np.ndarray:
    """Cell of a logarithmic histogram; cell 0 is no movement."""
    with np.errstate(divide="ignore"):
        b = np.floor(np.log10(moves) * BINS_PER_DECADE) + BIN_ZERO
    return np.where(moves > 0, np.clip(b, 1, 2 * BIN_ZERO), 0).astype(np.int64)


def _runs(key: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of one value within one key."""
    new = np.ones(len(v), bool)
    new[1:] = (key[1:] != key[:-1]) | (v[1:] != v[:-1])
    start = np.flatnonzero(new)
    return start, np.diff(np.append(start, len(v)))


def _statistics(vals: np.ndarray, block: np.ndarray, source: np.ndarray, n_blocks: int, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[list, list]]]:
    """Per channel and block: the longest run of one value, and whether it is nearly all of the block (-1: no reading).

    Per source (a number per block): cells of the histograms of movement and their counts.
    """
    rest, whole = np.full((n_blocks, len(vals)), np.nan), np.full((n_blocks, len(vals)), -1)
    cells: dict[int, tuple[list, list]] = {}
    for ch, row in enumerate(vals):
        ok = np.isfinite(row)
        v, own = row[ok], block[ok]
        if not len(v):
            continue
        start, length = _runs(own, v)
        longest, seen = np.zeros(n_blocks), np.bincount(own, minlength=n_blocks)
        np.maximum.at(longest, own[start], length)
        has = seen > 0
        rest[has, ch] = longest[has]
        whole[has, ch] = longest[has] >= 0.9 * seen[has]
        same = own[1:] == own[:-1]
        edge = np.ones(len(v) + 1, bool)
        edge[1:-1] = ~same
        # runs at the ends of a block may go on beyond it
        lasts = np.repeat((length > LONGEST_SPIKE) | edge[start] | edge[start + length], length)
        move = np.where(lasts[1:] & lasts[:-1], 0.0, np.abs(np.diff(v)))
        found, counts = np.unique(source[own[1:][same]] * 4096 + _bins(move[same]), return_counts=True)
        for src, cell, k in zip((found // 4096).tolist(), (found % 4096 + (codes[ch] << 12)).tolist(), counts.tolist(), strict=True):
            into = cells.setdefault(src, ([], []))
            into[0].append(cell)
            into[1].append(k)
    return rest, whole, cells


def _edges(vals: np.ndarray, codes: np.ndarray) -> list[float]:
    """Of each channel with a reading: code, readings, first value, length of its run, last value, length of its run."""
    out: list[float] = []
    for code, row in zip(codes.tolist(), vals, strict=True):
        v = row[np.isfinite(row)]
        if len(v):
            _, length = _runs(np.zeros(len(v)), v)
            out += [code, len(v), v[0], length[0], v[-1], length[-1]]
    return out


def _majority(robots: pa.Array, block: np.ndarray, n_blocks: int) -> list[str | None]:
    """Most frequent robot of each block, the first by name of several; None where none is told."""
    robots = robots.chunk(0) if isinstance(robots, pa.ChunkedArray) else robots
    names, code = np.unique(np.array(robots.fill_null("").to_pylist(), dtype=object).astype(str), return_inverse=True)
    count = np.zeros((n_blocks, len(names)), np.int64)
    np.add.at(count, (block, code), 1)
    if len(names) and names[0] == "":
        count[:, 0] = 0
    best = count.argmax(axis=1)
    return [str(names[k]) if count[i, k] else None for i, k in enumerate(best.tolist())]


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(values.ravel(), kind))


def _pack(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Sorted frames to one row per block. A block that goes on in the next batch is carried over; it has BLOCK + 2 * HALO frames at most."""
    carried: pa.Table | None = None

    def emit(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        ep, bl, fr = (t.column(x).to_numpy() for x in ("episode_index", "block", "frame_index"))
        first = np.ones(len(ep), bool)
        first[1:] = (ep[1:] != ep[:-1]) | (bl[1:] != bl[:-1]) | (fr[1:] != fr[:-1])  # a frame counts once
        t = t.filter(pa.array(first)).combine_chunks()
        ep, bl, fr = ep[first], bl[first], fr[first]
        start = np.flatnonzero(np.append(True, (ep[1:] != ep[:-1]) | (bl[1:] != bl[:-1])))
        size = np.diff(np.append(start, len(ep)))
        block = np.repeat(np.arange(len(start)), size)
        fields = [t.column(f"f{k}").combine_chunks() for k in range(len(FIELDS))]
        fields = [f.chunk(0) if isinstance(f, pa.ChunkedArray) else f for f in fields]
        widths = [int(f.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).max()) for f in fields]
        vals = np.vstack([_columns_of(f, w) for f, w in zip(fields, widths, strict=True)])
        codes = _codes(widths)
        robots = _majority(t.column("robot_id").combine_chunks(), block, len(start))
        # a block without a robot is a source of its own until its episode tells the robot
        number: dict = {}
        source = np.array([number.setdefault(r if r is not None else k, len(number)) for k, r in enumerate(robots)], dtype=np.int64)
        rest, whole, cells = _statistics(vals, block, source, len(start), codes)
        told: set[int] = set()
        histogram = []
        for src in source.tolist():
            histogram.append(cells.get(src, ([], [])) if src not in told else ([], []))
            told.add(src)
        packed = [np.ascontiguousarray(vals[:, a : a + n]).tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        # only a block with context has neighbours
        inner = np.floor_divide(fr, span) == bl
        edges = [[] if inner[a : a + n].all() else _edges(vals[:, a : a + n][:, inner[a : a + n]], codes) for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        moments = [fr[a : a + n].astype(np.int64).tobytes() for a, n in zip(start.tolist(), size.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ep[start]), pa.array(bl[start]), pa.array(robots, pa.string()), pa.array(size.astype(np.int32)), _lists(np.tile(np.array(widths, dtype=np.int32), (len(start), 1)), pa.int32()), pa.array(moments, pa.binary()), pa.array(packed, pa.binary()),
                _lists(rest, pa.float64()), _lists(whole.astype(np.int32), pa.int32()), pa.array([h[0] for h in histogram], pa.list_(pa.int64())), pa.array([h[1] for h in histogram], pa.list_(pa.int64())), pa.array(edges, pa.list_(pa.float64())),
            ],
            schema=_PACKED,
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        if carried is not None:
            t = pa.concat_tables([carried, t])
        ep, bl = t.column("episode_index").to_numpy(), t.column("block").to_numpy()
        last = int(np.flatnonzero((ep != ep[-1]) | (bl != bl[-1]))[-1]) + 1 if ((ep != ep[-1]) | (bl != bl[-1])).any() else 0
        if last:
            yield emit(t.slice(0, last))
        carried = t.slice(last)
    if carried is not None and carried.num_rows:
        yield emit(carried)


def pack_frames(frames: DataFrame, files: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row per block of an episode, with its readings as binary columns, written to the shared folder."""
    f = resolve_episodes(frames, files, ["episode_index", "frame_index", "robot_id", *FIELDS])
    own = F.floor(F.col("frame_index") / BLOCK).cast("bigint")
    off = F.col("frame_index") - own * BLOCK
    blocks = F.when((off < HALO) & (own > 0), F.array(own, own - 1)).when(off >= BLOCK - HALO, F.array(own, own + 1)).otherwise(F.array(own))
    f = (
        f.where(F.col("episode_index").isNotNull() & F.col("frame_index").isNotNull())
        .select("episode_index", "frame_index", F.explode(blocks).alias("block"), "robot_id", *[c(x).cast("array<double>").alias(f"f{k}") for k, x in enumerate(FIELDS)])
        .repartition("episode_index", "block")
        .sortWithinPartitions("episode_index", "block", "frame_index")
    )
    span = BLOCK
    packed = materialize(f.mapInArrow(lambda batches: _pack(batches, span), PACKED_DDL), "packed")
    robots = clean_episodes(episodes).select("episode_index", F.col("robot_id").alias("__robot")).where(F.col("__robot").isNotNull())
    lost = packed.where(F.col("source").isNull())
    lost = lost.join(robots, "episode_index", "left").withColumn("source", F.coalesce("__robot", F.concat(F.lit("?"), F.col("episode_index").cast("string")))).drop("__robot")
    return packed.where(F.col("source").isNotNull()).unionByName(lost)


def source_parameters(packed: DataFrame, robots: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, params): per channel code -> scale, longest usual stillness and hard bounds.

    Histograms of movement and of the longest run of each block add up, so sources of any size are
    summed up with partial aggregation.
    """
    cell = (
        packed.select("source", F.explode(F.arrays_zip("cells", "cell_n")).alias("z"))
        .groupBy("source", F.shiftright("z.cells", 12).alias("ch"), F.col("z.cells").bitwiseAND(4095).alias("cell"))
        .agg(F.sum("z.cell_n").alias("k"))
        .groupBy("source", "ch")
        .agg(F.sort_array(F.collect_list(F.struct("cell", "k"))).alias("h"))  # 1001 cells at most
    )
    total = F.aggregate("h", F.lit(0).cast("bigint"), lambda a, x: a + x.k)
    level = F.greatest(F.lit(0.5), F.least(F.lit(0.99), 1 - 8 / F.greatest(F.lit(1), F.col("total"))))
    walked = F.aggregate(
        "h", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-1).cast("bigint").alias("at")),
        lambda a, x: F.struct((a.n + x.k).alias("n"), F.when((a["at"] < 0) & (a.n + x.k >= F.col("level") * F.col("total")), x.cell).otherwise(a["at"]).alias("at")),
    )
    scale = cell.withColumn("total", total).withColumn("level", level).select("source", "ch", walked.at.alias("cell"))
    scale = scale.select("source", "ch", F.when(F.col("cell") < 1, 0.0).otherwise(F.pow(F.lit(10.0), (F.col("cell") - BIN_ZERO + 1) / BINS_PER_DECADE)).alias("scale"))
    edges = [F.aggregate(F.slice("widths", 1, k), F.lit(0), lambda a, x: a + x) for k in range(len(FIELDS) + 1)]
    pos = F.col("pos")
    code = pos
    for k in range(len(FIELDS)):
        code = F.when((pos >= edges[k]) & (pos < edges[k + 1]), (pos - edges[k]) * len(FIELDS) + k).otherwise(code)
    # runs have a length of BLOCK + 2 * HALO at most, so have their histograms
    still = (
        packed.select("source", "widths", F.posexplode(F.arrays_zip("rest", "whole")).alias("pos", "z"))
        .where("z.whole >= 0")
        .groupBy("source", code.cast("bigint").alias("ch"), F.col("z.rest").alias("rest"))
        .agg(F.count(F.lit(1)).alias("k"), F.sum("z.whole").alias("whole"))
        .groupBy("source", "ch")
        .agg(F.sort_array(F.collect_list(F.struct("rest", "k")), asc=False).alias("r"), F.sum("k").alias("blocks"), (F.sum("whole") / F.sum("k")).alias("whole"))
    )
    rank = F.least(F.col("blocks"), 1 + F.ceil(FAULTY * F.col("blocks")))
    down = F.aggregate(
        "r", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("at")),
        lambda a, x: F.struct((a.n + x.k).alias("n"), F.when(a.n < F.col("rank"), x.rest).otherwise(a["at"]).alias("at")),
    )
    still = still.withColumn("rank", rank).select("source", "ch", down["at"].alias("rest"), "whole")
    number = F.lit(-1).cast("bigint")
    for k, name in enumerate(FIELDS):
        number = F.when(F.col("field_name") == name, F.col("channel").cast("bigint") * len(FIELDS) + k).otherwise(number)
    bounds = (
        robots.where("robot_id is not null").groupBy("robot_id").agg(F.min("model_name").alias("model_name"))
        .join(limits, "model_name")
        .groupBy(F.col("robot_id").alias("source"), number.cast("bigint").alias("ch"))
        .agg(F.min("lower_limit").alias("low"), F.max("upper_limit").alias("high"))
    )
    each = still.join(scale, ["source", "ch"], "left").join(bounds, ["source", "ch"], "left")
    longest = F.when(F.col("whole") >= 0.5, F.lit(float("inf"))).otherwise(F.greatest(F.lit(LEAST_STILL), REST_FACTOR * F.col("rest")))
    return each.groupBy("source").agg(F.collect_list(F.struct("ch", F.coalesce("scale", F.lit(0.0)).alias("scale"), longest.alias("still"), "low", "high")).alias("params"))


def crossing_runs(packed: DataFrame, params: DataFrame) -> DataFrame:
    """(episode_index, block, runs): true lengths of the runs at the first and last reading of a block.

    Only for channels that rest for longer than the context of a block shows; ``runs`` holds ch, lead and
    trail. Blocks without a reading of the channel are passed over. A block gives a piece (its first run)
    or two (its first and its last); pieces of one value that touch are one run.
    """
    each = F.transform(F.sequence(F.lit(0), (F.size("edges") / 6).cast("int") - 1), lambda i: F.slice("edges", i * 6 + 1, 6))
    pieces = packed.where(F.size("edges") > 0).select("source", "episode_index", "block", F.explode(each).alias("e"))
    limits = params.select("source", F.explode("params").alias("p")).where((F.col("p.still") > HALO) & (F.col("p.still") < float("inf"))).select("source", F.col("p.ch").alias("ch"))
    pieces = pieces.withColumn("ch", F.col("e")[0].cast("bigint")).join(limits, ["source", "ch"])
    by_block = Window.partitionBy("episode_index", "ch").orderBy("block")
    pieces = pieces.withColumn("on", F.coalesce(F.lag(F.col("e")[4]).over(by_block) == F.col("e")[2], F.lit(False)))
    one = F.col("e")[3] == F.col("e")[1]
    lead = F.struct(F.lit(0).alias("side"), F.col("e")[3].alias("n"), (~F.col("on")).cast("bigint").alias("new"))
    trail = F.struct(F.lit(1).alias("side"), F.col("e")[5].alias("n"), F.lit(1).cast("bigint").alias("new"))
    pieces = pieces.select("episode_index", "block", "ch", one.alias("one"), F.explode(F.when(one, F.array(lead)).otherwise(F.array(lead, trail))).alias("p"))
    run = F.sum("p.new").over(Window.partitionBy("episode_index", "ch").orderBy("block", "p.side"))
    total = F.sum("p.n").over(Window.partitionBy("episode_index", "ch", "run"))
    ends = pieces.withColumn("run", run).withColumn("total", total).groupBy("episode_index", "block", "ch").agg(
        F.max(F.when(F.col("p.side") == 0, F.col("total"))).alias("lead"), F.max(F.when((F.col("p.side") == 1) | F.col("one"), F.col("total"))).alias("trail")
    )
    return ends.groupBy("episode_index", "block").agg(F.collect_list(F.struct("ch", "lead", "trail")).alias("runs"))


# ---- the model -------------------------------------------------------------------------------

STATES = ("normal", "spike", "stuck", "range")
_A = np.log(
    np.array(
        [
            [1 - 1e-5 - 1e-4 - 1e-4, 1e-5, 1e-4, 1e-4],
            [0.549, 0.45, 5e-5, 95e-5],
            # what ends a run costs as much by way of another fault
            [1e-3, 1e-8, 1 - 1e-3 - 1e-8 - 1e-7, 1e-7],
            [0.549, 1e-5, 5e-5, 1 - 0.549 - 1e-5 - 5e-5],
        ]
    )
)
_P0 = np.log(np.array([1 - 3e-4, 1e-4, 1e-4, 1e-4]))
#: A chain ends as though a normal reading followed.
_P1 = np.array([0.0, 0.0, _A[2, 0], 0.0])
COST = -(_A[0, 2] + _A[2, 0])
DECAY = 9.0
SPIKE_SPAN = np.log(1000.0)


def spike_gain(z: np.ndarray) -> np.ndarray:
    """Log-likelihood of an excursion of ``z`` scales as a spike over that as normal movement."""
    z = np.maximum(z, 1e-3)
    return -np.log(np.maximum(z, 1.0) * SPIKE_SPAN) - (np.log(DECAY) - DECAY * z)


def excursions(key: np.ndarray, v: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height of each reading's excursion in scales, the length of that excursion (0: none) and its first reading."""
    n = len(v)
    best, size, first = np.zeros(n), np.zeros(n, np.int64), np.arange(n)

    def at(o: int) -> np.ndarray:
        out = np.full(n, np.nan)
        if abs(o) < n:
            if o > 0:
                out[:-o] = np.where(key[:-o] == key[o:], v[o:], np.nan)
            elif o < 0:
                out[-o:] = np.where(key[-o:] == key[:o], v[:o], np.nan)
            else:
                out[:] = v
        return out

    before = at(-1)
    ahead = [at(o) for o in range(LONGEST_SPIKE + 1)]
    for length in range(1, LONGEST_SPIKE + 1):
        after = ahead[length]
        height = np.full(n, np.inf)
        for o in range(length):
            line = before + (after - before) * (o + 1) / (length + 1)
            height = np.minimum(height, np.abs(ahead[o] - line))
        ok = np.isfinite(height) & (np.abs(after - before) <= RETURNED * height)
        z = np.where(ok, height / scale, 0.0)
        for o in range(length):
            t = np.zeros(n)
            if o < n:
                t[o:] = np.where(key[o:] == key[: n - o], z[: n - o], 0.0)
            up = t > best
            best[up], size[up], first[up] = t[up], length, np.flatnonzero(up) - o
    return best, size, first


def posteriors(logb: np.ndarray, moved: np.ndarray, apart: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Forward-backward over chains (S, T, 4) padded to one length; probabilities of the states.

    ``moved`` (S, T) marks readings that differ from the one before: chains enter and leave the stuck
    state there and stay in it elsewhere, so that a run is stuck as a whole or not at all.
    ``apart`` (S, T) marks readings of another excursion than the one before: to go from spike to spike
    there is as rare as to enter the state.
    """
    t = logb.shape[1]
    step = np.exp(_A)
    stay, last = step[2, 2], step[1, 1] - step[0, 1]
    fw = np.empty_like(logb)
    fw[:, 0] = _P0 + logb[:, 0]
    for i in range(1, t):
        m = fw[:, i - 1].max(axis=1, keepdims=True)
        p = np.exp(fw[:, i - 1] - m)
        nxt = p @ step
        go = moved[:, i]
        nxt -= p[:, 2:3] * step[2] * (1 - go)[:, None]
        nxt[:, 2] = np.where(go > 0, nxt[:, 2] - p[:, 2] * stay, p[:, 2] * stay)
        nxt[:, 1] -= p[:, 1] * last * apart[:, i]
        fw[:, i] = m + np.log(np.maximum(nxt, 1e-300)) + logb[:, i]
    bw = np.tile(_P1, (*logb.shape[:2], 1))
    for i in range(t - 2, -1, -1):
        q = bw[:, i + 1] + logb[:, i + 1]
        m = q.max(axis=1, keepdims=True)
        p = np.exp(q - m)
        prev = p @ step.T
        go = moved[:, i + 1]
        prev -= p[:, 2:3] * step[:, 2] * (1 - go)[:, None]
        prev[:, 2] = np.where(go > 0, prev[:, 2] - p[:, 2] * stay, p[:, 2] * stay)
        prev[:, 1] -= p[:, 1] * last * apart[:, i + 1]
        bw[:, i] = np.where((i + 1 < lengths)[:, None], m + np.log(np.maximum(prev, 1e-300)), _P1)
    g = fw + bw
    g -= g.max(axis=2, keepdims=True)
    g = np.exp(g)
    return g / g.sum(axis=2, keepdims=True)


def _chain(key: np.ndarray, logb: np.ndarray, moved: np.ndarray, apart: np.ndarray, most: int = 1 << 19) -> np.ndarray:
    """State probabilities of readings sorted by chain ``key``."""
    out = np.empty_like(logb)
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    size = np.diff(np.append(start, len(key)))
    order = np.argsort(size, kind="stable")
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and (b + 1 - a) * size[order[b]] <= most:
            b += 1
        own = order[a:b]
        t = int(size[own].max())
        x = np.zeros((len(own), t, logb.shape[1]))
        col = np.arange(t)
        inside = col[None, :] < size[own][:, None]
        where = (start[own][:, None] + col[None, :])[inside]
        x[inside] = logb[where]
        change, other = np.zeros(inside.shape), np.zeros(inside.shape)
        change[inside], other[inside] = moved[where], apart[where]
        out[where] = posteriors(x, change, other, size[own])[inside]
        a = b
    return out


def flag_chains(key: np.ndarray, vals: np.ndarray, scale: np.ndarray, still: np.ndarray, low: np.ndarray, high: np.ndarray, longer: dict[int, float] | None = None) -> np.ndarray:
    """State of every reading (0: normal or no reading) of chains laid end to end; ``key`` is each reading's chain, the rest are per chain.

    ``longer`` tells of single readings how long their run is, where it goes on beyond the chain.
    """
    read = ~np.isnan(vals)
    out = read & ((vals < low[key]) | (vals > high[key]) | np.isinf(vals))
    state = np.where(out, 3, 0).astype(np.int8)
    span = np.where(np.isfinite(high - low), high - low, 0.0)
    use = np.flatnonzero(read & ~out)
    if not len(use):
        return state
    ch, v = key[use], vals[use]
    floor = np.maximum(scale, np.maximum(2e-3 * span, 1e-9))
    z, size, lift = excursions(ch, v, floor[ch])
    begin, length = _runs(ch, v)
    whole = length.astype(float)
    if longer:
        at = np.searchsorted(use, list(longer))
        np.maximum.at(whole, np.searchsorted(begin, at, side="right") - 1, list(longer.values()))
    run = np.repeat(length, length)
    spike = np.where(size > 0, spike_gain(z) / np.maximum(size, 1), -DECAY)
    # what a run is worth is shared by those of its readings that are here
    worth = whole / still[ch[begin]]
    stuck = np.where(run > 1, COST * np.repeat(worth / length, length), -30.0)
    speaks = np.zeros(len(scale), bool)
    speaks[ch[(spike > 0) | ((run > 1) & np.repeat(worth > 0.5, length))]] = True
    # out-of-range readings stay in their chain, with one certain state
    own = np.flatnonzero(read & speaks[key])
    if len(own):
        at = np.full(len(vals), -1)
        at[use] = np.arange(len(use))
        first = np.zeros(len(use))
        first[begin] = 1.0
        k = at[own]
        sure = k < 0
        logb = np.zeros((len(own), 4))
        logb[:, 1], logb[:, 2], logb[:, 3] = spike[k], stuck[k], -700.0
        # a reading out of bounds within a run doesn't end it, and costs as much there as in normal work
        inside = np.zeros(len(own), bool)
        then = np.searchsorted(use, own[sure])
        both = (then > 0) & (then < len(use))
        inside[np.flatnonzero(sure)[both]] = (first[then[both]] == 0) & (key[own[sure]][both] == ch[then[both]])
        logb[sure] = (-700.0, -700.0, -700.0, 0.0)
        logb[inside, 2] = _A[0, 3] + _A[3, 0]
        other = np.ones(len(use))
        other[1:] = lift[1:] != lift[:-1]
        p = _chain(key[own], logb, np.where(sure, ~inside, first[k]), np.where(sure, 1.0, other[k]))
        best = np.where(p[:, 0] > 0.5, 0, 1 + np.argmax(p[:, 1:], axis=1))
        state[own[~sure]] = best[~sure]
    return state


#: Readings that are scored in one go.
PORTION = 1 << 18


_FLAGS = pa.schema([("episode_index", pa.int64()), ("frame_index", pa.int64()), ("field_name", pa.string()), ("channel", pa.int64()), ("kind", pa.string())])
FLAGS_DDL = "episode_index bigint, frame_index bigint, field_name string, channel bigint, kind string"


def _inside(v: float, limit: tuple) -> bool:
    return (limit[2] is None or v >= limit[2]) and (limit[3] is None or v <= limit[3])


def _score(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    """Blocks are scored many at a time: their chains, laid end to end, share every array operation."""
    unknown = (0.0, np.inf, -np.inf, np.inf)
    for batch in batches:
        meta = batch.select(["episode_index", "block", "n", "widths", "runs"]).to_pylist()
        frames, vals, params = (batch.column(x) for x in ("frames", "vals", "params"))
        known: dict[str | None, dict] = {}
        sources = batch.column("source").to_pylist()
        at = 0
        while at < len(meta):
            xs, fs, lens, codes, owner, limits, used = [], [], [], [], [], [], []
            total = 0
            longer: dict[int, float] = {}
            while at < len(meta) and (not xs or total < PORTION):
                r = meta[at]
                if sum(r["widths"]) and r["n"]:
                    source = sources[at]
                    if source not in known:
                        known[source] = {p["ch"]: (p["scale"], p["still"], p["low"], p["high"]) for p in params[at].as_py() or ()}
                    own = _codes(r["widths"])
                    xs.append(np.frombuffer(vals[at].as_buffer(), np.float64))
                    fs.append(np.frombuffer(frames[at].as_buffer(), np.int64))
                    codes.append(own)
                    lens.append(np.full(len(own), r["n"]))
                    owner.append(np.full(len(own), len(xs) - 1))
                    limits += [known[source].get(int(x), unknown) for x in own]
                    if r["runs"]:
                        inner = np.floor_divide(fs[-1], span) == r["block"]
                        for run in r["runs"]:
                            k = int(np.flatnonzero(own == run["ch"])[0])
                            here = np.flatnonzero(inner & np.isfinite(xs[-1][k * r["n"] : (k + 1) * r["n"]]))
                            for j, length in ((here[0], run["lead"]), (here[-1], run["trail"])):
                                # readings out of bounds are in no run
                                if _inside(xs[-1][k * r["n"] + j], limits[len(limits) - len(own) + k]):
                                    longer[total + k * r["n"] + int(j)] = max(length, longer.get(total + k * r["n"] + int(j), 0.0))
                    total += len(xs[-1])
                    used.append(r)
                at += 1
            if not xs:
                continue
            x, length, code, block = np.concatenate(xs), np.concatenate(lens), np.concatenate(codes), np.concatenate(owner)
            scale, still, low, high = (np.array([u if q[k] is None else q[k] for q in limits], dtype=float) for k, u in enumerate(unknown))
            key = np.repeat(np.arange(len(length)), length)
            state = flag_chains(key, x, scale, still, low, high, longer)
            hit = np.flatnonzero(state)
            chain = key[hit]
            row = hit - (np.cumsum(length) - length)[chain]
            base = np.cumsum([0, *map(len, fs)])
            frame = np.concatenate(fs)[base[block[chain]] + row]
            mine = np.floor_divide(frame, span) == np.array([m["block"] for m in used])[block[chain]]
            chain, frame, hit = chain[mine], frame[mine], hit[mine]
            channel, field = np.divmod(code[chain], len(FIELDS))
            episode = np.array([m["episode_index"] for m in used], dtype=np.int64)[block[chain]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(episode), pa.array(frame), pa.array(np.array(FIELDS, dtype=object)[field], pa.string()), pa.array(channel.astype(np.int64)), pa.array(np.array(STATES, dtype=object)[state[hit]], pa.string())],
                schema=_FLAGS,
            )


def implausible(frames: DataFrame, files: DataFrame, episodes: DataFrame, robots: DataFrame, limits: DataFrame) -> DataFrame:
    """episode_index, frame_index, field_name, channel and kind (spike, stuck, range) of every implausible element."""
    packed = pack_frames(frames, files, episodes)
    params = materialize(source_parameters(packed, robots, limits), "sources")
    runs = materialize(crossing_runs(packed, params), "runs")
    scored = packed.select("episode_index", "block", "source", "n", "widths", "frames", "vals").join(params, "source", "left").join(runs, ["episode_index", "block"], "left")
    span = BLOCK
    return scored.mapInArrow(lambda batches: _score(batches, span), FLAGS_DDL)
