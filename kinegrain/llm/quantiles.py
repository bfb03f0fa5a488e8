"""Percentiles of large numeric columns with a stated rank error, mergeable over partitions and days.

Deterministic collapsing of buffers: a sketch holds one partly filled buffer and at most one full
buffer of ``SIZE`` sorted values per level; a value of level ``l`` stands for ``2**l`` values. Two full
buffers of one level collapse into one of the next: of their merged values every second one is kept,
starting at the first or the second in turn. A collapse into level ``l`` shifts a rank by at most
``2**(l - 1)``; the sum of these shifts and the weight of the highest level is the stated error.
Sketches add like binary numbers, so any tree of merges keeps the bound
``n / (2 * SIZE) * log2(n / SIZE)`` or less. Up to ``SIZE`` values the result is exact.

Execution: records are made distinct by their id within buckets of ids (one shuffle), sorted by
group, bucket and value within a partition and summed up as they stream by, one sketch in memory at a time.
Sketches meet in two rounds, first within ``SALT`` shares of a group and then per group, again as a stream and
in the order of their contents, so a group that holds a third of all rows is neither collected nor a bottleneck,
and the result depends neither on the number of partitions nor on the order of arrival.

Defined cases: null and NaN values are left out, infinite and negative ones are values like others; a
null label or date is a group of its own; repeated ids count once (of differing rows the smallest);
rows with a null id are left out; an empty table gives no groups; further columns are ignored.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinegrain.operators.compaction import input_bytes

SIZE = 2048
SALT = 32
#: Bytes of input per share of the ids that is summed up apart, and the least and most shares. Results depend on the shares (within the stated
#: error), so their number follows from the data alone, not from the layout.
BUCKET_BYTES, LEAST_BUCKETS, MOST_BUCKETS = 16 << 20, 8, 4096


class Sketch:
    def __init__(self, size: int = SIZE):
        self.size, self.n, self.error, self.turn = size, 0, 0.0, 0
        self.part = np.empty(0)
        self.full: dict[int, np.ndarray] = {}

    def _carry(self, level: int, buffer: np.ndarray) -> None:
        while level in self.full:
            both = np.sort(np.concatenate([self.full.pop(level), buffer]), kind="stable")
            level += 1
            buffer = both[self.turn :: 2]
            self.turn ^= 1
            self.error += 2.0 ** (level - 1)
        self.full[level] = buffer

    def add(self, values: np.ndarray) -> None:
        self.n += len(values)
        values = np.concatenate([self.part, values])
        at = 0
        while len(values) - at >= self.size:
            self._carry(0, np.sort(values[at : at + self.size]))
            at += self.size
        self.part = values[at:]

    def merge(self, other: Sketch) -> None:
        if self.size != other.size:
            raise ValueError("sketches of different sizes")
        n = self.n + other.n
        self.error += other.error
        for level in sorted(other.full):
            self._carry(level, other.full[level])
        self.add(other.part)
        self.n = n

    def rank_error(self) -> float:
        """Ranks by which a percentile may be off at most."""
        return self.error + (2.0 ** max(self.full) if self.full and self.error else 0.0)

    def quantiles(self, qs: list[float]) -> list[float]:
        """Values at rank ceil(q * n), at least 1."""
        values = np.concatenate([self.part, *self.full.values()])
        weights = np.concatenate([np.ones(len(self.part)), *[np.full(len(b), 2.0**lv) for lv, b in self.full.items()]])
        order = np.argsort(values, kind="stable")
        reach = np.cumsum(weights[order])
        wanted = np.maximum(1, np.ceil(np.array(qs) * self.n - 1e-9))
        at = np.minimum(np.searchsorted(reach, wanted), len(values) - 1)
        return values[order][at].tolist()

    def to_bytes(self) -> bytes:
        levels = sorted(self.full)
        head = struct.pack("<iqdiii", self.size, self.n, self.error, self.turn, len(self.part), len(levels))
        return head + struct.pack(f"<{len(levels)}i", *levels) + self.part.tobytes() + b"".join(self.full[lv].tobytes() for lv in levels)

    @classmethod
    def from_bytes(cls, data: bytes) -> Sketch:
        size, n, error, turn, n_part, n_levels = struct.unpack_from("<iqdiii", data)
        at = struct.calcsize("<iqdiii")
        levels = struct.unpack_from(f"<{n_levels}i", data, at)
        values = np.frombuffer(data, np.float64, offset=at + 4 * n_levels) if len(data) > at + 4 * n_levels else np.empty(0)
        out = cls(size)
        out.n, out.error, out.turn, out.part = n, error, turn, values[:n_part].copy()
        for k, lv in enumerate(levels):
            out.full[lv] = values[n_part + k * size : n_part + (k + 1) * size].copy()
        return out


def _stream(n_keys: int, names: list[str], types: list[pa.DataType], size: int):
    """Rows sorted by their first ``n_keys`` columns, the last one a value or a sketch, to one sketch per key."""
    schema = pa.schema([*zip(names, types, strict=True), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            nonlocal rows
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
            rows = []
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = [batch.column(k) for k in range(n_keys)]
            codes = [k.dictionary_encode(null_encoding="encode").indices.to_numpy() for k in keys]
            new = np.zeros(n, bool)
            new[0] = True
            for x in codes:
                new[1:] |= x[1:] != x[:-1]
            cuts = np.append(np.flatnonzero(new), n)
            last = batch.column(n_keys)
            merging = pa.types.is_binary(last.type)
            values = None if merging else last.to_numpy(zero_copy_only=False)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                key = tuple(k[a].as_py() for k in keys)
                if at is None or key != at:
                    if held is not None:
                        rows.append((*at, held.to_bytes()))
                    at, held = key, Sketch(size)
                if merging:
                    for k in range(a, b):
                        held.merge(Sketch.from_bytes(last[k].as_py()))
                else:
                    held.add(values[a:b])
            if len(rows) > 500:
                yield out()
        if held is not None:
            rows.append((*at, held.to_bytes()))
        yield out()

    return run


def _sum_up(df: DataFrame, keys: list[str], last: str, size: int) -> DataFrame:
    """Sketches of runs of rows with equal keys within each partition."""
    from pyspark.sql.pandas.types import to_arrow_type

    fields = [df.schema[k] for k in keys]
    ddl = T.StructType([*fields, T.StructField("sketch", T.BinaryType())])
    run = _stream(len(keys), keys, [to_arrow_type(f.dataType) for f in fields], size)
    return df.sortWithinPartitions(*keys, last).select(*keys, last).mapInArrow(run, ddl)


def merge_sketches(sketches: DataFrame, keys: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per combination of ``keys``; further key columns of ``sketches`` are merged away."""
    near = sketches.select(*keys, F.pmod(F.xxhash64("sketch"), F.lit(SALT)).alias("__salt"), "sketch")
    near = _sum_up(near.repartition(*keys, "__salt"), [*keys, "__salt"], "sketch", size)
    return _sum_up(near.select(*keys, "sketch").repartition(*keys), keys, "sketch", size)


def sketch_groups(df: DataFrame, keys: dict[str, Column], value: Column, record_id: str, size: int = SIZE, buckets: int | None = None) -> DataFrame:
    """One sketch of ``value`` per group of ``keys`` (name to expression), each ``record_id`` once; ``buckets`` follow from the input's size unless given."""
    if buckets is None:
        buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, math.ceil(math.log2(max(1, input_bytes(df)) / BUCKET_BYTES)))))
    v = value.cast("double")
    one = (
        df.where(F.col(record_id).isNotNull() & v.isNotNull() & ~F.isnan(v))
        .select(F.pmod(F.xxhash64(record_id), F.lit(buckets)).alias("__bucket"), F.col(record_id).alias("__id"), *[e.alias(k) for k, e in keys.items()], v.alias("__value"))
        .repartition("__bucket")
        .groupBy("__bucket", "__id")
        .agg(F.min(F.struct("__value", *keys)).alias("r"))
        .select("__bucket", "r.*")
    )
    return merge_sketches(_sum_up(one, [*keys, "__bucket"], "__value", size), [*keys], size)


def percentiles(sketches: DataFrame, keys: list[str], qs: list[float]) -> DataFrame:
    """``keys``, n, p<percent> columns and rank_error of each sketch."""
    from pyspark.sql.pandas.types import to_arrow_type

    names = [f"p{str(round(q * 100, 4)).rstrip('0').rstrip('.').replace('.', '_')}" for q in qs]
    fields = [sketches.schema[k] for k in keys]
    ddl = T.StructType([*fields, T.StructField("n", T.LongType()), *[T.StructField(x, T.DoubleType()) for x in names], T.StructField("rank_error", T.DoubleType())])
    schema = pa.schema([*[(f.name, to_arrow_type(f.dataType)) for f in fields], ("n", pa.int64()), *[(x, pa.float64()) for x in names], ("rank_error", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Sketch.from_bytes(x) for x in batch.column(len(keys)).to_pylist()]
            table = [s.quantiles(qs) for s in found]
            cols = [batch.column(k) for k in range(len(keys))]
            cols += [pa.array([s.n for s in found], pa.int64())]
            cols += [pa.array([row[k] for row in table], pa.float64()) for k in range(len(qs))]
            cols += [pa.array([s.rank_error() for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return sketches.select(*keys, "sketch").mapInArrow(run, ddl)


def label_of(label: Column) -> Column:
    return F.lower(F.regexp_replace(label, r"^\s+|\s+$", ""))


def duration_sketches(segments: DataFrame, size: int = SIZE) -> DataFrame:
    """label, run_date, sketch of the durations."""
    return sketch_groups(segments, {"label": label_of(F.col("label")), "run_date": F.col("run_date")}, F.col("duration"), "segment_id", size)
