"""Filling of fixed-capacity containers with texts measured in tokens.

Bounded-space online best fit: a packer keeps at most ``OPEN`` containers open, with a bitset keyed by
free space. An item goes where it leaves the least room; if it fits nowhere and all places are taken,
the fullest container closes first. A container without room closes at once.

An item larger than the capacity is cut: full containers of its own for the whole multiples of the
capacity, and the rest is an item like any other.

Execution: sizes are counted once and written to the shared folder (a few bytes per text). Items are
spread by the hash of their key over groups of about ``GROUP`` containers, so the work splits over any
number of tasks, a packer's memory doesn't grow with the data, and the outcome depends neither on the
number of tasks nor on the order of arrival. Groups go through at most ``TASKS`` tasks, each of which packs one
group after the other.

Defined cases: texts without tokens (null, empty) need no room; they come out with a null container and
zero tokens. Repeated rows are items of their own. Null keys are packed like others. An empty table or
an empty list of targets gives an empty result; a target whose capacity is null or below one raises
ValueError; more than ``MOST_TARGETS`` targets too.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinegrain.llm.tokens import VOCABULARIES, count_tokens
from kinegrain.runtime import materialize

OPEN = 256
GROUP = 4096
MOST_TARGETS = 1000
TASKS = 4096


class Packer:
    """Best fit with a bounded number of open containers."""

    def __init__(self, capacity: int, most_open: int = OPEN):
        self.capacity, self.most_open = capacity, most_open
        self.bits = 0
        self.by_free: dict[int, list[list]] = {}
        self.n_open = 0
        self.closed: list[list] = []

    def _take(self, free: int) -> list:
        own = self.by_free[free]
        items = own.pop()
        if not own:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.n_open -= 1
        return items

    def _put(self, free: int, items: list) -> None:
        if free == 0:
            self.closed.append(items)
            return
        self.by_free.setdefault(free, []).append(items)
        self.bits |= 1 << free
        self.n_open += 1

    def add(self, size: int, item) -> None:
        """Place an item of 1 to ``capacity``."""
        fits = self.bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            items = self._take(free)
        else:
            if self.n_open >= self.most_open:
                self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))
            free, items = self.capacity, []
        items.append(item)
        self._put(free - size, items)

    def drain(self) -> list[list]:
        out, self.closed = self.closed, []
        return out

    def finish(self) -> None:
        while self.bits:
            self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))


def _pack(kind: pa.DataType, most_open: int):
    schema = pa.schema([("target_name", pa.string()), ("container", pa.int64()), ("__key", kind), ("piece", pa.int64()), ("start_token", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        packer: Packer | None = None
        number = 0
        cols: list[list] = [[] for _ in schema]

        def put(target, container, key, piece, start, size) -> None:
            for c, x in zip(cols, (target, container, key, piece, start, size), strict=True):
                c.append(x)

        def flush() -> None:
            nonlocal number
            for items in packer.drain():
                cid = (at[1] << 36) + number
                number += 1
                for key, piece, start, size in items:
                    put(at[0], cid, key, piece, start, size)

        def batch_out() -> pa.RecordBatch:
            nonlocal cols
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, schema, strict=True)], schema=schema)
            cols = [[] for _ in schema]
            return out

        for batch in batches:
            for target, group, capacity, key, size in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                if at != (target, group):
                    if packer is not None:
                        packer.finish()
                        flush()
                    at, packer, number = (target, group), Packer(capacity, most_open), 0
                if not size:
                    put(target, None, key, 0, 0, 0)
                    continue
                whole, rest = divmod(size, capacity)
                for piece in range(whole):
                    packer.closed.append([(key, piece, piece * capacity, capacity)])
                if rest:
                    packer.add(rest, (key, whole, whole * capacity, rest))
                if len(packer.closed) > 256:
                    flush()
            yield batch_out()
        if packer is not None:
            packer.finish()
            flush()
            yield batch_out()

    return run


def fill_containers(docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", folder: str = VOCABULARIES, most_open: int = OPEN, group: int = GROUP) -> DataFrame:
    """target_name, container, ``key``, piece, start_token, n_tokens: where each piece of each text went."""
    want = targets.select("target_name", "tokenizer", "capacity_tokens").distinct().limit(MOST_TARGETS + 1).collect()
    if len(want) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    if any(not r.capacity_tokens or r.capacity_tokens < 1 for r in want):
        raise ValueError("a capacity is below one")
    spark = docs.sparkSession
    kind = docs.schema[key].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    ddl = f"target_name string, container bigint, __key {kind.simpleString()}, piece bigint, start_token bigint, n_tokens bigint"
    out = None
    for name in sorted({r.tokenizer for r in want}):
        sizes = materialize(count_tokens(docs, key, text, name, folder), "sizes")
        total = sizes.agg(F.sum("n_tokens")).first()[0] or 0
        own = [r for r in want if r.tokenizer == name]
        groups = [(r.target_name, r.capacity_tokens, max(1, math.ceil(total / (r.capacity_tokens * group)))) for r in own]
        goals = F.array(*[F.struct(F.lit(t).alias("target_name"), F.lit(cap).cast("bigint").alias("capacity"), F.lit(n).cast("bigint").alias("n")) for t, cap, n in groups])
        mark = F.xxhash64(F.lit(17), F.col(key))
        items = (
            sizes.select(F.col(key).alias("__key"), "n_tokens", mark.alias("__mark"), F.explode(goals).alias("g"))
            .select("g.target_name", F.pmod("__mark", "g.n").alias("group"), "g.capacity", "__key", "n_tokens", F.xxhash64(F.lit(5), "__mark").alias("__order"))
            .repartition(min(TASKS, max(1, sum(n for _, _, n in groups))), "target_name", "group")
            .sortWithinPartitions("target_name", "group", "__order", "__key", "n_tokens")
            .select("target_name", "group", "capacity", "__key", "n_tokens")
        )
        rows = items.mapInArrow(_pack(to_arrow_type(kind), most_open), ddl)
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        out = spark.createDataFrame([], ddl)
    return out.withColumnRenamed("__key", key)
