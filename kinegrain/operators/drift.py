"""Schemas that change from inspection to inspection: one consistent table and a list of changes.

Headers are folded through a lattice of types. A chain of numeric types (boolean below int below
bigint below double, float below double) widens upwards; arrays widen by their elements; whatever
else meets widens to string. The fold is a set union per key (at most one entry per type), so it can
be done in any order and in parts. Headers come from inspections (``snapshots``) or from the footers of
files on any file system (``read_headers``). A key is retyped where the lattice doesn't hold its two
types as they were; the verdict of the lattice (widened, narrowed, merged, incompatible) is told with it.

Values are cast to the type of their key: true and false are 1 and 0 among numbers, whole numbers with a
fraction of nought are integers. What a cast loses (text among numbers, a bigint beyond 2**53 among
doubles) is told by key.

Changes are found between each inspection and the one before it in the same dataset. The predecessor
is looked up in two steps, within a month and then from the last inspection of the month before, so
that a dataset with a great share of all inspections doesn't end up in one task.

Defined cases: repeated inspections count once (by snapshot id, the latest loaded); inspections
without keys failed and are passed over; a null type is the type ``null`` (bottom of the lattice);
a key repeated in one header has the first of its types; equal times are ordered by snapshot id;
nulls for roles and layouts are no names, but a layout that turns null or is no longer null differs;
empty tables give empty results; further columns are ignored; a file whose footer can't be read is told with its
error (``read_headers``) and ends a fold of headers (``header_cells``). Records with more than ``most_keys`` keys are
refused as columns (ValueError) and are had as cells instead, one row per value, whatever their number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROLES = ("joint_state_key", "joint_command_key", "ee_pose_key", "gripper_key", "timestamp_key", "episode_index_key", "frame_index_key")

# The spellings of a type.
SPELLINGS = {
    "double": "double", "float64": "double",
    "float": "float", "float32": "float",
    "bigint": "bigint", "int64": "bigint", "long": "bigint",
    "int": "int", "int32": "int", "integer": "int",
    "string": "string", "str": "string", "utf8": "string",
    "boolean": "boolean", "bool": "boolean",
}

#: What two different types of a key become; anything else becomes string.
_WIDER = {
    frozenset(("boolean", "int")): "int", frozenset(("boolean", "bigint")): "bigint", frozenset(("boolean", "float")): "float", frozenset(("boolean", "double")): "double",
    frozenset(("int", "bigint")): "bigint", frozenset(("int", "float")): "double", frozenset(("int", "double")): "double",
    frozenset(("bigint", "float")): "double", frozenset(("bigint", "double")): "double", frozenset(("float", "double")): "double",
}


def promote(a: str | None, b: str | None) -> str | None:
    """Least type above both; commutative, associative and idempotent. Double stands above bigint, though it rounds beyond 2**53."""
    if a is None or a == b:
        return b
    if b is None:
        return a
    if a.startswith("array<") and b.startswith("array<"):
        return f"array<{promote(a[6:-1], b[6:-1])}>"
    return _WIDER.get(frozenset((a, b)), "string")


def promote_types(a: Column, b: Column) -> Column:
    """``promote`` of two columns of type names; ``null`` is below all."""
    wider = F.create_map(*[F.lit(x) for pair, v in _WIDER.items() for k in (sorted(pair), sorted(pair, reverse=True)) for x in ("|".join(k), v)])
    array = "array<"
    deep = lambda t: F.length(F.regexp_extract(t, r"^((?:array<)*)", 1)) / len(array)
    inner = lambda t: F.regexp_extract(t, r"^(?:array<)*(.*?)>*$", 1)
    depth = F.least(deep(a), deep(b)).cast("int")
    x, y = inner(a), inner(b)
    met = F.when(deep(a) != deep(b), "string").when(x == y, x).otherwise(F.coalesce(F.try_element_at(wider, F.concat_ws("|", x, y)), F.lit("string")))
    return F.when((a == b) | (b == "null"), a).when(a == "null", b).otherwise(F.concat(F.repeat(F.lit(array), depth), met, F.repeat(F.lit(">"), depth)))


def key_name(x: Column) -> Column:
    return F.lower(F.regexp_replace(x, r"^\s+|\s+$", ""))


def type_name(x: Column) -> Column:
    """One spelling per type; list<> is array<>; unknown types keep their (lower-case) name."""
    t = F.regexp_replace(F.regexp_replace(F.lower(x), r"\s+", ""), r"\blist<", "array<")
    spelled = F.create_map(*[F.lit(v) for kv in SPELLINGS.items() for v in kv])
    inner = F.regexp_extract(t, r"^(?:array<)*([^<>]*)>*$", 1)
    plain = F.coalesce(F.try_element_at(spelled, inner), inner)
    return F.coalesce(F.when(inner == "", t).otherwise(F.concat(F.regexp_extract(t, r"^((?:array<)*)", 1), plain, F.regexp_extract(t, r"(>*)$", 1))), F.lit("null"))


def snapshots(schemas: DataFrame) -> DataFrame:
    """One row per successful inspection: names and types in one spelling, parallel arrays, roles."""
    cols = ["dataset_id", "inspected_at", "layout", "all_keys", "all_types", *ROLES]
    one = schemas.where(F.col("snapshot_id").isNotNull()).groupBy("snapshot_id").agg(F.max_by(F.struct(*cols), F.struct("loaded_at", "inspected_at")).alias("r")).select("snapshot_id", "r.*")
    names = F.transform("all_keys", key_name)
    n = F.size("keys")
    first = F.filter(F.sequence(F.lit(1), n), lambda i: F.array_position("keys", F.element_at("keys", i)) == i)
    return (
        one.where(F.col("all_keys").isNotNull())
        .withColumn("keys", F.transform(names, lambda k: F.coalesce(k, F.lit(""))))
        .withColumn("__at", F.when(n > 0, first).otherwise(F.array().cast("array<int>")))
        .select(
            "dataset_id", "snapshot_id", "inspected_at", "layout",
            F.transform("__at", lambda i: F.element_at("keys", i)).alias("keys"),
            F.transform("__at", lambda i: type_name(F.try_element_at("all_types", i))).alias("types"),
            F.array(*[key_name(F.col(r)) for r in ROLES]).alias("roles"),
        )
    )


def with_previous(df: DataFrame, key: str, time: str, tie: str, columns: list[str]) -> DataFrame:
    """Adds ``prev``: ``columns`` of the row before in ``key`` by (time, tie), or null.

    Two steps: a window within (key, month), and for the first row of a month the last row of the
    latest month before it, found in a table of one row per key and month.
    """
    month = F.coalesce(F.date_trunc("month", F.col(time)), F.timestamp_seconds(F.lit(-(10**10))).cast("timestamp_ntz"))
    own = F.struct(*columns)
    b = df.withColumn("__month", month)
    near = b.withColumn("__near", F.lag(own).over(Window.partitionBy(key, "__month").orderBy(time, tie)))
    ends = b.groupBy(key, "__month").agg(F.max_by(own, F.struct(time, tie)).alias("__end"))
    ends = ends.withColumn("__far", F.lag("__end").over(Window.partitionBy(key).orderBy("__month"))).drop("__end")
    return near.join(ends, [key, "__month"], "left").withColumn("prev", F.coalesce("__near", "__far")).drop("__near", "__far", "__month")


def schema_changes(schemas: DataFrame) -> DataFrame:
    """dataset_id, snapshot_id, change_kind, key_name, what was before and after, and the verdict of the lattice on new types."""
    s = with_previous(snapshots(schemas), "dataset_id", "inspected_at", "snapshot_id", ["layout", "keys", "types", "roles"]).where(F.col("prev").isNotNull())
    # (old, new) names of roles that moved to a key that wasn't there, from a key that is gone
    pair = F.zip_with(F.col("prev.roles"), F.col("roles"), lambda a, b: F.struct(a.alias("old"), b.alias("new")))
    moved = F.filter(
        pair,
        lambda p: p.old.isNotNull() & p.new.isNotNull() & (p.old != p.new) & ~F.array_contains(F.col("keys"), p.old) & ~F.array_contains(F.col("prev.keys"), p.new),
    )
    s = s.withColumn("moved", F.array_distinct(moved))
    s = s.withColumn("olds", F.transform("moved", lambda p: p.old)).withColumn("news", F.transform("moved", lambda p: p.new))
    none = F.lit(None).cast("string")
    event = lambda kind, key, was, now, verdict=none: F.struct(F.lit(kind).alias("change_kind"), key.alias("key_name"), was.alias("was"), now.alias("now"), verdict.alias("verdict"))
    type_in = lambda types, keys, k: F.try_element_at(types, F.array_position(keys, k).cast("int"))
    before = lambda k: F.coalesce(F.try_element_at(F.col("olds"), F.when(F.array_contains("news", k), F.array_position("news", k).cast("int"))), k)
    present = F.filter("keys", lambda k: F.array_contains(F.col("prev.keys"), before(k)))
    kept = F.transform(present, lambda k: F.struct(k.alias("key"), type_in(F.col("prev.types"), F.col("prev.keys"), before(k)).alias("was"), type_in(F.col("types"), F.col("keys"), k).alias("now")))
    # equal types meet in themselves
    met = F.transform(F.filter(kept, lambda e: e.was != e.now), lambda e: F.struct(e.key.alias("key"), e.was.alias("was"), e.now.alias("now"), promote_types(e.was, e.now).alias("met")))
    retyped = F.filter(met, lambda e: (e.met != e.was) | (e.met != e.now))
    verdict = lambda e: F.when(e.met == e.now, "widened").when(e.met == e.was, "narrowed").when(e.met.endswith("string") | e.met.startswith("array<string"), "incompatible").otherwise("merged")
    changes = F.concat(
        F.when(F.col("layout").eqNullSafe(F.col("prev.layout")), F.array().cast("array<struct<change_kind:string,key_name:string,was:string,now:string,verdict:string>>")).otherwise(F.array(event("layout", F.col("layout"), F.col("prev.layout"), F.col("layout")))),
        F.transform("moved", lambda p: event("renamed", p.new, p.old, p.new)),
        F.transform(F.filter(F.array_except("keys", "prev.keys"), lambda k: ~F.array_contains("news", k)), lambda k: event("added", k, none, type_in(F.col("types"), F.col("keys"), k))),
        F.transform(F.filter(F.array_except("prev.keys", "keys"), lambda k: ~F.array_contains("olds", k)), lambda k: event("removed", k, type_in(F.col("prev.types"), F.col("prev.keys"), k), none)),
        F.transform(retyped, lambda e: event("retyped", e.key, e.was, e.now, verdict(e))),
    )
    return s.select("dataset_id", "snapshot_id", "inspected_at", F.explode(changes).alias("e")).select("dataset_id", "snapshot_id", "inspected_at", "e.*")


def union_schema(schemas: DataFrame) -> DataFrame:
    """key_name, key_type: all keys of all inspections with the least type that holds them all."""
    return fold_types(snapshots(schemas).select(F.explode(F.arrays_zip("keys", "types")).alias("z")).select(F.col("z.keys").alias("key_name"), F.col("z.types").alias("type")))


def fold_types(cells: DataFrame) -> DataFrame:
    """key_name, key_type of rows of (key_name, type)."""
    z = cells.groupBy("key_name").agg(F.array_sort(F.collect_set("type")).alias("types"))
    met = F.aggregate("types", F.lit("null"), promote_types)
    return z.select("key_name", F.when(met == "null", "string").otherwise(met).alias("key_type"))


def current_names(schemas: DataFrame) -> DataFrame:
    """snapshot_id, dataset_id and for each role the key of that snapshot, to bring records to one set of names."""
    s = snapshots(schemas)
    return s.select("snapshot_id", *[F.element_at("roles", k + 1).alias(r) for k, r in enumerate(ROLES)])


def _cast(raw: Column, kind: str) -> Column:
    """The value of a JSON text as ``kind``; null where it can't be had."""
    if kind.startswith("array<"):
        inner = kind[6:-1]
        return F.from_json(raw, kind) if "<" in inner else F.transform(F.from_json(raw, "array<string>"), lambda x: _cast(x, inner))
    if kind in ("string", "null") or kind not in SPELLINGS.values():
        return raw
    if kind == "boolean":
        return raw.try_cast("boolean")
    number = F.when(F.lower(raw) == "true", "1").when(F.lower(raw) == "false", "0").otherwise(raw)
    if kind in ("int", "bigint"):
        whole = number.try_cast("decimal(38,6)")
        return F.coalesce(number.try_cast(kind), F.when(whole == F.floor(whole), whole.cast("string").try_cast("double").try_cast(kind)))
    return number.try_cast(kind)


def _lost(raw: Column, value: Column, kind: str) -> Column:
    """Whether the cast of ``raw`` to ``kind`` lost something."""
    absent = lambda x: x.isNull() | (x == "null")
    if kind.startswith("array<"):
        # an array that can't be read, or elements that were there and aren't any more
        was = F.from_json(raw, "array<string>")
        return ~absent(raw) & (value.isNull() | (F.size(F.filter(was, lambda x: ~absent(x))) > F.size(F.filter(value, lambda x: x.isNotNull()))))
    gone = ~absent(raw) & value.isNull()
    if kind in ("double", "float"):
        exact = raw.try_cast("bigint")
        gone = gone | (exact.isNotNull() & (F.abs(exact) > 2**53) & (value.try_cast("decimal(38,0)") != exact.cast("decimal(38,0)")))
    return F.coalesce(gone, F.lit(False))


def _records(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """Distinct records with the roles' names of their snapshot and a map of their values; ``broken`` ones have none."""
    lower = F.map_from_entries(F.array_distinct(F.transform(F.map_entries("__map"), lambda e: F.struct(key_name(e.key).alias("key"), e.value.alias("value")))))
    return (
        rows.select("row_id", "dataset_id", "snapshot_id", "line_no", "record_json")
        .where(F.col("row_id").isNotNull())
        .dropDuplicates(["row_id"])
        .join(current_names(schemas), "snapshot_id", "left")
        .withColumn("__map", F.from_json("record_json", "map<string,string>"))
        .withColumn("broken", F.col("record_json").isNull() | F.col("__map").isNull() | ~F.rtrim("record_json").endswith("}"))
        .withColumn("__map", F.when(~F.col("broken"), lower))
    )


def consistent_rows(rows: DataFrame, schemas: DataFrame, most_keys: int = 2000) -> DataFrame:
    """All records as one table: row_id, dataset_id, snapshot_id, line_no, the roles, then every key of the union schema.

    The union schema is a driver-side list of names and types; ``most_keys`` bounds it (ValueError
    beyond; ``consistent_cells`` has no bound). A record is parsed once, names without regard to case.
    Values that don't fit their type are null and their keys stand in ``lost``; cut-off lines have
    ``broken`` true and null keys. Role columns (``role_...``) hold the value under whatever name the role
    had in the record's snapshot, as JSON text. Repeated rows (row_id) count once. A key with the name of one of
    the other columns stands under its name after ``field_``.
    """
    keys = [(r.key_name, r.key_type) for r in union_schema(schemas).where("key_name <> ''").orderBy("key_name").limit(most_keys + 1).collect()]
    if len(keys) > most_keys:
        raise ValueError(f"more than {most_keys} keys: use consistent_cells")
    raw = lambda k: F.try_element_at("__map", F.lit(k))
    lost = [F.when(_lost(raw(k), _cast(raw(k), t), t), k) for k, t in keys]
    taken = {"row_id", "dataset_id", "snapshot_id", "line_no", "broken", "lost", *(f"role_{r.removesuffix('_key')}" for r in ROLES)}
    names = {}
    for k, _ in keys:
        name = k
        while name in taken:
            name = f"field_{name}"
        taken.add(name)
        names[k] = name
    return _records(rows, schemas).select(
        "row_id", "dataset_id", "snapshot_id", "line_no", "broken",
        F.array_compact(F.array(*lost)).alias("lost") if lost else F.array().cast("array<string>").alias("lost"),
        *[F.try_element_at("__map", F.col(r)).alias(f"role_{r.removesuffix('_key')}") for r in ROLES],
        *[_cast(raw(k), t).alias(names[k]) for k, t in keys],
    )


def consistent_cells(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """row_id, key_name, key_type, value: all records in long form, for any number of keys.

    ``value`` is the JSON text of the value cast to the type of its key. Keys that no header names are left out.
    """
    cells = _records(rows, schemas).select("row_id", F.explode("__map").alias("key_name", "raw")).join(union_schema(schemas).where("key_name <> ''"), "key_name")
    kinds = sorted(set(SPELLINGS.values()))
    value, lost = F.col("raw"), F.lit(False)
    for kind in [*kinds, *[f"array<{k}>" for k in kinds]]:
        cast = _cast(F.col("raw"), kind)
        own = F.col("key_type") == kind
        value = F.when(own, F.to_json(cast) if kind.startswith("array<") else cast.cast("string")).otherwise(value)
        lost = F.when(own, _lost(F.col("raw"), cast, kind)).otherwise(lost)
    return cells.select("row_id", "key_name", "key_type", value.alias("value"), lost.alias("lost"))


def lost_values(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """key_name, key_type, n_values and n_lost: what the casts to the union schema lose."""
    own = consistent_cells(rows, schemas).groupBy("key_name", "key_type")
    return own.agg(F.count(F.lit(1)).alias("n_values"), F.sum(F.col("lost").cast("bigint")).alias("n_lost"))


def list_files(spark: SparkSession, root: str, pattern: str = "*.parquet") -> DataFrame:
    """path of every file below ``root``, at any depth, on any file system of the cluster; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root).select("path")


def _arrow_name(t) -> str:
    import pyarrow as pa

    if pa.types.is_list(t) or pa.types.is_large_list(t) or pa.types.is_fixed_size_list(t):
        return f"array<{_arrow_name(t.value_type)}>"
    name = str(t)
    small = {"bool": "boolean", "int8": "int", "int16": "int", "uint8": "int", "uint16": "int", "uint32": "bigint", "halffloat": "float", "large_string": "string", "date32[day]": "date"}
    return "timestamp" if name.startswith("timestamp") else SPELLINGS.get(small.get(name, name), small.get(name, name))


def _locate(path: str):
    """Arrow's file system of ``path`` and the name on it. A path is taken as it is written, as Spark lists it: a blank, ``%`` or ``#`` is part of the name."""
    from pyarrow import fs

    if path.startswith(("/", "file:")):
        return fs.LocalFileSystem(), re.sub(r"^file:(?://[^/]*)?", "", path)
    root, name = re.match(r"([^:/]+:(?://[^/]*)?)?(.*)", path, re.DOTALL).groups("")
    return fs.FileSystem.from_uri(root + quote(name))


def read_headers(files: DataFrame) -> DataFrame:
    """path, keys, types, error of the parquet files in column ``path`` of ``files``, from their footers, in parallel.

    Paths may be of any file system that Arrow knows by its scheme. A file that can't be read has null keys and
    ``error`` tells why; it is null for all others, those without columns included.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq

        for b in batches:
            found = []
            for p in b["path"]:
                try:
                    if p is None:
                        raise ValueError("no path")
                    system, name = _locate(p)
                    with system.open_input_file(name) as f:
                        schema = pq.read_schema(f)
                    found.append((p, list(schema.names), [_arrow_name(t) for t in schema.types], None))
                except Exception as e:  # noqa: BLE001 - one broken file is told, not fatal
                    found.append((p, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(found, columns=["path", "keys", "types", "error"])

    return files.select("path").repartition(F.col("path")).mapInPandas(read, "path string, keys array<string>, types array<string>, error string")


def header_cells(headers: DataFrame) -> DataFrame:
    """key_name, type: a row for every key of ``read_headers``. What is folded from them holds for all files, so one that couldn't be read ends the job with its path and error."""
    told = F.concat_ws(" ", F.lit("header can't be read:"), F.coalesce("path", F.lit("null")), F.col("error"))
    cells = F.when(F.col("error").isNotNull(), F.raise_error(told)).otherwise(F.arrays_zip("keys", "types"))
    return headers.select(F.explode(cells).alias("z")).select(key_name(F.col("z.keys")).alias("key_name"), F.col("z.types").alias("type"))
