"""Rotations as column expressions: quaternions are (x, y, z, w)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FLOOR = 1e-12


def quat_to_rotvec(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Rotation vector of at most pi of a quaternion of any length."""
    norm = F.greatest(F.sqrt(x * x + y * y + z * z + w * w), F.lit(FLOOR))
    sign = F.when(w < 0, -1.0).otherwise(1.0)
    a, b, c, d = (v / norm * sign for v in (x, y, z, w))
    part = F.sqrt(a * a + b * b + c * c)
    angle = 2 * F.atan2(part, d)
    factor = F.when(part < FLOOR, 2.0).otherwise(angle / part)
    return F.array(a * factor, b * factor, c * factor)


def unwrap_rotvecs(df: DataFrame, keys: list[str], order: str, vector: str) -> DataFrame:
    """(keys, order, vector): each vector negated where it lies more than pi from its fixed predecessor.

    The choice depends on the choice before, so a key's vectors are folded in order.
    """
    lists = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("i"), F.col(vector).alias("v")))).alias("s"))

    def dist(a: Column, b: Column) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda acc, e: acc + e))

    def step(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, F.greatest(F.lit(1), F.size(acc))).v
        fixed = F.when((F.size(acc) > 0) & (dist(s.v, last) > math.pi), F.transform(s.v, lambda e: 0.0 - e)).otherwise(s.v)
        return F.concat(acc, F.array(F.struct(s.i.alias("i"), fixed.alias("v"))))

    kind = df.schema[order].dataType.simpleString()
    folded = F.aggregate("s", F.array().cast(f"array<struct<i:{kind},v:array<double>>>"), step)
    return lists.select(*keys, F.explode(folded).alias("e")).select(*keys, F.col("e.i").alias(order), F.transform("e.v", lambda x: x + 0.0).alias(vector))


def matrix_to_quat(m: list[list[Column]]) -> Column:
    """Quaternion of a rotation matrix, by the largest of trace and diagonal entries."""
    (a, b, c), (d, e, f), (g, h, i) = m
    trace = a + e + i
    s0 = 2 * F.sqrt(trace + 1)
    s1, s2, s3 = 2 * F.sqrt(1 + a - e - i), 2 * F.sqrt(1 + e - a - i), 2 * F.sqrt(1 + i - a - e)
    return (
        F.when(trace > 0, F.array((h - f) / s0, (c - g) / s0, (d - b) / s0, 0.25 * s0))
        .when((a > e) & (a > i), F.array(0.25 * s1, (b + d) / s1, (c + g) / s1, (h - f) / s1))
        .when(e > i, F.array((b + d) / s2, 0.25 * s2, (f + h) / s2, (c - g) / s2))
        .otherwise(F.array((c + g) / s3, (f + h) / s3, 0.25 * s3, (d - b) / s3))
    )
