"""Column algebra on (z, y, x) triples, and exact point-to-triangle distance, all inside Catalyst."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TINY = 1e-12
TURN = 2 * math.pi


def triple(prefix: str, suffix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{axis}{suffix}") for axis in "zyx")


def sub(a, b):
    return tuple(p - q for p, q in zip(a, b))


def dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a) -> Column:
    return F.sqrt(dot(a, a))


def unit(a):
    n = F.greatest(norm(a), F.lit(TINY))
    return tuple(p / n for p in a)


def guarded(c: Column) -> Column:
    """A denominator that is never zero."""
    return F.when(F.abs(c) < TINY, F.lit(TINY)).otherwise(c)


def angle_deg(a, b) -> Column:
    """Angle of two unit vectors, whatever their signs."""
    return F.degrees(F.acos(F.least(F.abs(dot(a, b)), F.lit(1.0))))


def with_triangle_distance(df: DataFrame, out: str = "dist") -> DataFrame:
    """df with the distance of point (pz, py, px) to triangle (az.., bz.., cz..).

    The regions around a triangle are tried in order: corners, edges, inside (the textbook case analysis, as in
    C. Ericson, Real-Time Collision Detection, 5.1.5). Each region's weights of the corners b and c say where the
    nearest point lies, so one CASE per weight is all there is.
    """
    p, a, b, c = (triple(x) for x in "pabc")
    ab, ac = sub(b, a), sub(c, a)
    df = df.withColumns({"_1": dot(ab, sub(p, a)), "_2": dot(ac, sub(p, a)), "_3": dot(ab, sub(p, b)), "_4": dot(ac, sub(p, b)), "_5": dot(ab, sub(p, c)), "_6": dot(ac, sub(p, c))})
    d1, d2, d3, d4, d5, d6 = (F.col(f"_{i}") for i in range(1, 7))
    df = df.withColumns({"_vc": d1 * d4 - d3 * d2, "_vb": d5 * d2 - d1 * d6, "_va": d3 * d6 - d5 * d4})
    va, vb, vc = F.col("_va"), F.col("_vb"), F.col("_vc")
    at_a = (d1 <= 0) & (d2 <= 0)
    at_b = (d3 >= 0) & (d4 <= d3)
    on_ab = (vc <= 0) & (d1 >= 0) & (d3 <= 0)
    at_c = (d6 >= 0) & (d5 <= d6)
    on_ac = (vb <= 0) & (d2 >= 0) & (d6 <= 0)
    on_bc = (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0)
    along = (d4 - d3) / guarded((d4 - d3) + (d5 - d6))
    whole = guarded(va + vb + vc)
    zero, one = F.lit(0.0), F.lit(1.0)
    v = F.when(at_a, zero).when(at_b, one).when(at_c, zero).when(on_ab, d1 / guarded(d1 - d3)).when(on_ac, zero).when(on_bc, one - along).otherwise(vb / whole)
    w = F.when(at_a, zero).when(at_b, zero).when(at_c, one).when(on_ab, zero).when(on_ac, d2 / guarded(d2 - d6)).when(on_bc, along).otherwise(vc / whole)
    df = df.withColumns({"_v": v, "_w": w})
    near = tuple(q + F.col("_v") * e + F.col("_w") * f for q, e, f in zip(a, ab, ac))
    return df.withColumn(out, norm(sub(p, near))).drop("_1", "_2", "_3", "_4", "_5", "_6", "_va", "_vb", "_vc", "_v", "_w")


def triangle_distance(p: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The same over arrays of points and corners, row by row."""
    ab, ac = b - a, c - a
    along = lambda e, o: (e * (p - o)).sum(1)
    d1, d2, d3, d4, d5, d6 = along(ab, a), along(ac, a), along(ab, b), along(ac, b), along(ab, c), along(ac, c)
    va, vb, vc = d3 * d6 - d5 * d4, d5 * d2 - d1 * d6, d1 * d4 - d3 * d2
    safe = lambda x: np.where(np.abs(x) < TINY, TINY, x)
    regions = [
        (d1 <= 0) & (d2 <= 0), (d3 >= 0) & (d4 <= d3), (d6 >= 0) & (d5 <= d6),
        (vc <= 0) & (d1 >= 0) & (d3 <= 0), (vb <= 0) & (d2 >= 0) & (d6 <= 0), (va <= 0) & (d4 - d3 >= 0) & (d5 - d6 >= 0),
    ]
    zero, one, whole = np.zeros(len(p)), np.ones(len(p)), safe(va + vb + vc)
    edge = (d4 - d3) / safe((d4 - d3) + (d5 - d6))
    v = np.select(regions, [zero, one, zero, d1 / safe(d1 - d3), zero, one - edge], vb / whole)
    w = np.select(regions, [zero, zero, one, zero, d2 / safe(d2 - d6), edge], vc / whole)
    return np.sqrt(((p - (a + v[:, None] * ab + w[:, None] * ac)) ** 2).sum(1))


def polar(y: Column, x: Column, cy, cx) -> tuple[Column, Column]:
    """radius and azimuth around (cy, cx)."""
    dy, dx = y - cy, x - cx
    return F.sqrt(dy * dy + dx * dx), F.atan2(dy, dx)
