"""Exact signs of determinants: a floating-point bound settles most rows in generated code, rational arithmetic the rest."""

from __future__ import annotations

from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .types import fresh

#: Error of the plain determinants relative to the sum of their terms' magnitudes, generously rounded up.
ERROR = {"orient2d": 4e-16, "in_circle": 1.2e-15, "orient3d": 8e-16, "in_sphere": 2e-15}
POINTS = {"orient2d": (3, 2), "in_circle": (4, 2), "orient3d": (4, 3), "in_sphere": (5, 3)}


def _matrix(kind: str, points: list) -> list[list]:
    """Rows of differences to the last point, with their squared length for the circle and the sphere."""
    last = points[-1]
    rows = [[a - b for a, b in zip(p, last)] for p in points[:-1]]
    return [[*r, sum((v * v for v in r[1:]), r[0] * r[0])] for r in rows] if kind in ("in_circle", "in_sphere") else rows


def _det(m: list[list], times):
    """The determinant by the first column; `times` multiplies, so that magnitudes can be had too."""
    if len(m) == 1:
        return m[0][0], m[0][0] if not isinstance(m[0][0], Column) else F.abs(m[0][0])
    total = size = None
    for i, row in enumerate(m):
        minor, minor_size = _det([r[1:] for k, r in enumerate(m) if k != i], times)
        term = row[0] * minor
        magnitude = (F.abs(row[0]) if isinstance(row[0], Column) else abs(row[0])) * minor_size
        total = term if total is None else (total - term if i % 2 else total + term)
        size = magnitude if size is None else size + magnitude
    return total, size


def exact(kind: str, points: list[tuple[float, ...]]) -> int:
    """The sign, exactly. Orientation is positive to the left (below in space); circles and spheres are positive inside."""
    value, _ = _det(_matrix(kind, [tuple(Fraction(v) for v in p) for p in points]), None)
    if kind in ("orient3d", "in_sphere"):
        value = value if kind == "orient3d" else -value
    return (value > 0) - (value < 0)


def determinant(kind: str, points: list[Column]) -> tuple[Column, Column]:
    """The plain determinant and the bound of its error."""
    axes = "xyz"[: POINTS[kind][1]]
    value, size = _det(_matrix(kind, [[p[a] for a in axes] for p in points]), None)
    if kind == "in_sphere":
        value = -value
    return value, size * ERROR[kind] * 4


def sign(df: DataFrame, kind: str, points: list[str], name: str = "sign") -> DataFrame:
    """df with the exact sign of a determinant of point columns.

    Rows beyond the bound never leave the JVM; the others are a branch of their own.
    """
    value, bound = determinant(kind, [F.col(p) for p in points])
    v, e = fresh(df, "v", "e")
    held = df.withColumns({v: value, e: bound})
    sure = held.where(F.abs(v) > F.col(e)).withColumn(name, F.signum(v).cast("int"))
    axes = "xyz"[: POINTS[kind][1]]

    @F.pandas_udf("int")
    def slow(frame: pd.DataFrame) -> pd.Series:
        k = len(axes)
        return pd.Series([exact(kind, [tuple(row[i : i + k]) for i in range(0, len(row), k)]) for row in frame.itertuples(index=False, name=None)])

    flat = F.struct(*[F.col(p)[a].alias(f"c{i}{a}") for i, p in enumerate(points) for a in axes])
    rest = held.where(~(F.abs(v) > F.col(e))).withColumn(name, slow(flat))
    return sure.unionByName(rest).drop(v, e)
