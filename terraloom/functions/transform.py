"""Affine maps as literal coefficients, applied to structs and arrays of points."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shapes import box_ring
from .types import point, point3


@dataclass(frozen=True)
class Affine:
    """Rows of a matrix with the shift in the last column, of two or three dimensions."""

    rows: tuple[tuple[float, ...], ...]

    @property
    def dim(self) -> int:
        return len(self.rows)

    @staticmethod
    def identity(dim: int = 2) -> Affine:
        return Affine(tuple(tuple(1.0 if i == j else 0.0 for j in range(dim + 1)) for i in range(dim)))

    @staticmethod
    def shift(*by: float) -> Affine:
        n = len(by)
        return Affine(tuple(tuple([1.0 if i == j else 0.0 for j in range(n)] + [float(by[i])]) for i in range(n)))

    @staticmethod
    def scale(*by: float) -> Affine:
        n = len(by)
        return Affine(tuple(tuple([float(by[i]) if i == j else 0.0 for j in range(n)] + [0.0]) for i in range(n)))

    @staticmethod
    def rotate(radian: float) -> Affine:
        c, s = math.cos(radian), math.sin(radian)
        return Affine(((c, -s, 0.0), (s, c, 0.0)))

    @staticmethod
    def mirror(axis: str) -> Affine:
        """About the x axis (y changes its sign), the y axis, or both."""
        return Affine.scale(*{"x": (1, -1), "y": (-1, 1), "xy": (-1, -1)}[axis])

    @staticmethod
    def rotate3(axis: tuple[float, float, float], radian: float) -> Affine:
        n = math.sqrt(sum(a * a for a in axis))
        x, y, z = (a / n for a in axis)
        c, s = math.cos(radian), math.sin(radian)
        k = 1 - c
        return Affine(((x * x * k + c, x * y * k - z * s, x * z * k + y * s, 0.0), (y * x * k + z * s, y * y * k + c, y * z * k - x * s, 0.0), (z * x * k - y * s, z * y * k + x * s, z * z * k + c, 0.0)))

    def __matmul__(self, other: Affine) -> Affine:
        """First other, then self."""
        n = self.dim
        return Affine(tuple(tuple(sum(self.rows[i][k] * other.rows[k][j] for k in range(n)) + (self.rows[i][n] if j == n else 0.0) for j in range(n + 1)) for i in range(n)))

    def inverse(self) -> Affine:
        """Raises ValueError where there is none."""
        import numpy as np

        n = self.dim
        full = np.vstack([np.array(self.rows), [0.0] * n + [1.0]])
        try:
            inv = np.linalg.inv(full)
        except np.linalg.LinAlgError as e:
            raise ValueError("the map has no inverse") from e
        return Affine(tuple(map(tuple, inv[:n].tolist())))

    def coefficients(self, row_major: bool = True) -> list[float]:
        return [v for r in (self.rows if row_major else zip(*self.rows)) for v in r]

    def point(self, p: Column) -> Column:
        axes = "xyz"[: self.dim]
        values = [sum((F.lit(r[j]) * p[a] for j, a in enumerate(axes)), F.lit(r[-1])) for r in self.rows]
        return point(*values) if self.dim == 2 else point3(*values)

    def segment(self, s: Column) -> Column:
        return F.struct(self.point(s["s"]).alias("s"), self.point(s["e"]).alias("e"))

    def triangle(self, t: Column) -> Column:
        return F.struct(*[self.point(t[k]).alias(k) for k in ("p0", "p1", "p2")])

    def points(self, ps: Column) -> Column:
        """Of a polyline or ring."""
        return F.transform(ps, self.point)

    def box(self, b: Column) -> Column:
        """A box becomes a ring."""
        return self.points(box_ring(b))

    def polygon(self, p: Column) -> Column:
        return F.struct(self.points(p["outline"]).alias("outline"), F.transform(p["holes"], self.points).alias("holes"))
