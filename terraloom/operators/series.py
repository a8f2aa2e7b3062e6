"""Ordered series: moving averages, lookup tables, linear, cubic and monotone interpolation."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import fresh
from . import ranges as ranges_


def moving_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int, name: str = "sma", ranges: int | None = None) -> DataFrame:
    """Over the value and `length` on either side; past the ends the end value counts again, and the divisor is always 2 length + 1."""
    first, last = fresh(df, "first", "last")
    ranges = ranges or ranges_.ranges_for(df)
    if ranges == 1:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        own, block, home = df.withColumns({first: F.first(value).over(whole), last: F.last(value).over(whole)}), list(keys), F.lit(True)
    else:
        ends = df.groupBy(*keys).agg(F.min_by(value, F.struct(*order)).alias(first), F.max_by(value, F.struct(*order)).alias(last))
        own, block, home = ranges_.in_blocks(df, keys, order, length, ranges)
        own = ranges_.meet(own, ends, keys)
    w = Window.partitionBy(*block).orderBy(*order)
    total = F.col(value)
    for j in range(1, length + 1):
        total = total + F.coalesce(F.lag(value, j).over(w), F.col(first)) + F.coalesce(F.lead(value, j).over(w), F.col(last))
    return own.withColumn(name, total / (2 * length + 1)).where(home).select(*[c for c in df.columns if c != name], name)


def recursive_average(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int, name: str = "sma") -> DataFrame:
    """(keys, pos, name): as moving_average, but the values on the left are those already averaged, which makes it sequential.

    The value before the first is the first itself: as it came for the first value, averaged for later ones. A series is
    one task; different series go side by side.
    """
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        v = frame.sort_values(list(order))[value].tolist()
        out: list[float] = []
        n = len(v)
        for i in range(n):
            total = v[i]
            for j in range(1, length + 1):
                total += (out[max(i - j, 0)] if i else v[0]) + v[min(i + j, n - 1)]
            out.append(total / (2 * length + 1))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * n for k in keys}, "pos": range(n), name: out})

    kinds = dict(df.dtypes)
    held = df.select(*keys, *order, F.col(value).cast("double").alias(value))
    return held.groupBy(*keys).applyInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + f"pos int, {name} double")


def lookup(x: Column, breakpoints: Sequence[float], values: Sequence[float], extrapolate: bool = False) -> Column:
    """Linear in a small table; outside the end value, or the end line with extrapolate. One value is a constant; NaN stays."""
    bs, vs = list(map(float, breakpoints)), list(map(float, values))
    if len(bs) == 1:
        return F.lit(vs[0])
    q = x if extrapolate else F.greatest(F.lit(bs[0]), F.least(F.lit(bs[-1]), x))
    out = None
    for i in reversed(range(len(bs) - 1)):
        piece = F.lit(vs[i]) + (q - bs[i]) * F.lit((vs[i + 1] - vs[i]) / (bs[i + 1] - bs[i]))
        out = piece if out is None else F.when(q < bs[i + 1], piece).otherwise(out)
    return F.when(F.isnan(x), x).otherwise(out)


def lookup_2d(x: Column, y: Column, xs: Sequence[float], ys: Sequence[float], values: Sequence[float], extrapolate: bool = False) -> Column:
    """Bilinear in a table whose values lie row by row, y running fastest."""
    n = len(ys)
    rows = [lookup(y, ys, values[i * n : (i + 1) * n], extrapolate) for i in range(len(xs))]
    if len(xs) == 1:
        return rows[0]
    q = x if extrapolate else F.greatest(F.lit(float(xs[0])), F.least(F.lit(float(xs[-1])), x))
    out = None
    for i in reversed(range(len(xs) - 1)):
        piece = rows[i] + (q - float(xs[i])) * (rows[i + 1] - rows[i]) / float(xs[i + 1] - xs[i])
        out = piece if out is None else F.when(q < float(xs[i + 1]), piece).otherwise(out)
    return out


def lookup_index(sizes: Sequence[int], indices: Sequence[Column]) -> Column:
    """The place in row-major values of a table of any number of dimensions."""
    out = F.lit(0)
    for n, i in zip(sizes, indices):
        out = out * n + i
    return out


def pchip_pieces(samples: DataFrame, keys: Sequence[str], x: str, y: str, ranges: int | None = None) -> DataFrame:
    """(keys, x1, x2, c0..c3, is_first, is_last): a monotone cubic for every interval, by lag and lead.

    Inner slopes are weighted harmonic means of the neighbouring secants, or 0 where those change sign; end slopes are
    one-sided and cut so that the curve stays monotone. y = c0 + c1 t + c2 t^2 + c3 t^3 with t = x - x1.
    """
    s = samples.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s, block, home = ranges_.in_blocks(s, keys, ["x"], 4, ranges)
    w = Window.partitionBy(*block).orderBy("x")
    s = s.withColumn("h", F.lead("x").over(w) - F.col("x")).withColumn("d", (F.lead("y").over(w) - F.col("y")) / F.col("h"))
    h0, d0, h1, d1 = F.lag("h").over(w), F.lag("d").over(w), F.col("h"), F.col("d")
    s = s.withColumns({"h0": h0, "d0": d0, "h2": F.lead("h").over(w), "d2": F.lead("d").over(w), "h00": F.lag("h", 2).over(w), "d00": F.lag("d", 2).over(w)})
    h0, d0 = F.col("h0"), F.col("d0")

    def end(ha: Column, da: Column, hb: Column, db: Column) -> Column:
        """At an end, from the nearest secant (a) and the next (b)."""
        m = ((2 * ha + hb) * da - ha * db) / (ha + hb)
        return F.when(db.isNull(), da).when(F.signum(m) != F.signum(da), 0.0).when((F.signum(da) != F.signum(db)) & (F.abs(m) > 3 * F.abs(da)), 3 * da).otherwise(m)

    w1, w2 = 2 * h1 + h0, h1 + 2 * h0
    safe0, safe1 = F.when(d0 == 0, 1.0).otherwise(d0), F.when(d1 == 0, 1.0).otherwise(d1)
    inner = F.when(d0 * d1 <= 0, 0.0).otherwise((w1 + w2) / (w1 / safe0 + w2 / safe1))
    slope = F.when(d0.isNull(), end(h1, d1, F.col("h2"), F.col("d2"))).when(d1.isNull(), end(h0, d0, F.col("h00"), F.col("d00"))).otherwise(inner)
    s = s.withColumn("m", slope)
    s = s.withColumns({"m1": F.lead("m").over(w), "x2": F.lead("x").over(w), "is_first": F.lag("x").over(w).isNull(), "is_last": F.lead("x", 2).over(w).isNull()}).where(home & F.col("h").isNotNull())
    c2 = (3 * F.col("d") - 2 * F.col("m") - F.col("m1")) / F.col("h")
    c3 = (F.col("m") + F.col("m1") - 2 * F.col("d")) / (F.col("h") * F.col("h"))
    return s.select(*keys, F.col("x").alias("x1"), "x2", F.col("y").alias("c0"), F.col("m").alias("c1"), c2.alias("c2"), c3.alias("c3"), "is_first", "is_last")


def linear_pieces(samples: DataFrame, keys: Sequence[str], x: str, y: str, ranges: int | None = None) -> DataFrame:
    """Pieces as of pchip_pieces, of straight lines."""
    s = samples.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    s, block, home = ranges_.in_blocks(s, keys, ["x"], 2, ranges)
    w = Window.partitionBy(*block).orderBy("x")
    s = s.withColumns({"x2": F.lead("x").over(w), "y2": F.lead("y").over(w), "is_first": F.lag("x").over(w).isNull(), "is_last": F.lead("x", 2).over(w).isNull()}).where(home & F.col("x2").isNotNull())
    return s.select(*keys, F.col("x").alias("x1"), "x2", F.col("y").alias("c0"), ((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x"))).alias("c1"), F.lit(0.0).alias("c2"), F.lit(0.0).alias("c3"), "is_first", "is_last")


def three_bands(low: np.ndarray, middle: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The solution of a system with three bands, by elimination from the top; low[0] and high[-1] are not read."""
    n = len(middle)
    up, out = np.zeros(n), np.zeros(n)
    up[0], out[0] = high[0] / middle[0], right[0] / middle[0]
    for i in range(1, n):
        d = middle[i] - low[i] * up[i - 1]
        up[i] = high[i] / d if i < n - 1 else 0.0
        out[i] = (right[i] - low[i] * out[i - 1]) / d
    for i in range(n - 2, -1, -1):
        out[i] -= up[i] * out[i + 1]
    return out


def cubic_pieces(samples: DataFrame, keys: Sequence[str], x: str, y: str, ends: str = "natural", monotonic: bool = False) -> DataFrame:
    """Pieces of a cubic spline with continuous second derivatives; fewer than three samples give lines.

    ends is natural (no curvature) or flat (no slope). With monotonic, slopes are cut where the spline would leave the
    range of its neighbours. A series' equations are solved in one task.
    """
    import pandas as pd

    names = [*keys, "x1", "x2", "c0", "c1", "c2", "c3", "is_first", "is_last"]

    def solve(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("x")
        xs, ys = frame["x"].to_numpy(float), frame["y"].to_numpy(float)
        n = len(xs)
        if n < 2:
            return pd.DataFrame(columns=names)
        h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
        if n == 2:
            m = np.array([d[0], d[0]])
        else:
            low, middle, high, b = (np.zeros(n) for _ in range(4))
            low[1:-1], middle[1:-1], high[1:-1] = h[1:], 2 * (h[:-1] + h[1:]), h[:-1]
            b[1:-1] = 3 * (h[1:] * d[:-1] + h[:-1] * d[1:])
            if ends == "flat":
                middle[0] = middle[-1] = 1
            else:
                middle[0], high[0], b[0] = 2, 1, 3 * d[0]
                low[-1], middle[-1], b[-1] = 1, 2, 3 * d[-1]
            m = three_bands(low, middle, high, b)
            if monotonic:
                for i in range(n):
                    near = [d[j] for j in (i - 1, i) if 0 <= j < n - 1]
                    m[i] = 0.0 if min(near) <= 0 <= max(near) else np.sign(near[0]) * min(abs(m[i]), 3 * min(map(abs, near))) if m[i] * near[0] > 0 else 0.0
        out = pd.DataFrame({"x1": xs[:-1], "x2": xs[1:], "c0": ys[:-1], "c1": m[:-1], "c2": (3 * d - 2 * m[:-1] - m[1:]) / h, "c3": (m[:-1] + m[1:] - 2 * d) / h**2})
        out["is_first"], out["is_last"] = np.arange(n - 1) == 0, np.arange(n - 1) == n - 2
        for k in keys:
            out[k] = frame[k].iloc[0]
        return out[names]

    s = samples.select(*keys, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    kinds = {f.name: f.dataType.simpleString() for f in s.schema}
    head = "".join(f"{k} {kinds[k]}, " for k in keys)
    grouped = s.groupBy(*keys) if keys else s.groupBy(F.lit(1).alias("_k"))
    return grouped.applyInPandas(solve, f"{head}x1 double, x2 double, c0 double, c1 double, c2 double, c3 double, is_first boolean, is_last boolean")


def evaluate(queries: DataFrame, pieces: DataFrame, keys: Sequence[str], xq: str, name: str = "yq", ranges: int | None = None) -> DataFrame:
    """queries with the value of their series at xq; the end pieces go on outside.

    Pieces and queries of a series are put in order and the last piece is carried on. A query before all takes the first
    piece; one of a series without pieces has NULL.
    """
    kinds = "struct<x1:double,c0:double,c1:double,c2:double,c3:double>"
    piece = F.struct("x1", "c0", "c1", "c2", "c3")
    at, side, held = fresh(queries, "at", "side", "piece")
    a = queries.withColumns({at: F.col(xq).cast("double"), side: F.lit(1), held: F.lit(None).cast(kinds)})
    b = pieces.select(*keys, F.when(F.col("is_first"), F.lit(float("-inf"))).otherwise(F.col("x1")).alias(at), F.lit(0).alias(side), piece.cast(kinds).alias(held))
    both = ranges_.carried(a.unionByName(b, allowMissingColumns=True), keys, [at, side], held, ranges).where(F.col(side) == 1)
    p = F.col(held)
    t = F.col(at) - p["x1"]
    return both.withColumn(name, p["c0"] + t * (p["c1"] + t * (p["c2"] + t * p["c3"]))).drop(at, side, held)
