"""Aggregations: envelopes, moments, histograms, polynomial fits, hashes, duplicates by tolerance and topology."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.types import box, fresh, num, point
from .ranges import numbered


def extent_agg(b: Column) -> Column:
    """The envelope of boxes as an aggregate; NULL without any."""
    return F.when(F.count(b) > 0, box(F.min(b["xmin"]), F.min(b["ymin"]), F.max(b["xmax"]), F.max(b["ymax"])))


def point_extent(x, y) -> Column:
    x, y = num(x), num(y)
    return F.when(F.count(x) > 0, box(F.min(x), F.min(y), F.max(x), F.max(y)))


def mean(v) -> Column:
    return F.avg(num(v))


def mean_and_variance(v) -> Column:
    """Unbiased; a single value has the variance 0, none has NULL."""
    v = num(v)
    variance = F.when(F.count(v) > 0, F.when(F.count(v) == 1, 0.0).otherwise(F.var_samp(v)))
    return F.struct(F.avg(v).alias("mean"), variance.alias("variance"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, bin, n) with equal bins; values below the first or above the last count in them."""
    k = F.floor((value - low) / (high - low) * bins)
    return df.where(value.isNotNull()).groupBy(*keys, F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def poly_fit(df: DataFrame, x: Column, y: Column, degree: int, weight: Column | None = None) -> list[float]:
    """Least squares, ascending powers. Weights multiply both sides, so a row counts by its weight squared.

    The sums are an aggregate of fixed size; only the small system of equations is solved here. Empty input gives [].
    """
    w2 = F.lit(1.0) if weight is None else weight * weight
    powers = [F.sum(w2 * F.pow(x, F.lit(float(k)))).alias(f"s{k}") for k in range(2 * degree + 1)]
    rights = [F.sum(w2 * F.pow(x, F.lit(float(k))) * y).alias(f"t{k}") for k in range(degree + 1)]
    row = df.where(x.isNotNull() & y.isNotNull()).agg(*powers, *rights).first()
    if row["s0"] is None:
        return []
    a = np.array([[row[f"s{i + j}"] for j in range(degree + 1)] for i in range(degree + 1)])
    b = np.array([row[f"t{i}"] for i in range(degree + 1)])
    return np.linalg.lstsq(a, b, rcond=None)[0].tolist()


def poly_fit_columns(x: Column, y: Column, degree: int) -> Column:
    """The coefficients of degree 1 or 2 as an aggregate, by Cramer's rule, for fits of many groups; NULL where undetermined."""
    s = [F.sum(F.pow(x, F.lit(float(k)))) for k in range(2 * degree + 1)]
    t = [F.sum(F.pow(x, F.lit(float(k))) * y) for k in range(degree + 1)]
    if degree == 1:
        det = s[0] * s[2] - s[1] * s[1]
        return F.when(det != 0, F.array((t[0] * s[2] - t[1] * s[1]) / det, (s[0] * t[1] - s[1] * t[0]) / det))
    m = [[s[i + j] for j in range(3)] for i in range(3)]

    def det3(q: list[list[Column]]) -> Column:
        return q[0][0] * (q[1][1] * q[2][2] - q[1][2] * q[2][1]) - q[0][1] * (q[1][0] * q[2][2] - q[1][2] * q[2][0]) + q[0][2] * (q[1][0] * q[2][1] - q[1][1] * q[2][0])

    d = det3(m)
    return F.when(d != 0, F.array(*[det3([[t[i] if j == k else m[i][j] for j in range(3)] for i in range(3)]) / d for k in range(3)]))


def unordered_hash(v: Column) -> Column:
    """XOR of hashes as an aggregate: partly done before the shuffle, and equal pairs cancel."""
    return F.bit_xor(F.xxhash64(v))


def ordered_hash(df: DataFrame, keys: Sequence[str], order: str, value: Column, ranges: int | None = None) -> DataFrame:
    """(keys, hash): of the group's values in order, each hashed with its place; the XOR of these is taken partly before the
    shuffle, and places are numbered range by range, so that a group may be of any length. Nulls count as values."""
    (place,) = fresh(df, "place")
    at = numbered(df, keys, [order], place, ranges)
    return at.groupBy(*keys).agg(F.bit_xor(F.xxhash64(F.col(place).cast("long"), value)).alias("hash"))


def find_duplicates(points: DataFrame, tol: float) -> DataFrame:
    """(id, keep): points (id, p) in the same square of side tol share the smallest id."""
    cell = points.select("id", F.floor(F.col("p.x") / tol).alias("cx"), F.floor(F.col("p.y") / tol).alias("cy"))
    first = cell.groupBy("cx", "cy").agg(F.min("id").alias("keep"))
    return cell.join(first, ["cx", "cy"]).select("id", "keep")


def remove_duplicates(points: DataFrame, tol: float) -> DataFrame:
    return points.join(find_duplicates(points, tol).where("id = keep").select("id"), "id", "left_semi")


def remap_edges(edges: DataFrame, mapping: DataFrame, distinct: bool = False) -> DataFrame:
    """Edges (src, dst) by a mapping (id, keep); loops go, parallel edges stay unless distinct."""
    s, d = mapping.select(F.col("id").alias("src"), F.col("keep").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("keep").alias("d"))
    out = edges.join(s, "src").join(d, "dst").where("s <> d").select(F.least("s", "d").alias("src"), F.greatest("s", "d").alias("dst"))
    return out.distinct() if distinct else out


def extract_topology(segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points (pid, p) and distinct undirected edges (src, dst) of segments (id, seg).

    A point's id is a hash of its coordinates, so nothing needs a global order.
    """
    key = lambda p: F.xxhash64(p["x"] + 0.0, p["y"] + 0.0)  # noqa: E731  0.0 makes a negative zero a zero
    ends = segments.select(F.explode(F.array("seg.s", "seg.e")).alias("p")).select(key(F.col("p")).alias("pid"), "p").groupBy("pid").agg(F.first("p").alias("p"))
    pairs = segments.select(key(F.col("seg.s")).alias("a"), key(F.col("seg.e")).alias("b")).where("a <> b")
    return ends, pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct()


def edge_set(edges: DataFrame) -> DataFrame:
    return edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def triangle_report(triangles: DataFrame, bins: int = 10) -> DataFrame:
    """One row: nodes, elements, least and largest angle and edge, and both histograms as shares; from (tid, tri).

    angle_shares are of the triangles' smallest angles from 0 to 60 degrees, edge_shares of the lengths of the mesh's edges,
    each counted once, from the least to the largest. Without triangles there is one row of NULLs and zeros.
    """
    import math

    from ..functions.vectors import interior_angles

    t = triangles.select(interior_angles(F.col("tri.p0"), F.col("tri.p1"), F.col("tri.p2")).alias("angles"), shapes.triangle_edges(F.col("tri")).alias("lengths"), F.array("tri.p0", "tri.p1", "tri.p2").alias("ps"))
    nodes = t.select(F.explode("ps").alias("p")).select("p.x", "p.y").distinct().agg(F.count(F.lit(1)).alias("nodes"))

    def counts(bin_: Column) -> list[Column]:
        at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.floor(bin_)))
        return [F.count(F.when(at == k, 1)) for k in range(bins)]

    def shares(found: list[Column]) -> Column:
        total = F.lit(0)
        for n in found:
            total = total + n
        return F.when(total > 0, F.array(*[n / total for n in found]))

    least = F.array_min("angles")
    sums = t.agg(
        F.count(F.lit(1)).alias("elements"), F.min(least).alias("min_angle"), F.max(F.array_max("angles")).alias("max_angle"),
        F.min(F.array_min("lengths")).alias("min_edge"), F.max(F.array_max("lengths")).alias("max_edge"), shares(counts(least / (math.pi / 3) * bins)).alias("angle_shares"),
    )
    bounds = sums.select("min_edge", "max_edge")
    edges = mesh_edges(triangles).crossJoin(F.broadcast(bounds))  # one row
    wide = F.when(F.col("max_edge") > F.col("min_edge"), F.col("max_edge") - F.col("min_edge")).otherwise(1.0)
    lengths = edges.agg(shares(counts((F.col("length") - F.col("min_edge")) / wide * bins)).alias("edge_shares"))
    return sums.crossJoin(nodes).crossJoin(lengths)  # one row each


def minimum_angle_histogram(triangles: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n) of the smallest angle of each triangle, over 0 to 60 degrees."""
    import math

    from ..functions.vectors import interior_angles

    least = F.array_min(interior_angles(F.col("tri.p0"), F.col("tri.p1"), F.col("tri.p2")))
    return histogram(triangles, least, 0.0, math.pi / 3, bins)


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """(ax, ay, bx, by, length): each edge of triangles (tid, tri) once."""
    t = F.col("tri")
    pairs = F.array(*[F.struct(t[a].alias("a"), t[b].alias("b")) for a, b in (("p0", "p1"), ("p1", "p2"), ("p2", "p0"))])
    e = triangles.select(F.explode(pairs).alias("e")).select(F.least("e.a", "e.b").alias("a"), F.greatest("e.a", "e.b").alias("b")).distinct()
    return e.select(F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), F.col("b.x").alias("bx"), F.col("b.y").alias("by"), F.hypot(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")).alias("length"))


def edge_length_histogram(triangles: DataFrame, bins: int = 10) -> DataFrame:
    e = mesh_edges(triangles)
    low, high = e.agg(F.min("length"), F.max("length")).first()
    if low is None:
        return triangles.sparkSession.createDataFrame([], "bin int, n long")
    return histogram(e, F.col("length"), low, max(high, low + 1e-300) if high > low else low + 1.0, bins)


def centroid(x, y) -> Column:
    return point(F.avg(num(x)), F.avg(num(y)))


def stamp(devices: DataFrame) -> DataFrame:
    """(i, j, v): the matrix of conductances of devices (i, j, g); node 0 is the ground and has no row.

    A device adds g to both of its diagonal entries and takes it off the two between its nodes.
    """
    g = F.col("g")
    entries = F.array(*[F.struct(a.alias("i"), b.alias("j"), v.alias("v")) for a, b, v in ((F.col("i"), F.col("i"), g), (F.col("j"), F.col("j"), g), (F.col("i"), F.col("j"), -g), (F.col("j"), F.col("i"), -g))])
    return devices.select(F.explode(entries).alias("e")).select("e.*").where("i <> 0 and j <> 0").groupBy("i", "j").agg(F.sum("v").alias("v"))


def median_split(v: str) -> Column:
    """The value in the middle of the sorted ones (the lower of two) as an aggregate of counts by value, partly done before the
    shuffle. NULLs are left out."""
    return F.expr(f"percentile_disc(0.5) within group (order by cast(`{v}` as double))")


def split_plane(columns: dict[str, Column], by: str = "range") -> Column:
    """The name of the widest dimension, by range or by variance, as an aggregate; the first of equal ones."""
    spread = [(F.max(c) - F.min(c) if by == "range" else F.var_pop(c)) for c in columns.values()]
    order = F.array(*[F.struct(s.alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n")) for i, (n, s) in enumerate(zip(columns, spread))])
    return F.array_max(order)["n"]


def boxes_and_centers(objects: DataFrame, box_col: str = "box") -> tuple[DataFrame, DataFrame]:
    """objects with the middle of their boxes, and one row with the envelope of all."""
    b = F.col(box_col)
    return objects.withColumn("center", shapes.box_center(b)), objects.agg(extent_agg(b).alias("extent"))
