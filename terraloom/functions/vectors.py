"""Vector arithmetic, distances, angles, lines, planes and circles as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import circle, col, let, num, point, point3

EPS = 2.0**-52


def _axes(dim: int) -> str:
    return "xyz"[:dim]


def _make(parts: list[Column]) -> Column:
    return point(*parts) if len(parts) == 2 else point3(*parts)


def add(a: Column, b: Column, dim: int = 2) -> Column:
    return _make([a[c] + b[c] for c in _axes(dim)])


def sub(a: Column, b: Column, dim: int = 2) -> Column:
    return _make([a[c] - b[c] for c in _axes(dim)])


def mul(a: Column, b, dim: int = 2) -> Column:
    """By a number, or by a vector component-wise."""
    return _make([a[c] * (b[c] if isinstance(b, Column) else F.lit(float(b))) for c in _axes(dim)])


def scaled(a: Column, k, dim: int = 2) -> Column:
    return _make([a[c] * num(k) for c in _axes(dim)])


def div(a: Column, k, dim: int = 2) -> Column:
    return _make([a[c] / num(k) for c in _axes(dim)])


def neg(a: Column, dim: int = 2) -> Column:
    return _make([-a[c] for c in _axes(dim)])


def dot(a: Column, b: Column, dim: int = 2) -> Column:
    out = a["x"] * b["x"] + a["y"] * b["y"]
    return out if dim == 2 else out + a["z"] * b["z"]


def norm_sq(a: Column, dim: int = 2) -> Column:
    return dot(a, a, dim)


def norm(a: Column, dim: int = 2) -> Column:
    return F.sqrt(norm_sq(a, dim))


def cross(a: Column, b: Column) -> Column:
    return a["x"] * b["y"] - a["y"] * b["x"]


def cross3(a: Column, b: Column) -> Column:
    return point3(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def normalize(a: Column, dim: int = 2) -> Column:
    """The unit vector; a vector of no length stays as it is."""
    n = norm(a, dim)
    return F.when(n > EPS, div(a, n, dim)).otherwise(a)


def safe_inv(v) -> Column:
    """1/v, where zero gives +-1/eps by its sign; a negative zero counts as negative."""
    v = num(v)
    sign = F.when(F.startswith(v.cast("string"), F.lit("-")), -1.0).otherwise(1.0)
    return F.when(F.abs(v) < EPS, sign / EPS).otherwise(1.0 / F.when(F.abs(v) < EPS, 1.0).otherwise(v))


def inverse(a: Column, dim: int = 2, safe: bool = False) -> Column:
    return _make([safe_inv(a[c]) if safe else 1.0 / a[c] for c in _axes(dim)])


def distance_sq(a: Column, b: Column, dim: int = 2) -> Column:
    return norm_sq(sub(a, b, dim), dim)


def distance(a: Column, b: Column, dim: int = 2) -> Column:
    return F.sqrt(distance_sq(a, b, dim))


def round_half_away(v, digits: int = 0) -> Column:
    return F.round(num(v), digits)


def cast_point(a: Column, kind: str = "bigint", dim: int = 2) -> Column:
    """Integer coordinates, rounded half away from zero."""
    return F.struct(*[F.round(a[c]).cast(kind).alias(c) for c in _axes(dim)])


def array_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def array_distance_sq(a: Column, b: Column) -> Column:
    """Squared distance of arrays of numbers; NULL where lengths differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def angle(v: Column) -> Column:
    """Of a vector, in [0, 2 pi)."""
    a = F.atan2(v["y"], v["x"])
    return F.when(a < 0, a + 2 * math.pi).otherwise(a)


def angle_between(a: Column, b: Column) -> Column:
    """From a to b, in [0, 2 pi)."""
    d = angle(b) - angle(a)
    return F.when(d < 0, d + 2 * math.pi).otherwise(d)


def angle_at(s: Column, p: Column, e: Column) -> Column:
    return angle_between(sub(s, p), sub(e, p))


def inner_angle(a: Column, b: Column, dim: int = 2) -> Column:
    """In [0, pi]; 0 where a vector has no length."""
    n = norm(a, dim) * norm(b, dim)
    c = dot(a, b, dim) / F.when(n == 0, 1.0).otherwise(n)
    return F.when(n == 0, 0.0).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c))))


def interior_angles(p1: Column, p2: Column, p3: Column) -> Column:
    return F.array(inner_angle(sub(p2, p1), sub(p3, p1)), inner_angle(sub(p1, p2), sub(p3, p2)), inner_angle(sub(p1, p3), sub(p2, p3)))


def closest_on_segment(p: Column, s: Column, e: Column) -> Column:
    d = sub(e, s)
    n = norm_sq(d)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, s), d) / F.when(n == 0, 1.0).otherwise(n)))
    return point(s["x"] + t * d["x"], s["y"] + t * d["y"])


def closest_on_plane(p: Column, plane: Column) -> Column:
    def foot(m: Column) -> Column:
        p, plane, k = m["p"], m["plane"], plane_distance(m["p"], m["plane"])
        return point3(p["x"] - k * plane["nx"], p["y"] - k * plane["ny"], p["z"] - k * plane["nz"])

    return let(F.struct(p.alias("p"), plane.alias("plane")), foot)


def closest_in_box(p: Column, b: Column) -> Column:
    return point(F.least(F.greatest(p["x"], b["xmin"]), b["xmax"]), F.least(F.greatest(p["y"], b["ymin"]), b["ymax"]))


def point_segment_distance_sq(p: Column, s: Column, e: Column) -> Column:
    return distance_sq(p, closest_on_segment(p, s, e))


def point_line_distance_sq(p: Column, a: Column, b: Column) -> Column:
    d = sub(b, a)
    c = cross(d, sub(p, a))
    n = norm_sq(d)
    return F.when(n == 0, distance_sq(p, a)).otherwise(c * c / F.when(n == 0, 1.0).otherwise(n))


def point_box_distance_sq(p: Column, b: Column) -> Column:
    return distance_sq(p, closest_in_box(p, b))


def segment_distance(p: Column, q: Column, dim: int = 2) -> Column:
    """Least distance of two segments, 0 where they meet; parallel and degenerate ones too."""
    z = F.lit(0.0)

    def lift(v: Column) -> Column:
        return point3(v["x"], v["y"], v["z"] if dim == 3 else z)

    def to_segment(x: Column, lo: Column, direction: Column, size: Column) -> Column:
        """Squared distance of x from lo + k direction, k in 0 .. 1."""
        k = F.greatest(z, F.least(F.lit(1.0), dot(sub(x, lo, 3), direction, 3) / F.when(size == 0, 1.0).otherwise(size)))
        return let(k, lambda k: norm_sq(sub(x, add(lo, scaled(direction, k, 3), 3), 3), 3))

    def least(m: Column) -> Column:
        s, t, u, v = m["s"], m["t"], m["u"], m["v"]
        ends = F.least(to_segment(m["a"], m["c"], v, m["vv"]), to_segment(m["b"], m["c"], v, m["vv"]), to_segment(m["c"], m["a"], u, m["uu"]), to_segment(m["d"], m["a"], u, m["uu"]))
        inside = (m["det"] > 0) & s.between(0, 1) & t.between(0, 1)
        across = norm_sq(add(m["w"], sub(scaled(u, s, 3), scaled(v, t, 3), 3), 3), 3)
        return F.sqrt(F.when(inside, F.least(ends, across)).otherwise(ends))

    def parameters(m: Column) -> Column:
        det = m["uu"] * m["vv"] - m["uv"] * m["uv"]
        safe = F.when(det > 0, det).otherwise(1.0)
        s, t = (m["uv"] * m["vw"] - m["vv"] * m["uw"]) / safe, (m["uu"] * m["vw"] - m["uv"] * m["uw"]) / safe
        kept = [m[k].alias(k) for k in ("a", "b", "c", "d", "u", "v", "w", "uu", "vv")]
        return let(F.struct(*kept, det.alias("det"), s.alias("s"), t.alias("t")), least)

    def products(m: Column) -> Column:
        u, v, w = m["u"], m["v"], m["w"]
        pairs = {"uu": (u, u), "uv": (u, v), "vv": (v, v), "uw": (u, w), "vw": (v, w)}
        kept = [m[k].alias(k) for k in ("a", "b", "c", "d", "u", "v", "w")]
        return let(F.struct(*kept, *[dot(x, y, 3).alias(k) for k, (x, y) in pairs.items()]), parameters)

    def differences(m: Column) -> Column:
        kept = [m[k].alias(k) for k in ("a", "b", "c", "d")]
        return let(F.struct(*kept, sub(m["b"], m["a"], 3).alias("u"), sub(m["d"], m["c"], 3).alias("v"), sub(m["a"], m["c"], 3).alias("w")), products)

    return let(F.struct(lift(p["s"]).alias("a"), lift(p["e"]).alias("b"), lift(q["s"]).alias("c"), lift(q["e"]).alias("d")), differences)


def line_by_points(a: Column, b: Column) -> Column:
    """a x + b y + c = 0 with a^2 + b^2 = 1."""
    return line_normalized(F.struct((b["y"] - a["y"]).alias("a"), (a["x"] - b["x"]).alias("b"), (b["x"] * a["y"] - a["x"] * b["y"]).alias("c")))


def line_by_normal(p: Column, n: Column) -> Column:
    return line_normalized(F.struct(n["x"].alias("a"), n["y"].alias("b"), (-(n["x"] * p["x"] + n["y"] * p["y"])).alias("c")))


def line_normalized(line: Column) -> Column:
    n = F.sqrt(line["a"] * line["a"] + line["b"] * line["b"])
    k = F.when(n == 0, 1.0).otherwise(n)
    return F.struct((line["a"] / k).alias("a"), (line["b"] / k).alias("b"), (line["c"] / k).alias("c"))


def line_side(line: Column, p: Column) -> Column:
    return line["a"] * p["x"] + line["b"] * p["y"] + line["c"]


def line_distance(line: Column, p: Column) -> Column:
    return F.abs(line_side(line, p))


def line_intersection(m: Column, n: Column) -> Column:
    """The common point of two lines; NULL where they are parallel."""
    det = m["a"] * n["b"] - n["a"] * m["b"]
    safe = F.when(det == 0, 1.0).otherwise(det)
    return F.when(det != 0, point((m["b"] * n["c"] - n["b"] * m["c"]) / safe, (n["a"] * m["c"] - m["a"] * n["c"]) / safe))


def plane_by_normal(normal: Column, p: Column) -> Column:
    unit = let(normal, lambda n: normalize(n, 3))
    return let(unit, lambda n: F.struct(n["x"].alias("nx"), n["y"].alias("ny"), n["z"].alias("nz"), dot(n, p, 3).alias("d")))


def plane_by_points(p1: Column, p2: Column, p3: Column) -> Column:
    return plane_by_normal(cross3(sub(p2, p1, 3), sub(p3, p1, 3)), p1)


def plane_distance(p: Column, plane: Column) -> Column:
    """Signed; positive on the normal's side."""
    return plane["nx"] * p["x"] + plane["ny"] * p["y"] + plane["nz"] * p["z"] - plane["d"]


def diametral_circle(a: Column, b: Column) -> Column:
    return circle(point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2), distance(a, b) / 2)


def circumcircle(p1: Column, p2: Column, p3: Column) -> Column:
    """Through three points; where they are in line the divisor is taken as eps, so that the result is finite."""
    ax, ay, bx, by = p2["x"] - p1["x"], p2["y"] - p1["y"], p3["x"] - p1["x"], p3["y"] - p1["y"]
    det = 2 * (ax * by - ay * bx)
    safe = F.when(F.abs(det) < EPS, F.when(det < 0, -EPS).otherwise(EPS)).otherwise(det)
    a2, b2 = ax * ax + ay * ay, bx * bx + by * by
    ux, uy = (by * a2 - ay * b2) / safe, (ax * b2 - bx * a2) / safe
    return circle(point(p1["x"] + ux, p1["y"] + uy), F.sqrt(ux * ux + uy * uy))


def circle_contains(c: Column, p: Column) -> Column:
    return distance_sq(c["o"], p) <= c["r"] * c["r"]


def radius_edge_ratio_sq(p1: Column, p2: Column, p3: Column) -> Column:
    """Squared circumradius over the squared shortest edge; a measure of a triangle's quality."""
    short = F.least(distance_sq(p1, p2), distance_sq(p2, p3), distance_sq(p3, p1))
    r = circumcircle(p1, p2, p3)["r"]
    return r * r / F.when(short == 0, EPS).otherwise(short)


def radius_edge_ratio(p1: Column, p2: Column, p3: Column) -> Column:
    return F.sqrt(radius_edge_ratio_sq(p1, p2, p3))


def inscribed_circle(s: Column, p: Column, e: Column, r) -> Column:
    """The circle of radius r that touches both sides of the corner s-p-e: centre o and its feet fs and fe on the sides."""

    def touching(m: Column) -> Column:
        p, us, ue = m["p"], m["us"], m["ue"]
        half = inner_angle(us, ue) / 2
        foot, reach = m["r"] / F.tan(half), m["r"] / F.sin(half)
        return F.struct(let(normalize(add(us, ue)), lambda middle: add(p, scaled(middle, reach))).alias("o"), add(p, scaled(us, foot)).alias("fs"), add(p, scaled(ue, foot)).alias("fe"))

    return let(F.struct(p.alias("p"), normalize(sub(s, p)).alias("us"), normalize(sub(e, p)).alias("ue"), num(r).alias("r")), touching)


def _around(o: Column, rx, ry, div: int, start=0.0, sweep=2 * math.pi, closed: bool = False) -> Column:
    last = div if closed else div - 1
    return F.transform(F.sequence(F.lit(0), F.lit(last)), lambda i: point(o["x"] + num(rx) * F.cos(num(start) + i * num(sweep) / div), o["y"] + num(ry) * F.sin(num(start) + i * num(sweep) / div)))


def inscribed_polygon(c: Column, div: int) -> Column:
    return _around(c["o"], c["r"], c["r"], div)


def circumscribed_polygon(c: Column, div: int) -> Column:
    r = c["r"] / math.cos(math.pi / div)
    return _around(c["o"], r, r, div)


def ellipse_polygon(e: Column, div: int) -> Column:
    return _around(e["o"], e["a"], e["b"], div)


def arc(origin: Column, start: Column, radian) -> Column:
    return F.struct(origin.alias("o"), start.alias("s"), num(radian).alias("radian"))


def arc_end(a: Column) -> Column:
    d = sub(a["s"], a["o"])
    c, s = F.cos(a["radian"]), F.sin(a["radian"])
    return point(a["o"]["x"] + d["x"] * c - d["y"] * s, a["o"]["y"] + d["x"] * s + d["y"] * c)


def arc_start_angle(a: Column) -> Column:
    return F.struct(angle(sub(a["s"], a["o"])).alias("alpha"), distance(a["o"], a["s"]).alias("mag"))


def arc_polyline(a: Column, div: int) -> Column:
    return let(F.struct(a.alias("a"), arc_start_angle(a).alias("first")), lambda m: _around(m["a"]["o"], m["first"]["mag"], m["first"]["mag"], div, m["first"]["alpha"], m["a"]["radian"], closed=True))


def arc_by_three_points(s: Column, m: Column, e: Column) -> Column:
    """The arc from s over m to e; positive radians turn left."""

    def turned(v: Column) -> Column:
        left = cross(sub(v["m"], v["s"]), sub(v["e"], v["s"])) < 0
        return arc(v["o"], v["s"], F.when(left, v["turn"] - 2 * math.pi).otherwise(v["turn"]))

    def around(v: Column) -> Column:
        return F.struct(*[v[c].alias(c) for c in ("s", "m", "e", "o")], angle_between(sub(v["s"], v["o"]), sub(v["e"], v["o"])).alias("turn"))

    points = F.struct(s.alias("s"), m.alias("m"), e.alias("e"))
    found = let(points, lambda v: F.struct(*[v[c].alias(c) for c in ("s", "m", "e")], circumcircle(v["s"], v["m"], v["e"])["o"].alias("o")))
    return let(let(found, around), turned)


# Quaternions: struct<w,x,y,z>.


def quaternion(w, x, y, z) -> Column:
    return F.struct(num(w).alias("w"), num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))


def quat_by_axis(axis: Column, radian) -> Column:
    s, c = F.sin(num(radian) / 2), F.cos(num(radian) / 2)
    return let(normalize(axis, 3), lambda u: quaternion(c, u["x"] * s, u["y"] * s, u["z"] * s))


def quat_mul(p: Column, q: Column) -> Column:
    def product(v: Column) -> Column:
        p, q = v["p"], v["q"]
        return quaternion(
            p["w"] * q["w"] - p["x"] * q["x"] - p["y"] * q["y"] - p["z"] * q["z"],
            p["w"] * q["x"] + p["x"] * q["w"] + p["y"] * q["z"] - p["z"] * q["y"],
            p["w"] * q["y"] - p["x"] * q["z"] + p["y"] * q["w"] + p["z"] * q["x"],
            p["w"] * q["z"] + p["x"] * q["y"] - p["y"] * q["x"] + p["z"] * q["w"],
        )

    return let(F.struct(p.alias("p"), q.alias("q")), product)


def quat_dot(p: Column, q: Column) -> Column:
    return p["w"] * q["w"] + p["x"] * q["x"] + p["y"] * q["y"] + p["z"] * q["z"]


def quat_scale(q: Column, k) -> Column:
    return quaternion(*[q[c] * num(k) for c in "wxyz"])


def quat_add(p: Column, q: Column) -> Column:
    return quaternion(*[p[c] + q[c] for c in "wxyz"])


def quat_conjugate(q: Column) -> Column:
    return quaternion(q["w"], -q["x"], -q["y"], -q["z"])


def quat_inverse(q: Column) -> Column:
    return let(q, lambda v: quat_scale(quat_conjugate(v), 1.0 / quat_dot(v, v)))


def quat_normalize(q: Column) -> Column:
    """A quaternion of no length stays as it is."""

    def unit(v: Column) -> Column:
        n = F.sqrt(quat_dot(v, v))
        return quat_scale(v, 1.0 / F.when(n == 0, 1.0).otherwise(n))

    return let(q, unit)


def quat_angle(q: Column) -> Column:
    return 2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q["w"])))


def quat_axis(q: Column) -> Column:
    return normalize(point3(q["x"], q["y"], q["z"]), 3)


def quat_rotate(q: Column, v: Column) -> Column:
    def turned(s: Column) -> Column:
        return let(quat_mul(quat_mul(s["q"], quaternion(0.0, s["v"]["x"], s["v"]["y"], s["v"]["z"])), quat_inverse(s["q"])), lambda r: point3(r["x"], r["y"], r["z"]))

    return let(F.struct(q.alias("q"), v.alias("v")), turned)


def quat_inverse_rotate(q: Column, v: Column) -> Column:
    return quat_rotate(quat_inverse(q), v)


def quat_log(q: Column) -> Column:
    """Of a unit quaternion."""
    return let(q, _quat_log)


def _quat_log(q: Column) -> Column:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    k = F.when(n == 0, 0.0).otherwise(F.atan2(n, q["w"]) / F.when(n == 0, 1.0).otherwise(n))
    return quaternion(0.0, q["x"] * k, q["y"] * k, q["z"] * k)


def quat_exp(q: Column) -> Column:
    return let(q, _quat_exp)


def _quat_exp(q: Column) -> Column:
    n = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"])
    k = F.when(n == 0, 1.0).otherwise(F.sin(n) / F.when(n == 0, 1.0).otherwise(n))
    return quaternion(F.cos(n), q["x"] * k, q["y"] * k, q["z"] * k)


def slerp(p: Column, q: Column, t) -> Column:
    """On the shorter way; linear where the two are nearly equal."""
    return let(F.struct(p.alias("p"), q.alias("q"), num(t).alias("t")), lambda s: _slerp(s["p"], s["q"], s["t"]))


def _slerp(p: Column, q: Column, t: Column) -> Column:
    c = quat_dot(p, q)
    near = F.when(c < 0, -1.0).otherwise(1.0)
    w = F.acos(F.least(F.lit(1.0), F.abs(c)))
    s = F.sin(w)
    flat = s < 1e-9
    safe = F.when(flat, 1.0).otherwise(s)
    return quat_add(quat_scale(p, F.when(flat, 1 - t).otherwise(F.sin((1 - t) * w) / safe)), quat_scale(q, near * F.when(flat, t).otherwise(F.sin(t * w) / safe)))


def squad_tangent(before: Column, center: Column, after: Column) -> Column:
    back = quat_log(quat_mul(quat_inverse(center), before))
    ahead = quat_log(quat_mul(quat_inverse(center), after))
    return quat_mul(center, quat_exp(quat_scale(quat_add(back, ahead), -0.25)))


def squad(a: Column, a_tangent: Column, b: Column, b_tangent: Column, t) -> Column:
    return slerp(slerp(a, b, t), slerp(a_tangent, b_tangent, t), 2 * num(t) * (1 - num(t)))


def vector_of(value) -> Column:
    return col(value)
