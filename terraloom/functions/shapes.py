"""Boxes, triangles, rings and polygons with holes: measures, constructors and predicates as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import RING, box, box3, col, let, num, point, point3, polygon, ring
from .vectors import cross, distance, sub

# Boxes.


def box_center(b: Column, dim: int = 2) -> Column:
    x, y = (b["xmin"] + b["xmax"]) / 2, (b["ymin"] + b["ymax"]) / 2
    return point(x, y) if dim == 2 else point3(x, y, (b["zmin"] + b["zmax"]) / 2)


def box_length(b: Column) -> Column:
    return b["xmax"] - b["xmin"]


def box_width(b: Column) -> Column:
    return b["ymax"] - b["ymin"]


def box_height(b: Column) -> Column:
    return b["zmax"] - b["zmin"]


def box_area(b: Column) -> Column:
    return box_length(b) * box_width(b)


def box_diagonal(b: Column) -> Column:
    return point3(box_length(b), box_width(b), box_height(b))


def box_half_area(b: Column) -> Column:
    l, w, h = box_length(b), box_width(b), box_height(b)
    return l * w + w * h + h * l


def box_surface(b: Column) -> Column:
    return 2 * box_half_area(b)


def box_volume(b: Column) -> Column:
    return box_length(b) * box_width(b) * box_height(b)


def box_largest_axis(b: Column) -> Column:
    """0, 1 or 2; the first of equal ones."""
    l, w, h = box_length(b), box_width(b), box_height(b)
    return F.when((l >= w) & (l >= h), 0).when(w >= h, 1).otherwise(2)


def _sides(dim: int) -> list[tuple[str, str]]:
    return [(f"{a}min", f"{a}max") for a in "xyz"[:dim]]


def _box(values: dict[str, Column], dim: int) -> Column:
    names = [lo for lo, _ in _sides(dim)] + [hi for _, hi in _sides(dim)]
    return (box if dim == 2 else box3)(*[values[n] for n in names])


def box_valid(b: Column, dim: int = 2) -> Column:
    return reduce(lambda p, q: p & q, [b[lo] <= b[hi] for lo, hi in _sides(dim)])


def box_normalize(b: Column, dim: int = 2) -> Column:
    return _box({n: f(b[lo], b[hi]) for lo, hi in _sides(dim) for n, f in ((lo, F.least), (hi, F.greatest))}, dim)


def box_times(b: Column, k, dim: int = 2) -> Column:
    """All coordinates times k."""
    return _box({n: b[n] * num(k) for s in _sides(dim) for n in s}, dim)


def box_shift(b: Column, v: Column, dim: int = 2) -> Column:
    return _box({n: b[n] + v[n[0]] for s in _sides(dim) for n in s}, dim)


def box_scale(b: Column, k) -> Column:
    """About the centre."""
    c, l, w = box_center(b), box_length(b) * num(k) / 2, box_width(b) * num(k) / 2
    return box(c["x"] - l, c["y"] - w, c["x"] + l, c["y"] + w)


def box_union(a: Column, b: Column, dim: int = 2) -> Column:
    return _box({n: f(a[n], b[n]) for lo, hi in _sides(dim) for n, f in ((lo, F.least), (hi, F.greatest))}, dim)


def box_add_point(b: Column, p: Column, dim: int = 2) -> Column:
    return _box({n: f(b[n], p[n[0]]) for lo, hi in _sides(dim) for n, f in ((lo, F.least), (hi, F.greatest))}, dim)


def box_intersection(a: Column, b: Column, dim: int = 2) -> Column:
    """NULL where the boxes don't meet."""
    out = _box({n: f(a[n], b[n]) for lo, hi in _sides(dim) for n, f in ((lo, F.greatest), (hi, F.least))}, dim)
    return F.when(box_collides(a, b, True, dim), out)


def box_contains(a: Column, b: Column, touch: bool = True, dim: int = 2) -> Column:
    """Whether b is in a; strictly so without touch."""
    parts = [(a[lo] <= b[lo]) & (b[hi] <= a[hi]) if touch else (a[lo] < b[lo]) & (b[hi] < a[hi]) for lo, hi in _sides(dim)]
    return reduce(lambda p, q: p & q, parts)


def box_contains_point(b: Column, p: Column, touch: bool = True, dim: int = 2) -> Column:
    parts = [(b[lo] <= p[lo[0]]) & (p[lo[0]] <= b[hi]) if touch else (b[lo] < p[lo[0]]) & (p[lo[0]] < b[hi]) for lo, hi in _sides(dim)]
    return reduce(lambda p, q: p & q, parts)


def box_collides(a: Column, b: Column, touch: bool = True, dim: int = 2) -> Column:
    parts = [(a[lo] <= b[hi]) & (b[lo] <= a[hi]) if touch else (a[lo] < b[hi]) & (b[lo] < a[hi]) for lo, hi in _sides(dim)]
    return reduce(lambda p, q: p & q, parts)


def box_ring(b: Column) -> Column:
    return ring(point(b["xmin"], b["ymin"]), point(b["xmax"], b["ymin"]), point(b["xmax"], b["ymax"]), point(b["xmin"], b["ymax"]))


# Triangles.


def triangle_area(t: Column) -> Column:
    return F.abs(cross(sub(t["p1"], t["p0"]), sub(t["p2"], t["p0"]))) / 2


def triangle_center(t: Column) -> Column:
    return point((t["p0"]["x"] + t["p1"]["x"] + t["p2"]["x"]) / 3, (t["p0"]["y"] + t["p1"]["y"] + t["p2"]["y"]) / 3)


def triangle_ccw(t: Column) -> Column:
    return cross(sub(t["p1"], t["p0"]), sub(t["p2"], t["p0"])) > 0


def triangle_reverse(t: Column) -> Column:
    return F.struct(t["p0"].alias("p0"), t["p2"].alias("p1"), t["p1"].alias("p2"))


def triangle_ring(t: Column) -> Column:
    return ring(t["p0"], t["p1"], t["p2"])


def triangle_extent(t: Column) -> Column:
    return extent(triangle_ring(t))


def triangle_edges(t: Column) -> Column:
    """The edges' lengths, from the shortest to the longest."""
    return F.array_sort(F.array(distance(t["p0"], t["p1"]), distance(t["p1"], t["p2"]), distance(t["p2"], t["p0"])))


# Rings and polygons.


def rotated(points: Column) -> Column:
    """The points from the second on and the first at the end, so that zipping gives the edges."""
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def edges(points: Column) -> Column:
    return F.zip_with(points, rotated(points), lambda s, e: F.struct(s.alias("s"), e.alias("e")))


def extent(points: Column) -> Column:
    """The envelope of an array of points; NULL for an empty one."""
    x, y = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.when(F.size(points) > 0, box(F.array_min(x), F.array_min(y), F.array_max(x), F.array_max(y)))


def segment_extent(s: Column) -> Column:
    return box(F.least(s["s"]["x"], s["e"]["x"]), F.least(s["s"]["y"], s["e"]["y"]), F.greatest(s["s"]["x"], s["e"]["x"]), F.greatest(s["s"]["y"], s["e"]["y"]))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, v: a + v)


def signed_area(points: Column) -> Column:
    """Positive counter-clockwise; 0 for fewer than three points."""
    return F.when(F.size(points) >= 3, _sum(F.zip_with(points, rotated(points), lambda p, q: p["x"] * q["y"] - p["y"] * q["x"])) / 2).otherwise(0.0)


def ring_ccw(points: Column) -> Column:
    """Rings without area count as counter-clockwise."""
    return signed_area(points) >= 0


def canonical(points: Column) -> Column:
    return F.when(ring_ccw(points), points).otherwise(F.reverse(points))


def perimeter(points: Column) -> Column:
    return _sum(F.zip_with(points, rotated(points), lambda p, q: distance(p, q)))


def polygon_area(p: Column) -> Column:
    return F.abs(signed_area(p["outline"])) - _sum(F.transform(p["holes"], lambda h: F.abs(signed_area(h))))


def clean(points: Column) -> Column:
    """Without points equal to the one before and those on a line parallel to an axis with both neighbours.

    Each pass looks at all points at once; passes go on until one takes nothing out.
    """

    def fresh(p: Column) -> Column:
        n = F.size(p)
        return F.filter(p, lambda q, i: let(F.element_at(p, F.pmod(i - 1, n) + 1), lambda b: (q["x"] != b["x"]) | (q["y"] != b["y"])))

    def bent(p: Column) -> Column:
        n = F.size(p)

        def keep(q: Column, i: Column) -> Column:
            around = F.struct(F.element_at(p, F.pmod(i - 1, n) + 1).alias("b"), F.element_at(p, F.pmod(i + 1, n) + 1).alias("a"))
            return let(around, lambda w: ~(((w["b"]["x"] == q["x"]) & (q["x"] == w["a"]["x"])) | ((w["b"]["y"] == q["y"]) & (q["y"] == w["a"]["y"]))))

        return F.when(n >= 3, F.filter(p, keep)).otherwise(p)

    def again(state: Column, _: Column) -> Column:
        def passed(q: Column) -> Column:
            return F.struct(q.alias("points"), (F.size(q) < F.size(state["points"])).alias("more"))

        return F.when(state["more"], let(let(let(state["points"], fresh), bent), passed)).otherwise(state)

    start = F.struct(points.alias("points"), F.lit(True).alias("more"))
    return F.when(points.isNotNull(), F.aggregate(F.sequence(F.lit(0), F.size(points)), start, again, lambda s: s["points"]))


def insert_at(points: Column, position: int, more: Column) -> Column:
    """Points put in before the given position, from 0."""
    return F.concat(F.slice(points, 1, position), more, F.slice(points, F.lit(position + 1), F.size(points)))


def append_point(points: Column, p: Column) -> Column:
    return F.concat(points, F.array(p))


def pop_back(points: Column) -> Column:
    return F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))


def resize(points: Column, n: int) -> Column:
    """The first n points, filled up with the origin."""
    return F.concat(F.slice(points, 1, n), F.array_repeat(point(0.0, 0.0), F.greatest(F.lit(n) - F.size(points), F.lit(0))))


def with_holes(outline: Column, holes: Column | None = None) -> Column:
    ccw = canonical(outline)
    return polygon(ccw, None if holes is None else F.transform(holes, canonical))


def orientation(a: Column, b: Column, c: Column) -> Column:
    """Twice the signed area of a, b, c: positive where c is left of a-b."""
    return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])


def on_segment(p: Column, s: Column, e: Column) -> Column:
    return (orientation(s, e, p) == 0) & p["x"].between(F.least(s["x"], e["x"]), F.greatest(s["x"], e["x"])) & p["y"].between(F.least(s["y"], e["y"]), F.greatest(s["y"], e["y"]))


def on_ring(points: Column, p: Column) -> Column:
    return F.exists(edges(points), lambda d: on_segment(p, d["s"], d["e"]))


def in_ring(points: Column, p: Column) -> Column:
    """By the even-odd rule; points on the ring aren't decided here."""

    def crosses(d: Column) -> Column:
        s, e = d["s"], d["e"]
        over = (s["y"] > p["y"]) != (e["y"] > p["y"])
        at = (e["x"] - s["x"]) * (p["y"] - s["y"]) / F.when(e["y"] == s["y"], 1.0).otherwise(e["y"] - s["y"]) + s["x"]
        return F.when(over & (p["x"] < at), 1).otherwise(0)

    return F.aggregate(F.transform(edges(points), crosses), F.lit(0), lambda a, v: a + v) % 2 == 1


def ring_contains(points: Column, p: Column, touch: bool = True) -> Column:
    return on_ring(points, p) | in_ring(points, p) if touch else ~on_ring(points, p) & in_ring(points, p)


def polygon_contains(pwh: Column, p: Column, touch: bool = True) -> Column:
    """In the outline and not strictly inside of a hole (not touching one either without touch)."""
    return ring_contains(pwh["outline"], p, touch) & ~F.exists(pwh["holes"], lambda h: ring_contains(h, p, not touch))


def ring_contains_points(points: Column, others: Column, touch: bool = True) -> Column:
    """All of the vertices; for concave rings that doesn't mean all between them."""
    return F.forall(others, lambda p: ring_contains(points, p, touch))


def ring_covers(points: Column, other: Column) -> Column:
    """Whether a ring lies in another: its vertices do and no edges cross."""
    crossing = F.exists(edges(points), lambda d: F.exists(edges(other), lambda o: segments_cross(d["s"], d["e"], o["s"], o["e"])))
    return ring_contains_points(points, other) & ~crossing


def triangle_contains(t: Column, p: Column, touch: bool = True) -> Column:
    return ring_contains(triangle_ring(t), p, touch)


def segment_contains(s: Column, p: Column) -> Column:
    return on_segment(p, s["s"], s["e"])


def segments_cross(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Properly: each separates the other's ends strictly."""
    return (F.signum(orientation(a, b, c)) * F.signum(orientation(a, b, d)) < 0) & (F.signum(orientation(c, d, a)) * F.signum(orientation(c, d, b)) < 0)


def segments_intersect(p: Column, q: Column, touch: bool = True) -> Column:
    a, b, c, d = p["s"], p["e"], q["s"], q["e"]
    crossing = segments_cross(a, b, c, d)
    if not touch:
        return crossing
    return crossing | on_segment(a, c, d) | on_segment(b, c, d) | on_segment(c, a, b) | on_segment(d, a, b)


def segment_intersection(p: Column, q: Column) -> Column:
    """The common points: one for a crossing or touch, the two ends of a common piece, none otherwise."""
    a, b, c, d = p["s"], p["e"], q["s"], q["e"]
    u, v, w = sub(b, a), sub(d, c), sub(c, a)
    det = cross(u, v)
    t = cross(w, v) / F.when(det == 0, 1.0).otherwise(det)
    single = F.array(point(a["x"] + t * u["x"], a["y"] + t * u["y"]))
    none = F.expr(f"cast(array() as {RING})")
    ends = F.array_distinct(F.concat(*[F.when(on_segment(x, s, e), F.array(x)).otherwise(none) for x, s, e in ((a, c, d), (b, c, d), (c, a, b), (d, a, b))]))
    # An end on the other segment is the common point as it is; the computed one can miss it by a rounding error.
    crossing = F.when(F.size(ends) > 0, F.slice(ends, 1, 1)).otherwise(single)
    return F.when(det == 0, ends).otherwise(F.when(segments_intersect(p, q), crossing).otherwise(none))


def segment_line_intersection(s: Column, line: Column) -> Column:
    """Ends on the line first; else the crossing, if any."""
    a, b = s["s"], s["e"]
    da, db = (line["a"] * x["x"] + line["b"] * x["y"] + line["c"] for x in (a, b))
    none = F.expr(f"cast(array() as {RING})")
    t = da / F.when(da == db, 1.0).otherwise(da - db)
    crossing = F.array(point(a["x"] + t * (b["x"] - a["x"]), a["y"] + t * (b["y"] - a["y"])))
    return F.when((da == 0) & (db == 0), F.array(a, b)).when(da == 0, F.array(a)).when(db == 0, F.array(b)).when(F.signum(da) * F.signum(db) < 0, crossing).otherwise(none)


def segment_plane_intersection(s: Column, plane: Column) -> Column:
    """The common point of a segment and a plane in space; NULL without one or where the segment lies in the plane."""
    a, b = s["s"], s["e"]
    da, db = (plane["nx"] * x["x"] + plane["ny"] * x["y"] + plane["nz"] * x["z"] - plane["d"] for x in (a, b))
    t = da / F.when(da == db, 1.0).otherwise(da - db)
    return F.when((da != db) & (F.signum(da) * F.signum(db) <= 0), point3(*[a[c] + t * (b[c] - a[c]) for c in "xyz"]))


ON_LINE, LEFT, RIGHT = 0, 1, 2
OUTSIDE, ON_EDGE1, ON_EDGE2, ON_EDGE3, INSIDE = range(5)


def point_line_location(p: Column, a: Column, b: Column) -> Column:
    o = orientation(a, b, p)
    return F.when(o > 0, LEFT).when(o < 0, RIGHT).otherwise(ON_LINE)


def point_triangle_location(p: Column, t: Column) -> Column:
    """Outside 0, on an edge 1 to 3, inside 4; the triangle turns left. The edges' extensions are outside."""
    o1, o2, o3 = orientation(t["p0"], t["p1"], p), orientation(t["p1"], t["p2"], p), orientation(t["p2"], t["p0"], p)
    out = (o1 < 0) | (o2 < 0) | (o3 < 0)
    return F.when(out, OUTSIDE).when(o1 == 0, ON_EDGE1).when(o2 == 0, ON_EDGE2).when(o3 == 0, ON_EDGE3).otherwise(INSIDE)


def in_circle(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Positive where d is inside the circle through a, b, c (which turn left)."""
    ax, ay, bx, by, cx, cy = a["x"] - d["x"], a["y"] - d["y"], b["x"] - d["x"], b["y"] - d["y"], c["x"] - d["x"], c["y"] - d["y"]
    return (ax * ax + ay * ay) * (bx * cy - by * cx) - (bx * bx + by * by) * (ax * cy - ay * cx) + (cx * cx + cy * cy) * (ax * by - ay * bx)


def in_circumcircle(a: Column, b: Column, c: Column, d: Column, touch: bool = True) -> Column:
    v = in_circle(a, b, c, d)
    return v >= 0 if touch else v > 0


def shape_hash(shape: Column) -> Column:
    return F.xxhash64(shape)


def extent_of(value) -> Column:
    return extent(col(value))
