"""More queries of the catalogue: rows of the inventory that the first part doesn't reach, several to a query."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mathx, robust, shapes, text, vectors
from ..functions.types import box, box3, circle, point, point3, polygon, ring, segment, triangle
from ..operators import aggs, circuit, graph, grid, joins, mesh, polygons, series
from ..operators.scratch import Scratch
from ..sources import config, mesh_files, wkt
from . import boolexpr, mapreduce
from .catalog import BOXES, HOURS, events_points, part_boxes, query, r, table

# Four points of every part, in Spark and in SQL.
PTS = """q AS (SELECT p_partkey AS id, p_size::DOUBLE AS ax, round(p_retailprice - 900, 3) AS ay, (p_partkey % 7)::DOUBLE AS bx, (p_partkey % 11)::DOUBLE AS b_y,
20.0 + p_partkey % 13 AS cx, (p_partkey % 5)::DOUBLE AS cy, 3.0 + p_partkey % 3 AS ex, 31.0 + p_partkey % 4 AS ey FROM part)"""


def corners() -> tuple:
    return tuple(F.col(n) for n in "abce")


def quads(spark, d) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("id"), point(F.col("p_size"), F.round(F.col("p_retailprice") - 900, 3)).alias("a"), point(k % 7, k % 11).alias("b"), point(20.0 + k % 13, k % 5).alias("c"), point(3.0 + k % 3, 31.0 + k % 4).alias("e")
    )


def xy(p, name: str, digits: int = 4) -> list:
    return [r(p[c], digits).alias(f"{name}_{c}") for c in "xy"]


# Vectors and boxes.


@query(
    f"""WITH {PTS} SELECT id, round(ax + bx, 4) AS sum_x, round(ay + b_y, 4) AS sum_y, round(ax - bx, 4) AS diff_x, round(ay - b_y, 4) AS diff_y, round(ax * bx, 4) AS prod_x, round(ay * b_y, 4) AS prod_y,
round(ax * 2.5 / 4, 4) AS part_x, round(ay * 2.5 / 4, 4) AS part_y, round(-ax, 4) AS back_x, round(-ay, 4) AS back_y, round(ax / sqrt(ax * ax + ay * ay), 4) AS unit_x, round(ay / sqrt(ax * ax + ay * ay), 4) AS unit_y,
round(CASE WHEN bx = 0 THEN 4503599627370496 ELSE 1 / bx END, 6) AS inv, round(1 / ax, 6) AS inv_x, round(ay)::BIGINT AS whole, round(ay, 1) AS tenths FROM q"""
)
def vector_arithmetic(spark, d):
    pa, pb, _, _ = corners()
    unit, inverse = vectors.normalize(pa), vectors.inverse(pa)
    return quads(spark, d).select(
        "id", *xy(vectors.add(pa, pb), "sum"), *xy(vectors.sub(pa, pb), "diff"), *xy(vectors.mul(pa, pb), "prod"), *xy(vectors.div(vectors.scaled(pa, 2.5), 4), "part"), *xy(vectors.neg(pa), "back"), *xy(unit, "unit"),
        r(vectors.safe_inv(pb["x"]), 6).alias("inv"), r(inverse["x"], 6).alias("inv_x"), vectors.cast_point(pa)["y"].alias("whole"), r(vectors.round_half_away(pa["y"], 1), 1).alias("tenths"),
    )


def _to_segment(px: str, py: str, ax: str, ay: str, bx: str, by: str) -> str:
    t = f"greatest(0, least(1, (({px} - {ax}) * ({bx} - {ax}) + ({py} - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
    return f"sqrt(pow({px} - {ax} - {t} * ({bx} - {ax}), 2) + pow({py} - {ay} - {t} * ({by} - {ay}), 2))"


def _turn(p: str, q: str, s: str) -> str:
    (px, py), (qx, qy), (sx, sy) = ((f"{v}x", f"{v}_y" if v == "b" else f"{v}y") for v in (p, q, s))
    return f"(({qx} - {px}) * ({sy} - {py}) - ({qy} - {py}) * ({sx} - {px}))"


MEET = f"(sign({_turn('a', 'b', 'c')}) * sign({_turn('a', 'b', 'e')}) <= 0 AND sign({_turn('c', 'e', 'a')}) * sign({_turn('c', 'e', 'b')}) <= 0)"


@query(
    f"""WITH {PTS} SELECT id, round(ay * bx - b_y * ax, 4) AS cross_z, round(ay * 2 - b_y * 1, 4) AS cross_x,
round(CASE WHEN {MEET} THEN 0 ELSE least({_to_segment('ax', 'ay', 'cx', 'cy', 'ex', 'ey')}, {_to_segment('bx', 'b_y', 'cx', 'cy', 'ex', 'ey')}, {_to_segment('cx', 'cy', 'ax', 'ay', 'bx', 'b_y')}, {_to_segment('ex', 'ey', 'ax', 'ay', 'bx', 'b_y')}) END, 4) AS apart,
round(sqrt(pow(CASE WHEN {MEET} THEN 0 ELSE least({_to_segment('ax', 'ay', 'cx', 'cy', 'ex', 'ey')}, {_to_segment('bx', 'b_y', 'cx', 'cy', 'ex', 'ey')}, {_to_segment('cx', 'cy', 'ax', 'ay', 'bx', 'b_y')}, {_to_segment('ex', 'ey', 'ax', 'ay', 'bx', 'b_y')}) END, 2) + 9), 4) AS apart_3d FROM q"""
)
def vector_products(spark, d):
    """The cross product in space, and distances of segments; those in space lie in planes three apart."""
    pa, pb, pc, pe = corners()
    a3, b3 = point3(pa["x"], pa["y"], 1.0), point3(pb["x"], pb["y"], 2.0)
    k = vectors.cross3(a3, b3)
    low, high = segment(point3(pa["x"], pa["y"], 0.0), point3(pb["x"], pb["y"], 0.0)), segment(point3(pc["x"], pc["y"], 3.0), point3(pe["x"], pe["y"], 3.0))
    return quads(spark, d).select("id", r(-k["z"]).alias("cross_z"), r(k["x"]).alias("cross_x"), r(vectors.segment_distance(segment(pa, pb), segment(pc, pe))).alias("apart"), r(vectors.segment_distance(low, high, 3)).alias("apart_3d"))


@query(
    f"""WITH {BOXES} SELECT id, round((xmin + xmax) / 2 - (xmax - xmin), 4) AS wide_min, round((ymin + ymax) / 2 + (ymax - ymin), 4) AS wide_max, round(xmin * 3, 4) AS times, round(ymax + 7, 4) AS moved,
round(least(xmin, 10), 4) AS all_min, round(greatest(ymax, 12), 4) AS all_max, round(least(ymin, 4), 4) AS with_point, xmin >= 2 AND xmax <= 30 AND ymin >= 5 AND ymax <= 60 AS inside,
xmin > 2 AND xmax < 30 AND ymin > 5 AND ymax < 60 AS strictly, false AS valid, round((xmax - xmin) * (ymax - ymin) * 2, 4) AS volume FROM boxes"""
)
def box_edits(spark, d):
    b = F.col("box")
    wide, times, moved = shapes.box_scale(b, 2.0), shapes.box_times(b, 3.0), shapes.box_shift(b, point(5.0, 7.0))
    turned = box(b["xmax"], b["ymax"], b["xmin"], b["ymin"])
    joint, grown = shapes.box_union(b, box(10.0, 11.0, 11.0, 12.0)), shapes.box_add_point(b, point(9.0, 4.0))
    solid = box3(b["xmin"], b["ymin"], 1.0, b["xmax"], b["ymax"], 3.0)
    return part_boxes(spark, d).select(
        "id", r(wide["xmin"]).alias("wide_min"), r(wide["ymax"]).alias("wide_max"), r(times["xmin"]).alias("times"), r(moved["ymax"]).alias("moved"), r(joint["xmin"]).alias("all_min"), r(joint["ymax"]).alias("all_max"),
        r(grown["ymin"]).alias("with_point"), shapes.box_contains(box3(2.0, 5.0, 0.0, 30.0, 60.0, 3.0), solid, True, 3).alias("inside"), shapes.box_contains(box3(2.0, 5.0, 0.0, 30.0, 60.0, 4.0), solid, False, 3).alias("strictly"),
        shapes.box_valid(turned).alias("valid"), r(shapes.box_volume(shapes.box_normalize(solid, 3))).alias("volume"),
    )


# Rings, circles, lines, planes, arcs.


@query(
    f"""WITH {BOXES} SELECT id, 4 AS corners, round((xmax - xmin) * (ymax - ymin), 4) AS area, 5 AS longer, 3 AS shorter, 6 AS filled, 5 AS put, round((xmin + xmax) / 2, 4) AS put_x, round(-(xmax - xmin) * (ymax - ymin), 4) AS turned,
round(2 * (xmax - xmin + ymax - ymin), 4) AS around FROM boxes"""
)
def ring_edits(spark, d):
    """Corners that are no corners go, however many lie one behind the other."""
    b = F.col("box")
    middle = point((b["xmin"] + b["xmax"]) / 2, b["ymin"])
    spike = [point(b["xmax"] + k, b["ymax"]) for k in (3.0, 2.0, 1.0)]
    dirty = ring(point(b["xmin"], b["ymin"]), point(b["xmin"], b["ymin"]), middle, point(b["xmax"], b["ymin"]), point(b["xmax"], b["ymax"]), *spike, point(b["xmax"], b["ymax"]), point(b["xmin"], b["ymax"]))
    clean = shapes.clean(dirty)
    own = shapes.box_ring(b)
    put = shapes.insert_at(own, 1, F.array(middle))
    return part_boxes(spark, d).select(
        "id", F.size(clean).alias("corners"), r(shapes.signed_area(clean)).alias("area"), F.size(shapes.append_point(own, middle)).alias("longer"), F.size(shapes.pop_back(own)).alias("shorter"), F.size(shapes.resize(own, 6)).alias("filled"),
        F.size(put).alias("put"), r(F.get(put, F.lit(1))["x"]).alias("put_x"), r(shapes.signed_area(F.reverse(own))).alias("turned"), r(shapes.perimeter(shapes.canonical(F.reverse(own)))).alias("around"),
    )


@query(
    f"""WITH {BOXES} SELECT id, round((xmax - xmin) * (ymax - ymin) - 4 * 0.25 + 4 * (0.25 / 2 * 8 * sin(pi() / 16)), 4) AS rounded, round(0.5 * (xmax - xmin + ymax - ymin), 4) AS path FROM boxes"""
)
def rounded_outlines(spark, d):
    """Boxes with round corners of eight pieces, and their lower left sides as lines of a width."""
    b = F.col("box")
    rows = part_boxes(spark, d).select("id", shapes.box_ring(b).alias("own"), ring(point(b["xmax"], b["ymin"]), point(b["xmin"], b["ymin"]), point(b["xmin"], b["ymax"])).alias("line"))
    done = polygons.ring_rows(polygons.ring_rows(rows, F.col("own"), lambda p: polygons.round_corners(p, 0.5, 32), "rounded"), F.col("line"), lambda p: polygons.path_outline(p, 0.5), "path")
    return done.select("id", r(shapes.signed_area(F.col("rounded"))).alias("rounded"), r(F.abs(shapes.signed_area(F.col("path")))).alias("path"))


@query(
    f"""WITH {PTS}, s AS (SELECT *, sqrt(pow(ax - cx, 2) + pow(ay - cy, 2)) AS ac, sqrt(pow(cx - ex, 2) + pow(cy - ey, 2)) AS ce, sqrt(pow(ex - ax, 2) + pow(ey - ay, 2)) AS ea, abs({_turn('a', 'c', 'e')}) / 2 AS area FROM q)
SELECT id, round(6 * pow(3 + id % 5, 2) * sin(pi() / 6), 4) AS inner_area, round(12 * pow(3 + id % 5, 2) * tan(pi() / 12), 4) AS outer_area, bx * bx + b_y * b_y <= pow(3 + id % 5, 2) AS holds,
CASE WHEN area > 1 THEN round(ac * ce * ea / (4 * area) / least(ac, ce, ea), 3) END AS ratio, round((3 + id % 5) / tan(pi() / 8), 4) AS foot FROM s"""
)
def circle_shapes(spark, d):
    pa, pb, pc, pe = corners()
    c = circle(point(0.0, 0.0), 3 + F.col("id") % 5)
    ratio = F.when(F.abs(shapes.orientation(pa, pc, pe)) > 2, r(vectors.radius_edge_ratio(pa, pc, pe), 3))
    touch = vectors.inscribed_circle(point(100.0, 0.0), point(0.0, 0.0), point(100.0, 100.0), 3 + F.col("id") % 5)
    return quads(spark, d).select(
        "id", r(shapes.signed_area(vectors.inscribed_polygon(c, 12))).alias("inner_area"), r(shapes.signed_area(vectors.circumscribed_polygon(c, 12))).alias("outer_area"), vectors.circle_contains(c, pb).alias("holds"),
        ratio.alias("ratio"), r(touch["fs"]["x"]).alias("foot"),
    )


@query(
    f"""WITH {PTS}, l AS (SELECT *, {_turn('c', 'e', 'a')} AS w, sqrt(pow(cx - ex, 2) + pow(cy - ey, 2)) AS n, (ax - 0) AS dx FROM q)
SELECT id, round(abs(w) / n, 3) AS to_line, round(w * w / (n * n), 3) AS to_line_sq, round(pow({_to_segment('ax', 'ay', 'cx', 'cy', 'ex', 'ey')}, 2), 3) AS to_part_sq,
round(pow(greatest(0, greatest(5 - ax, ax - 20)), 2) + pow(greatest(0, greatest(6 - ay, ay - 30)), 2), 3) AS to_box_sq, round(cx + (ex - cx) * (10 - cy) / (ey - cy), 6) AS at_ten, 
round((ax + 2 * ay + 2 * 5 - 4) / 3, 4) AS over_plane, round(ay - b_y, 4) AS over_floor, CASE WHEN ay <= 3 THEN round(ax, 4) END AS cut FROM l"""
)
def lines_and_planes(spark, d):
    pa, pb, pc, pe = corners()
    line = vectors.line_by_points(pc, pe)
    level = vectors.line_by_normal(point(0.0, 10.0), point(0.0, 2.0))
    plane = vectors.plane_by_normal(point3(1.0, 2.0, 2.0), point3(0.0, 1.0, 1.0))
    floor = vectors.plane_by_points(point3(0.0, pb["y"], 0.0), point3(0.0, pb["y"], 1.0), point3(1.0, pb["y"], 0.0))
    post = segment(point3(pa["x"], 0.0, 0.0), point3(pa["x"], pa["y"], 0.0))
    cut = shapes.segment_plane_intersection(post, vectors.plane_by_points(point3(0.0, 3.0001, 0.0), point3(0.0, 3.0001, 1.0), point3(1.0, 3.0001, 0.0)))
    return quads(spark, d).select(
        "id", r(vectors.line_distance(line, pa), 3).alias("to_line"), r(vectors.point_line_distance_sq(pa, pc, pe), 3).alias("to_line_sq"), r(vectors.point_segment_distance_sq(pa, pc, pe), 3).alias("to_part_sq"),
        r(vectors.point_box_distance_sq(pa, box(5.0, 6.0, 20.0, 30.0)), 3).alias("to_box_sq"), r(vectors.line_intersection(line, level)["x"], 6).alias("at_ten"),
        r(vectors.plane_distance(point3(pa["x"], pa["y"], 5.0), plane)).alias("over_plane"), r(vectors.plane_distance(point3(pa["x"], pa["y"], 9.0), floor)).alias("over_floor"),
        F.when(cut.isNull(), r(pa["x"])).alias("cut"),
    )


@query(
    f"""WITH {PTS} SELECT id, round(bx + cos(0.75) * (cx - bx) - sin(0.75) * (cy - b_y), 4) AS end_x, round(b_y + sin(0.75) * (cx - bx) + cos(0.75) * (cy - b_y), 4) AS end_y,
round(10 * 2 * sqrt(pow(cx - bx, 2) + pow(cy - b_y, 2)) * sin(0.0375), 4) AS length, round(sqrt(pow(cx - bx, 2) + pow(cy - b_y, 2)), 4) AS mag, round(pi() / 2, 4) AS by_three FROM q"""
)
def arcs(spark, d):
    _, pb, pc, _ = corners()
    a = vectors.arc(pb, pc, 0.75)
    line = vectors.arc_polyline(a, 10)
    length = F.aggregate(F.zip_with(F.slice(line, 1, 10), F.slice(line, 2, 10), lambda p, q: vectors.distance(p, q)), F.lit(0.0), lambda s, v: s + v)
    end = vectors.arc_end(a)
    h = math.sqrt(0.5)
    three = vectors.arc_by_three_points(point(pc["x"], 0.0), point(pc["x"] * h, pc["x"] * h), point(0.0, pc["x"]))
    return quads(spark, d).select("id", *xy(end, "end"), r(length).alias("length"), r(vectors.arc_start_angle(a)["mag"]).alias("mag"), r(three["radian"]).alias("by_three"))


@query(f"WITH {PTS} SELECT id, round(cos(0.3 * (0.1 + id % 9 / 4.0)), 5) AS x, round(sin(0.3 * (0.1 + id % 9 / 4.0)), 5) AS y, round(cos(0.5 * (0.1 + id % 9 / 4.0)), 5) AS sx FROM q")
def quaternion_ways(spark, d):
    """Part of the way between two turns about an axis, and the smooth way, which about one axis is the same."""
    axis, t = point3(0.0, 0.0, 1.0), 0.1 + F.col("id") % 9 / 4.0
    p, q = vectors.quat_by_axis(axis, F.lit(0.0)), vectors.quat_by_axis(axis, t)
    on = vectors.quat_rotate(vectors.slerp(p, q, 0.3), point3(1.0, 0.0, 0.0))
    before, after = vectors.quat_by_axis(axis, -t), vectors.quat_by_axis(axis, 2 * t)
    ways = vectors.squad(p, vectors.squad_tangent(before, p, q), q, vectors.squad_tangent(p, q, after), 0.5)
    return quads(spark, d).select("id", r(on["x"], 5).alias("x"), r(on["y"], 5).alias("y"), r(vectors.quat_rotate(ways, point3(1.0, 0.0, 0.0))["x"], 5).alias("sx"))


# Predicates.


@query(
    f"""WITH {PTS} SELECT id, abs(bx - b_y) <= 1 AS equal, NOT abs(bx - b_y) <= 1 AS unequal, bx >= b_y - 1 AS at_least, bx <= b_y + 1 AS at_most, NOT bx <= b_y + 1 AS over, NOT bx >= b_y - 1 AS under,
ax > 5 AND ax < 20 AS open, ax >= 5 AND ax <= 20 AS closed, ax > 5 AND ax <= 20 AS left_open, ax >= 5 AND ax < 20 AS right_open, bx - 3 < 0 AS negative, bx - 3 > 0 AS positive FROM q"""
)
def tolerant_comparisons(spark, d):
    pa, pb, _, _ = corners()
    x, y = pb["x"], pb["y"]
    kinds = [mathx.within(pa["x"], 5.0, 20.0, k).alias(k) for k in ("open", "closed", "left_open", "right_open")]
    both = [f(x, y, 1.0).alias(n) for n, f in (("equal", mathx.eq), ("unequal", mathx.ne), ("at_least", mathx.ge), ("at_most", mathx.le), ("over", mathx.gt), ("under", mathx.lt))]
    return quads(spark, d).select("id", *both, *kinds, mathx.is_negative(x - 3).alias("negative"), mathx.is_positive(x - 3).alias("positive"))


CORNER = "SELECT id, bx AS x, b_y AS y, 8 - bx - b_y AS o, bx * bx + b_y * b_y - 8 * bx - 8 * b_y AS k FROM q"


@query(
    f"""WITH {PTS}, t AS ({CORNER}) SELECT id, (CASE WHEN x < 0 OR y < 0 OR o < 0 THEN 0 WHEN y = 0 THEN 1 WHEN o = 0 THEN 2 WHEN x = 0 THEN 3 ELSE 4 END)::INTEGER AS at,
k <= 0 AS in_circle, k < 0 AS strictly, sign(8 - x - y)::INTEGER AS side, sign(-k)::INTEGER AS exact_circle FROM t"""
)
def point_in_triangle(spark, d):
    """Where points lie to a triangle, its sides and its circle, plainly and by exact signs."""
    _, pb, _, _ = corners()
    p0, p1, p2 = point(0.0, 0.0), point(8.0, 0.0), point(0.0, 8.0)
    rows = quads(spark, d).select("id", "b", p0.alias("p0"), p1.alias("p1"), p2.alias("p2"))
    rows = robust.sign(robust.sign(rows, "orient2d", ["p1", "p2", "b"], "side"), "in_circle", ["p0", "p1", "p2", "b"], "exact_circle")
    return rows.select(
        "id", shapes.point_triangle_location(pb, triangle(p0, p1, p2)).cast("int").alias("at"), shapes.in_circumcircle(p0, p1, p2, pb).alias("in_circle"), shapes.in_circumcircle(p0, p1, p2, pb, False).alias("strictly"),
        F.col("side").cast("int").alias("side"), F.col("exact_circle").cast("int").alias("exact_circle"),
    )


@query(
    f"""WITH {PTS}, m AS (SELECT *, {_turn('a', 'b', 'c')} AS o1, {_turn('a', 'b', 'e')} AS o2, {_turn('c', 'e', 'a')} AS o3, {_turn('c', 'e', 'b')} AS o4 FROM q)
SELECT id, round(cx + (ex - cx) * o1 / (o1 - o2), 3) AS x, round(cy + (ey - cy) * o1 / (o1 - o2), 3) AS y FROM m WHERE o1 * o2 < 0 AND o3 * o4 < 0"""
)
def segment_meetings(spark, d):
    pa, pb, pc, pe = corners()
    at = F.get(shapes.segment_intersection(segment(pa, pb), segment(pc, pe)), F.lit(0))
    return quads(spark, d).where(shapes.segments_cross(pa, pb, pc, pe)).select("id", *[r(at[c], 3).alias(c) for c in "xy"])


@query("SELECT '((a_[999] & b) ^ ((c & d) | (a & b)))' AS printed, 'Unexpected end of content. expecting \")\" line 1' AS said, count(*) FILTER (p_size > 10 AND p_size < 30 AND p_partkey % 2 = 0) AS every, count(*) FILTER (p_size > 45 OR p_size < 5 OR p_partkey % 10 = 0) AS some FROM part")
def expressions_printed(spark, d):
    try:
        boolexpr.parse("(a & bbb[0]) ^ ((c & d) | (a & b)")
        said = ""
    except boolexpr.ParseError as e:
        said = str(e).strip()
    k, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, d, "part").agg(
        F.lit(str(boolexpr.parse(r"a_\[999] & b ^ (c & d | a & b)"))).alias("printed"), F.lit(said).alias("said"), F.count(F.when(boolexpr.all_of(s > 10, s < 30, k % 2 == 0), 1)).alias("every"),
        F.count(F.when(boolexpr.any_of(s > 45, s < 5, k % 10 == 0), 1)).alias("some"),
    )


# Joins and series.


@query("WITH b(k, x1, q1, x2, q2) AS (VALUES (1, 5.0, 1.0, 12.0, 4.0), (2, 12.0, 4.0, 30.0, 2.0), (3, 30.0, 2.0, 41.0, 9.0)) SELECT p_partkey AS id, round(q1 + (q2 - q1) * (p_size - x1) / (x2 - x1), 4)::DOUBLE AS v FROM part JOIN b ON (k = 1 OR p_size >= x1) AND (k = 3 OR p_size < x2)")
def bracket_lookup(spark, d):
    points = spark.createDataFrame([(5.0, 1.0), (12.0, 4.0), (30.0, 2.0), (41.0, 9.0)], "bx double, q double")
    rows = joins.bracket_join(table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x")), points, "x")
    return rows.select("id", r(mathx.linear(F.col("q1"), F.col("q2"), F.col("x1"), F.col("x2"), F.col("x"))).alias("v"))


@query("SELECT p_partkey AS id, p_name AS name, p_size * 2 AS twice FROM part")
def zipped_rows(spark, d):
    p = table(spark, d, "part")
    return joins.zip_rows(p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), p.select(F.col("p_partkey").alias("id"), (F.col("p_size") * 2).alias("twice")), "id")


@query(f"WITH {BOXES} SELECT ceil((max(xmax) - min(xmin)) / 4)::BIGINT AS width, ceil((max(ymax) - min(ymin)) / 8)::BIGINT AS height FROM boxes")
def grid_extent(spark, d):
    e = part_boxes(spark, d).agg(aggs.extent_agg(F.col("box")).alias("b"))
    s = grid.grid_size(F.col("b"), 4.0, 8.0)
    return e.select(s["width"].cast("long").alias("width"), s["height"].cast("long").alias("height"))


@query(f"WITH {BOXES} SELECT id, (2 * (floor(xmax / 2) - floor(xmin / 2) + floor(ymax / 2) - floor(ymin / 2)))::INTEGER AS n FROM boxes WHERE floor(xmax / 2) > floor(xmin / 2) AND floor(ymax / 2) > floor(ymin / 2)")
def ring_outline_cells(spark, d):
    """The cells of a box's outline on a grid, and a polygon's snapped to it, which covers as many."""
    rows = part_boxes(spark, d).select("id", shapes.box_ring(F.col("box")).alias("own"), F.col("box").alias("b"))
    at = lambda c: F.floor(F.col("b")[c] / 2)
    cells = F.size(F.array_distinct(grid.rasterize_polygon(polygon(F.col("own")), 2.0, 2.0)))
    return rows.where((at("xmax") > at("xmin")) & (at("ymax") > at("ymin")) & (F.size(grid.snapped_ring(F.col("own"), 2.0, 2.0)) == 4)).select("id", cells.alias("n"))


@query("SELECT 'orders' AS t, true AS any_order, true AS cancels, true AS order_matters")
def hash_invariants(spark, d):
    """Hashes don't depend on how rows are dealt; pairs cancel; the order of a sequence tells."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"))
    one, other = o.agg(aggs.unordered_hash(F.col("k")).alias("h")), o.repartition(7).orderBy(F.desc("k")).agg(aggs.unordered_hash(F.col("k")).alias("h2"))
    twice = o.unionByName(o).agg(aggs.unordered_hash(F.col("k")).alias("h3"))
    rows = o.withColumn("g", F.lit(1))
    up, down = aggs.ordered_hash(rows, ["g"], "k", F.col("k")).select(F.col("hash").alias("u")), aggs.ordered_hash(rows.withColumn("m", -F.col("k")), ["g"], "m", F.col("k")).select(F.col("hash").alias("v"))
    return one.crossJoin(other).crossJoin(twice).crossJoin(up).crossJoin(down).select(F.lit("orders").alias("t"), (F.col("h") == F.col("h2")).alias("any_order"), (F.col("h3") == 0).alias("cancels"), (F.col("u") != F.col("v")).alias("order_matters"))  # one row each


TREE = f"""e AS (SELECT event_id AS id, greatest(0, least(255, ceil({HOURS} / 9000 * 256)::BIGINT - 1)) AS gx, greatest(0, least(255, ceil(value / 500 * 256)::BIGINT - 1)) AS gy FROM events),
k AS (SELECT id, array_to_string(list_transform(range(7, -1, -1), lambda b: CASE WHEN (gx >> b) % 2 = 0 THEN CASE WHEN (gy >> b) % 2 = 0 THEN '0' ELSE '3' END WHEN (gy >> b) % 2 = 0 THEN '1' ELSE '2' END), '') AS key FROM e),
n AS (SELECT substr(key, 1, l) AS node, l, count(*) AS n FROM k, range(0, 9) t(l) GROUP BY 1, 2),
leaf AS (SELECT node, n FROM n x WHERE (n <= 50 OR l = 8) AND (l = 0 OR (SELECT n FROM n y WHERE y.l = x.l - 1 AND y.node = substr(x.node, 1, x.l - 1)) > 50))"""


@query(f"WITH {TREE} SELECT node AS leaf, n FROM leaf")
def quad_tree(spark, d):
    """Leaves of a quadtree over events, with the number of objects in each."""
    t = grid.quad_tree(events_points(spark, d).select("id", "p"), (0.0, 0.0, 9000.0, 500.0), 50, 8)
    return t.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS objects, 16 AS tiles, true AS even FROM part")
def str_tiles(spark, d):
    """Tiles of a sorted tree: every object is in one, and none has half more or less than its share."""
    t = grid.str_tiles(part_boxes(spark, d), 16).groupBy("tile").agg(F.count(F.lit(1)).alias("n"))
    return t.agg(F.sum("n").alias("objects"), F.count(F.lit(1)).cast("int").alias("tiles"), ((F.max("n") * 16 < 1.5 * F.sum("n")) & (F.min("n") * 16 > 0.5 * F.sum("n"))).alias("even"))


# Graphs and meshes.


@query("SELECT DISTINCT least(o_custkey, o_orderkey % 97) AS src, greatest(o_custkey, o_orderkey % 97) AS dst FROM orders WHERE o_custkey BETWEEN 1 AND 60 AND o_orderkey % 97 <= 60 AND o_orderkey % 97 > 0 AND o_custkey > 0")
def sparse_edges(spark, d):
    e = table(spark, d, "orders").select(F.col("o_custkey").alias("src"), (F.col("o_orderkey") % 97).alias("dst"))
    return graph.sparse_graph(e, spark.range(1, 61))


@query("SELECT unnest(['chain', 'random', 'silkworm', 'star', 'tall']) AS kind, 199 AS edges, 1 AS components")
def random_trees(spark, d):
    """A tree of every kind, side by side as one graph."""
    kinds = ("chain", "random", "silkworm", "star", "tall")
    trees = None
    for k, kind in enumerate(kinds):
        t = graph.random_tree(spark, 200, kind).select((F.col("src") + 1000 * k).alias("src"), (F.col("dst") + 1000 * k).alias("dst"))
        trees = t if trees is None else trees.unionByName(t)
    nodes = spark.range(1000 * len(kinds)).where("id % 1000 < 200")
    c = graph.connected_components(nodes, trees).groupBy(F.floor(F.col("id") / 1000).cast("int").alias("k")).agg(F.countDistinct("component").cast("int").alias("components"))
    e = trees.groupBy(F.floor(F.col("src") / 1000).cast("int").alias("k")).agg(F.count(F.lit(1)).cast("int").alias("edges"))
    return e.join(c, "k").select(F.get(F.array(*map(F.lit, kinds)), F.col("k")).alias("kind"), "edges", "components")


@query("SELECT user_id AS id, count(*) AS edges FROM events GROUP BY 1")
def ring_edge_counts(spark, d):
    rings = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.collect_list(F.struct(F.col("value").alias("x"), F.col("value").alias("y"))).alias("ring"))
    return graph.ring_edges(rings, F.col("ring")).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))


def _lattice(spark, d) -> DataFrame:
    """Ten by ten points for every nation, from its key."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    at = spark.range(100).withColumnRenamed("id", "i")
    return n.crossJoin(F.broadcast(at)).select("k", F.col("i").alias("id"), point(F.col("i") % 10, F.floor(F.col("i") / 10) * (1 + F.col("k") % 3)).alias("p"))  # a hundred rows


@query("SELECT n_nationkey AS k, 162 AS triangles, (81.0 * (1 + n_nationkey % 3))::DOUBLE AS area, true AS has_edge FROM nation")
def lattice_triangles(spark, d):
    """Triangles over lattices with an edge across that no triangle would have by itself."""
    p = _lattice(spark, d)
    wanted = p.select("k").distinct().select("k", F.lit(0).cast("long").alias("src"), F.lit(79).cast("long").alias("dst"))
    t = mesh.triangulate(p, ["k"], wanted)
    corners = t
    for c in "abc":
        at = p.select(F.col("k").alias("k2"), F.col("id").alias(c), F.col("p").alias(f"p{c}"))
        corners = corners.withColumnRenamed("k", "k1").join(at, c).where("k1 = k2").drop("k2").withColumnRenamed("k1", "k")
    area = F.sum(shapes.triangle_area(triangle("pa", "pb", "pc")))
    held = F.max(F.array_contains(F.array("a", "b", "c"), 0) & F.array_contains(F.array("a", "b", "c"), 79))
    return corners.groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("triangles"), r(area).alias("area"), held.alias("has_edge"))


@query("SELECT n_nationkey::BIGINT AS k, 225 AS shared FROM nation")
def mesh_neighbours(spark, d):
    """Pairs of triangles with a common side: three sides each, less the 36 at the border, two by two, are (162 * 3 - 36) / 2."""
    t = mesh.triangulate(_lattice(spark, d), ["k"]).withColumn("tid", F.xxhash64("k", "a", "b", "c"))
    base = t.select(F.col("k") * 1000 + F.col("a"), F.col("k") * 1000 + F.col("b"), F.col("k") * 1000 + F.col("c"), "tid", "k").toDF("a", "b", "c", "tid", "k")
    pairs = mesh.neighbours(base.select("tid", "a", "b", "c"))
    return pairs.select(F.floor(F.col("src") / 1000).cast("long").alias("k")).groupBy("k").agg(F.count(F.lit(1)).cast("int").alias("shared"))


@query(f"WITH {BOXES} SELECT id, 2 AS n, round((xmax - xmin) * (ymax - ymin), 4) AS area, round(sqrt(pow(xmax - xmin, 2) + pow(ymax - ymin, 2)) / 2, 4) AS radius FROM boxes")
def fan_measures(spark, d):
    t = mesh.fan(part_boxes(spark, d).select("id", shapes.box_ring(F.col("box")).alias("ring")))
    m = mesh.triangle_measures(t)
    return m.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), r(F.sum("area")).alias("area"), r(F.max(F.col("circle")["r"])).alias("radius"))


OUTER, HOLE = [(0.0, 0.0), (10.0, 0.0), (10.0, 3.0), (4.0, 3.0), (4.0, 10.0), (0.0, 10.0)], [(1.0, 1.0), (1.0, 1.4), (3.0, 1.4), (3.0, 1.0)]


@query("SELECT unnest(['chew', 'lens', 'ruppert']) AS method, 57.2::DOUBLE AS area, unnest([27.5, 30.0, 20.0]::DOUBLE[]) AS least, true AS reached")
def refined_meshes(spark, d):
    """A bent outline with a hole, refined by each method to its limit."""
    rows = []
    for name, (limit, _) in sorted(mesh.METHODS.items()):
        pts, tris = mesh.refine([*OUTER, *HOLE], [OUTER, HOLE], method=name)
        rows += [(name, limit, *({"x": pts[i][0], "y": pts[i][1]} for i in t)) for t in tris]
    p = "struct<x:double,y:double>"
    t = spark.createDataFrame(rows, f"method string, least double, p0 {p}, p1 {p}, p2 {p}")
    tri = triangle("p0", "p1", "p2")
    smallest = F.degrees(F.array_min(vectors.interior_angles(F.col("p0"), F.col("p1"), F.col("p2"))))
    return t.groupBy("method", "least").agg(r(F.sum(shapes.triangle_area(tri))).alias("area"), (F.min(smallest) >= F.col("least") - 1e-6).alias("reached")).select("method", "area", "least", "reached")


@query(
    f"""WITH {PTS}, e AS (SELECT sqrt(pow(bx - cx, 2) + pow(b_y - cy, 2)) AS bc, sqrt(pow(cx - ex, 2) + pow(cy - ey, 2)) AS ce, sqrt(pow(ex - bx, 2) + pow(ey - b_y, 2)) AS eb FROM q),
g AS (SELECT acos((pow(greatest(bc, ce, eb), 2) + pow(bc + ce + eb - greatest(bc, ce, eb) - least(bc, ce, eb), 2) - pow(least(bc, ce, eb), 2)) / (2 * greatest(bc, ce, eb) * (bc + ce + eb - greatest(bc, ce, eb) - least(bc, ce, eb)))) AS low FROM e)
SELECT greatest(0, least(5, floor(low / (pi() / 3) * 6)))::INTEGER AS bin, round(count(*) / (SELECT count(*) FROM g), 6) AS share FROM g GROUP BY 1"""
)
def angle_shares(spark, d):
    """Shares of the smallest angles, out of a mesh's report."""
    t = quads(spark, d).select(F.col("id").alias("tid"), triangle("b", "c", "e").alias("tri"))
    rep = aggs.triangle_report(t, 6).select(F.posexplode("angle_shares").alias("bin", "share"))
    return rep.where("share > 0").select("bin", r(F.col("share"), 6).alias("share"))


@query("SELECT n_nationkey AS nation, 125.0::DOUBLE AS area, true AS short, true AS wide FROM nation")
def mesh_flow(spark, d):
    """For every nation two squares, one within the other but apart from it, one of whose sides is drawn twice."""
    rows = []
    for j, box_ in enumerate(((0, 0, 10, 10), (2, 2, 7, 7))):
        x0, y0, x1, y1 = map(float, box_)
        rows += [(4 * j + i, *s) for i, s in enumerate(((x0, y0, x1, y0), (x1, y0, x1, y1), (x1, y1, x0, y1), (x0, y1, x0, y0)))]
    lines = spark.createDataFrame([*rows, (8, 0.0, 0.0, 10.0, 0.0)], "i int, x0 double, y0 double, x1 double, y1 double")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).crossJoin(F.broadcast(lines))  # nine lines
    s = n.select((F.col("k") * 100 + F.col("i")).alias("id"), segment(point(F.col("x0") + 20 * F.col("k"), "y0"), point(F.col("x1") + 20 * F.col("k"), "y1")).alias("seg"))
    t = mesh.mesh_flow(s, 5.0, 1e-6, 4.0, 20.0, "ruppert")
    tri, name = F.col("tri"), F.floor(F.col("tri.p0.x") / 20).cast("int").alias("nation")
    least = F.degrees(F.array_min(vectors.interior_angles(tri["p0"], tri["p1"], tri["p2"])))
    return t.groupBy(name).agg(r(F.sum(shapes.triangle_area(tri))).alias("area"), (F.max(F.array_max(shapes.triangle_edges(tri))) <= 4 + 1e-9).alias("short"), (F.min(least) >= 20 - 1e-6).alias("wide"))


@query("SELECT count(*) AS objects, 3 AS levels, 21 AS nodes, true AS below, count(*) AS in_small FROM part")
def rectangle_tree(spark, d):
    """Levels of a sorted tree, and its highest nodes below an area: the lowest level's, if the area is just above theirs."""
    t = Scratch(spark, "tree").write(grid.rect_tree(part_boxes(spark, d), 16), "nodes")
    sizes = t.groupBy("level").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("nodes"))
    area = t.where("level = 2").agg(F.max(shapes.box_area(F.col("box")))).first()[0]
    small = grid.top_nodes_below(t, area * (1 + 1e-9))
    whole = sizes.agg(F.max("n").alias("objects"), F.count(F.lit(1)).cast("int").alias("levels"), F.sum("nodes").cast("int").alias("nodes"))
    return whole.crossJoin(small.agg((F.max(shapes.box_area(F.col("box"))) <= area).alias("below"), F.sum("n").alias("in_small")))  # one row each


@query(f"WITH {TREE}, s AS (SELECT node, length(node) AS l, list_reduce(list_prepend(0, list_transform(string_split(node, ''), lambda c: CASE WHEN c IN ('1', '2') THEN 1 ELSE 0 END)), lambda a, b: 2 * a + b) AS x, list_reduce(list_prepend(0, list_transform(string_split(node, ''), lambda c: CASE WHEN c IN ('2', '3') THEN 1 ELSE 0 END)), lambda a, b: 2 * a + b) AS y FROM leaf), b AS (SELECT node, x / pow(2, l) AS x0, (x + 1) / pow(2, l) AS x1, y / pow(2, l) AS y0, (y + 1) / pow(2, l) AS y1 FROM s) SELECT a.node AS leaf, CASE WHEN a.x1 = o.x0 THEN 'E' WHEN a.x0 = o.x1 THEN 'W' WHEN a.y1 = o.y0 THEN 'N' ELSE 'S' END AS side, o.node AS other FROM b a JOIN b o ON a.node <> o.node AND ((a.x1 = o.x0 OR a.x0 = o.x1) AND a.y0 < o.y1 AND o.y0 < a.y1 OR (a.y1 = o.y0 OR a.y0 = o.y1) AND a.x0 < o.x1 AND o.x0 < a.x1)")
def quad_tree_neighbours(spark, d):
    t = grid.quad_tree(events_points(spark, d).select("id", "p"), (0.0, 0.0, 9000.0, 500.0), 50, 8)
    return grid.beside(t, 8)


@query("SELECT lang AS key, count(*) AS n, (SELECT count(*) FROM documents) AS rows, (SELECT count(*) FROM documents) * 2 AS pairs, (SELECT count(DISTINCT lang) + max((lang IS NULL)::INTEGER) + 1 FROM documents) AS keys FROM documents GROUP BY 1 UNION ALL SELECT 'all', count(*), count(*), count(*) * 2, (SELECT count(DISTINCT lang) + max((lang IS NULL)::INTEGER) + 1 FROM documents) FROM documents")
def job_counters(spark, d):
    docs = table(spark, d, "documents")
    pairs = F.array(F.struct(F.col("lang").alias("key"), F.lit(1).alias("value")), F.struct(F.lit("all").alias("key"), F.lit(1).alias("value")))
    out, done = mapreduce.run_job(docs, pairs, {"n": F.sum})
    return out.select("key", "n", F.lit(done.rows).cast("long").alias("rows"), F.lit(done.pairs).cast("long").alias("pairs"), F.lit(done.keys).cast("long").alias("keys"))


@query(f"WITH {BOXES}, c AS (SELECT *, id % 3 AS p FROM boxes) SELECT least(a.p, b.p)::INTEGER AS low, greatest(a.p, b.p)::INTEGER AS high, round(sum((least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin)) * (least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin))), 3) AS area FROM c a JOIN c b ON a.id < b.id AND a.p <> b.p AND a.xmin < b.xmax AND b.xmin < a.xmax AND a.ymin < b.ymax AND b.ymin < a.ymax GROUP BY 1, 2")
def shared_areas(spark, d):
    p = part_boxes(spark, d).select((F.col("id") % 3).cast("int").alias("p"), polygon(shapes.box_ring(F.col("box"))).alias("polygon"))
    return polygons.shared_areas(p, "p", 5.0, shapes.polygon_area).groupBy("low", "high").agg(r(F.sum(F.col("n") * F.col("value")), 3).alias("area"))


@query(f"""WITH RECURSIVE {BOXES}, c AS (SELECT *, (id % 40)::BIGINT AS p FROM boxes), e AS MATERIALIZED (SELECT DISTINCT a.p AS x, b.p AS y FROM c a JOIN c b ON a.p <> b.p AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax),
w AS (SELECT DISTINCT p AS x, p AS y FROM c UNION SELECT w.x, e.y FROM w JOIN e ON w.y = e.x) SELECT l.y AS p, count(*) AS n FROM c JOIN (SELECT x, min(y) AS y FROM w GROUP BY x) l ON c.p = l.x GROUP BY 1""")
def smallest_properties(spark, d):
    k = F.col("id") % 40
    p = part_boxes(spark, d).select(k.cast("long").alias("p"), polygon(shapes.box_ring(F.col("box"))).alias("polygon"))
    return polygons.smallest_property(p, "p", 5.0).groupBy("p").agg(F.count(F.lit(1)).alias("n"))


# Numbers, texts, circuits.


@query("SELECT p_partkey AS id, true AS fast, round(p_size * pi() / 180, 6) AS radians, round(p_size::DOUBLE, 6) AS degrees, (127 + floor(log2(p_size))::BIGINT) * 8388608 + ((p_size::DOUBLE / pow(2, floor(log2(p_size))) - 1) * 8388608)::BIGINT AS bits, true AS between FROM part")
def numbers(spark, d):
    v = F.col("p_size").cast("double")
    close = [F.abs(mathx.fast(n, x) - f) < 2e-4 for n, x, f in (("sin", v / 20, F.sin(v / 20)), ("cos", v / 20, F.cos(v / 20)), ("log2", v, F.log2(v)), ("log", v, F.log(v)), ("exp", v / 20, F.exp(v / 20)), ("pow2", v / 20, F.pow(F.lit(2.0), v / 20)))]
    fast = close[0]
    for c in close[1:]:
        fast = fast & c
    at = mathx.random_between(3.0, 5.0, 7)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), fast.alias("fast"), r(mathx.rad(v), 6).alias("radians"), r(mathx.deg(mathx.rad(v)), 6).alias("degrees"), F.conv(mathx.to_bits(v), 2, 10).cast("long").alias("bits"), ((at >= 3) & (at < 5)).alias("between"))


@query("SELECT p_partkey AS id, 'part ' || p_partkey || ' of ' || p_brand AS line, p_brand || CASE WHEN p_partkey < 100000 THEN lpad(p_partkey::VARCHAR, 5, '0') ELSE p_partkey::VARCHAR END AS numbered, p_size || '-' || p_partkey AS joined, true AS same, ['ns', 'us', 'ms', 's'][1 + p_partkey % 4] AS unit FROM part")
def texts_made(spark, d):
    k, unit = F.col("p_partkey"), F.element_at(F.array(*map(F.lit, ("nanosecond", "microsecond", "millisecond", "second"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    same = (text.hashed("p_name", "p_size") == text.hashed("p_name", "p_size")) & (text.unordered_hash(F.array("p_name", "p_brand")) == text.unordered_hash(F.array("p_brand", "p_name"))) & (text.ordered_hash(F.array("p_name", "p_brand")) != text.ordered_hash(F.array("p_brand", "p_name")))
    return table(spark, d, "part").select(
        k.alias("id"), text.format_text("part %d of %s", k, "p_brand").alias("line"), text.append_int("p_brand", k, 5).alias("numbered"), text.join_values(F.array(F.col("p_size").cast("string"), k.cast("string")), "-").alias("joined"), same.alias("same"), text.time_unit_text(unit).alias("unit")
    )


@query("SELECT n_nationkey::BIGINT AS id, false AS singular, round(-((1 + n_nationkey % 3) * 3e-3 + (2 + n_nationkey % 5) * 1e-3), 9) AS delay, true AS settled, true AS kept, round(3e-3, 9) AS total_c FROM nation")
def circuit_measures(spark, d):
    """Two resistors and two capacitors for each nation: the first moment is the sum of resistances to a capacitor times its
    capacity; the reduced circuit keeps it; a load's model holds all capacity."""
    import pandas as pd

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for n in frame["id"]:
            r1, r2 = 1.0 + n % 3, 2.0 + n % 5
            g, c, b, l = circuit.matrices(3, [("R", 0, 1, r1), ("R", 1, 2, r2), ("C", 1, -1, 2e-3), ("C", 2, -1, 1e-3)], [0])
            m = circuit.moments(c, g, b, l, 2)
            small = circuit.prima(g, c, b, l, 2)
            again = circuit.moments(small[1], small[0], small[2], small[3], 2)
            last = circuit.simulate(g, c, b, l, lambda t: [1.0], 2e-4, 3000)[-1]
            near, _, far = circuit.pi_model(g, c, b, l)
            rows.append((n, bool(circuit.is_singular(g)), round(float(m[1][2, 0]), 9) + 0.0, bool(abs(last[2] - 1) < 1e-6), bool(abs(again[1] - m[1]).max() < 1e-9), round(abs(near) + abs(far), 9)))
        return pd.DataFrame(rows, columns=["id", "singular", "delay", "settled", "kept", "total_c"])

    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"))
    return n.groupBy("id").applyInPandas(run, "id long, singular boolean, delay double, settled boolean, kept boolean, total_c double")


# Files, written and read again.


@query(f"WITH {BOXES} SELECT count(*) AS n, round(sum((xmax - xmin) * (ymax - ymin)), 3) AS area FROM boxes")
def wkt_files(spark, d):
    path = f"{Scratch(spark, 'wkt').base}/polygons"
    wkt.write(part_boxes(spark, d), wkt.polygon_text(polygon(shapes.box_ring(F.col("box")))), path)
    rows = wkt.read(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.sum(shapes.polygon_area(wkt.parse_polygon(F.col("wkt")))), 3).alias("area"))


@query("SELECT count(*) AS n, round(sum(p_retailprice), 3) AS x, round(sum(p_size * 1.5), 3)::DOUBLE AS y FROM part")
def node_files(spark, d):
    path = f"{Scratch(spark, 'nodes').base}/nodes"
    p = table(spark, d, "part").select(F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_retailprice").cast("string"), (F.col("p_size") * 1.5).cast("string")).alias("value"))
    p.unionByName(p.agg(F.concat(F.count(F.lit(1)).cast("string"), F.lit(" 2 0 0")).alias("value"))).write.text(path)
    rows = mesh_files.read_nodes(spark, path)
    return rows.agg(F.count(F.lit(1)).alias("n"), r(F.sum("p.x"), 3).alias("x"), r(F.sum("p.y"), 3).alias("y"))


@query("SELECT 'nation' || n_nationkey || '.name' AS key, n_name AS value FROM nation UNION ALL SELECT 'nation' || n_nationkey || '.region', n_regionkey::VARCHAR FROM nation")
def config_rows(spark, d):
    path = f"{Scratch(spark, 'config').base}/nations"
    n = table(spark, d, "nation").orderBy("n_nationkey").coalesce(1)
    lines = F.array(F.concat(F.lit("[nation"), F.col("n_nationkey").cast("string"), F.lit("]  # a section")), F.concat(F.lit("name = "), F.col("n_name")), F.concat(F.lit("region="), F.col("n_regionkey").cast("string")))
    n.select(F.explode(lines).alias("value")).write.text(path)
    return config.read(spark, path).select("key", "value")
