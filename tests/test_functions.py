import math

import pytest
from pyspark.sql import functions as F

from terraloom.functions import mathx, robust, shapes, text, transform, vectors
from terraloom.functions.types import box, point, point3, polygon, ring, segment, triangle
from terraloom.plans import boolexpr, taskflow


def one(spark, *columns):
    row = spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return row[0] if len(columns) == 1 else tuple(row)


def test_closest_points_and_distances(spark):
    plane = vectors.plane_by_points(point3(0, 0, 0), point3(1, 0, 1), point3(0, 1, 1))
    p = one(spark, vectors.closest_on_plane(point3(0, 0, 1), plane))
    assert [p.x, p.y, p.z] == pytest.approx([1 / 3, 1 / 3, 2 / 3])
    assert abs(one(spark, vectors.plane_distance(point3(0, 0, 1), plane))) == pytest.approx(math.sqrt(3) / 3)
    p, d = one(spark, vectors.closest_on_segment(point(0, 2), point(0, 0), point(2, 2)), vectors.point_segment_distance_sq(point(0, 2), point(0, 0), point(2, 2)))
    assert (p.x, p.y, d) == (1, 1, 2)
    assert one(spark, vectors.point_box_distance_sq(point(-1, -1), box(0, 0, 2, 2))) == 2


def test_angles(spark):
    got = one(spark, *[vectors.angle(point(x, y)) for x, y in ((1, 1), (-1, 1), (-1, -1), (1, -1))])
    assert got == pytest.approx([math.pi * k / 4 for k in (1, 3, 5, 7)])
    assert one(spark, vectors.inner_angle(point(0, 0), point(1, 0))) == 0


def test_cast_rounds_half_away(spark):
    p = one(spark, vectors.cast_point(point(-0.999, 1.999)))
    assert (p.x, p.y) == (-1, 2)


def test_circumcircle(spark):
    c = one(spark, vectors.circumcircle(point(0, 0), point(1, 0), point(1, 1)))
    assert (c.o.x, c.o.y, c.r) == pytest.approx((0.5, 0.5, math.sqrt(0.5)))
    flat = one(spark, vectors.circumcircle(point(-1, 0), point(0, 0), point(1, 0)))
    assert math.isfinite(flat.r)


def test_locations(spark):
    t = triangle(point(-2, 0), point(2, 0), point(0, 2))
    got = one(spark, *[shapes.point_triangle_location(point(x, y), t) for x, y in ((0, -1), (0, 0), (1, 1), (-1, 1), (0, 1), (3, 0))])
    assert got == (0, 1, 2, 3, 4, 0)
    assert one(spark, *[shapes.point_line_location(point(x, y), point(0, 0), point(2, 2)) for x, y in ((1, 1), (1, 0), (0, 1))]) == (0, 2, 1)


def test_segments(spark):
    a, b = segment(point(0, 0), point(2, 2)), segment(point(0, 2), point(2, 0))
    assert one(spark, shapes.segment_intersection(a, b))[0].asDict() == {"x": 1.0, "y": 1.0}
    overlap = one(spark, shapes.segment_intersection(a, segment(point(1, 1), point(5, 5))))
    assert sorted((p.x, p.y) for p in overlap) == [(1, 1), (2, 2)]
    assert one(spark, shapes.segments_intersect(a, segment(point(2, 2), point(3, 0)), True), shapes.segments_intersect(a, segment(point(2, 2), point(3, 0)), False)) == (True, False)
    assert one(spark, vectors.segment_distance(segment(point(0, 0), point(1, 0)), segment(point(0, 2), point(1, 3)))) == pytest.approx(2)


def test_polygons(spark):
    square = ring(point(0, 0), point(10, 0), point(10, 10), point(0, 10))
    hole = ring(point(4, 4), point(6, 4), point(6, 6), point(4, 6))
    p = polygon(square, F.array(hole))
    assert one(spark, shapes.polygon_area(p)) == 96
    assert one(spark, *[shapes.polygon_contains(p, point(x, y)) for x, y in ((1, 1), (5, 5), (4, 5), (10, 5), (11, 5))]) == (True, False, True, True, False)
    assert one(spark, shapes.polygon_contains(p, point(10, 5), False)) is False
    assert one(spark, shapes.signed_area(F.reverse(square))) == -100
    cleaned = one(spark, shapes.clean(ring(point(0, 0), point(5, 0), point(10, 0), point(10, 10), point(10, 10), point(0, 10))))
    assert len(cleaned) == 4


def test_transform(spark):
    m = transform.Affine.shift(1, 2) @ transform.Affine.rotate(math.pi / 2)
    p = one(spark, m.point(point(1, 0)))
    assert (p.x, p.y) == pytest.approx((1, 3))
    q = one(spark, m.inverse().point(point(1, 3)))
    assert (q.x, q.y) == pytest.approx((1, 0))
    with pytest.raises(ValueError):
        transform.Affine.scale(0, 1).inverse()


def test_quaternions(spark):
    q = vectors.quat_by_axis(point3(0, 0, 1), math.pi / 2)
    v = one(spark, vectors.quat_rotate(q, point3(1, 0, 0)))
    assert (v.x, v.y, v.z) == pytest.approx((0, 1, 0))
    h = one(spark, vectors.slerp(vectors.quat_by_axis(point3(0, 0, 1), 0.0), q, 0.5))
    assert h.z == pytest.approx(math.sin(math.pi / 8))
    e = one(spark, vectors.quat_exp(vectors.quat_log(q)))
    assert (e.w, e.z) == pytest.approx((math.cos(math.pi / 4), math.sin(math.pi / 4)))


def test_numbers(spark):
    assert one(spark, mathx.to_bits(0.0003153)) == f"{__import__('struct').unpack('>I', __import__('struct').pack('>f', 0.0003153))[0]:032b}"
    assert one(spark, mathx.to_bits(-1.5), mathx.to_bits(0.0)) == ("1" + "01111111" + "1" + "0" * 22, "0" * 32)
    assert one(spark, mathx.round_digits(123456.0, 3), mathx.round_digits(0.0, 3)) == (123000.0, 0.0)
    assert one(spark, mathx.next_pow_two(4), mathx.next_pow_two(5), mathx.prev_pow_two(5)) == (4, 8, 4)
    assert one(spark, mathx.is_negative(F.lit(-0.0)), mathx.is_negative(0.0), mathx.is_negative(-1.0)) == (True, False, True)
    assert one(spark, mathx.within(1.0, 1.0, 2.0), mathx.within(1.0, 1.0, 2.0, "open"), mathx.within(1.0, 1.0, 2.0, "left_open"), mathx.within(1.0, 1.0, 2.0, "right_open")) == (True, False, False, True)
    root = one(spark, mathx.bisection(lambda x: x - 10 + 10 * F.exp(-(10 + x) / 10), 0.0, 10.0))
    assert root == pytest.approx(8.41406, abs=1e-4)
    assert one(spark, mathx.newton(lambda x: x * x - 2, lambda x: 2 * x, 1.0)) == pytest.approx(math.sqrt(2))
    assert one(spark, mathx.poly_val([2.0, -1.0], 3.0), mathx.poly_val([2.0, -1.0], 4.0)) == (-1, -2)


def test_text(spark):
    s = F.lit("hello world")
    assert one(spark, *[text.wildcard(s, p) for p in ("hello*", "*world*", "hello?world", "hello?world*", "hell.")]) == (True, True, True, True, False)
    assert one(spark, text.split(F.lit(" a,,b c"), " ,")) == ["a", "b", "c"]
    assert one(spark, text.version_pack(F.lit(1), F.lit(2), F.lit(3)), text.version_text(F.lit(911126))) == (102003, "9.11.126")
    a, b = F.array(*map(F.lit, (1.0, 2.0, 3.0))), F.array(*map(F.lit, (3.0, 1.0, 2.0)))
    h = one(spark, text.ordered_hash(a), text.ordered_hash(b), text.unordered_hash(a), text.unordered_hash(b))
    assert h[0] != h[1] and h[2] == h[3]
    assert one(spark, text.dir_name(F.lit("/a/b/c.tar.gz")), text.file_name(F.lit("/a/b/c.tar.gz")), text.base_name(F.lit("/a/b/c.tar.gz"))) == ("/a/b", "c.tar.gz", "c.tar")
    assert one(spark, text.append_int(F.lit("n"), F.lit(7), 3), text.append_int(F.lit("n"), F.lit(12345), 3)) == ("n007", "n12345")


def test_robust_signs(spark):
    rows = [(0.1, 0.1, 0.3, 0.3, 0.2, 0.2), (0.0, 0.0, 1.0, 1.0, 0.5, 0.5 + 2**-53), (0.0, 0.0, 1.0, 0.0, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "ax double, ay double, bx double, by double, cx double, cy double").select(*[point(f"{k}x", f"{k}y").alias(k) for k in "abc"])
    got = [r["sign"] for r in robust.sign(df, "orient2d", ["a", "b", "c"]).orderBy("a.x", "c.y").collect()]
    want = sorted((r[0], r[5], robust.exact("orient2d", [r[:2], r[2:4], r[4:]])) for r in rows)
    assert got == [w[2] for w in want]
    assert robust.exact("in_circle", [(0, 0), (1, 0), (0, 1), (0.5, 0.5)]) == 1
    assert robust.exact("in_circle", [(0, 0), (1, 0), (0, 1), (1, 1)]) == 0


def test_boolean_expressions(spark):
    assert str(boolexpr.parse(r"a_\[999] & b ^ (c & d | a & b)")) == "((a_[999] & b) ^ ((c & d) | (a & b)))"
    with pytest.raises(boolexpr.ParseError, match=r'Unexpected end of content. expecting "\)" line 1'):
        boolexpr.parse("(a & bbb[0]) ^ ((c & d) | (a & b)")
    with pytest.raises(boolexpr.ParseError):
        boolexpr.parse("a b")
    names = {"a": F.lit(True), "b": F.lit(False)}
    assert one(spark, boolexpr.compile_expression("!a | a & !b", names.__getitem__), boolexpr.compile_expression("a ^ a", names.__getitem__)) == (True, False)


def test_task_flow():
    flow = taskflow.TaskFlow()
    flow.add("start", lambda: 0).add("div5", lambda v: v / 5, ["start"]).add("mul4", lambda v: v * 4, ["div5"])
    flow.add("add2", lambda v: v + 2, ["mul4"]).add("sub3", lambda v: v - 3, ["mul4"]).add("end", lambda a, b: a + b + 43, ["add2", "sub3"])
    assert flow.run() and flow.results["end"] == 42
    assert not flow.run()
    with pytest.raises(taskflow.CycleError):
        taskflow.TaskFlow().add("a", print, ["b"]).add("b", print, ["a"]).run()
    assert '"div5" -> "mul4"' in flow.graph()
