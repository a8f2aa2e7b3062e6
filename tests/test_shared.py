"""What polygons of two properties have in common, with copies among them, and components finished on the driver."""

import random

import pytest
from pyspark.sql import functions as F

from terraloom.functions import shapes
from terraloom.operators import clip, graph, polygons


def ring(*pts):
    return [{"x": float(x), "y": float(y)} for x, y in pts]


def rectangle(x, y, w, h):
    return (ring((x, y), (x + w, y), (x + w, y + h), (x, y + h)), [])


def rows_of(spark, rows):
    kind = "prop int, polygon struct<outline:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>"
    return spark.createDataFrame(rows, kind)


def test_copies_and_rectangles_share_without_the_clipper(spark, monkeypatch):
    rnd = random.Random(1)
    known = [rectangle(rnd.randrange(8), rnd.randrange(8), 1 + rnd.randrange(3), 1 + rnd.randrange(3)) for _ in range(15)]
    rows = [(None if k == 4 else k % 3, known[k % 15]) for k in range(70)] + [(1, None)]
    monkeypatch.setattr(clip, "clip", lambda *a: pytest.fail("clipped"))
    want = {}
    for k, (p, a) in enumerate(rows):
        for q, b in rows[k + 1 :]:
            if None not in (p, q, a, b) and p != q:
                (x0, y0), (x1, y1) = ([f(a[0][i][c] for i in range(4)) for c in "xy"] for f in (min, max))
                (u0, v0), (u1, v1) = ([f(b[0][i][c] for i in range(4)) for c in "xy"] for f in (min, max))
                area = max(0.0, min(x1, u1) - max(x0, u0)) * max(0.0, min(y1, v1) - max(y0, v0))
                n, total = want.get((min(p, q), max(p, q)), (0, 0.0))
                want[min(p, q), max(p, q)] = n + (area > 0), total + area
    df = rows_of(spark, rows)
    got = polygons.shared_areas(df, "prop", 2.0, shapes.polygon_area)
    assert {(r.low, r.high): (r.n, r.a) for r in got.groupBy("low", "high").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("value")).alias("a")).collect()} == want
    each = polygons.shared_areas(df, "prop", 2.0).groupBy("low", "high").agg(F.count(F.lit(1)).alias("n"), F.sum(shapes.polygon_area(F.col("polygon"))).alias("a"))
    assert {(r.low, r.high): (r.n, r.a) for r in each.collect()} == want


def test_other_polygons_are_clipped(spark):
    triangle = (ring((0, 0), (4, 0), (0, 4)), [])
    rows = [(1, triangle), (2, triangle), (2, rectangle(0, 0, 2, 2)), (1, rectangle(1, 1, 4, 4)), (1, rectangle(1, 1, 4, 4))]
    got = polygons.shared_areas(rows_of(spark, rows), "prop", 2.0, shapes.polygon_area)
    # The triangle with itself 8, with the square 4, with the two others 2 each; the square with these 1 each.
    assert got.groupBy("low", "high").agg(F.sum("n"), F.sum(F.col("n") * F.col("value"))).collect() == [(1, 2, 6, 18.0)]


def test_components_finish_on_the_driver(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    vertices = spark.range(300)
    written = []
    kept = graph.Scratch.write
    monkeypatch.setattr(graph.Scratch, "write", lambda self, df, name: written.append(name) or kept(self, df, name))
    quick = sorted(map(tuple, graph.connected_components(vertices, edges).collect()))
    assert written == ["components-edges", "components-labels"]
    monkeypatch.setattr(graph, "FEW", 5)
    assert sorted(map(tuple, graph.connected_components(vertices, edges).collect())) == quick
    named = graph.connected_components(vertices.select(F.lpad(F.col("id").cast("string"), 3, "0").alias("id")), edges.select(*[F.lpad(F.col(c).cast("string"), 3, "0").alias(c) for c in ("src", "dst")]))
    assert sorted((int(r.id), int(r.component)) for r in named.collect()) == quick


def smallest(rows, touch):
    """(property, its smallest) of rows (prop, shape) by all pairs."""
    up = {p: p for p, _ in rows if p is not None}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (p, a) in enumerate(rows):
        for q, b in rows[:i]:
            if None not in (p, q, a, b) and touch(a, b):
                p_, q_ = root(p), root(q)
                up[max(p_, q_)] = min(p_, q_)
    return sorted((p, root(p)) for p, _ in rows if p is not None)


def rectangles_touch(a, b):
    return all(a[0][0][c] <= b[0][2][c] and b[0][0][c] <= a[0][2][c] for c in "xy")


def smallest_of(df):
    kept = df.select("prop", F.col("prop").alias("was"), "polygon")
    return sorted((r.was, r.prop) for r in polygons.smallest_property(kept, "prop", 2.0).where("was is not null").collect())


@pytest.mark.parametrize("kind", ["int", "string"])
def test_properties_of_rectangles_meet_without_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(polygons, "touching", lambda *a: pytest.fail("paired"))
    rnd = random.Random(3)
    rows = [(rnd.randrange(60), rectangle(rnd.randrange(-20, 20), rnd.randrange(-20, 20), rnd.choice([0.5, 1, 3]), rnd.choice([0.5, 1, 3]))) for _ in range(90)]
    rows += [*rows[:10], (99, rows[0][1]), (None, rows[1][1]), (100, None)]
    df = rows_of(spark, rows)
    want = smallest([(p if kind == "int" or p is None else str(p), a) for p, a in rows], rectangles_touch)
    assert 10 < len({p for _, p in want}) < 50  # neither alone nor all one
    assert smallest_of(df.withColumn("prop", F.col("prop").cast(kind))) == want


def test_properties_of_other_polygons_meet_rectangles(spark):
    triangle = (ring((0, 0), (4, 0), (0, 4)), [])
    framed = (ring((20, 0), (30, 0), (30, 10), (20, 10)), [ring((22, 2), (22, 8), (28, 8), (28, 2))])
    rows = [(5, triangle), (4, rectangle(2.5, 2.5, 1, 1)), (3, rectangle(1, 1, 1, 1)), (2, framed), (1, rectangle(24, 4, 1, 1)), (7, rectangle(30, 10, 1, 1)), (6, rectangle(3.5, 3.5, 1, 1)), (9, triangle)]
    assert smallest_of(rows_of(spark, rows)) == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 3), (6, 4), (7, 2), (9, 3)]


def test_a_cell_of_many_rectangles_gives_few_edges(spark):
    boxes = spark.range(4000).select((F.col("id") % 500).alias("prop"), shapes.box(F.lit(0.0), F.col("id") / 4000, F.lit(1.0), F.lit(1.5)).alias("box"))
    assert polygons.met_in_cells(boxes, 4.0).count() == 499
    apart = spark.range(3000).select("id", F.col("id").alias("prop"), shapes.box(F.lit(0.0), F.col("id") * 2.0, F.lit(1.0), F.col("id") * 2.0 + 1).alias("box"))
    assert polygons.met_in_cells(apart.select("prop", "box"), 10000.0).isEmpty()
