"""Copies of the same shape meet others as one; results are as those of every row with every row."""

import itertools
import random

from pyspark.sql import functions as F

from terraloom.functions.types import box, box3, point
from terraloom.operators import joins


def solid(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, z double, s double").select("id", box3("x", "y", "z", *(F.col(c) + F.col("s") for c in "xyz")).alias("box"))


def test_equal_boxes_in_space_meet_as_one(spark):
    rnd = random.Random(1)
    shapes = [(float(rnd.randrange(20)), float(rnd.randrange(20)), float(rnd.randrange(4)), float(1 + rnd.randrange(3))) for _ in range(40)]
    rows = [(k, *shapes[k % 40]) for k in range(400)] + [(7, 1.0, 1.0, 1.0, 2.0)] * 2 + [(None, 1.0, 1.0, 1.0, 2.0)]
    b = solid(spark, rows)
    want = sorted((p[0], q[0]) for p, q in itertools.product(rows, rows) if None not in (p[0], q[0]) and p[0] < q[0] and all(p[i] < q[i] + q[4] and q[i] < p[i] + p[4] for i in (1, 2, 3)))
    assert sorted(map(tuple, joins.box_join_3d(b, b, 3.0, self_join=True).collect())) == want
    held = joins.copies(b, ["box"], "a_ids", limit=4).collect()
    assert sorted(str(i) for r in held for i in r.a_ids) == sorted(str(r[0]) for r in rows)
    assert joins.copies(b, ["box"], "a_ids").count() <= len(set(shapes)) + 2


def test_equal_points_and_boxes_meet_as_one(spark):
    rnd = random.Random(2)
    pts = [(None if k % 50 == 0 else k, float(rnd.randrange(12)), float(rnd.randrange(12))) for k in range(600)]
    boxes = [(None if k == 5 else k, float(rnd.randrange(9)), float(rnd.randrange(9))) for k in range(60)] * 2
    p = spark.createDataFrame(pts, "id long, x double, y double").select("id", point("x", "y").alias("p"))
    b = spark.createDataFrame(boxes, "box_id long, x double, y double").select("box_id", box("x", "y", F.col("x") + 3, F.col("y") + 2).alias("box"))
    want = sorted(str((i, j)) for i, x, y in pts for j, u, v in boxes if u <= x <= u + 3 and v <= y <= v + 2)
    assert sorted(str(tuple(r)) for r in joins.point_in_box(p, b, 2.0).collect()) == want
    assert joins.copies(p, ["p"], "a_ids").count() <= 144 + 12


def test_nearest_of_many_copies(spark):
    rnd = random.Random(3)
    pts = [(k, float(k % 7) * 10, float(k % 5) * 10) for k in range(1400)]
    asked = [(k, float(rnd.randrange(70)), float(rnd.randrange(50))) for k in range(20)] * 3
    asked = [(i, x, y) for i, (_, x, y) in enumerate(asked)]
    p = spark.createDataFrame(pts, "id long, x double, y double").select("id", point("x", "y").alias("p"))
    q = spark.createDataFrame(asked, "q_id long, x double, y double").select("q_id", point("x", "y").alias("q"))
    for k in (1, 45):
        want = {i: [m for _, m in sorted(((x - u) ** 2 + (y - v) ** 2, m) for m, u, v in pts)[:k]] for i, x, y in asked}
        got = {i: [m for _, m in sorted((r["rank"], r.id) for r in rows)] for i, rows in itertools.groupby(sorted(joins.knn_2d(q, p, k, 200.0).collect(), key=lambda r: r.q_id), key=lambda r: r.q_id)}
        assert got == want
    # Of the copies in a place no more meet a query than can be in its result.
    met = []
    kept = joins._ringed
    joins._ringed = lambda asked, points, *rest: met.append((asked.count(), points.count())) or kept(asked, points, *rest)
    try:
        joins.knn_2d(q, p, 1, 200.0)
    finally:
        joins._ringed = kept
    assert met[0][0] <= 20 and met[0][1] == 35


def test_blocks_of_vectors_meet_once(spark, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    rnd = random.Random(4)
    rows = [(k % 290, [rnd.choice([0.3, 1.0, 4.0]) * rnd.random() for _ in range(3 + (k % 20 == 0))]) for k in range(300)]
    v = spark.createDataFrame(rows, "id long, v array<double>")
    met = []
    kept = DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, *rest: met.append(self.count()) or kept(self, *rest))
    want = sorted((i, j) for (i, x), (j, y) in itertools.product(rows, rows) if i < j and len(x) == len(y) and sum((p - q) ** 2 for p, q in zip(x, y)) <= 0.25)
    for other in (v, v.select("*")):
        assert sorted((r.a_id, r.b_id) for r in joins.radius_vectors(v, other, 0.5, block=20).collect()) == want and want
    assert met[0] < 0.7 * met[1]


def test_edges_are_made_once_for_all_rounds(spark, monkeypatch):
    from terraloom.operators import graph

    made = spark.sparkContext.accumulator(0)

    def edges(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    chain = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long").mapInArrow(edges, "src long, dst long")
    assert sorted(r.id for r in graph.reachable(chain, spark.createDataFrame([(0,)], "id long")).collect()) == list(range(7))
    assert made.value <= 12  # both ways


def test_equal_rings_are_clipped_once(spark, monkeypatch):
    from terraloom.functions.types import ring
    from terraloom.operators import grid

    clipped = []
    kept = grid._clipped
    monkeypatch.setattr(grid, "_clipped", lambda df, *rest: clipped.append(df.count()) or kept(df, *rest))
    rows = spark.range(60).select("id", ring(point(F.col("id") % 3, 0), point(F.col("id") % 3 + 2, 0), point(F.col("id") % 3, 2)).alias("r"), (F.col("id") % 2 == 1).alias("hole"))
    per = {r.id: r.s for r in grid.ring_cells(rows, F.col("r"), 1.0, 1.0).groupBy("id").agg(F.sum("ratio").alias("s")).collect()}
    assert per == {k: 2.0 for k in range(60)}
    solid = {(r.gx, r.gy): r.value for r in grid.density(rows.where("not hole or id < 2"), F.col("r"), F.col("hole"), 1.0, 1.0).collect()}
    assert sum(solid.values()) == 2.0 * (30 - 1)
    assert clipped == [3, 3]


def test_rays_end_where_triangles_do(spark, monkeypatch):
    from terraloom.functions.types import point3, triangle

    asked = []
    kept = joins.line_cells
    monkeypatch.setattr(joins, "line_cells", lambda x0, y0, x1, y1, cell: asked.append((x0, x1)) or kept(x0, y0, x1, y1, cell))
    t = spark.range(300).select((299 - F.col("id")).alias("tri_id"), triangle(point3(F.col("id") % 30, 0, F.col("id") % 2), point3(F.col("id") % 30 + 1, 0, 1), point3(F.col("id") % 30, 1, 1)).alias("tri"))
    rays = spark.range(40).select(F.col("id").alias("ray_id"), point3(F.col("id") % 4 + 0.25, 0.25, 9.0).alias("o"), point3(0.01, 0.0, -1.0).alias("d"))
    lines, different = joins._alike(rays, t)
    assert (lines.count(), different.count()) == (4, 30)
    got = {r.ray_id: r.tri_id for r in joins.first_hits(rays, t).collect()}
    # Ids grow from behind, so the smallest of the copies of triangle x is 29 - x.
    assert got == {k: 29 - k % 4 for k in range(40)}
    assert {r.ray_id for r in joins.any_hit(rays, t).collect()} == set(range(40))
    assert asked


def test_points_in_one_place_are_located_once(spark):
    from terraloom.functions.types import triangle
    from terraloom.operators import mesh

    p = spark.range(50).select("id", point(F.col("id") % 2 * 9 + 0.5, 0.25).alias("p"))
    t = spark.range(1, 40).select(F.col("id").alias("tid"), triangle(point(0, 0), point(F.when(F.col("id") > 3, 20.0).otherwise(2.0), 0), point(0, 2)).alias("tri"))
    assert {r.id: r.tid for r in mesh.locate(p, t, 5.0).collect()} == {k: 1 if k % 2 == 0 else 4 for k in range(50)}


def test_layers_of_copies_and_rectangles(spark, monkeypatch):
    from terraloom.functions import shapes
    from terraloom.functions.types import polygon
    from terraloom.operators import polygons

    rnd = random.Random(5)
    rows = [(k, k % 3, float(rnd.randrange(8)), float(rnd.randrange(8)), 1.0 + k % 2) for k in range(60)] * 2
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, "id long, layer long, x double, y double, s double").select("id", "layer", polygon(shapes.box_ring(box("x", "y", F.col("x") + F.col("s"), F.col("y") + F.col("s")))).alias("polygon"))
    layers = spark.createDataFrame([(1, 0)], "layer1 long, layer2 long")
    want = sorted((p[0], q[0]) for p, q in itertools.product(rows, rows) if p[0] < q[0] and (p[1] == q[1] or {p[1], q[1]} == {0, 1}) and all(p[i] <= q[i] + q[4] and q[i] <= p[i] + p[4] for i in (2, 3)))
    # Rectangles need no look at their edges.
    monkeypatch.setattr(joins, "polygons_touch", lambda a, b: F.raise_error(F.lit("edges")).cast("boolean"))
    assert sorted(map(tuple, joins.layered_connectivity(df, layers, 2.0).collect())) == want
    assert polygons.smallest_property(df, "layer", 2.0).count() == len(rows)


def test_rounds_of_nearest_end_when_all_queries_are_answered(spark, monkeypatch):
    p = spark.range(400).select("id", point(F.col("id") % 20 * 5.0, F.floor(F.col("id") / 20) * 5.0).alias("p"))
    p = p.unionByName(spark.createDataFrame([(400, 1e5, 1e5)], "id long, x double, y double").select("id", point("x", "y").alias("p")))
    q = spark.range(30).select(F.col("id").alias("q_id"), point(F.col("id") + 0.5, 50.0).alias("q"))
    rounds = []
    kept = joins._ringed
    monkeypatch.setattr(joins, "_ringed", lambda *a: rounds.append(a) or kept(*a))
    got = {r.q_id: r.id for r in joins.knn_2d(q, p, 1, 20.0).collect()}
    assert got == {k: 200 + min(range(20), key=lambda m: (abs(5 * m - k - 0.5), m)) for k in range(30)}
    assert len(rounds) == 1


def test_pairs_of_few_boxes_are_made_by_many_tasks(spark):
    # 64 places in cells of their own, 70 copies in each: few bytes, which Spark would put in one partition.
    rows = spark.range(64 * 70).select("id", box((F.col("id") % 64) * 10.0 + 1, F.lit(1.0), (F.col("id") % 64) * 10.0 + 2, F.lit(2.0)).alias("box"))
    pairs = joins.box_join(rows, rows, 5.0, self_join=True)
    made = [r.n for r in pairs.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(made) == 64 * 70 * 69 // 2 and len(made) >= 8 and max(made) < sum(made) / 3
    assert pairs.where("a_id >= b_id or a_id % 64 <> b_id % 64").isEmpty() and pairs.distinct().count() == sum(made)
