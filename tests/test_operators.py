import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraloom.functions import shapes
from terraloom.functions.types import box, box3, point, point3, polygon, ring, segment, triangle
from terraloom.operators import aggs, circuit, clip, graph, grid, joins, mesh, polygons, series
from terraloom.sources import config, mesh_files, wkt
from terraloom.streaming import density


def square(a, b):
    return [(a, a), (b, a), (b, b), (a, b)]


def test_boolean_areas():
    a, b = [square(0, 5)], [square(2, 7)]
    for operation, area, pieces in (("union", 41, 1), ("difference", 16, 1), ("intersection", 9, 1), ("xor", 32, 2)):
        got = clip.clip(a, b, operation)
        assert (clip.total_area(got), len(got)) == (area, pieces)
    assert clip.clip([], [], "union") == []


def test_random_polygons_obey_inclusion_exclusion():
    rnd = random.Random(3)
    for _ in range(20):
        a, b = ([[(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(5)]] for _ in range(2))
        u, i, d, x = (clip.total_area(clip.clip(a, b, o)) for o in ("union", "intersection", "difference", "xor"))
        assert u == pytest.approx(x + i) and u == pytest.approx(clip.total_area(clip.clip(b, [], "union")) + d)


def test_merge_keeps_holes(spark):
    hole = ring(*[point(x, y) for x, y in square(20, 80)])
    frame = polygon(ring(*[point(x, y) for x, y in square(0, 100)]), F.array(hole))
    bar = polygon(shapes.box_ring(box(40, 0, 60, 100)))
    df = spark.range(1).select(F.lit(0).alias("prop"), F.explode(F.array(frame, bar)).alias("polygon"))
    got = polygons.merge_by_property(df, "prop", 50.0).collect()
    assert len(got) == 1 and len(got[0].polygon.holes) == 2


def test_rounding_hulls_paths():
    r = polygons.round_corners(square(0, 10), 2.0, 100)
    assert clip.area(r) == pytest.approx(96.566, rel=1e-3)
    assert polygons.round_corners(square(0, 1), 2.0) == square(0, 1)
    assert clip.area(clip.hull([(0, 0), (1, 0), (1, 1), (0, 1), (0.5, 0.5)])) == 1
    assert clip.area(polygons.path_outline([(0, 0), (10, 0)], 2)) == pytest.approx(20)
    assert clip.area(polygons.path_outline([(0, 0), (10, 0), (10, 10)], 2)) == pytest.approx(40)
    assert polygons.trapezoid([(0, 0), (4, 0), (3, 2), (1, 2)]) == ("horizontal", (0, 0), (1, 2), 4, 2)
    parts = polygons.simplify([(0, 0), (10, 0), (10, 10), (0, 10), (0, 0), (2, 2), (2, 4), (4, 4), (4, 2), (2, 2)])
    assert clip.total_area(parts) == pytest.approx(96)


def test_collisions_rays(spark):
    b = spark.createDataFrame([(0, 0.0, 2.0), (1, 1.0, 3.0), (2, 3.0, 5.0)], "id int, a double, b double").select("id", box3("a", "a", "a", "b", "b", "b").alias("box"))
    assert [tuple(r) for r in joins.box_join_3d(b, b, 2.0, self_join=True).collect()] == [(0, 1)]
    t = spark.range(1).select(F.explode(F.array(F.struct(F.lit(0).alias("tri_id"), triangle(point3(0, 0, 0), point3(1, 0, 1), point3(0, 1, 1)).alias("tri")), F.struct(F.lit(1).alias("tri_id"), triangle(point3(0, 0, 0.5), point3(0.5, 0, 1), point3(0, 0.5, 1)).alias("tri")))).alias("s")).select("s.*")
    rays = spark.range(1).select(F.lit(9).alias("ray_id"), point3(0, 0, 1).alias("o"), point3(1, 1, -1).alias("d"))
    hit = joins.first_hits(rays, t).first()
    assert (hit.tri_id, hit.t, hit.u, hit.v) == pytest.approx((1, 1 / 6, 1 / 3, 1 / 3))


def test_nearest_matches_brute_force(spark):
    rnd = np.random.default_rng(5)
    p = np.vstack([rnd.uniform(0, 100, (300, 2)), rnd.uniform(1000, 1001, (20, 2))])
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(p)], "id int, x double, y double").select("id", point("x", "y").alias("p"))
    q = df.where("id % 40 = 0").select(F.col("id").alias("q_id"), F.col("p").alias("q"))
    got = {(r.q_id, r["rank"]): r.id for r in joins.knn_2d(q, df, 7, 3.0, exclude_same=True).collect()}
    for i in range(0, len(p), 40):
        d = ((p - p[i]) ** 2).sum(1)
        d[i] = np.inf
        order = np.lexsort((np.arange(len(p)), d))[:7]
        assert [got[i, k + 1] for k in range(7)] == order.tolist()


def test_connectivity_of_layers(spark):
    def row(i, layer, o, holes=()):
        return i, layer, ([{"x": float(x), "y": float(y)} for x, y in o], [[{"x": float(x), "y": float(y)} for x, y in h] for h in holes])

    schema = "id int, layer int, polygon struct<outline:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>"
    rows = [row(0, 0, square(-2, 2)), row(1, 1, square(-30, 30), [square(-20, 20)]), row(2, 2, square(25, 40)), row(3, 2, square(40, 50)), row(4, None, square(-2, 2))]
    o = spark.createDataFrame(rows, schema)
    layers = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "layer1 int, layer2 int")
    wire = spark.range(1).select(F.lit(0).alias("layer1"), F.lit(2).alias("layer2"), segment(point(0, 0), point(45, 45)).alias("segment"))
    e = joins.layered_connectivity(o, layers, 20.0)
    assert sorted(tuple(r) for r in e.collect()) == [(1, 2), (2, 3)]
    with_wire = joins.layered_connectivity(o, layers, 20.0, wire).select(F.col("a_id").alias("src"), F.col("b_id").alias("dst"))
    c = {r.id: r.component for r in graph.connected_components(o.select("id"), with_wire).collect()}
    assert c == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4}


def test_components_of_chains(spark):
    rnd = random.Random(1)
    order = list(range(200))
    rnd.shuffle(order)
    e = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:100] + order[101:])][:-1], "src long, dst long")
    c = {r.id: r.component for r in graph.connected_components(spark.range(200), e).collect()}
    import collections

    nxt = collections.defaultdict(set)
    for r in e.collect():
        nxt[r.src].add(r.dst), nxt[r.dst].add(r.src)
    for v in range(200):
        seen, todo = {v}, [v]
        while todo:
            for w in nxt[todo.pop()] - seen:
                seen.add(w), todo.append(w)
        assert c[v] == min(seen)


def test_random_trees(spark):
    for kind in ("random", "tall", "star", "chain", "silkworm"):
        e = graph.random_tree(spark, 30, kind)
        assert e.count() == 29 and e.where("src < 0 or src >= dst").count() == 0


def test_moving_average_of_few_values(spark):
    df = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 6.0)], "pos int, v double").withColumn("k", F.lit(1))
    plain = [r.sma for r in series.moving_average(df, ["k"], ["pos"], "v", 1).orderBy("pos").collect()]
    assert plain == pytest.approx([4 / 3, 3, 14 / 3])
    rec = [r.sma for r in series.recursive_average(df, ["k"], ["pos"], "v", 1).orderBy("pos").collect()]
    assert rec == pytest.approx([4 / 3, (4 / 3 + 2 + 6) / 3, ((4 / 3 + 8) / 3 + 12) / 3])


def test_interpolation(spark):
    xs = [0.0, 1.0, 3.0, 5.0, 9.0]
    df = spark.createDataFrame([(1, x, x**3 + 2 * x**2 + 3 * x + 4) for x in xs], "k int, x double, y double")
    for pieces in (series.cubic_pieces(df, ["k"], "x", "y"), series.pchip_pieces(df, ["k"], "x", "y"), series.linear_pieces(df, ["k"], "x", "y")):
        got = {r.x: r.yq for r in series.evaluate(df.select("k", "x"), pieces, ["k"], "x").collect()}
        assert [got[x] for x in xs] == pytest.approx([x**3 + 2 * x**2 + 3 * x + 4 for x in xs])
    v = spark.range(1).select(series.lookup(F.lit(2.0), [1, 3], [2, 4]), series.lookup(F.lit(9.0), [1, 3], [2, 4]), series.lookup(F.lit(9.0), [1, 3], [2, 4], True), series.lookup(F.lit(9.0), [1], [2])).first()
    assert tuple(v) == (3, 4, 10, 2)


def test_aggregates(spark):
    df = spark.createDataFrame([(0.0, 2.0), (1.0, 1.0), (2.0, 0.0)], "x double, y double")
    assert aggs.poly_fit(df, F.col("x"), F.col("y"), 1) == pytest.approx([2, -1])
    assert aggs.poly_fit(df.where("false"), F.col("x"), F.col("y"), 1) == []
    m = df.where("x = 0").agg(aggs.mean_and_variance("y").alias("m")).first().m
    assert (m.mean, m.variance) == (2, 0)
    assert df.where("false").agg(aggs.point_extent("x", "y").alias("e")).first().e is None


def test_grids(spark):
    p = spark.range(1).select(grid.cell_of(F.lit(-10.0), 10.0).alias("a"), grid.cell_of(F.lit(-10.0), 10.0, compat=True).alias("b"), grid.cell_of(F.lit(15.0), 10.0, compat=True).alias("c")).first()
    assert tuple(p) == (-1, -2, 1)
    t = spark.range(1).select(ring(point(0, 0), point(4, 0), point(0, 4)).alias("r"))
    cells = grid.ring_cells(t, F.col("r"), 1.0, 1.0)
    assert cells.agg(F.sum("ratio")).first()[0] == pytest.approx(8)
    line = spark.range(1).select(grid.rasterize_segment(point(0.5, 0.5), point(3.5, 1.5), 1.0, 1.0).alias("c")).first().c
    assert len(line) == 3 and (line[0].gx, line[0].gy) == (0, 0)


def test_delaunay(spark):
    rnd = random.Random(4)
    pts = [(rnd.uniform(0, 10), rnd.uniform(0, 10)) for _ in range(40)]
    tris = mesh.delaunay(pts)
    assert sum(abs(clip.area([pts[i] for i in t])) for t in tris) == pytest.approx(clip.area(clip.hull(pts)))
    for a, b, c in tris:
        assert not any(mesh.in_circle(pts[a], pts[b], pts[c], p) > 0 for p in pts)
    edge = (0, max(range(1, 40), key=lambda k: math.dist(pts[0], pts[k])))
    fixed = mesh.edges_of(mesh.delaunay(pts, [edge]))
    assert edge in fixed
    outer, inner = square(0.0, 10.0), square(4.0, 6.0)
    all_points = outer + inner
    kept = mesh.delaunay(all_points, [(i, (i + 1) % 4) for i in range(4)] + [(4 + i, 4 + (i + 1) % 4) for i in range(4)], [outer, inner])
    assert sum(clip.area([all_points[i] for i in t]) for t in kept) == pytest.approx(96)
    more, fine = mesh.refine(outer, [outer], 20.0, 4.0)
    assert sum(clip.area([more[i] for i in t]) for t in fine) == pytest.approx(100)
    assert all(math.dist(more[a], more[b]) <= 4.0 + 1e-9 for a, b in mesh.edges_of(fine))
    df = spark.createDataFrame([(0, i, x, y) for i, (x, y) in enumerate(pts)], "k int, id long, x double, y double").select("k", "id", point("x", "y").alias("p"))
    assert mesh.triangulate(df, ["k"]).count() == len(tris)


def test_circuit():
    g, c, b, l = circuit.matrices(3, [("R", 0, 1, 0.01), ("R", 1, 2, 100.0), ("C", 1, -1, 1e-12), ("C", 2, -1, 1e-12)], [0])
    y = circuit.simulate(g, c, b, l, lambda t: [0.88], 1e-14, 2000)
    assert y[-1, 1] == pytest.approx(0.88, abs=1e-3)
    m0 = circuit.moments(c, g, b, l, 1)[0]
    assert m0.ravel() == pytest.approx([1, 1, 1])
    gr, cr, br, lr, _ = circuit.prima(g, c, b, l, 3)
    assert circuit.moments(cr, gr, br, lr, 2)[1] == pytest.approx(circuit.moments(c, g, b, l, 2)[1], rel=1e-6)


def test_wkt(spark, tmp_path):
    (tmp_path / "a.wkt").write_text("# note\nBOX(0 0,2 3)\nPOINT(1 -2.5e0)\nPOLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,1 2,1 1))\n")
    df = wkt.read(spark, str(tmp_path / "a.wkt"))
    assert sorted(r.kind for r in df.collect()) == ["BOX", "POINT", "POLYGON"]
    p = df.where("kind = 'POLYGON'").select(wkt.parse_polygon(F.col("wkt")).alias("p")).first().p
    assert len(p.outline) == 3 and len(p.holes) == 1
    assert df.where("kind = 'POLYGON'").select(wkt.polygon_text(wkt.parse_polygon(F.col("wkt")))).first()[0] == "POLYGON((0 0,4 0,4 4,0 0),(1 1,2 1,1 2,1 1))"
    (tmp_path / "b.wkt").write_text("BOX(0 0,x 3)\n")
    with pytest.raises(Exception, match="not a geometry"):
        wkt.read(spark, str(tmp_path / "b.wkt")).collect()
    assert wkt.read(spark, str(tmp_path / "b.wkt"), strict=False).first().kind is None


def test_mesh_files(spark, tmp_path):
    points = [(0.0, 0.0), (1.0, 0.5), (2.0, 1.5)]
    (tmp_path / "m.node").write_text(mesh_files.node_text(points))
    got = mesh_files.read(spark, str(tmp_path / "m.node"), "node").orderBy("id").collect()
    assert [tuple(r["values"]) for r in got] == points
    spark.dataSource.register(mesh_files.MeshSource)
    assert spark.read.format("terraloom_mesh").option("kind", "node").load(str(tmp_path)).count() == 3
    poly = mesh_files.poly_text(points, [[[0, 1, 2]]], [(0.5, 0.5)])
    assert [r[0] for r in mesh_files.parse("poly", poly)] == ["node"] * 3 + ["facet", "hole"]
    with pytest.raises(ValueError):
        mesh_files.parse("node", "3 2\n0 1 1\n")
    (tmp_path / "t.txt").write_text(mesh_files.topology_text(points, [(0, 1), (1, 2)]))
    p, e = mesh_files.read_topology(spark, str(tmp_path / "t.txt"))
    assert p.count() == 3 and sorted(map(tuple, e.collect())) == [(0, 1), (1, 2)]


def test_config(spark, tmp_path):
    (tmp_path / "c.ini").write_text("top = 1\n[a]\nx=2 # note\n\n[b]\nx = y z\n")
    got = {r.key: r["value"] for r in config.read(spark, str(tmp_path / "c.ini")).collect()}
    assert got == {"top": "1", "a.x": "2", "b.x": "y z"}


def test_stream_density(spark, tmp_path):
    spark.createDataFrame([(1.0, 1.0), (1.5, 1.2), (9.0, 9.0)], "x double, y double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("x double, y double").parquet(str(tmp_path / "in"))
    q = density.point_density(stream, "x", "y", 5.0, 5.0).writeStream.outputMode("complete").format("memory").queryName("cells").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("cells").collect())) == [(0, 0, 2), (1, 1, 1)]


def test_split_of_all_segments_against_brute_force(spark, data):
    from terraloom.plans import catalog

    rows = catalog.user_segments(spark, data).select("id", "seg.s.x", "seg.s.y", F.col("seg.e.x").alias("u"), F.col("seg.e.y").alias("v")).toPandas()
    s, e = rows[["x", "y"]].to_numpy(), rows[["u", "v"]].to_numpy()

    def side(a, b, p):
        return np.sign((b[:, 0] - a[:, 0]) * (p[1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (p[0] - a[:, 0]))

    across = np.array([side(s, e, s[k]) * side(s, e, e[k]) < 0 for k in range(len(rows))])
    want = dict(zip(rows.id, 1 + (across & across.T).sum(axis=1)))  # ends that only touch cut nothing
    got = {r.id: r.parts for r in catalog.split_crossing_segments(spark, data).collect()}
    assert got == want
