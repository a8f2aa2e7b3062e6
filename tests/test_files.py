import json
import os

import pytest
from pyspark.sql import functions as F

from terraloom.functions import shapes, text, types
from terraloom.operators import grid
from terraloom.plans import mapreduce
from terraloom.sources import archive, images, mesh_files


@pytest.mark.parametrize("alpha", [False, True])
def test_png_round_trip(alpha):
    import random

    n = 4 if alpha else 3
    raw = random.Random(1).randbytes(7 * 5 * n)
    for level in (0, 6):
        assert images.sized(images.png(7, 5, raw, alpha, level)) == (7, 5, raw)
    with pytest.raises(ValueError):
        images.png(7, 6, raw, alpha)


def test_grids_as_images(spark):
    cells = spark.createDataFrame([(0, 0, 1.0), (2, 1, 0.5), (2, 1, 0.2), (9, 9, 1.0), (1, 1, None)], "gx long, gy long, value double")
    w, h, raw = images.sized(images.draw(cells, 3, 2))
    assert (w, h) == (3, 2) and raw == bytes([0, 0, 0, 0, 0, 0, 128, 128, 128, 255, 255, 255, 0, 0, 0, 0, 0, 0])
    got = {(r.tx, r.ty): images.sized(bytes(r.png))[2] for r in images.tiles(cells, 2).collect()}
    assert set(got) == {(0, 0), (1, 0), (4, 4)} and got[1, 0][:3] == bytes([128] * 3) and got[4, 4][3:6] == bytes([255] * 3)
    assert images.outline_cells([(0, 0), (2, 0), (2, 2)]) == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (1, 1)]


@pytest.mark.parametrize("fmt", archive.FORMATS)
def test_archives(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, 2.5, None), (2, 0.1, "x")], "id int, v double, s string").withColumn("p", types.point("v", F.lit(1.0))).withColumn("ring", F.array("p", "p"))
    archive.save(df, f"{tmp_path}/a", 3, fmt)
    back = archive.load(spark, f"{tmp_path}/a", 3)
    assert back.schema.simpleString() == df.schema.simpleString() and sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    assert archive.version(spark, f"{tmp_path}/a") == 3
    with pytest.raises(ValueError):
        archive.load(spark, f"{tmp_path}/a", 2)
    with pytest.raises(ValueError):
        archive.save(df, f"{tmp_path}/b", 1, "bin")


def test_mesh_files_round_trip(spark, tmp_path):
    spark.dataSource.register(mesh_files.MeshSource)
    rows = [("", "node", 0, [0.0, 0.0]), ("", "node", 1, [1.5, 0.0]), ("", "node", 2, [0.0, 2.0]), ("", "edge", 0, [0.0, 1.0]), ("", "edge", 1, [1.0, 2.0]), ("", "ele", 0, [0.0, 1.0, 2.0]), ("", "facet", 0, [0.0, 1.0, 2.0]), ("", "hole", 0, [0.2, 0.2])]
    df = spark.createDataFrame(rows, "file string, table string, id long, values array<double>").coalesce(1)
    for kind, tables in (("node", {"node"}), ("edge", {"edge"}), ("ele", {"ele"}), ("poly", {"node", "facet", "hole"})):
        df.write.format("terraloom_mesh").option("kind", kind).mode("append").save(f"{tmp_path}/{kind}")
        got = spark.read.format("terraloom_mesh").option("kind", kind).load(f"{tmp_path}/{kind}").collect()
        assert sorted((r.table, r.id, list(r["values"])) for r in got) == sorted((t, i, v) for _, t, i, v in rows if t in tables), kind
    df.write.format("terraloom_mesh").option("kind", "vtk").mode("append").save(f"{tmp_path}/vtk")
    (name,) = os.listdir(f"{tmp_path}/vtk")
    assert "CELLS 1 4" in open(f"{tmp_path}/vtk/{name}").read()
    assert mesh_files.tree_dot([(0, 1), (0, 2)]).count("->") == 2 and "CELL_TYPES 1" in mesh_files.boxes_vtk([(0, 0, 0, 1, 1, 1)])


def test_parts_of_a_job(spark, tmp_path):
    df = spark.range(100).withColumn("k", F.col("id") % 7)
    mapreduce.write_parts(df, F.concat_ws(" ", "k", "id"), f"{tmp_path}/out", "sum", 3, ("k",))
    assert sorted(os.listdir(f"{tmp_path}/out")) == [f"sum{i}_of_3" for i in range(3)]
    held = [{line.split()[0] for line in open(f"{tmp_path}/out/sum{i}_of_3")} for i in range(3)]
    assert set().union(*held) == set("0123456") and sum(map(len, held)) == 7
    timers = mapreduce.Timers(spark, ["a", "b"])
    with timers.timed("a"):
        pass

    def run(frames):
        for frame in frames:
            with timers.timed("b"):
                yield frame

    df.select("id").repartition(4).mapInPandas(run, "id long").count()
    assert timers.count("a")[1] == 1 and timers.count("b")[1] >= 1 and timers.count("b")[0] >= 0


def test_kinds_names_and_parsers(spark):
    df = spark.createDataFrame([(1.0, 2.0, "7"), (3.0, 4.0, "x")], "x double, y double, s string").withColumn("p", types.point("x", "y"))
    df = df.withColumn("b", types.box("x", "x", "y", "y")).withColumn("r", F.array("p")).withColumn("i", F.struct(F.lit(1).alias("x"), F.lit(2).alias("y")))
    assert types.is_kind(df, "p", "point") and types.is_kind(df, "i", "point") and types.is_kind(df, "b", "box") and types.is_kind(df, "r", "ring")
    assert not types.is_kind(df, "b", "point") and not types.is_kind(df, "s", "point")
    got = df.select(text.parse("s", lambda s: int(s) * 2, "long").alias("v"), text.type_name("p").alias("t")).collect()
    assert [r.v for r in got] == [14, None] and got[0].t == "struct<x:double,y:double>"


def test_tree_cost(spark):
    boxes = spark.createDataFrame([(i, float(i % 4), float(i // 4)) for i in range(16)], "id long, x double, y double")
    boxes = boxes.select("id", types.box("x", "y", F.col("x") + 0.5, F.col("y") + 0.5).alias("box"))
    tree = grid.rect_tree(boxes, 4)
    leaves = tree.where("level = 1").collect()
    root = tree.where("level = 0").first()
    size = lambda r: r.box.xmax - r.box.xmin + r.box.ymax - r.box.ymin
    want = (size(root) + sum(size(r) * r.n for r in leaves)) / size(root)
    assert grid.tree_cost(tree).first().cost == pytest.approx(want) and sum(r.n for r in leaves) == 16
    assert json.dumps(sorted(r.node for r in grid.top_nodes_below(tree, 1e9).collect())) == '["0-0-0"]'
