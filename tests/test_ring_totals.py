"""Sums of the shares of rings' cells."""

from pyspark.sql import functions as F

from terraloom.functions.types import point, ring
from terraloom.operators import grid


def test_totals_of_rings_and_tasks_for_them(spark, monkeypatch):
    x = (F.col("id") % 6).cast("double")
    rows = spark.range(60).select("id", ring(point(x, 0), point(x + 5, 0), point(x + 5, x + 1)).alias("ring"))
    rows = rows.unionByName(spark.createDataFrame([(60, None), (61, [])], "id long, ring array<struct<x:double,y:double>>"))
    clipped = []
    kept = grid._clipped
    monkeypatch.setattr(grid, "_clipped", lambda df, *rest: clipped.append((df.count(), kept(df, *rest))) or clipped[-1][1])
    got = {r.id: r.ratio for r in grid.ring_totals(rows, F.col("ring"), 2.0, 2.0).collect()}
    assert {k: None if v is None else round(v, 9) for k, v in got.items()} == {**{k: round(5 * (k % 6 + 1) / 2 / 4, 9) for k in range(60)}, 60: None, 61: 0.0}
    assert clipped[0][0] == 7
    # Few bytes are no reason for few tasks.
    few = spark.createDataFrame([([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)],)], "whole array<struct<x:double,y:double>>").distinct()
    assert kept(few, "whole", 2.0, 2.0, (0.0, 0.0)).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
