import random

import pytest
from pyspark.sql import functions as F

from terraloom.operators import aggs, joins, ranges, series


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(5)
    data = [(rnd.choice(["a", "a", "a", "b", None]), float(rnd.randrange(40)) + rnd.random(), rnd.random(), k) for k in range(300)] + [("one", 1.0, 2.0, 300), ("two", 1.0, 2.0, 301), ("two", 3.0, 5.0, 302)]
    return spark.createDataFrame(data, "k string, x double, v double, id long").repartition(5)


def result(df):
    return sorted((tuple(None if c is None else round(c, 9) if isinstance(c, float) else c for c in r) for r in df.collect()), key=str)


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    defaults = list(ranges.in_blocks.__defaults__)
    monkeypatch.setattr(ranges.in_blocks, "__defaults__", (defaults[0], 9))


def test_numbers(rows):
    plain, parts = (result(ranges.numbered(rows, ["k"], ["x", "id"], ranges=n)) for n in (1, 7))
    assert plain == parts
    assert result(ranges.numbered(rows.where("false"), ["k"], ["x"], ranges=7)) == []


def test_averages(rows):
    plain, parts = (result(series.moving_average(rows, ["k"], ["x", "id"], "v", 3, ranges=n)) for n in (1, 6))
    assert plain == parts and len(plain) == 303


@pytest.mark.parametrize("pieces", [series.linear_pieces, series.pchip_pieces])
def test_pieces(rows, pieces):
    plain, parts = (result(pieces(rows, ["k"], "x", "v", ranges=n)) for n in (1, 6))
    assert plain == parts
    made = pieces(rows, ["k"], "x", "v")
    q = rows.select("k", "id", (F.col("x") * 1.1 - 2).alias("x"))
    assert result(series.evaluate(q, made, ["k"], "x", ranges=1)) == result(series.evaluate(q, made, ["k"], "x", ranges=8))


def test_last_before(rows):
    left, right = rows.select("k", "x", "id"), rows.where("id % 3 = 0").select("k", "x", F.col("v").alias("held"), "id")
    one, many = (result(joins.asof_previous(left, right, "x", ["k"], ["held"], "id", ranges=n)) for n in (1, 9))
    assert one == many and len(one) == 303
    known = {(r.k, r.x): r.held for r in right.collect()}
    for k, x, i, held in one:
        before = max((q for kk, q in known if kk == k and q <= x + 1e-9), default=None)
        assert held == (None if before is None else round(known[k, before], 9))


def test_ordered_hash(rows, spark):
    assert result(aggs.ordered_hash(rows, ["k"], "id", F.col("v"), ranges=1)) == result(aggs.ordered_hash(rows, ["k"], "id", F.col("v"), ranges=6))
    a, b, c = (spark.createDataFrame([(i, v) for i, v in enumerate(vs)], "i int, v string") for vs in (["x", "y", None], ["y", "x", None], ["x", "y", None]))
    first = [aggs.ordered_hash(df.withColumn("k", F.lit(1)), ["k"], "i", F.col("v")).first().hash for df in (a, b, c)]
    assert first[0] == first[2] != first[1]


def test_brackets(spark):
    points = spark.createDataFrame([(1.0, 10.0), (3.0, 30.0), (2.0, 20.0), (7.0, 70.0)], "bx double, q double")
    left = spark.createDataFrame([(-5.0,), (1.0,), (1.5,), (2.0,), (6.9,), (7.0,), (99.0,), (None,), (float("nan"),)], "x double")
    got = [(r.x, r.x1, r.q1, r.x2, r.q2) for r in joins.bracket_join(left, points, "x").collect()]
    span = {1: (1.0, 10.0, 2.0, 20.0), 2: (2.0, 20.0, 3.0, 30.0), 3: (3.0, 30.0, 7.0, 70.0)}
    assert got[:7] == [(-5.0, *span[1]), (1.0, *span[1]), (1.5, *span[1]), (2.0, *span[2]), (6.9, *span[3]), (7.0, *span[3]), (99.0, *span[3])]
    assert got[7] == (None,) * 5 and got[8][1:] == (None,) * 4
    assert joins.bracket_join(left, points.limit(1), "x").where("x1 is not null").count() == 0


def test_three_bands():
    import numpy as np

    rnd = np.random.default_rng(1)
    n = 50
    low, high, middle, right = rnd.random(n), rnd.random(n), 3 + rnd.random(n), rnd.random(n)
    full = np.diag(middle) + np.diag(low[1:], -1) + np.diag(high[:-1], 1)
    assert np.allclose(full @ series.three_bands(low, middle, high, right), right)
