"""Polygon sets by group: union, intersection, difference, xor, merging by property, hulls, rounding and buffers.

Groups of polygons go to a task each; unions run in two steps, by tile and then by group, so that the last step sees what is
left of each tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.types import POLYGON, fresh
from ..functions.types import polygon as polygon_of
from . import clip as clipper
from . import joins
from .graph import FEW, components
from .scratch import Scratch


def _rings(polygon) -> list:
    """Rings of a polygon row: the outline counter-clockwise, holes clockwise."""
    if polygon is None:
        return []

    def points(ring, ccw: bool) -> list:
        out = [(p["x"], p["y"]) for p in ring]
        return out if (clipper.area(out) >= 0) == ccw else out[::-1]

    return [points(polygon["outline"], True), *(points(h, False) for h in polygon["holes"])]


def _row(outline, holes) -> dict:
    return {"outline": [{"x": x, "y": y} for x, y in outline], "holes": [[{"x": x, "y": y} for x, y in h] for h in holes]}


def boolean(df: DataFrame, keys: Sequence[str], operation: str, polygon: str = "polygon", side: str | None = None, fill: str = "nonzero") -> DataFrame:
    """(keys, polygon): for each group the polygons of side 0 combined with those of side 1; without a side all are of side 0.

    Polygons within a side are united by the fill rule first.
    """
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for polygon_, s in zip(frame["_p"], frame["_s"]):
            (b if s else a).extend(_rings(polygon_))
        out = [_row(*p) for p in clipper.clip(a, b, operation, fill)]
        return pd.DataFrame({**{k: pd.Series([frame[k].iloc[0]] * len(out), dtype=frame[k].dtype) for k in keys}, "polygon": pd.Series(out, dtype=object)})

    kinds = dict(df.dtypes)
    held = df.select(*keys, F.col(polygon).alias("_p"), (F.col(side).cast("int") if side else F.lit(0)).alias("_s"))
    return held.groupBy(*keys).applyInPandas(run, "".join(f"{k} {kinds[k]}, " for k in keys) + f"polygon {POLYGON}")


def touching(parts: DataFrame, keys: Sequence[str], cell: float, keep: Sequence[str] = ("polygon",)) -> DataFrame:
    """(a, b, a_polygon, b_polygon), a < b, of polygons (keys, id, polygon) with the same keys that touch; null keys are equal. Other
    columns may be kept, and the envelope (box) and whether a polygon is its own (plain)."""
    held = parts.select(F.xxhash64(F.lit(0), *keys).alias("key"), "id", *sorted({"polygon", *keep} - {"box", "plain"}), shapes.extent(F.col("polygon.outline")).alias("box")).where("box is not null")
    held = joins._with_cells(held.withColumn("plain", joins.is_box(F.col("polygon"), F.col("box"))), F.col("box"), cell, "c")
    a, b = (held.select("key", "cx", "cy", *[F.col(c).alias(f"{side}_{c}") for c in sorted({"id", "box", "plain", "polygon", *keep})]) for side in "ab")
    home = [F.floor(F.greatest(f"a_box.{c}min", f"b_box.{c}min") / cell) == F.col(f"c{c}") for c in "xy"]
    met = a.join(b, ["key", "cx", "cy"]).where((F.col("a_id") < F.col("b_id")) & home[0] & home[1] & shapes.box_collides(F.col("a_box"), F.col("b_box")))
    met = met.where((F.col("a_plain") & F.col("b_plain")) | joins.polygons_touch(F.col("a_polygon"), F.col("b_polygon")))
    return met.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), *[f"{side}_{c}" for side in "ab" for c in keep])


def unite(df: DataFrame, keys: Sequence[str], polygon: str = "polygon", tile: float | None = None) -> DataFrame:
    """The union of each group. With a tile size, polygons are first united by the tile of their lower left corner; then those
    that touch others of their group, chain by chain. What touches nothing passes through, so a task holds a chain at most."""
    if not tile:
        return boolean(df, keys, "union", polygon)
    scratch = Scratch(df.sparkSession, "unite")
    corner = shapes.extent(F.col(f"{polygon}.outline"))
    tx, ty, number, root = fresh(df, "tx", "ty", "id", "root")
    tiled = boolean(df.withColumn(tx, F.floor(corner["xmin"] / tile)).withColumn(ty, F.floor(corner["ymin"] / tile)), [*keys, tx, ty], "union", polygon)
    parts = scratch.write(tiled.select(*keys, "polygon", F.monotonically_increasing_id().alias(number)), "parts")
    labels = components(touching(parts.withColumnRenamed(number, "id"), keys, tile), scratch)
    if labels is None:
        return parts.select(*keys, "polygon")
    chained = parts.join(labels.select(F.col("x").alias(number), F.col("p").alias(root)), number, "left")
    united = boolean(chained.where(F.col(root).isNotNull()), [*keys, root], "union").select(*keys, "polygon")
    return united.unionByName(chained.where(F.col(root).isNull()).select(*keys, "polygon"))


def shared_areas(df: DataFrame, prop: str, cell: float, measure: Callable[[Column], Column] | None = None) -> DataFrame:
    """(low, high, polygon): what polygons of two properties have in common, by pair of polygons; low < high are the properties.

    Copies of a polygon meet others as one, and rectangles by their envelopes. What they have in common comes once a pair of
    copies; with a measure of it (low, high, value, n) once, and n says for how many.
    """
    numbers = df.where(F.col(prop).isNotNull() & F.col("polygon").isNotNull()).select(F.col(prop).alias("prop"), "polygon").groupBy("polygon", "prop").agg(F.count(F.lit(1)).alias("n"))
    held = numbers.groupBy("polygon").agg(F.collect_list(F.struct("prop", "n")).alias("props"))
    ids = Scratch(df.sparkSession, "shared").write(held.withColumn("id", F.monotonically_increasing_id()), "polygons")
    kind = dict(df.dtypes)[prop]
    kept = ("polygon", "props", "box", "plain")
    box = shapes.extent(F.col("polygon.outline"))
    boxed = ids.withColumn("box", box).where("box is not null").withColumn("plain", joins.is_box(F.col("polygon"), F.col("box")))
    alone = boxed.where(F.size("props") > 1).select(F.col("id").alias("a"), F.col("id").alias("b"), *[F.col(c).alias(f"{side}_{c}") for side in "ab" for c in kept])
    pairs = touching(ids, [], cell, kept).unionByName(alone)
    plain = F.col("a_plain") & F.col("b_plain")

    def run(frames):
        for frame in frames:
            rows = [(same, x, y, _row(*p)) for same, x, y, a, b in zip(frame["same"], frame["a_props"], frame["b_props"], frame["a_polygon"], frame["b_polygon"]) for p in clipper.clip(_rings(a), _rings(b), "intersection")]
            yield pd.DataFrame(rows, columns=["same", "a_props", "b_props", "polygon"])

    same, props = (F.col("a") == F.col("b")).alias("same"), f"array<struct<prop:{kind},n:bigint>>"
    kinds = boxed.select("plain").distinct().collect()
    common = shapes.box_intersection(F.col("a_box"), F.col("b_box"))
    found = pairs.where(plain).select(same, "a_props", "b_props", common.alias("box")).where("box.xmin < box.xmax and box.ymin < box.ymax")
    found = found.select("same", "a_props", "b_props", polygon_of(shapes.box_ring(F.col("box"))).alias("polygon"))
    if not all(k.plain for k in kinds):
        clipped = pairs.where(~plain).select(same, "a_props", "b_props", "a_polygon", "b_polygon").mapInPandas(run, f"same boolean, a_props {props}, b_props {props}, polygon {POLYGON}")
        found = found.unionByName(clipped)
    found, of = (found, "polygon") if measure is None else (found.withColumn("value", measure(F.col("polygon"))), "value")
    each = found.select("same", of, "b_props", F.explode("a_props").alias("a")).select("same", of, "a", F.explode("b_props").alias("b"))
    each = each.where(F.when(F.col("same"), F.col("a.prop") < F.col("b.prop")).otherwise(F.col("a.prop") != F.col("b.prop")))
    each = each.select(F.least("a.prop", "b.prop").alias("low"), F.greatest("a.prop", "b.prop").alias("high"), of, (F.col("a.n") * F.col("b.n")).alias("n"))
    return each if measure else each.select("low", "high", "polygon", F.explode(F.sequence(F.lit(1).cast("long"), "n"))).drop("col")


def smallest_property(df: DataFrame, prop: str, cell: float) -> DataFrame:
    """df with every property replaced by the smallest of those whose polygons it touches, and so on; null ones stay.

    Rectangles meet by their envelopes, a cell at a time, of which no more is kept than joins its properties; other polygons meet
    all as pairs.
    """
    scratch = Scratch(df.sparkSession, "smallest")
    held = df.where(F.col(prop).isNotNull()).select(F.col(prop).alias("prop"), "polygon", shapes.extent(F.col("polygon.outline")).alias("box")).where("box is not null")
    # Copies of a rectangle say no more than one does.
    boxes = scratch.write(held.select("prop", "box", joins.is_box(F.col("polygon"), F.col("box")).alias("plain")).distinct(), "boxes")
    edges = met_in_cells(boxes.where("plain").select("prop", "box"), cell)
    if not boxes.where("not plain").isEmpty():
        ids = scratch.write(held.select("prop", "polygon").distinct().withColumn("id", F.monotonically_increasing_id()), "polygons")
        pairs = touching(ids, [], cell, ("prop", "plain")).where("not (a_plain and b_plain) and a_prop <> b_prop")
        edges = edges.unionByName(pairs.select(F.col("a_prop").alias("a"), F.col("b_prop").alias("b")))
    labels = components(edges, scratch, "properties", few=FEW)
    if labels is None:
        return df
    (least,) = fresh(df, "least")
    return df.join(labels.select(F.col("x").alias(prop), F.col("p").alias(least)), prop, "left").withColumn(prop, F.coalesce(least, prop)).select(*df.columns)


def met_in_cells(boxes: DataFrame, cell: float, block: int = 256) -> DataFrame:
    """(a, b): properties joined as those are whose boxes (prop, box) touch, directly or by others in a cell; not every pair that does.

    Two boxes that touch share a cell. There all boxes of a property start together, and what they meet goes on with all of its
    property, so a box meets those that none has met so far; where most touch these are soon none.
    """
    kind = dict(boxes.dtypes)["prop"]

    def joined(table: pa.Table) -> pa.Table:
        codes = table.column("prop").combine_chunks().dictionary_encode()
        code = codes.indices.to_numpy()
        # To Spark NaN is the largest number, and equal to itself.
        x0, y0, x1, y1 = (np.nan_to_num(table.column(c).to_numpy(), nan=np.inf, posinf=np.inf, neginf=-np.inf) for c in ("x0", "y0", "x1", "y1"))
        first, other = [], []
        left = np.argsort(code, kind="stable")
        while len(left):
            start = code[left[0]]
            own = code[left] == start
            front, left = left[own], left[~own]
            while len(front) and len(left):
                now, front = front[:block, None], front[block:]
                hit = ((x0[now] <= x1[left]) & (x0[left] <= x1[now]) & (y0[now] <= y1[left]) & (y0[left] <= y1[now])).any(0)
                if hit.any():
                    found = np.unique(code[left[hit]])
                    first.append(np.full(len(found), start)), other.append(found)
                    met = np.isin(code[left], found)
                    front, left = np.concatenate([front, left[met]]), left[~met]
        a, b = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (first, other))
        return pa.table({"a": codes.dictionary.take(pa.array(a)), "b": codes.dictionary.take(pa.array(b))})

    near = joins.dealt(joins._with_cells(boxes, F.col("box"), cell, "c"), "cx", "cy")
    near = near.select("cx", "cy", "prop", *[F.col(f"box.{c}{f}").alias(f"{c}{k}") for k, f in enumerate(("min", "max")) for c in "xy"])
    return near.groupBy("cx", "cy").applyInArrow(joined, f"a {kind}, b {kind}").distinct()


def merge_by_property(df: DataFrame, prop: str, cell: float, min_area: float = 0.0, min_hole: float = 0.0, clean_first: bool = True) -> DataFrame:
    """(prop, polygon): polygons with the same property that touch become one; small ones and small holes go."""
    held = df.select(prop, F.col("polygon"))
    if clean_first:
        held = held.select(prop, F.struct(shapes.clean(F.col("polygon.outline")).alias("outline"), F.transform("polygon.holes", lambda h: shapes.clean(h)).alias("holes")).alias("polygon"))
        held = held.where(F.size("polygon.outline") >= 3)
    merged = unite(held, [prop], tile=cell)
    return drop_small(merged, min_area, min_hole)


def drop_small(df: DataFrame, min_area: float = 0.0, min_hole: float = 0.0) -> DataFrame:
    """Without polygons below an area, and without holes below one."""
    holes = F.filter("polygon.holes", lambda h: F.abs(shapes.signed_area(h)) >= min_hole)
    out = df.withColumn("polygon", F.struct(F.col("polygon.outline").alias("outline"), holes.alias("holes")))
    return out.where(shapes.polygon_area(F.col("polygon")) >= min_area)


def convex_hull(points: DataFrame, keys: Sequence[str], spread: int = 32) -> DataFrame:
    """(keys, hull) of points (keys, p): hulls of random parts of a group first, then the hull of those."""
    kinds = dict(points.dtypes)
    head = "".join(f"{k} {kinds[k]}, " for k in keys)

    def part(frame: pd.DataFrame) -> pd.DataFrame:
        ring = clipper.hull(zip(frame["x"], frame["y"]))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] * len(ring) for k in keys}, "x": [p[0] for p in ring], "y": [p[1] for p in ring]})

    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        ring = clipper.hull(zip(frame["x"], frame["y"]))
        return pd.DataFrame({**{k: [frame[k].iloc[0]] for k in keys}, "hull": [[{"x": x, "y": y} for x, y in ring]]})

    xy = points.where("p is not null").select(*keys, F.col("p.x").cast("double").alias("x"), F.col("p.y").cast("double").alias("y"))
    salted = xy.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(spread)))
    partial = salted.groupBy(*keys, "_salt").applyInPandas(part, f"{head}x double, y double")
    grouped = partial.groupBy(*keys)
    return grouped.applyInPandas(whole, f"{head}hull array<struct<x:double,y:double>>")


def box_union_area(boxes: DataFrame, keys: Sequence[str], box: str = "box", cell: float = 16.0) -> DataFrame:
    """(keys, area) of the union of boxes, without Python: slabs between all x, and united intervals of y in each.

    Boxes are cut at the edges of square cells, and every cell of a group is added up by itself, so that no group, however
    large, meets in one task.
    """
    from pyspark.sql import Window

    b = boxes.select(*keys, *[F.col(f"{box}.{c}").alias(c) for c in ("xmin", "xmax", "ymin", "ymax")]).where("xmin < xmax and ymin < ymax")
    b = b.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("xmin") / cell), F.floor(F.col("xmax") / cell)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("ymin") / cell), F.floor(F.col("ymax") / cell))))
    own = [*keys, "_cx", "_cy"]
    low, high = (lambda c, at: F.greatest(F.col(c), F.col(at) * cell)), (lambda c, at: F.least(F.col(c), (F.col(at) + 1) * cell))
    b = b.select(*own, low("xmin", "_cx").alias("x0"), high("xmax", "_cx").alias("x1"), low("ymin", "_cy").alias("y0"), high("ymax", "_cy").alias("y1")).where("x0 < x1 and y0 < y1")
    order = Window.partitionBy(*own).orderBy("s0")
    slabs = b.select(*own, F.explode(F.array("x0", "x1")).alias("s0")).distinct().withColumn("s1", F.lead("s0").over(order)).where("s1 is not null")
    cut = b.join(slabs, own).where("x0 <= s0 and x1 >= s1")
    up = Window.partitionBy(*own, "s0").orderBy("y0", "y1").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("y1").over(up), F.lit(float("-inf")))
    fresh = F.greatest(F.lit(0.0), F.col("y1") - F.greatest("y0", top))
    return cut.withColumn("fresh", fresh * (F.col("s1") - F.col("s0"))).groupBy(*keys).agg(F.sum("fresh").alias("area"))


def round_corners(ring: Sequence[tuple[float, float]], radius: float, div: int = 32) -> list[tuple[float, float]]:
    """A ring with arcs in place of its corners; a corner whose sides are too short for the arc stays sharp."""
    n = len(ring)
    if n < 3:
        return list(ring)
    if clipper.area(ring) < 0:
        ring = list(ring)[::-1]
    out: list[tuple[float, float]] = []
    for i in range(n):
        (ax, ay), (x, y), (bx, by) = ring[i - 1], ring[i], ring[(i + 1) % n]
        la, lb = math.hypot(ax - x, ay - y), math.hypot(bx - x, by - y)
        if la == 0 or lb == 0:
            continue
        ux, uy, vx, vy = (ax - x) / la, (ay - y) / la, (bx - x) / lb, (by - y) / lb
        half = math.acos(max(-1.0, min(1.0, ux * vx + uy * vy))) / 2
        foot = radius / math.tan(half) if 0 < half < math.pi / 2 else 0.0
        if foot <= 0 or foot > min(la, lb):
            out.append((x, y))
            continue
        k = radius / math.sin(half)
        mx, my = ux + vx, uy + vy
        m = math.hypot(mx, my)
        ox, oy = x + mx / m * k, y + my / m * k
        start = math.atan2(y + uy * foot - oy, x + ux * foot - ox)
        sweep = math.atan2(y + vy * foot - oy, x + vx * foot - ox) - start
        sweep = (sweep + math.pi) % (2 * math.pi) - math.pi
        steps = max(1, math.ceil(abs(sweep) / (2 * math.pi) * div))
        out += [(ox + radius * math.cos(start + sweep * j / steps), oy + radius * math.sin(start + sweep * j / steps)) for j in range(steps + 1)]
    return out


def path_outline(line: Sequence[tuple[float, float]], width: float, round_div: int = 0) -> list[tuple[float, float]]:
    """The outline of a line of a width: square ends, mitred joints, or round ones with round_div."""
    r = width / 2
    pts = [p for i, p in enumerate(line) if i == 0 or p != line[i - 1]]
    if len(pts) < 2:
        return []
    rings = []
    for (x0, y0), (x1, y1) in zip(pts, pts[1:]):
        d = math.hypot(x1 - x0, y1 - y0)
        nx, ny = -(y1 - y0) / d * r, (x1 - x0) / d * r
        rings.append([(x0 - nx, y0 - ny), (x1 - nx, y1 - ny), (x1 + nx, y1 + ny), (x0 + nx, y0 + ny)])
    for (ax, ay), (x, y), (bx, by) in zip(pts, pts[1:], pts[2:]):
        if round_div:
            rings.append([(x + r * math.cos(2 * math.pi * k / round_div), y + r * math.sin(2 * math.pi * k / round_div)) for k in range(round_div)])
            continue
        da, db = math.hypot(x - ax, y - ay), math.hypot(bx - x, by - y)
        turn = (x - ax) * (by - y) - (y - ay) * (bx - x)
        s = -r if turn > 0 else r  # the outer side
        p, q = (x - (y - ay) / da * s, y + (x - ax) / da * s), (x - (by - y) / db * s, y + (bx - x) / db * s)
        mx, my = p[0] + q[0] - 2 * x, p[1] + q[1] - 2 * y
        m2 = mx * mx + my * my
        corner = (x + mx * 2 * r * r / m2, y + my * 2 * r * r / m2) if m2 > 1e-12 * r * r else p
        ring = [(x, y), p, corner, q]
        rings.append(ring if clipper.area(ring) >= 0 else ring[::-1])
    found = clipper.clip(rings, [], "union")
    return max((o for o, _ in found), key=clipper.area, default=[])


def simplify(ring: Sequence[tuple[float, float]]) -> list[tuple[list, list]]:
    """A ring that touches itself as outlines with holes."""
    return clipper.clip([list(ring)], [], "union", "evenodd")


def trapezoid(points: Sequence[tuple[float, float]]):
    """(direction, low corner, high corner, low length, high length) of four points with two parallel sides along an axis, or None."""
    pts = list(points)
    if len(pts) != 4:
        return None
    for direction, a in (("horizontal", 1), ("vertical", 0)):
        levels = sorted({p[a] for p in pts})
        if len(levels) == 2:
            low, high = (sorted(p for p in pts if p[a] == v) for v in levels)
            if len(low) == len(high) == 2:
                b = 1 - a
                return direction, low[0], high[0], low[1][b] - low[0][b], high[1][b] - high[0][b]
    return None


def ring_rows(df: DataFrame, ring: Column, transform, name: str = "ring") -> DataFrame:
    """df with a Python function of a ring applied to each row's."""
    @F.pandas_udf("array<struct<x:double,y:double>>")
    def run(rings: pd.Series) -> pd.Series:
        return rings.map(lambda r: None if r is None else [{"x": float(x), "y": float(y)} for x, y in transform([(p["x"], p["y"]) for p in r])])

    return df.withColumn(name, run(ring))
