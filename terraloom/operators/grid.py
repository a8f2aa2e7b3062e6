"""Grids: cells of points, lines and shapes, area ratios by cell, density maps and quad keys. A grid is sparse: (gx, gy, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import shapes
from ..functions.mathx import is_negative
from ..functions.types import fresh, num, point


def cell_of(v, stride: float, ref: float = 0.0, compat: bool = False) -> Column:
    """The cell's number along an axis. With compat, negative offsets are cut to zero first and then lowered by one."""
    d = num(v) - F.lit(float(ref))
    if not compat:
        return F.floor(d / stride).cast("long")
    cut = F.when(d < 0, F.ceil(d / stride)).otherwise(F.floor(d / stride)).cast("long")
    return cut - F.when(is_negative(d), 1).otherwise(0)


def rasterize_point(p: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0), compat: bool = False) -> Column:
    return F.struct(cell_of(p["x"], sx, ref[0], compat).alias("gx"), cell_of(p["y"], sy, ref[1], compat).alias("gy"))


def rasterize_segment(s: Column, e: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> Column:
    """Cells from that of s on to that of e, which is left out: one step of the longer axis at a time."""
    x0, y0 = ((s[c] - r) / k for c, r, k in (("x", ref[0], sx), ("y", ref[1], sy)))
    x1, y1 = ((e[c] - r) / k for c, r, k in (("x", ref[0], sx), ("y", ref[1], sy)))
    x0, y0, x1, y1 = (v.cast("long") for v in (x0, y0, x1, y1))
    dx, dy = x1 - x0, y1 - y0
    n = F.greatest(F.abs(dx), F.abs(dy))

    def at(i: Column) -> Column:
        # The other axis moves to the nearest cell, halves staying behind.
        def step(d: Column) -> Column:
            return F.signum(d).cast("long") * F.ceil((2 * i * F.abs(d) - n) / (2 * n)).cast("long")

        return F.struct((x0 + step(dx)).alias("gx"), (y0 + step(dy)).alias("gy"))

    none = F.expr("cast(array() as array<struct<gx:bigint,gy:bigint>>)")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0).cast("long"))), at)).otherwise(none)


def rasterize_ring(points: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The cells of all edges one after the other; some may come twice."""
    return F.flatten(F.transform(shapes.edges(points), lambda d: rasterize_segment(d["s"], d["e"], sx, sy, ref)))


def rasterize_polygon(p: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> Column:
    return F.concat(rasterize_ring(p["outline"], sx, sy, ref), F.flatten(F.transform(p["holes"], lambda h: rasterize_ring(h, sx, sy, ref))))


def snapped_ring(points: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> Column:
    """The ring on cell numbers, equal neighbours once."""
    moved = F.transform(points, lambda p: point(cell_of(p["x"], sx, ref[0]), cell_of(p["y"], sy, ref[1])))
    n = F.size(moved)
    return F.filter(moved, lambda p, i: (p["x"] != F.element_at(moved, F.pmod(i - 1, n) + 1)["x"]) | (p["y"] != F.element_at(moved, F.pmod(i - 1, n) + 1)["y"]))


def box_cells(df: DataFrame, box: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """df with a row a cell that the box covers (more than its border): gx, gy and ratio, the covered share of the cell."""
    x0, x1 = (box["xmin"] - ref[0]) / sx, (box["xmax"] - ref[0]) / sx
    y0, y1 = (box["ymin"] - ref[1]) / sy, (box["ymax"] - ref[1]) / sy
    a, b, c, d = names = fresh(df, "x0", "x1", "y0", "y1")
    held = df.withColumns({a: x0, b: x1, c: y0, d: y1}).where((F.col(a) < F.col(b)) & (F.col(c) < F.col(d)))
    wide = held.withColumn("gx", F.explode(F.sequence(F.floor(a), F.ceil(b) - 1))).withColumn("gy", F.explode(F.sequence(F.floor(c), F.ceil(d) - 1)))
    over = (F.least(b, F.col("gx") + 1.0) - F.greatest(F.col(a), F.col("gx").cast("double"))) * (F.least(d, F.col("gy") + 1.0) - F.greatest(F.col(c), F.col("gy").cast("double")))
    return wide.withColumn("ratio", over).drop(*names)


def clip_half(points: Column, axis: str, bound: Column, upper: bool) -> Column:
    """A ring clipped by a half plane along an axis."""

    def inside(p: Column) -> Column:
        return p[axis] <= bound if upper else p[axis] >= bound

    def edge(d: Column) -> Column:
        s, e = d["s"], d["e"]
        k = (bound - s[axis]) / F.when(e[axis] == s[axis], 1.0).otherwise(e[axis] - s[axis])
        cut = point(s["x"] + k * (e["x"] - s["x"]), s["y"] + k * (e["y"] - s["y"]))
        none = F.expr("cast(array() as array<struct<x:double,y:double>>)")
        return F.when(inside(e), F.when(inside(s), F.array(e)).otherwise(F.array(cut, e))).otherwise(F.when(inside(s), F.array(cut)).otherwise(none))

    return F.flatten(F.transform(shapes.edges(points), edge))


def ring_cells(df: DataFrame, ring: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """As box_cells for rings (triangles, trapezoids, any simple ring): the ring clipped to each cell of its envelope.

    Clipping of a concave ring may leave edges along the cell's border, which add no area. Equal rings are clipped once.
    """
    (whole,) = fresh(df, "whole")
    keyed = df.withColumn(whole, ring)
    return keyed.join(_clipped(keyed.select(whole).distinct(), whole, sx, sy, ref), whole).select(*df.columns, "gx", "gy", "ratio")


def ring_totals(df: DataFrame, ring: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0), name: str = "ratio") -> DataFrame:
    """df with the sum of the shares of each ring's cells; 0 for one without area. Equal rings are added up once."""
    whole, own = fresh(df, "whole", "own")
    keyed = df.withColumn(whole, ring)
    totals = _clipped(keyed.select(whole).where(F.col(whole).isNotNull()).distinct(), whole, sx, sy, ref).groupBy(whole).agg(F.sum("ratio").alias(own))
    total = F.when(F.col(whole).isNotNull(), F.coalesce(own, F.lit(0.0)))
    return keyed.join(totals, whole, "left").select(*df.columns, total.alias(name))


def _clipped(df: DataFrame, ring: str, sx: float, sy: float, ref: tuple[float, float]) -> DataFrame:
    """df with a row a cell of each ring, clipped one by one: gx, gy and ratio."""
    own, around = fresh(df, "ring", "around")
    # Rings are few bytes and much work: their number of tasks is given, as it would be one or two by their size.
    dealt = df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)
    held = dealt.withColumn(own, F.col(ring)).withColumn(around, shapes.extent(F.col(ring))).where(F.col(around).isNotNull())
    wide = held.withColumn("gx", F.explode(F.sequence(F.floor((F.col(around)["xmin"] - ref[0]) / sx), F.floor((F.col(around)["xmax"] - ref[0]) / sx))))
    # A column of cells is cut once, and its cells from that.
    for axis, upper, bound in (("x", False, F.col("gx") * sx + ref[0]), ("x", True, (F.col("gx") + 1) * sx + ref[0])):
        wide = wide.withColumn(own, clip_half(F.col(own), axis, bound, upper))
    wide = wide.withColumn(around, shapes.extent(F.col(own))).where(F.col(around).isNotNull())
    wide = wide.withColumn("gy", F.explode(F.sequence(F.floor((F.col(around)["ymin"] - ref[1]) / sy), F.floor((F.col(around)["ymax"] - ref[1]) / sy))))
    for axis, upper, bound in (("y", False, F.col("gy") * sy + ref[1]), ("y", True, (F.col("gy") + 1) * sy + ref[1])):
        wide = wide.withColumn(own, clip_half(F.col(own), axis, bound, upper))
    ratio = F.abs(shapes.signed_area(F.col(own))) / (sx * sy)
    return wide.withColumn("ratio", ratio).drop(own, around).where("ratio > 0")


def grid_size(box: Column, sx: float, sy: float) -> Column:
    return F.struct(F.ceil(shapes.box_length(box) / sx).alias("width"), F.ceil(shapes.box_width(box) / sy).alias("height"))


def map_to_grid(cells: DataFrame, blend: Column, size: tuple[int, int] | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, gx, gy, value): cells blended by an aggregate; those outside 0 .. size are dropped where a size is given."""
    if size:
        cells = cells.where(F.col("gx").between(0, size[0] - 1) & F.col("gy").between(0, size[1] - 1))
    return cells.groupBy(*keys, "gx", "gy").agg(blend.alias("value"))


def density(shapes_df: DataFrame, ring: Column, is_hole: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    """Solids add the share of a cell they cover and holes take it off; overlaps count twice."""
    signed = shapes_df.select(ring.alias("whole"), F.when(is_hole, -1.0).otherwise(1.0).alias("sign"))
    cells = _clipped(signed.groupBy("whole").agg(F.sum("sign").alias("sign")), "whole", sx, sy, ref)
    return map_to_grid(cells, F.sum(F.col("sign") * F.col("ratio")))


def box_density(df: DataFrame, box: Column, sx: float, sy: float, ref: tuple[float, float] = (0.0, 0.0)) -> DataFrame:
    return map_to_grid(box_cells(df, box, sx, sy, ref), F.sum("ratio"))


def peak(grid: DataFrame, largest: bool = True) -> DataFrame:
    """The cell of the largest value (or smallest), the first by gx and gy of equal ones."""
    sign = F.lit(1.0 if largest else -1.0)
    best = grid.agg(F.max(F.struct((sign * F.col("value")).alias("v"), (-F.col("gx")).alias("x"), (-F.col("gy")).alias("y"))).alias("m"))
    return best.where("m is not null").select((-F.col("m.x")).alias("gx"), (-F.col("m.y")).alias("gy"), (sign * F.col("m.v")).alias("value"))


def quad_key(x: Column, y: Column, xmin: float, ymin: float, xmax: float, ymax: float, depth: int) -> Column:
    """The path of quadrants (SW 0, SE 1, NE 2, NW 3) down to a depth, as text; a border goes to the lower side."""
    n = 1 << depth

    def number(v: Column, lo: float, hi: float) -> Column:
        return F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.ceil((v - lo) / (hi - lo) * n).cast("long") - 1))

    gx, gy = number(x, xmin, xmax), number(y, ymin, ymax)
    parts = []
    for k in reversed(range(depth)):
        bx, by = F.shiftright(gx, k).bitwiseAND(F.lit(1).cast("long")), F.shiftright(gy, k).bitwiseAND(F.lit(1).cast("long"))
        parts.append(F.when((bx == 0) & (by == 0), "0").when((bx == 1) & (by == 0), "1").when(bx == 1, "2").otherwise("3"))
    return F.concat(*parts) if parts else F.lit("")


def quad_tree(points: DataFrame, bounds: tuple[float, float, float, float], max_objects: int, depth: int) -> DataFrame:
    """points (id, p) with the key of the leaf that holds each: quadrants split while they hold more than max_objects."""
    key, length = fresh(points, "key", "len")
    keyed = points.withColumn(key, quad_key(F.col("p.x"), F.col("p.y"), *bounds, depth))
    levels = F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.substring(key, F.lit(1), k))
    counts = keyed.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(F.explode(levels).alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n"))
    # A node is reached where all above it were split; counts fall downwards, so it is enough that its parent was.
    split = counts.where((F.col("n") > max_objects) & (F.length("node") < depth)).select("node")
    paths = keyed.select(key).distinct().withColumn("node", F.explode(levels)).join(split, "node").groupBy(key).agg((F.max(F.length("node")) + 1).alias(length))
    return keyed.join(paths, key, "left").withColumn("leaf", F.substring(key, F.lit(1), F.coalesce(length, F.lit(0)))).drop(key, length)


def str_tiles(boxes: DataFrame, tiles: int) -> DataFrame:
    """boxes (id, box) with tile: sorted by x into slices and by y inside each, all of about the same size.

    Slices come from quantiles, so nothing is sorted in one place.
    """
    import math

    n = max(1, math.isqrt(tiles))
    x, y = (F.col("box.xmin") + F.col("box.xmax")) / 2, (F.col("box.ymin") + F.col("box.ymax")) / 2
    cuts = boxes.agg(F.percentile_approx(x, [i / n for i in range(1, n)] or [0.5], 10_000).alias("c")).first()["c"] if n > 1 else []
    slice_, cut = fresh(boxes, "slice", "cut")
    sliced = boxes.withColumn(slice_, sum((F.when(x > c, 1).otherwise(0) for c in cuts or []), F.lit(0)))
    rows = sliced.groupBy(slice_).agg(F.percentile_approx(y, [i / n for i in range(1, n)] or [0.5], 10_000).alias(cut))
    tile = F.size(F.filter(cut, lambda c: y > c)) if n > 1 else F.lit(0)
    return sliced.join(rows, slice_).withColumn("tile", F.col(slice_) * n + tile).drop(slice_, cut)


def rect_tree(boxes: DataFrame, tiles: int) -> DataFrame:
    """(level, node, parent, box, n): the levels of a sorted tree of rectangles over boxes (id, box), the root at level 0.

    The lowest level are the tiles of str_tiles, four of which at most make a node of the level above.
    """
    import math

    n = max(1, math.isqrt(tiles))
    depth = max(0, (n - 1).bit_length())
    envelope = [f(f"box.{c}").alias(c) for c, f in (("xmin", F.min), ("ymin", F.min), ("xmax", F.max), ("ymax", F.max))]
    low = str_tiles(boxes, tiles).groupBy("tile").agg(F.struct(*envelope).alias("box"), F.count(F.lit(1)).alias("n"))
    low = low.withColumn("x", F.floor(F.col("tile") / n).cast("int")).withColumn("y", (F.col("tile") % n).cast("int"))
    at = F.explode(F.transform(F.sequence(F.lit(0), F.lit(depth)), lambda k: F.struct(k.alias("level"), *[F.floor(F.col(c) / F.pow(F.lit(2.0), depth - k)).cast("int").alias(c) for c in "xy"])))
    nodes = low.select("box", "n", at.alias("at")).groupBy("at.level", "at.x", "at.y").agg(F.struct(*envelope).alias("box"), F.sum("n").alias("n"))
    name = lambda level, x, y: F.concat_ws("-", level.cast("string"), x.cast("string"), y.cast("string"))
    half = [F.shiftright(F.col(c), 1) for c in "xy"]
    return nodes.select("level", name(F.col("level"), F.col("x"), F.col("y")).alias("node"), F.when(F.col("level") > 0, name(F.col("level") - 1, *half)).alias("parent"), "box", "n")


def top_nodes_below(tree: DataFrame, area: float) -> DataFrame:
    """The highest nodes of a tree whose boxes are smaller than an area: those of which no node above is."""
    own = tree.withColumn("small", shapes.box_area(F.col("box")) < area)
    above = own.select(F.col("node").alias("parent"), F.col("small").alias("above"))
    # A box holds those below it, so small ones lie below large ones and it is enough to look one level up.
    return own.join(above, "parent", "left").where("small and not coalesce(above, false)").select(*tree.columns)


def tree_cost(tree: DataFrame, traversal: float = 1.0) -> DataFrame:
    """(cost): what a look into a tree of rectangles is expected to cost: half of the borders of inner nodes, times `traversal`, and
    of leaves, times their objects, over that of the root."""
    b = F.col("box")
    half = shapes.box_length(b) + shapes.box_width(b)
    deepest = tree.agg(F.max("level").alias("deepest"))
    own = tree.crossJoin(F.broadcast(deepest))  # one row
    part = F.sum(F.when(F.col("level") == F.col("deepest"), half * F.col("n")).otherwise(traversal * half))
    return own.agg((part / F.max(F.when(F.col("level") == 0, half))).alias("cost"))


def beside(leaves: DataFrame, depth: int) -> DataFrame:
    """(leaf, side, other): leaves of a quad tree that have a border in common, other on the side (E, W, N, S) of leaf."""
    keyed = leaves.select("leaf").distinct().select("leaf", F.length("leaf").alias("level"), *_cell(F.col("leaf")))
    steps = F.array(*[F.struct(F.lit(n).alias("side"), (F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for n, dx, dy in (("E", 1, 0), ("W", -1, 0), ("N", 0, 1), ("S", 0, -1))])
    wanted = keyed.select("leaf", "level", F.explode(steps).alias("c")).select("leaf", "level", "c.*")
    up = wanted.select("leaf", "side", "level", "x", "y", F.explode(F.sequence(F.lit(0), F.col("level"))).alias("k"))
    up = up.select("leaf", "side", (F.col("level") - F.col("k")).alias("level"), F.expr("shiftright(x, k)").alias("cx"), F.expr("shiftright(y, k)").alias("cy"))
    larger = up.join(keyed.withColumnRenamed("leaf", "other"), ["level", "cx", "cy"]).select("leaf", "side", "other")
    turned = F.translate("side", "EWNS", "WESN")
    return larger.unionByName(larger.select(F.col("other").alias("leaf"), turned.alias("side"), F.col("leaf").alias("other"))).distinct()


def split_long_edges(edges: DataFrame, longest: float) -> DataFrame:
    """(id, part, seg): every segment halved until no piece is longer."""
    d = F.hypot(F.col("seg.e.x") - F.col("seg.s.x"), F.col("seg.e.y") - F.col("seg.s.y"))
    n = F.when(d > longest, F.pow(F.lit(2.0), F.ceil(F.log2(d / longest)))).otherwise(1.0).cast("int")
    s, e = F.col("seg.s"), F.col("seg.e")

    def at(k: Column) -> Column:
        return point(s["x"] + (e["x"] - s["x"]) * k / F.col("n"), s["y"] + (e["y"] - s["y"]) * k / F.col("n"))

    return edges.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select("id", "part", F.struct(at(F.col("part")).alias("s"), at(F.col("part") + 1).alias("e")).alias("seg"))


def leaf_neighbours(leaves: DataFrame) -> DataFrame:
    """Counts of leaves by level, from rows with a leaf key."""
    return leaves.select("leaf").distinct().groupBy(F.length("leaf").alias("level")).agg(F.count(F.lit(1)).alias("n"))


def pattern_view(triplets: DataFrame, rows: int, cols: int, width: int, largest: bool = False) -> DataFrame:
    """A matrix of triplets (i, j, v) on a grid of width by width: the mean magnitude of a cell's entries, or the largest."""
    cells = triplets.select(F.floor(F.col("i") * width / rows).alias("gx"), F.floor(F.col("j") * width / cols).alias("gy"), F.abs("v").alias("v"))
    return map_to_grid(cells, F.max("v") if largest else F.avg("v"))


def first_in_cell(df: DataFrame, order: str) -> DataFrame:
    w = Window.partitionBy("gx", "gy").orderBy(order)
    (k,) = fresh(df, "k")
    return df.withColumn(k, F.row_number().over(w)).where(F.col(k) == 1).drop(k)


def balanced_leaves(leaves: DataFrame, depth: int) -> DataFrame:
    """(leaf): a quadtree's leaves split until neighbours differ by one level at most, from rows with a leaf key.

    Each round looks for leaves beside ones more than a level deeper and splits them; there are at most `depth` rounds, and
    the tables are those of leaves, not of objects.
    """
    out = leaves.select("leaf").distinct()
    for _ in range(depth):
        # Cells of each leaf's own level beside it, as (x, y, level), and the leaves that hold them two levels up or more.
        keyed = out.select("leaf", F.length("leaf").alias("level"), *_cell(F.col("leaf")))
        beside = keyed.where("level >= 2").select("level", F.explode(F.array(*[F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y")) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1))])).alias("c"))
        up = beside.select("level", "c.x", "c.y", F.explode(F.sequence(F.lit(2), F.col("level"))).alias("k"))
        up = up.select((F.col("level") - F.col("k")).alias("level"), F.expr("shiftright(x, k)").alias("cx"), F.expr("shiftright(y, k)").alias("cy")).distinct()
        coarse = keyed.join(up, ["level", "cx", "cy"], "left_semi").select("leaf")
        if coarse.isEmpty():
            break
        split = coarse.select(F.explode(F.transform(F.array(*map(F.lit, "0123")), lambda q: F.concat("leaf", q))).alias("leaf"))
        out = out.join(coarse, "leaf", "left_anti").unionByName(split)
    return out


def _cell(key: Column) -> tuple[Column, Column]:
    """The cell numbers of a quad key at its level: quadrants 1 and 2 lie to the right, 2 and 3 above."""

    def fold(right: str) -> Column:
        steps = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.when(F.substring(key, i, F.lit(1)).isin(*right), 1).otherwise(0))
        return F.when(F.length(key) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a * 2 + b))

    return fold("12").alias("cx"), fold("23").alias("cy")


def leaf_centers(leaves: DataFrame, bounds: tuple[float, float, float, float]) -> DataFrame:
    """(leaf, p): the middle of every leaf, for points to be added to a mesh."""
    xmin, ymin, xmax, ymax = bounds
    cx, cy = _cell(F.col("leaf"))
    n = F.pow(F.lit(2.0), F.length("leaf"))
    at = leaves.select("leaf", cx, cy, n.alias("n"))
    return at.select("leaf", point(F.lit(xmin) + (F.col("cx") + 0.5) / F.col("n") * (xmax - xmin), F.lit(ymin) + (F.col("cy") + 0.5) / F.col("n") * (ymax - ymin)).alias("p"))
