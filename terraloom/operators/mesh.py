"""Triangle meshes: Delaunay triangulation by group, constraints, carving, refinement and per-triangle measures."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import shapes, vectors
from ..functions.types import triangle
from . import aggs, graph, grid, joins
from .clip import contains
from .scratch import Scratch

Point = tuple[float, float]


def orient(a: Point, b: Point, c: Point) -> int:
    """The sign of the turn, exactly where rounding could matter."""
    left, right = (b[0] - a[0]) * (c[1] - a[1]), (b[1] - a[1]) * (c[0] - a[0])
    d = left - right
    if abs(d) > 4e-16 * (abs(left) + abs(right)):
        return 1 if d > 0 else -1
    ax, ay, bx, by, cx, cy = map(Fraction, (*a, *b, *c))
    d = (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)
    return (d > 0) - (d < 0)


def in_circle(a: Point, b: Point, c: Point, d: Point) -> int:
    """1 where d is inside the circle through a, b, c, which turn left."""

    def value(a, b, c, d):
        (ax, ay), (bx, by), (cx, cy) = ((p[0] - d[0], p[1] - d[1]) for p in (a, b, c))
        parts = ((ax * ax + ay * ay) * (bx * cy - by * cx), (bx * bx + by * by) * (cx * ay - cy * ax), (cx * cx + cy * cy) * (ax * by - ay * bx))
        return sum(parts), sum(map(abs, parts))

    v, size = value(a, b, c, d)
    if abs(v) > 1e-14 * size:
        return 1 if v > 0 else -1
    v, _ = value(*[tuple(map(Fraction, p)) for p in (a, b, c, d)])
    return (v > 0) - (v < 0)


class Mesh:
    """Triangles over points by a map from directed edges to the corner opposite; every triangle has three such edges.

    A point is found by walking from the last triangle, so points that come in order are found in a few steps.
    """

    def __init__(self, points: Sequence[Point]):
        self.points = list(points)
        self.apex: dict[tuple[int, int], int] = {}
        self.fixed: set[tuple[int, int]] = set()
        self.near: dict[int, int] = {}  # of each corner another that an edge leads to
        self.last: tuple[int, int] | None = None
        self._open: list[tuple[int, int]] = []  # edges that constraints have made

    def add(self, a: int, b: int, c: int) -> None:
        self.apex[a, b], self.apex[b, c], self.apex[c, a] = c, a, b
        self.near[a], self.near[b], self.near[c] = b, c, a
        self.last = a, b

    def remove(self, a: int, b: int, c: int) -> None:
        for e in ((a, b), (b, c), (c, a)):
            del self.apex[e]

    def triangles(self) -> list[tuple[int, int, int]]:
        return sorted({min((a, b, c), (b, c, a), (c, a, b)) for (a, b), c in self.apex.items()})

    def is_fixed(self, a: int, b: int) -> bool:
        return (min(a, b), max(a, b)) in self.fixed

    def has(self, a: int, b: int) -> bool:
        return (a, b) in self.apex or (b, a) in self.apex

    def _start(self) -> tuple[int, int]:
        if self.last not in self.apex:
            self.last = next(iter(self.apex))
        return self.last

    def locate(self, p: Point) -> tuple[int, int, int] | None:
        """A triangle that holds the point; None outside of all. Triangles that were carved away end the walk, which then
        looks at all that are left."""
        a, b = self._start()
        seen = set()
        while True:
            c = self.apex[a, b]
            if (t := min((a, b, c), (b, c, a), (c, a, b))) in seen:
                break
            seen.add(t)
            out = next((e for e in ((a, b), (b, c), (c, a)) if orient(self.points[e[0]], self.points[e[1]], p) < 0), None)
            if out is None:
                self.last = a, b
                return t
            if out[::-1] not in self.apex:
                break
            a, b = out[::-1]
        return next((t for t in self.triangles() if all(orient(self.points[t[i]], self.points[t[(i + 1) % 3]], p) >= 0 for i in range(3))), None)

    def insert(self, k: int) -> None:
        """Takes out the triangles that see point k in their circle and joins k to the border of the hole; an edge that was
        fixed and that k lies on is two fixed ones then."""
        p = self.points[k]
        first = self.locate(p)
        if first is None:
            raise ValueError(f"point {p} is outside of the mesh")
        for a, b in zip(first, (*first[1:], first[0])):
            if self.is_fixed(a, b) and orient(self.points[a], self.points[b], p) == 0:
                self.fixed.remove((min(a, b), max(a, b)))
                self.fixed |= {(min(a, k), max(a, k)), (min(b, k), max(b, k))}
        hole, todo = {first}, [first]
        while todo:
            t = todo.pop()
            for a, b in zip(t, (*t[1:], t[0])):
                c = self.apex.get((b, a))
                if c is None or self.is_fixed(a, b):
                    continue
                u = min((b, a, c), (a, c, b), (c, b, a))
                if u not in hole and in_circle(*[self.points[i] for i in u], p) > 0:
                    hole.add(u)
                    todo.append(u)
        border = {e for a, b, c in hole for e in ((a, b), (b, c), (c, a))}
        for t in hole:
            self.remove(*t)
        for a, b in border:
            if (b, a) not in border and orient(self.points[a], self.points[b], p) > 0:
                self.add(a, b, k)

    def star(self, k: int) -> list[tuple[int, int]]:
        """The edges opposite to a corner, of the triangles around it in order."""
        first = self.near.get(k)
        if (k, first) not in self.apex:
            first = next((v for u, v in self.apex if u == k), None)
            if first is None:
                return []
        out, v = [], first
        while (k, v) in self.apex:  # turning left
            w = self.apex[k, v]
            out.append((v, w))
            v = w
            if v == first:
                return out
        v = first
        while (v, k) in self.apex:  # a border was met: the rest lies to the right
            u = self.apex[v, k]
            out.insert(0, (u, v))
            v = u
        return out

    def flip(self, a: int, b: int) -> None:
        """The edge a-b of two triangles becomes the one between their other corners."""
        c, d = self.apex[a, b], self.apex[b, a]
        self.remove(a, b, c)
        self.remove(b, a, d)
        self.add(c, d, b)
        self.add(d, c, a)

    def flippable(self, a: int, b: int) -> bool:
        """Whether the two triangles at an edge make a convex quadrangle."""
        c, d = self.apex.get((a, b)), self.apex.get((b, a))
        pts = self.points
        return c is not None and d is not None and orient(pts[c], pts[d], pts[b]) > 0 and orient(pts[d], pts[c], pts[a]) > 0

    def split(self, a: int, b: int) -> int:
        """A new corner in the middle of an edge."""
        (ax, ay), (bx, by) = self.points[a], self.points[b]
        k = len(self.points)
        self.points.append(((ax + bx) / 2, (ay + by) / 2))
        fixed = self.is_fixed(a, b)
        self.fixed.discard((min(a, b), max(a, b)))
        for u, v in ((a, b), (b, a)):
            w = self.apex.get((u, v))
            if w is not None:  # by number, as the middle may be rounded off the line
                self.remove(u, v, w)
                self.add(u, k, w)
                self.add(k, v, w)
        if fixed:
            self.fixed |= {(min(a, k), max(a, k)), (min(b, k), max(b, k))}
        self.legalize([(u, v) for u, v in self.star(k)])
        return k

    def remove_vertex(self, k: int) -> None:
        """Takes a corner out that triangles surround and no fixed edge ends at; the hole is filled by Delaunay triangles."""
        around = self.star(k)
        if not around or around[-1][1] != around[0][0]:
            raise ValueError(f"point {k} is not inside of the mesh")
        ring = [a for a, _ in around]
        if any(self.is_fixed(k, a) for a in ring):
            raise ValueError(f"a fixed edge ends at point {k}")
        for a, b in around:
            self.remove(k, a, b)
        while len(ring) > 3:
            ears = []
            for i in range(len(ring)):
                a, b, c = ring[i - 1], ring[i], ring[(i + 1) % len(ring)]
                pa, pb, pc = (self.points[j] for j in (a, b, c))
                rest = [self.points[j] for j in ring if j not in (a, b, c)]
                if orient(pa, pb, pc) > 0 and not any(all(orient(u, v, q) >= 0 for u, v in ((pa, pb), (pb, pc), (pc, pa))) for q in rest):
                    ears.append((any(in_circle(pa, pb, pc, q) > 0 for q in rest), i, (a, b, c)))
            _, i, ear = min(ears)
            self.add(*ear)
            del ring[i]
        self.add(*ring)
        self.legalize([(a, b) for a, b in around] + [(a, b) for i, a in enumerate(ring) for b in ring[i + 1 :] if self.has(a, b)])

    def collapse(self, a: int, b: int) -> int:
        """An edge between two free corners inside of the mesh becomes one corner, in its middle."""
        (ax, ay), (bx, by) = self.points[a], self.points[b]
        self.remove_vertex(a)
        self.remove_vertex(b)
        self.points.append(((ax + bx) / 2, (ay + by) / 2))
        self.insert(len(self.points) - 1)
        return len(self.points) - 1

    def constrain(self, a: int, b: int) -> None:
        """Makes a-b an edge by flips of those that cross it; points on it split it."""
        while a != b and not self.has(a, b):
            to, crossing = self._crossed(a, b)
            stuck = 0
            while crossing:
                u, v = crossing.pop(0)
                if not self.flippable(u, v):
                    crossing.append((u, v))
                    stuck += 1
                    if stuck > len(crossing):  # one of the edges that cross a line can always be flipped
                        raise RuntimeError(f"edge {a}-{b} can't be made")
                    continue
                stuck = 0
                c, d = self.apex[u, v], self.apex[v, u]
                self.flip(u, v)
                if self._crosses((c, d), a, to):
                    crossing.append((c, d))
                else:
                    self._open.append((c, d))
            self._fix(a, to)
            a = to
        if a != b:
            self._fix(a, b)

    def _fix(self, a: int, b: int) -> None:
        self.fixed.add((min(a, b), max(a, b)))
        self.legalize(self._open)

    def _crossed(self, a: int, b: int) -> tuple[int, list[tuple[int, int]]]:
        """Where the line from a to b meets a corner first, and the edges that it crosses on its way there."""
        pts = self.points
        self._open = []
        pa, pb = pts[a], pts[b]
        ahead = lambda k: (pts[k][0] - pa[0]) * (pb[0] - pa[0]) + (pts[k][1] - pa[1]) * (pb[1] - pa[1]) > 0
        for u, v in self.star(a):
            for k in (u, v):
                if orient(pa, pb, pts[k]) == 0 and ahead(k):
                    return k, []
            if orient(pa, pb, pts[u]) < 0 < orient(pa, pb, pts[v]):
                out = [(u, v)]
                while True:
                    w = self.apex[v, u]
                    side = 0 if w == b else orient(pa, pb, pts[w])
                    if side == 0:
                        return w, out
                    u, v = (u, w) if side > 0 else (w, v)
                    out.append((u, v))
        raise RuntimeError(f"no way from {a} to {b}")

    def _crosses(self, e: tuple[int, int], a: int, b: int) -> bool:
        if {a, b} & set(e):
            return False
        p, q, r, s = (self.points[i] for i in (*e, a, b))
        return orient(p, q, r) * orient(p, q, s) < 0 and orient(r, s, p) * orient(r, s, q) < 0

    def legalize(self, edges: Sequence[tuple[int, int]] | None = None) -> None:
        """Flips edges that aren't fixed until each is locally Delaunay. Every flip lowers the lifted surface, so it ends."""
        todo = [e for e in self.apex if e[0] < e[1]] if edges is None else list(edges)
        while todo:
            a, b = todo.pop()
            c, d = self.apex.get((a, b)), self.apex.get((b, a))
            if c is None or d is None or self.is_fixed(a, b):
                continue
            if in_circle(*(self.points[i] for i in (a, b, c, d))) > 0 and self.flippable(a, b):
                self.flip(a, b)
                todo += [(a, c), (a, d), (b, c), (b, d)]

    def drop_outside(self, loops: list[list[Point]]) -> None:
        """Keeps triangles whose middle is inside an odd number of loops."""
        for t in self.triangles():
            middle = tuple(sum(self.points[i][k] for i in t) / 3 for k in (0, 1))
            if sum(contains(r, middle) for r in loops) % 2 == 0:
                self.remove(*t)


def triangulation(points: Sequence[Point], edges: Sequence[tuple[int, int]] = ()) -> tuple[Mesh, int]:
    """The mesh of all points within a large triangle, whose corners have the numbers from the second value on."""
    first: dict[Point, int] = {}
    for i, p in enumerate(points):
        first.setdefault((float(p[0]), float(p[1])), i)
    xs, ys = [p[0] for p in first], [p[1] for p in first]
    mid, span = ((min(xs) + max(xs)) / 2, (min(ys) + max(ys)) / 2), max(max(xs) - min(xs), max(ys) - min(ys)) or 1.0
    n = len(points)
    far = 1e3 * span
    mesh = Mesh([*[(float(p[0]), float(p[1])) for p in points], (mid[0] - 2 * far, mid[1] - far), (mid[0] + 2 * far, mid[1] - far), (mid[0], mid[1] + 2 * far)])
    mesh.add(n, n + 1, n + 2)
    for _, i in sorted(first.items()):
        mesh.insert(i)
    for a, b in edges:
        mesh.constrain(*(first[float(points[i][0]), float(points[i][1])] for i in (a, b)))
    return mesh, n


def delaunay(points: Sequence[Point], edges: Sequence[tuple[int, int]] = (), loops: list[list[Point]] | None = None) -> list[tuple[int, int, int]]:
    """Triangles of point numbers, each from its smallest number and turning left. Repeated points are used once.

    edges are kept as edges of triangles; with loops, only what lies inside of them (even-odd) stays.
    """
    if len({(float(x), float(y)) for x, y in points}) < 3:
        return []
    mesh, n = triangulation(points, edges)
    for t in mesh.triangles():
        if max(t) >= n:
            mesh.remove(*t)
    if loops is not None:
        mesh.drop_outside(loops)
    return mesh.triangles()


#: Methods of refinement: the largest angle that triangles can be asked for, and the angle under which an edge is seen from a
#: point that is too near to it (a circle on the edge, a lens of 30 degrees on it; none: only what hides a circumcentre).
METHODS = {"lens": (30.0, 120.0), "ruppert": (20.0, 90.0), "chew": (27.5, None)}


def refine(points: Sequence[Point], loops: list[list[Point]], min_angle: float | None = None, max_edge: float = math.inf, min_edge: float = 0.0, method: str = "lens", steps: int | None = None) -> tuple[list[Point], list[tuple[int, int, int]]]:
    """Points added at circumcentres of bad triangles, or at middles of edges of the loops that are in their way.

    A triangle is bad if an angle is below min_angle (degrees, cut to the method's limit, which a negative or no value stands
    for) or an edge longer than max_edge; edges shorter than min_edge are left alone. Methods tell when an edge is in the way:
    "lens" and "ruppert" if a point sees it under too wide an angle, "chew" if it hides the circumcentre; "lens" and "chew"
    take the circumcentres near a split edge out again. Without `steps` it goes on until no triangle is bad; if `steps` end
    before, an error says so.
    """
    limit, seen = METHODS[method]
    alpha = math.radians(limit if min_angle is None or min_angle < 0 else min(min_angle, limit))
    pts = [tuple(map(float, p)) for p in points]
    at = {p: i for i, p in reversed(list(enumerate(pts)))}
    mesh, n = triangulation(pts, [(at[tuple(map(float, a))], at[tuple(map(float, b))]) for r in loops for a, b in zip(r, [*r[1:], r[0]])])
    free: set[int] = set()

    def length(a: int, b: int) -> float:
        return math.dist(mesh.points[a], mesh.points[b])

    def too_near(p: Point, a: int, b: int) -> bool:
        if seen is None or length(a, b) < min_edge:
            return False
        u, v = ((q[0] - p[0], q[1] - p[1]) for q in (mesh.points[a], mesh.points[b]))
        size = math.hypot(*u) * math.hypot(*v)
        return size > 0 and (u[0] * v[0] + u[1] * v[1]) / size < math.cos(math.radians(seen)) - 1e-12

    def split(a: int, b: int) -> None:
        if method != "ruppert":
            middle, r = tuple((x + y) / 2 for x, y in zip(mesh.points[a], mesh.points[b])), length(a, b) / 2
            for k in [k for k in free if math.dist(mesh.points[k], middle) < r * (1 - 1e-12)]:
                mesh.remove_vertex(k)
                free.remove(k)
        mesh.split(a, b)

    def crowded() -> tuple[int, int] | None:
        for a, b in sorted(mesh.fixed):
            if any((k := mesh.apex.get(e)) is not None and not n <= k < n + 3 and too_near(mesh.points[k], a, b) for e in ((a, b), (b, a))):
                return a, b
        return None

    def worst() -> tuple[int, int, int] | None:
        found = None
        for t in mesh.triangles():
            if any(n <= k < n + 3 for k in t):
                continue
            p, q, r = (mesh.points[i] for i in t)
            sides = sorted((math.dist(p, q), math.dist(q, r), math.dist(r, p)))
            angle = math.acos(max(-1.0, min(1.0, (sides[1] ** 2 + sides[2] ** 2 - sides[0] ** 2) / (2 * sides[1] * sides[2]))))
            if sides[0] > min_edge and (angle < alpha - 1e-9 or sides[2] > max_edge) and (found is None or angle < found[0]):
                middle = ((p[0] + q[0] + r[0]) / 3, (p[1] + q[1] + r[1]) / 3)
                if sum(contains(ring, middle) for ring in loops) % 2 and not corner(t):
                    found = angle, t
        return None if found is None else found[1]

    def corner(t: tuple[int, int, int]) -> bool:
        """Whether the smallest angle is one that two edges of the loops make, which no point can widen."""
        for i in range(3):
            a, b, c = t[i], t[(i + 1) % 3], t[(i + 2) % 3]
            if mesh.is_fixed(a, b) and mesh.is_fixed(a, c) and length(b, c) <= min(length(a, b), length(a, c)):
                return True
        return False

    def way(t: tuple[int, int, int], p: Point) -> tuple[int, int] | None:
        """The edge of the loops that lies between a triangle and a point, if one does."""
        middle = tuple(sum(mesh.points[i][c] for i in t) / 3 for c in (0, 1))
        for a, b in sorted(mesh.fixed):
            q, r = mesh.points[a], mesh.points[b]
            if orient(q, r, middle) * orient(q, r, p) <= 0 and orient(middle, p, q) * orient(middle, p, r) <= 0:
                return a, b
        return None

    done = 0
    while True:
        edge = crowded()
        bad = worst() if edge is None else None
        if edge is None and bad is None:
            break
        if steps is not None and done >= steps:
            raise RuntimeError(f"{steps} steps were not enough: triangles below the angle or above the edge are left")
        done += 1
        if edge is None:
            center = circumcenter(*[mesh.points[i] for i in bad])
            edge = way(bad, center) or next(((a, b) for a, b in sorted(mesh.fixed) if too_near(center, a, b)), None)
            if edge is None or length(*edge) <= max(min_edge, 1e-9):
                mesh.points.append(center)
                mesh.insert(len(mesh.points) - 1)
                free.add(len(mesh.points) - 1)
                continue
        split(*edge)
    for t in mesh.triangles():
        if any(n <= k < n + 3 for k in t):
            mesh.remove(*t)
    mesh.drop_outside(loops)
    tris = mesh.triangles()
    used = sorted({i for t in tris for i in t} | set(range(n)))
    number = {k: i for i, k in enumerate(used)}
    return [mesh.points[k] for k in used], [tuple(number[i] for i in t) for t in tris]


def circumcenter(a: Point, b: Point, c: Point) -> Point:
    bx, by, cx, cy = b[0] - a[0], b[1] - a[1], c[0] - a[0], c[1] - a[1]
    d = 2 * (bx * cy - by * cx) or 1e-300
    return a[0] + (cy * (bx * bx + by * by) - by * (cx * cx + cy * cy)) / d, a[1] + (bx * (cx * cx + cy * cy) - cx * (bx * bx + by * by)) / d


def triangulate(points: DataFrame, keys: Sequence[str], edges: DataFrame | None = None) -> DataFrame:
    """(keys, a, b, c): the Delaunay triangles of each group of points (keys, id, p), as ids; edges (keys, src, dst) are kept.

    A group is one task; groups are tiles or objects of bounded size.
    """
    import pandas as pd

    kinds = dict(points.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "a long, b long, c long"

    def made(frame: pd.DataFrame, lines: pd.DataFrame | None) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids = frame["id"].tolist()
        at = {i: k for k, i in enumerate(ids)}
        wanted = [] if lines is None else [(at[s], at[d]) for s, d in zip(lines["src"], lines["dst"]) if s in at and d in at]
        tris = delaunay(list(zip(frame["x"], frame["y"])), wanted)
        out = pd.DataFrame([[ids[i] for i in t] for t in tris], columns=["a", "b", "c"], dtype="int64")
        for j, k in enumerate(keys):
            out.insert(j, k, frame[k].iloc[0] if len(frame) else None)
        return out

    xy = points.where("p is not null").select(*keys, F.col("id").cast("long").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    if edges is None:
        return xy.groupBy(*keys).applyInPandas(lambda frame: made(frame, None), schema)
    return xy.groupBy(*keys).cogroup(edges.select(*[F.col(k).alias(k) for k in keys], "src", "dst").groupBy(*keys)).applyInPandas(made, schema)


def loops_of(edges: Sequence[tuple[int, int]]) -> list[list[int]]:
    """The closed loops of edges whose ends have two each; other edges are in none."""
    around: dict[int, list[int]] = defaultdict(list)
    for a, b in edges:
        around[a].append(b)
        around[b].append(a)
    out, seen = [], set()
    for start in sorted(around):
        if start in seen or len(around[start]) != 2:
            continue
        loop, before, at = [start], start, around[start][0]
        while at != start and len(around[at]) == 2 and at not in loop[1:]:
            loop.append(at)
            before, at = at, next(k for k in around[at] if k != before)
        seen.update(loop)
        if at == start and len(loop) > 2:
            out.append(loop)
    return out


def refined(points: DataFrame, keys: Sequence[str], edges: DataFrame, min_angle: float | None = None, max_edge: float = math.inf, method: str = "lens") -> DataFrame:
    """(keys, tri): refined triangles inside the loops that each group's edges (keys, src, dst) make of its points (keys, id, p)."""
    import pandas as pd

    kinds = dict(points.dtypes)
    p = "struct<x:double,y:double>"

    def made(frame: pd.DataFrame, lines: pd.DataFrame) -> pd.DataFrame:
        at = {i: (x, y) for i, x, y in zip(frame["id"], frame["x"], frame["y"])}
        loops = [[at[i] for i in loop] for loop in loops_of([(a, b) for a, b in zip(lines["src"], lines["dst"]) if a in at and b in at])]
        pts, tris = refine([q for loop in loops for q in loop], loops, min_angle, max_edge, method=method) if loops else ([], [])
        rows = [{f"p{k}": {"x": pts[i][0], "y": pts[i][1]} for k, i in enumerate(t)} for t in tris]
        first = {k: (frame if len(frame) else lines)[k].iloc[0] for k in keys}
        return pd.DataFrame({**{k: [v] * len(rows) for k, v in first.items()}, "tri": rows})

    xy = points.where("p is not null").select(*keys, F.col("id").cast("long").alias("id"), F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    held = edges.select(*[F.col(k).alias(k) for k in keys], "src", "dst")
    return xy.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(made, "".join(f"{k} {kinds[k]}, " for k in keys) + f"tri struct<p0:{p},p1:{p},p2:{p}>")


def mesh_flow(segments: DataFrame, cell: float, tolerance: float, longest: float = math.inf, min_angle: float | None = None, method: str = "lens") -> DataFrame:
    """(part, tri): segments (id, seg) cut where they meet, joined at common points, those closer than the tolerance made one,
    pieces longer than `longest` halved, and what closed loops of each connected part hold made into triangles."""
    pieces = joins.split_segments(segments, cell).select(F.concat_ws("-", F.col("id").cast("string"), F.col("part").cast("string")).alias("id"), "seg")
    scratch = Scratch(segments.sparkSession, "mesh")
    if longest < math.inf:
        pieces = grid.split_long_edges(pieces, longest).select("id", "seg")
    points, edges = aggs.extract_topology(pieces)
    points, edges = scratch.write(points.select(F.col("pid").alias("id"), "p"), "points"), scratch.write(edges, "edges")
    close = scratch.write(aggs.find_duplicates(points, tolerance), "close")
    own = scratch.write(aggs.remap_edges(edges, close, distinct=True), "own")
    kept = scratch.write(points.join(close.where("id = keep").select("id"), "id", "left_semi"), "kept")
    labels = graph.components(own.select(F.col("src").alias("a"), F.col("dst").alias("b")), scratch)
    if labels is None:
        return refined(kept.withColumn("part", F.col("id")), ["part"], own.withColumn("part", F.col("src")), min_angle, longest, method)
    name = labels.withColumnRenamed("p", "part")
    return refined(kept.join(name, F.col("id") == F.col("x")).select("part", "id", "p"), ["part"], own.join(name, F.col("src") == F.col("x")).select("part", "src", "dst"), min_angle, longest, method)


def fan(polygons: DataFrame) -> DataFrame:
    """(id, tri) of convex rings (id, ring), from their first point."""
    r = F.col("ring")
    at = F.transform(F.sequence(F.lit(2), F.size(r) - 1), lambda i: triangle(F.element_at(r, 1), F.element_at(r, i), F.element_at(r, i + 1)))
    return polygons.where(F.size("ring") >= 3).select("id", F.explode(at).alias("tri"))


def triangle_rows(mesh: DataFrame, points: DataFrame) -> DataFrame:
    """mesh (a, b, c) with tri, from points (id, p)."""
    out = mesh
    for c, k in (("a", "p0"), ("b", "p1"), ("c", "p2")):
        out = out.join(points.select(F.col("id").alias(c), F.col("p").alias(k)), c)
    return out.withColumn("tri", triangle("p0", "p1", "p2")).drop("p0", "p1", "p2")


def triangle_measures(rows: DataFrame) -> DataFrame:
    """rows (tri) with area, centre, edges (shortest first), angles and circumcircle."""
    t = F.col("tri")
    return rows.withColumns(
        {
            "area": shapes.triangle_area(t),
            "center": shapes.triangle_center(t),
            "edges": shapes.triangle_edges(t),
            "angles": vectors.interior_angles(t["p0"], t["p1"], t["p2"]),
            "circle": vectors.circumcircle(t["p0"], t["p1"], t["p2"]),
        }
    )


def neighbours(mesh: DataFrame) -> DataFrame:
    """(t, u, src, dst): triangles (tid, a, b, c) that share an edge, t < u."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    e = mesh.select("tid", F.explode(pairs).alias("e")).select("tid", "e.src", "e.dst")
    return e.groupBy("src", "dst").agg(F.min("tid").alias("t"), F.max("tid").alias("u")).where("t < u").select("t", "u", "src", "dst")


def locate(points: DataFrame, rows: DataFrame, cell: float) -> DataFrame:
    """(id, tid): the triangle (tid, tri) that holds each point (id, p); the smallest of several. Equal points are asked once,
    equal triangles met once."""
    p = points.select("p").distinct().withColumn("cx", F.floor(F.col("p.x") / cell)).withColumn("cy", F.floor(F.col("p.y") / cell))
    b = rows.groupBy("tri").agg(F.min("tid").alias("tid")).withColumn("_b", shapes.triangle_extent(F.col("tri")))
    for axis in "xy":
        b = b.withColumn(f"c{axis}", F.explode(F.sequence(F.floor(F.col(f"_b.{axis}min") / cell), F.floor(F.col(f"_b.{axis}max") / cell))))
    met = p.join(b, ["cx", "cy"]).where(shapes.box_contains_point(F.col("_b"), F.col("p")))
    held = met.where(shapes.triangle_contains(F.col("tri"), F.col("p"))).groupBy("p").agg(F.min("tid").alias("tid"))
    return points.select("id", "p").join(held, "p").groupBy("id").agg(F.min("tid").alias("tid"))


def edges_of(tris: Sequence[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """Undirected edges and how many triangles have each."""
    out: dict = defaultdict(int)
    for a, b, c in tris:
        for e in ((a, b), (b, c), (c, a)):
            out[min(e), max(e)] += 1
    return out
