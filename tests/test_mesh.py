import math
import random

import pytest

from terraloom.operators import clip, mesh


def turning(m):
    return all(mesh.orient(*(m.points[i] for i in t)) > 0 for t in m.triangles())


def locally_delaunay(m, skip=()):
    for (a, b), c in m.apex.items():
        d = m.apex.get((b, a))
        if d is not None and not m.is_fixed(a, b) and not set(skip) & {a, b, c, d}:
            if mesh.in_circle(*(m.points[i] for i in (a, b, c, d))) > 0:
                return False
    return True


def smallest_angles(points, tris):
    out = []
    for t in tris:
        p = [points[i] for i in t]
        for i in range(3):
            u, v = ((q[0] - p[i][0], q[1] - p[i][1]) for q in (p[i - 1], p[i - 2]))
            out.append(math.degrees(math.acos(max(-1.0, min(1.0, (u[0] * v[0] + u[1] * v[1]) / math.hypot(*u) / math.hypot(*v))))))
    return out


def test_many_points_by_walking():
    rnd = random.Random(2)
    pts = [(rnd.random(), rnd.random()) for _ in range(3000)] + [(k / 20, j / 20) for k in range(20) for j in range(20)]
    rnd.shuffle(pts)
    m, n = mesh.triangulation(pts)
    assert turning(m) and locally_delaunay(m)
    assert len(m.triangles()) == 2 * (len(set(pts)) + 3) - 5
    assert {i for t in m.triangles() for i in t} >= set(range(len(pts)))


@pytest.mark.parametrize("seed", range(6))
def test_constraints_are_edges(seed):
    rnd = random.Random(seed)
    pts = [(float(rnd.randrange(12)), float(rnd.randrange(12))) for _ in range(90)]
    m, n = mesh.triangulation(pts)
    first = {}
    for i, p in enumerate(pts):
        first.setdefault(p, i)
    for y in (2.0, 5.0, 9.0):
        row = sorted((p for p in first if p[1] == y))
        if len(row) > 1:
            m.constrain(first[row[-1]], first[row[0]])
            assert all(m.is_fixed(first[a], first[b]) and m.has(first[a], first[b]) for a, b in zip(row, row[1:]))
    assert turning(m) and locally_delaunay(m)


def test_edits():
    rnd = random.Random(7)
    pts = [(rnd.random(), rnd.random()) for _ in range(60)]
    m, n = mesh.triangulation(pts)
    for k in range(0, 40, 2):
        m.remove_vertex(k)
        assert turning(m) and locally_delaunay(m) and not any(k in e for e in m.apex)
    left = [p for i, p in enumerate(pts) if i >= 40 or i % 2]
    again, _ = mesh.triangulation(left)
    assert len(again.triangles()) == len(m.triangles())
    a, b = next(e for e in m.apex if max(e) < n)
    k = m.split(a, b)
    assert turning(m) and locally_delaunay(m) and m.points[k] == tuple((x + y) / 2 for x, y in zip(pts[a], pts[b]))
    a, b = next(e for e in m.apex if max(e) < n)
    k = m.collapse(a, b)
    assert turning(m) and not any({a, b} & set(e) for e in m.apex) and any(k in e for e in m.apex)
    with pytest.raises(ValueError):
        m.remove_vertex(n)


@pytest.mark.parametrize("method", sorted(mesh.METHODS))
def test_refinement_reaches_its_angle(method):
    outer = [(0.0, 0.0), (10.0, 0.0), (10.0, 3.0), (4.0, 3.0), (4.0, 10.0), (0.0, 10.0)]
    hole = [(1.0, 1.0), (1.0, 1.4), (3.0, 1.4), (3.0, 1.0)]
    more, tris = mesh.refine([*outer, *hole], [outer, hole], method=method)
    limit = min(20.0, mesh.METHODS[method][0])
    fine, tris_ = mesh.refine([*outer, *hole], [outer, hole], min_angle=limit, max_edge=1.5, method=method)
    assert min(smallest_angles(more, tris)) >= mesh.METHODS[method][0] - 1e-6
    assert min(smallest_angles(fine, tris_)) >= limit - 1e-6 and all(math.dist(fine[a], fine[b]) <= 1.5 + 1e-9 for a, b in mesh.edges_of(tris_))
    for p, t in ((more, tris), (fine, tris_)):
        assert sum(clip.area([p[i] for i in x]) for x in t) == pytest.approx(58 - 0.8)
    with pytest.raises(RuntimeError):
        mesh.refine([*outer, *hole], [outer, hole], max_edge=0.5, method=method, steps=3)
