"""Graphs as edge tables (src, dst): components, reachability, multigraph edits and mesh adjacency."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import Scratch


def _hook(edges: DataFrame) -> DataFrame:
    """(x, p): every vertex of the edges and the smallest of itself and its neighbours."""
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
    return both.groupBy("x").agg(F.min("y").alias("y")).select("x", F.least("x", "y").alias("p"))


def _jump(parent: DataFrame) -> DataFrame:
    up = parent.select(F.col("x").alias("p"), F.col("p").alias("up")).where("p <> up")
    return parent.join(up, "p", "left").select("x", F.coalesce("up", "p").alias("p"))


#: Edges that are few enough to finish with on the driver.
FEW = 20_000


def _roots(edges: list) -> list[tuple]:
    """(x, p) for every vertex of the edges, p the smallest of its component."""
    up: dict = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = x = up[up[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return [(x, root(x)) for x in list(up)]


def components(edges: DataFrame, scratch: Scratch, name: str = "components", rounds: int | None = None, few: int = 0) -> DataFrame | None:
    """(x, p) for every vertex of edges (a, b), p the smallest vertex of its component; None without edges.

    With `rounds` the work stops early, and p is then some smaller vertex of the same component. A round maps every vertex
    to the smallest around it and keeps the edges between what they were mapped to, of which there are far fewer. The last `few`
    edges between numbers are followed on the driver.
    """
    levels = []
    k = 0
    edges = scratch.write(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), f"{name}-edges")
    numbers = few > 0 and set(dict(edges.dtypes).values()) <= {"bigint", "int"}
    while rounds is None or k < rounds:
        left = edges.limit(few + 1 if numbers else 1).collect()
        if not left:
            break
        if numbers and len(left) <= few:
            x, p = zip(*_roots(left))
            kind = pa.int32() if dict(edges.dtypes)["a"] == "int" else pa.int64()
            levels.append(edges.sparkSession.createDataFrame(pa.table({"x": pa.array(x, kind), "p": pa.array(p, kind)})))
            break
        parent = scratch.write(_jump(_hook(edges)), f"{name}-parent-{k}")
        a, b = parent.select(F.col("x").alias("a"), F.col("p").alias("pa")), parent.select(F.col("x").alias("b"), F.col("p").alias("pb"))
        between = edges.join(a, "a").join(b, "b").select("pa", "pb")
        chains = parent.select(F.col("p").alias("b")).join(b, "b").select(F.col("b").alias("pa"), "pb")  # from what was not yet a root
        left = between.unionByName(chains).where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b")).distinct()
        edges = scratch.write(left, f"{name}-left-{k}")
        levels.append(parent)
        k += 1
    if not levels:
        return None
    out = levels[0]
    for level in levels[1:]:
        out = _follow(out, level)
    return scratch.write(out, f"{name}-labels")


def _follow(labels: DataFrame, level: DataFrame) -> DataFrame:
    up = level.select(F.col("x").alias("p"), F.col("p").alias("up")).where("p <> up")
    return labels.join(up, "p", "left").select("x", F.coalesce("up", "p").alias("p"))


def connected_components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id of each vertex's component; vertices (id) without edges are their own."""
    labels = components(edges.select(F.col("src").alias("a"), F.col("dst").alias("b")), Scratch(edges.sparkSession, "graph"), few=FEW)
    if labels is None:
        return vertices.select("id", F.col("id").alias("component"))
    return vertices.select("id").join(labels.withColumnRenamed("x", "id"), "id", "left").select("id", F.coalesce("p", "id").alias("component"))


def reachable(edges: DataFrame, start: DataFrame, directed: bool = False) -> DataFrame:
    """(id): all vertices reachable from those of start (id), themselves included."""
    scratch = Scratch(edges.sparkSession, "reachable")
    step = edges.select("src", "dst")
    if not directed:
        step = step.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    step = scratch.write(step, "steps")  # read again every round
    seen = front = scratch.write(start.select("id").distinct(), "seen-0")
    k = 0
    while not front.isEmpty():
        k += 1
        front = scratch.write(step.join(front.withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti"), f"front-{k}")
        seen = seen.unionByName(front)
    return seen


def sparse_graph(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Distinct undirected edges whose ends are both vertices."""
    ids = vertices.select("id")
    held = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return held.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


# A directed multigraph: edges (edge_id, src, dst).


def out_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("src") == node)


def in_edges(edges: DataFrame, node) -> DataFrame:
    return edges.where(F.col("dst") == node)


def find_edge(edges: DataFrame, src, dst) -> DataFrame:
    return edges.where((F.col("src") == src) & (F.col("dst") == dst))


def remove_node(nodes: DataFrame, edges: DataFrame, node) -> tuple[DataFrame, DataFrame]:
    """Without the node and all edges at it."""
    return nodes.where(F.col("id") != node), edges.where((F.col("src") != node) & (F.col("dst") != node))


def remove_edge(edges: DataFrame, src, dst) -> DataFrame:
    return edges.where(~((F.col("src") == src) & (F.col("dst") == dst)))


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id"))
    return ends.groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def ring_edges(rings: DataFrame, ring: Column) -> DataFrame:
    """(id, i, j): the edges of each ring by the places of its points, the last leading to the first."""
    n = F.size(ring)
    return rings.select("id", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(i.alias("i"), ((i + 1) % n).alias("j")))).alias("e")).select("id", "e.i", "e.j")


def vertex_graph(triangles: DataFrame) -> DataFrame:
    """Distinct undirected edges of triangles (a, b, c) of vertex ids."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("src"), F.greatest(p, q).alias("dst")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return triangles.select(F.explode(pairs).alias("e")).select("e.src", "e.dst").distinct()


def random_tree(spark: SparkSession, n: int, kind: str = "random", k: int = 3, seed: int = 1) -> DataFrame:
    """(src, dst) of a tree on 0 .. n-1: random, tall (parents among the k before), star, chain or silkworm (a chain with a leaf on each)."""
    i = F.col("id")
    parent = {
        "random": F.floor(F.rand(seed) * i),
        "tall": i - 1 - F.floor(F.rand(seed) * F.least(F.lit(k), i)),
        "star": F.lit(0),
        "chain": i - 1,
        "silkworm": F.when(i < (n + 1) // 2, i - 1).otherwise(i - (n + 1) // 2),
    }[kind]
    return spark.range(1, max(1, n)).select(parent.cast("long").alias("src"), i.alias("dst"))
