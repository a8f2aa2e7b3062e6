"""Mesh text files: .node, .edge, .ele and .poly tables, topology files, and VTK as a sink.

Tables are read by Column expressions: numbered rows after a header with their count. A .poly file holds several tables one
after the other and is read as one value a file.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage


def _rows(lines: Iterable[str]) -> Iterator[list[str]]:
    for line in lines:
        parts = line.split("#", 1)[0].split()
        if parts:
            yield parts


def parse(kind: str, text: str) -> list[tuple]:
    """(table, id, values) rows of a file: node (coordinates), edge (two ids), ele (ids), facet (ids), hole (coordinates)."""
    rows = _rows(text.splitlines())
    out: list[tuple] = []

    def count(what: str) -> list[int]:
        try:
            return [int(float(v)) for v in next(rows)]
        except (StopIteration, ValueError) as e:
            raise ValueError(f"a count of {what} is missing") from e

    def take(n: int, what: str) -> Iterator[list[str]]:
        for _ in range(n):
            row = next(rows, None)
            if row is None:
                raise ValueError(f"fewer {what} than the header says")
            yield row

    if kind in ("node", "poly"):
        head = count("points")
        dim = head[1] if len(head) > 1 else 2
        out += [("node", int(r[0]), [float(v) for v in r[1 : 1 + dim]]) for r in take(head[0], "points")]
    if kind == "edge":
        out += [("edge", int(r[0]), [float(v) for v in r[1:3]]) for r in take(count("edges")[0], "edges")]
    if kind == "ele":
        head = count("elements")
        corners = head[1] if len(head) > 1 else 3
        out += [("ele", int(r[0]), [float(v) for v in r[1 : 1 + corners]]) for r in take(head[0], "elements")]
    if kind == "poly":
        for facet, row in enumerate(take(count("facets")[0], "facets")):
            n = int(row[0])
            holes = int(row[1]) if len(row) > 1 else 0
            for ring in take(n, "rings"):
                out.append(("facet", facet, [float(v) for v in ring[1 : 1 + int(ring[0])]]))
            for hole in take(holes, "holes"):
                out.append(("facet_hole", facet, [float(v) for v in hole[1:]]))
        tail = next(rows, None)
        if tail:
            out += [("hole", int(r[0]), [float(v) for v in r[1:]]) for r in take(int(tail[0]), "holes")]
    return out


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, table, id, values) of files of a kind (node, edge, ele or poly); each is read whole in a task."""
    import pandas as pd

    def run(frames):
        for frame in frames:
            rows = [(f, *row) for f, text in zip(frame["file"], frame["value"]) for row in parse(kind, text)]
            yield pd.DataFrame(rows, columns=["file", "table", "id", "values"])

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    return files.mapInPandas(run, "file string, table string, id long, values array<double>")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    """(id, p) of two-dimensional .node files, without Python: the header is the line that the count of fields tells apart."""
    lines = spark.read.text(path).select(F.split(F.trim(F.regexp_replace("value", "#.*$", "")), r"\s+").alias("v"))
    return lines.where((F.size("v") >= 3) & F.col("v")[1].rlike(r"[.eE]")).select(F.col("v")[0].cast("long").alias("id"), F.struct(F.col("v")[1].cast("double").alias("x"), F.col("v")[2].cast("double").alias("y")).alias("p"))


def read_topology(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (id, p) and edges (src, dst) of a file with `P n`, n points, `E m` and m edges."""
    lines = spark.read.text(path, wholetext=True).select(F.split("value", r"(?m)^\s*E[^\n]*\n").alias("parts"))
    points = F.filter(F.split(F.get("parts", F.lit(0)), "\n"), lambda s: s.rlike(r"^\s*[-+.0-9]"))
    edges = F.filter(F.split(F.get("parts", F.lit(1)), "\n"), lambda s: s.rlike(r"^\s*[0-9]"))
    p = lines.select(F.posexplode(points).alias("id", "s")).select(F.col("id").cast("long").alias("id"), F.split(F.trim("s"), r"[\s,]+").alias("v"))
    e = lines.select(F.explode(edges).alias("s")).select(F.split(F.trim("s"), r"[\s,]+").alias("v"))
    return p.select("id", F.struct(F.col("v")[0].cast("double").alias("x"), F.col("v")[1].cast("double").alias("y")).alias("p")), e.select(F.col("v")[0].cast("long").alias("src"), F.col("v")[1].cast("long").alias("dst"))


def topology_text(points: list[tuple[float, float]], edges: list[tuple[int, int]]) -> str:
    return "\n".join([f"P {len(points)}", *(f"{x!r} {y!r}" for x, y in points), f"E {len(edges)}", *(f"{a} {b}" for a, b in edges)]) + "\n"


def node_text(points: list[tuple]) -> str:
    dim = len(points[0]) if points else 2
    return "\n".join([f"{len(points)} {dim} 0 0", *(" ".join([str(i), *map(repr, p)]) for i, p in enumerate(points))]) + "\n"


def edge_text(edges: list[tuple[int, int]]) -> str:
    return "\n".join([f"{len(edges)} 0", *(f"{i} {a} {b}" for i, (a, b) in enumerate(edges))]) + "\n"


def poly_text(points: list[tuple], facets: list[list[list[int]]], holes: list[tuple] = ()) -> str:
    lines = [node_text(points).rstrip("\n"), f"{len(facets)} 0"]
    for rings in facets:
        lines += [f"{len(rings)} 0", *(" ".join(map(str, [len(r), *r])) for r in rings)]
    return "\n".join([*lines, str(len(holes)), *(" ".join([str(i), *map(repr, h)]) for i, h in enumerate(holes))]) + "\n"


def vtk_text(points: list[tuple], cells: list[list[int]], cell_type: int = 7) -> str:
    """An unstructured grid; type 7 is a polygon, 5 a triangle, 10 a tetrahedron."""
    size = sum(len(c) + 1 for c in cells)
    flat = [(*p, 0.0)[:3] for p in points]
    return "\n".join(
        ["# vtk DataFile Version 2.0", "grid", "ASCII", "DATASET UNSTRUCTURED_GRID", f"POINTS {len(flat)} double", *(" ".join(map(repr, p)) for p in flat), f"CELLS {len(cells)} {size}", *(" ".join(map(str, [len(c), *c])) for c in cells), f"CELL_TYPES {len(cells)}", *[str(cell_type)] * len(cells)]
    ) + "\n"


class MeshSource(DataSource):
    """spark.read.format("terraloom_mesh").option("kind", "node").load(path), for paths that all nodes see as files."""

    @classmethod
    def name(cls) -> str:
        return "terraloom_mesh"

    def schema(self) -> str:
        return "file string, table string, id long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self.options.get("kind", "node"))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"], self.options.get("kind", "node"))


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str):
        self.path, self.kind = path, kind

    def partitions(self) -> list[InputPartition]:
        import glob
        import os

        found = sorted(glob.glob(os.path.join(self.path, f"*.{self.kind}"))) if os.path.isdir(self.path) else sorted(glob.glob(self.path))
        return [InputPartition(f) for f in found]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        with open(partition.value) as f:
            for table, i, values in parse(self.kind, f.read()):
                yield partition.value, table, i, values


def ele_text(cells: list[tuple[int, ...]]) -> str:
    corners = len(cells[0]) if cells else 3
    return "\n".join([f"{len(cells)} {corners} 0", *(" ".join(map(str, [i, *c])) for i, c in enumerate(cells))]) + "\n"


class _Writer(DataSourceWriter):
    """Rows (file, table, id, values): a file of the kind for every partition, of the rows whose table it holds. A .poly and a .vtk file
    take node and facet rows; the others the rows of their own table."""

    def __init__(self, path: str, kind: str):
        if kind not in ("node", "edge", "ele", "poly", "vtk"):
            raise ValueError(f"no files of the kind {kind}")
        self.path, self.kind = path, kind

    def write(self, iterator) -> WriterCommitMessage:
        import os
        import uuid

        rows = sorted((row[1], row[2], tuple(row[3])) for row in iterator)
        of = lambda table: [v for t, _, v in rows if t == table]
        whole = lambda table: [tuple(map(int, v)) for v in of(table)]
        if self.kind in ("poly", "vtk"):
            facets = [list(f) for f in whole("facet")]
            text = poly_text(of("node"), [[f] for f in facets], of("hole")) if self.kind == "poly" else vtk_text(of("node"), facets)
        else:
            text = {"node": lambda: node_text(of("node")), "edge": lambda: edge_text(whole("edge")), "ele": lambda: ele_text(whole("ele"))}[self.kind]()
        if rows:
            os.makedirs(self.path, exist_ok=True)
            with open(os.path.join(self.path, f"part-{uuid.uuid4().hex}.{self.kind}"), "w") as f:
                f.write(text)
        return WriterCommitMessage()


def tree_dot(edges: list[tuple[int, int]]) -> str:
    """A tree (parent, child) in the DOT language."""
    return "\n".join(["digraph tree {", *(f"  {a} -> {b};" for a, b in edges), "}"]) + "\n"


def boxes_vtk(boxes: list[tuple[float, float, float, float, float, float]]) -> str:
    """Boxes (xmin, ymin, zmin, xmax, ymax, zmax) as cells of eight corners."""
    points, cells = [], []
    for x0, y0, z0, x1, y1, z1 in boxes:
        cells.append(list(range(len(points), len(points) + 8)))
        points += [(x, y, z) for z in (z0, z1) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]
    return vtk_text(points, cells, 12)


def write_vtk(polygons: DataFrame, ring: str, path: str, most: int = 1_000_000) -> int:
    """All rings of a small result as one file on the driver; returns how many there were. More than `most` raise."""
    rows = polygons.select(ring).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} polygons for one file")
    points: list[tuple] = []
    cells = []
    for (r,) in rows:
        cells.append(list(range(len(points), len(points) + len(r))))
        points += [(p["x"], p["y"]) for p in r]
    with open(path, "w") as f:
        f.write(vtk_text(points, cells))
    return len(rows)
