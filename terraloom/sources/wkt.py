"""Well-known text as a source and a sink: a geometry a line, parsed and written by Column expressions.

POINT, LINESTRING, POLYGON, SEGMENT, TRIANGLE, BOX and LINE. Rings are open here and closed in the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.types import RING, box, point

NUMBER = r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"
PAIR = rf"{NUMBER}\s+{NUMBER}"


def _points(text: Column) -> Column:
    pairs = F.regexp_extract_all(text, F.lit(f"({PAIR})"), F.lit(1))
    return F.transform(pairs, lambda p: point(F.split(p, r"\s+")[0].cast("double"), F.split(p, r"\s+")[1].cast("double")))


def _open(ring: Column) -> Column:
    """Without the last point where it repeats the first."""
    n = F.size(ring)
    return F.when((n > 1) & (F.get(ring, F.lit(0)) == F.get(ring, n - 1)), F.slice(ring, F.lit(1), n - 1)).otherwise(ring)


def kind(text: Column) -> Column:
    return F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)\s*\(", 1))


def parse_rings(text: Column) -> Column:
    """All rings of a POLYGON, the outline first; other kinds are one list of points."""
    lists = F.regexp_extract_all(text, F.lit(r"\(([^()]*)\)"), F.lit(1))
    return F.transform(lists, lambda s: _open(_points(s)))


def parse_polygon(text: Column) -> Column:
    rings = parse_rings(text)
    return F.when(kind(text) == "POLYGON", F.struct(F.get(rings, F.lit(0)).alias("outline"), F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))).alias("holes")))


def parse_points(text: Column) -> Column:
    return _points(text)


def parse_point(text: Column) -> Column:
    return F.when(kind(text) == "POINT", F.get(_points(text), F.lit(0)))


def parse_box(text: Column) -> Column:
    p = _points(text)
    a, b = F.get(p, F.lit(0)), F.get(p, F.lit(1))
    return F.when(kind(text) == "BOX", box(a["x"], a["y"], b["x"], b["y"]))


def valid(text: Column) -> Column:
    """Whether a line holds a geometry of a known kind with well-formed numbers."""
    numbers = rf"\(\s*{PAIR}(?:\s*,\s*{PAIR})*\s*\)"
    line = rf"\(\s*{NUMBER}(?:\s*,\s*{NUMBER}){{2}}\s*\)"
    return text.rlike(rf"^\s*(?i:(?:POINT|LINESTRING|SEGMENT|TRIANGLE|BOX)\s*{numbers}|POLYGON\s*\(\s*{numbers}(?:\s*,\s*{numbers})*\s*\)|LINE\s*{line})\s*$")


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(line, wkt, kind) of the geometries in text files; lines from # on are skipped, and so are empty ones.

    With strict a bad line raises an error that names it; without, its kind is NULL.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("wkt")).where("wkt <> '' and not startswith(wkt, '#')")
    ok = valid(F.col("wkt"))
    bad = F.raise_error(F.concat(F.lit("not a geometry: "), F.col("wkt"))) if strict else F.lit(None)
    return lines.select("wkt", F.when(ok, kind(F.col("wkt"))).otherwise(bad.cast("string")).alias("kind"))


def number(v: Column) -> Column:
    """Without a fraction where there is none."""
    return F.when(v == F.floor(v), F.format_string("%.0f", v)).otherwise(v.cast("string"))


def _pair(p: Column) -> Column:
    return F.concat(number(p["x"]), F.lit(" "), number(p["y"]))


def _list(points: Column, closed: bool = False) -> Column:
    held = F.concat(points, F.slice(points, 1, 1)) if closed else points
    return F.concat(F.lit("("), F.array_join(F.transform(held, _pair), ","), F.lit(")"))


def point_text(p: Column) -> Column:
    return F.concat(F.lit("POINT("), _pair(p), F.lit(")"))


def box_text(b: Column) -> Column:
    return F.concat(F.lit("BOX("), _pair(point(b["xmin"], b["ymin"])), F.lit(","), _pair(point(b["xmax"], b["ymax"])), F.lit(")"))


def segment_text(s: Column) -> Column:
    return F.concat(F.lit("SEGMENT"), _list(F.array(s["s"], s["e"])))


def triangle_text(t: Column) -> Column:
    return F.concat(F.lit("TRIANGLE"), _list(F.array(t["p0"], t["p1"], t["p2"]), closed=True))


def line_text(line: Column) -> Column:
    return F.concat(F.lit("LINE("), F.concat_ws(",", *[number(line[c]) for c in "abc"]), F.lit(")"))


def polygon_text(p: Column) -> Column:
    rings = F.concat(F.array(p["outline"].cast(RING)), p["holes"])
    return F.concat(F.lit("POLYGON("), F.array_join(F.transform(rings, lambda r: _list(r, closed=True)), ","), F.lit(")"))


def write(df: DataFrame, text: Column, path: str) -> None:
    df.select(text.alias("value")).write.mode("overwrite").text(path)
