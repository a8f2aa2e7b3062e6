"""Geometry as plain structs and arrays: constructors, schemas and canonical forms.

A missing geometry is NULL. Coordinates are doubles. Rings are open (the first point isn't repeated) and counter-clockwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINT = "struct<x:double,y:double>"
POINT3 = "struct<x:double,y:double,z:double>"
BOX = "struct<xmin:double,ymin:double,xmax:double,ymax:double>"
BOX3 = "struct<xmin:double,ymin:double,zmin:double,xmax:double,ymax:double,zmax:double>"
RING = f"array<{POINT}>"
POLYGON = f"struct<outline:{RING},holes:array<{RING}>>"


def col(value) -> Column:
    """A Column of a name, a number or a Column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def num(value) -> Column:
    return col(value).cast("double")


def let(value: Column, use) -> Column:
    """use(value) with the value taken once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def point(x, y) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"))


def point3(x, y, z) -> Column:
    return F.struct(num(x).alias("x"), num(y).alias("y"), num(z).alias("z"))


def segment(s, e) -> Column:
    return F.struct(col(s).alias("s"), col(e).alias("e"))


def triangle(p0, p1, p2) -> Column:
    return F.struct(col(p0).alias("p0"), col(p1).alias("p1"), col(p2).alias("p2"))


def box(xmin, ymin, xmax, ymax) -> Column:
    return F.struct(num(xmin).alias("xmin"), num(ymin).alias("ymin"), num(xmax).alias("xmax"), num(ymax).alias("ymax"))


def box3(xmin, ymin, zmin, xmax, ymax, zmax) -> Column:
    names = ("xmin", "ymin", "zmin", "xmax", "ymax", "zmax")
    return F.struct(*[num(v).alias(n) for n, v in zip(names, (xmin, ymin, zmin, xmax, ymax, zmax))])


def circle(o, r) -> Column:
    return F.struct(col(o).alias("o"), num(r).alias("r"))


def ellipse(o, a, b) -> Column:
    return F.struct(col(o).alias("o"), num(a).alias("a"), num(b).alias("b"))


def ring(*points) -> Column:
    return F.array(*[col(p) for p in points])


def polygon(outline, holes=None) -> Column:
    none = F.expr(f"cast(array() as array<{RING}>)")
    return F.struct(col(outline).alias("outline"), (none if holes is None else col(holes)).alias("holes"))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that no column of df has, in any case of letters, from the given ones."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def is_kind(df: DataFrame, column: str, kind: str) -> bool:
    """Whether a column holds geometry of a kind, by its type: the fields and their order; numbers of any width count as coordinates."""
    held = df.select(column).schema[0].dataType.simpleString()
    for number in ("float", "int", "bigint", "smallint", "tinyint"):
        held = held.replace(f":{number}", ":double")
    return held == KINDS[kind].replace(" ", "")


#: The types of geometry by name.
KINDS = {
    "point": POINT, "point3": POINT3, "box": BOX, "box3": BOX3, "ring": RING, "polygon": POLYGON, "segment": f"struct<s:{POINT},e:{POINT}>", "segment3": f"struct<s:{POINT3},e:{POINT3}>",
    "triangle": f"struct<p0:{POINT},p1:{POINT},p2:{POINT}>", "triangle3": f"struct<p0:{POINT3},p1:{POINT3},p2:{POINT3}>", "circle": f"struct<o:{POINT},r:double>", "ellipse": f"struct<o:{POINT},a:double,b:double>",
}
