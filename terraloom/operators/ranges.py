"""Ordered work on long groups: rows numbered, windowed and carried on range by range, so that no task holds a whole group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.types import fresh

#: A range has about so many rows; a table of fewer is one range, and its groups are windows of their own.
ROWS = 1_000_000
MOST = 4096


def ranges_for(df: DataFrame) -> int:
    """How many ranges the rows of a table are worth."""
    return min(MOST, -(-df.count() // ROWS)) or 1


def range_of(df: DataFrame, order: str, ranges: int) -> Column:
    """The number of a row's range: the table is cut at approximate quantiles of a column, equal values never. Nulls come first."""
    if ranges <= 1:
        return F.lit(0)
    cuts = df.agg(F.percentile_approx(order, [k / ranges for k in range(1, ranges)], 10 * ranges)).first()[0]
    return F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts or []))]), lambda c: c <= F.col(order))) if cuts else F.lit(0)


def meet(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left with the other columns of right where the keys are equal, a null being equal to another."""
    names = fresh(left, *[f"key{k}" for k in range(len(keys))])
    renamed = right.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], *[c for c in right.columns if c not in keys])
    equal = F.lit(True)
    for k, n in zip(keys, names):
        equal = equal & F.col(k).eqNullSafe(F.col(n))
    return left.join(renamed, equal).drop(*names)


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", ranges: int | None = None) -> DataFrame:
    """df with the place of each row in its group from 0: rows are numbered within ranges of the first column of the order, and
    moved up by the sizes of the ranges before."""
    ranges = ranges or ranges_for(df)
    if ranges == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    part, first = fresh(df, "part", "first")
    own = df.withColumn(part, range_of(df, order[0], ranges))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = own.groupBy(*keys, part).agg(F.count(F.lit(1)).alias(first)).withColumn(first, F.coalesce(F.sum(first).over(before), F.lit(0)))
    within = F.row_number().over(Window.partitionBy(*keys, part).orderBy(*order)) - 1
    placed = meet(own.withColumn(name, within), sizes, [*keys, part])
    return placed.withColumn(name, F.col(name) + F.col(first)).select(*[c for c in df.columns if c != name], name)


def in_blocks(df: DataFrame, keys: Sequence[str], order: Sequence[str], halo: int, ranges: int | None = None, rows: int = ROWS) -> tuple[DataFrame, list[str], Column]:
    """Rows dealt to blocks of their group with `halo` more rows on either side; the columns of a block, and whether a row is there
    in its own right. Windows over a block see all that those over the group would see, `halo` rows far."""
    ranges = ranges or ranges_for(df)
    if ranges == 1:
        return df, list(keys), F.lit(True)
    pos, block = fresh(df, "pos", "block")
    rows = max(rows, 2 * halo + 1)
    at, home = F.col(pos) % rows, F.floor(F.col(pos) / rows)
    near = F.array(home, F.when((at < halo) & (home > 0), home - 1), F.when(at >= rows - halo, home + 1))
    dealt = numbered(df, keys, order, pos, ranges).withColumn(block, F.explode(F.array_compact(near)))
    return dealt, [*keys, block], F.col(block) == home


def carried(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """df with `value` filled by the last one that isn't null up to each row, in the order within the group."""
    ranges = ranges or ranges_for(df)
    if ranges == 1:
        up = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.withColumn(value, F.last(value, ignorenulls=True).over(up))
    part, last = fresh(df, "part", "last")
    own = df.withColumn(part, range_of(df, order[0], ranges))
    known = F.col(value).isNotNull()
    ends = own.groupBy(*keys, part).agg(F.max_by(value, F.when(known, F.struct(*order))).alias(last))
    before = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    ends = ends.withColumn(last, F.last(last, ignorenulls=True).over(before))
    up = Window.partitionBy(*keys, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    filled = own.withColumn(value, F.last(value, ignorenulls=True).over(up))
    return meet(filled, ends, [*keys, part]).select(*[F.coalesce(c, last).alias(c) if c == value else F.col(c) for c in df.columns])
