"""Strings, hashes, paths, versions, units and colours as Column expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import col, num


def _cased(s, case: bool) -> Column:
    return col(s) if case else F.lower(col(s))


def _text(s: str | Column, case: bool) -> Column:
    s = F.lit(s) if isinstance(s, str) else s
    return s if case else F.lower(s)


def starts_with(s, prefix: str | Column, case: bool = True) -> Column:
    return F.startswith(_cased(s, case), _text(prefix, case))


def ends_with(s, suffix: str | Column, case: bool = True) -> Column:
    return F.endswith(_cased(s, case), _text(suffix, case))


def equals(s, other: str | Column, case: bool = True) -> Column:
    return _cased(s, case) == _text(other, case)


def contains(s, part: str | Column, case: bool = True) -> Column:
    return F.contains(_cased(s, case), _text(part, case))


def trim(s) -> Column:
    """All white space on both ends, not only spaces."""
    return F.regexp_replace(col(s), r"^\s+|\s+$", "")


def split(s, separators: str = " ") -> Column:
    """At any of the characters; empty parts are dropped."""
    return F.filter(F.split(col(s), "[" + re.escape(separators).replace("[", r"\[").replace("&", r"\&") + "]"), lambda t: t != "")


def wildcard(s, pattern: str) -> Column:
    """The whole string against * and ?; all other characters stand for themselves."""
    parts = (".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return col(s).rlike("^" + "".join(parts) + r"\z")


def join_values(values, separator: str = ",") -> Column:
    return F.array_join(col(values), separator)


def format_text(fmt: str, *args) -> Column:
    return F.format_string(fmt, *[col(a) for a in args])


def append_int(s, i, width: int = 0) -> Column:
    """The number behind the string, with leading zeros up to the width; longer numbers stay whole."""
    digits = col(i).cast("string")
    return F.concat(col(s), F.when(F.length(digits) >= width, digits).otherwise(F.lpad(digits, width, "0")))


def hashed(*values) -> Column:
    return F.xxhash64(*[col(v) for v in values])


def ordered_hash(values) -> Column:
    """Of an array; the order matters."""
    return F.aggregate(col(values), F.lit(0).cast("long"), lambda h, v: F.xxhash64(h, v))


def unordered_hash(values) -> Column:
    """XOR of the elements' hashes: any order gives the same, and equal pairs cancel."""
    return F.aggregate(col(values), F.lit(0).cast("long"), lambda h, v: h.bitwiseXOR(F.xxhash64(v)))


def dir_name(path) -> Column:
    return F.regexp_extract(col(path), r"^(.*)/[^/]*$", 1)


def file_name(path) -> Column:
    return F.regexp_extract(col(path), r"([^/]*)$", 1)


def base_name(path) -> Column:
    """The file's name without its last extension."""
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


# Versions: major * 100000 + minor * 1000 + patch.


def version_pack(major, minor, patch) -> Column:
    return col(major).cast("int") * 100000 + col(minor).cast("int") * 1000 + col(patch).cast("int")


def version_parts(v) -> Column:
    v = col(v).cast("int")
    return F.struct(F.floor(v / 100000).cast("int").alias("major"), (F.floor(v / 1000) % 100).cast("int").alias("minor"), (v % 1000).alias("patch"))


def version_text(v) -> Column:
    p = version_parts(v)
    return F.concat_ws(".", p["major"].cast("string"), p["minor"].cast("string"), p["patch"].cast("string"))


# Units: what one of the unit is in SI.

TIME = {"femtosecond": 1e-15, "picosecond": 1e-12, "nanosecond": 1e-9, "microsecond": 1e-6, "millisecond": 1e-3, "second": 1.0, "minute": 60.0, "hour": 3600.0}
LENGTH = {"nanometer": 1e-9, "micrometer": 1e-6, "millimeter": 1e-3, "centimeter": 1e-2, "meter": 1.0, "inch": 0.0254}
PREFIX = {"femto": 1e-15, "pico": 1e-12, "nano": 1e-9, "micro": 1e-6, "milli": 1e-3, "": 1.0, "kilo": 1e3, "mega": 1e6, "giga": 1e9}
SHORT_TIME = {"femtosecond": "fs", "picosecond": "ps", "nanosecond": "ns", "microsecond": "us", "millisecond": "ms", "second": "s", "minute": "min", "hour": "h"}


def _lookup(table: dict, key) -> Column:
    out = F.lit(None)
    for name, value in table.items():
        out = F.when(col(key) == name, F.lit(value)).otherwise(out)
    return out


def to_si(value, unit, table: dict[str, float]) -> Column:
    """NULL for an unknown unit."""
    return num(value) * _lookup(table, unit)


def time_unit_text(unit) -> Column:
    return _lookup(SHORT_TIME, unit)


def celsius_to_kelvin(t) -> Column:
    return num(t) + 273.15


def kelvin_to_celsius(t) -> Column:
    return num(t) - 273.15


# Colours.


def rgb_to_int(r, g, b, a=None) -> Column:
    out = F.shiftleft(col(r).cast("int"), 16).bitwiseOR(F.shiftleft(col(g).cast("int"), 8)).bitwiseOR(col(b).cast("int"))
    return out if a is None else F.shiftleft(col(a).cast("int"), 24).bitwiseOR(out)


def int_to_rgb(c) -> Column:
    c = col(c).cast("int")
    return F.struct(*[F.shiftrightunsigned(c, k).bitwiseAND(F.lit(255)).alias(n) for n, k in (("r", 16), ("g", 8), ("b", 0), ("a", 24))])


def jet(scalar) -> Column:
    """0 to 1 from dark blue over green to dark red."""
    s = F.greatest(F.lit(0.0), F.least(F.lit(1.0), num(scalar)))

    def channel(center: float) -> Column:
        v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * s - center)))
        return F.round(v * 255).cast("int")

    return F.struct(channel(3.0).alias("r"), channel(2.0).alias("g"), channel(1.0).alias("b"))


def grey(scalar) -> Column:
    v = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), num(scalar))) * 255).cast("int")
    return F.struct(v.alias("r"), v.alias("g"), v.alias("b"))


def type_name(value) -> Column:
    """The name of a value's type."""
    return F.typeof(col(value))


def parse(value, parser, kind: str) -> Column:
    """What a Python function makes of a text, as a SQL type; NULL where it raises ValueError."""
    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        def one(s):
            try:
                return None if s is None else parser(s)
            except ValueError:
                return None

        return pd.Series([one(s) for s in texts], dtype=object)

    return run(col(value))
