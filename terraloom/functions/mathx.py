"""Numbers: tolerant comparison, intervals, rounding, powers of two, polynomials, interpolation, roots and approximations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .types import num

PI, TWO_PI, HALF_PI, QUARTER_PI, INV_PI, SQRT2 = math.pi, 2 * math.pi, math.pi / 2, math.pi / 4, 1 / math.pi, math.sqrt(2)


def eq(a, b, tol: float = 0.0) -> Column:
    return F.abs(num(a) - num(b)) <= tol if tol else num(a) == num(b)


def ne(a, b, tol: float = 0.0) -> Column:
    return ~eq(a, b, tol)


def ge(a, b, tol: float = 0.0) -> Column:
    return num(a) >= num(b) - tol


def le(a, b, tol: float = 0.0) -> Column:
    return num(a) <= num(b) + tol


def gt(a, b, tol: float = 0.0) -> Column:
    return ~le(a, b, tol)


def lt(a, b, tol: float = 0.0) -> Column:
    return ~ge(a, b, tol)


def within(v, low, high, kind: str = "closed", tol: float = 0.0) -> Column:
    """kind: open, closed, left_open (right closed) or right_open (left closed)."""
    above = gt if kind in ("open", "left_open") else ge
    below = lt if kind in ("open", "right_open") else le
    return above(v, low, tol) & below(v, high, tol)


def is_negative(v) -> Column:
    """By the sign bit: a negative zero is negative."""
    v = num(v)
    return (v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-")))


def is_positive(v) -> Column:
    return num(v) > 0


def rad(v) -> Column:
    return F.radians(num(v))


def deg(v) -> Column:
    return F.degrees(num(v))


def round_digits(v, digits: int) -> Column:
    """To significant digits; 0 stays 0, and no digits leave the value."""
    v = num(v)
    if digits == 0:
        return v
    safe = F.when(v == 0, 1.0).otherwise(v)
    f = F.pow(F.lit(10.0), F.lit(float(digits)) - F.ceil(F.log10(F.abs(safe))))
    return F.when(v == 0, 0.0).otherwise(F.round(v * f) / f)


def next_pow_two(v) -> Column:
    """The smallest power of two that isn't below v."""
    return F.pow(F.lit(2.0), F.ceil(F.log2(num(v)))).cast("long")


def prev_pow_two(v) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(num(v)))).cast("long")


def to_bits(v) -> Column:
    """The 32 bits of a single-precision number, from its sign, exponent and fraction."""
    f = num(v).cast("float").cast("double")
    a = F.abs(f)
    safe = F.when(a == 0, 1.0).otherwise(a)
    guess = F.floor(F.log2(safe))
    exponent = guess + F.when(safe >= F.pow(F.lit(2.0), guess + 1), 1).when(safe < F.pow(F.lit(2.0), guess), -1).otherwise(0)
    small = exponent < -126
    fraction = F.when(small, a * 2.0**149).otherwise((safe / F.pow(F.lit(2.0), exponent.cast("double")) - 1) * 2.0**23)
    bits = F.when(a == 0, F.lit(0)).otherwise(F.when(small, F.lit(0)).otherwise((exponent + 127) * 8388608) + fraction.cast("long"))
    special = F.when(F.isnan(f), F.lit(2143289344)).when(a == float("inf"), F.lit(2139095040)).otherwise(bits.cast("long"))
    return F.lpad(F.bin(special.cast("long") + F.when(is_negative(f) & ~F.isnan(f), F.lit(2147483648)).otherwise(F.lit(0))), 32, "0")


def poly_val(coefficients: Sequence[float] | Column, x) -> Column:
    """Ascending powers."""
    x = num(x)
    if isinstance(coefficients, Column):
        return F.aggregate(F.reverse(coefficients), F.lit(0.0), lambda s, c: s * x + c)
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + F.lit(float(c))
    return out


def linear(q1, q2, x1, x2, x) -> Column:
    q1, q2, x1, x2, x = map(num, (q1, q2, x1, x2, x))
    return q1 + (q2 - q1) * (x - x1) / (x2 - x1)


def bilinear(q11, q12, q21, q22, x1, x2, y1, y2, x, y) -> Column:
    """qij is the value at xi, yj."""
    return linear(linear(q11, q21, x1, x2, x), linear(q12, q22, x1, x2, x), y1, y2, y)


def bisection(f: Callable[[Column], Column], low, high, steps: int = 60) -> Column:
    """The root of f in a bracket by so many halvings; NULL where the ends don't differ in sign."""
    low, high = num(low), num(high)
    start = F.struct(low.alias("a"), high.alias("b"))
    sign = F.signum(f(low))

    def halve(s: Column, _: Column) -> Column:
        m = (s["a"] + s["b"]) / 2
        left = F.signum(f(m)) == sign
        return F.struct(F.when(left, m).otherwise(s["a"]).alias("a"), F.when(left, s["b"]).otherwise(m).alias("b"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve, lambda s: (s["a"] + s["b"]) / 2)
    return F.when(f(low) == 0, low).when(f(high) == 0, high).when(F.signum(f(low)) * F.signum(f(high)) < 0, root)


def newton(f: Callable[[Column], Column], df: Callable[[Column], Column], start, steps: int = 30) -> Column:
    """So many Newton steps; one whose slope is zero stays."""

    def step(x: Column, _: Column) -> Column:
        slope = df(x)
        return F.when(slope == 0, x).otherwise(x - f(x) / F.when(slope == 0, 1.0).otherwise(slope))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), num(start), step)


def random_between(low: float, high: float, seed: int) -> Column:
    return F.rand(seed) * (high - low) + low


def random_normal(mean: float, deviation: float, seed: int) -> Column:
    return F.randn(seed) * deviation + mean


#: The fast approximations are the exact functions here: inside generated code these cost less than a shuffle of a byte.
FAST = {"sin": F.sin, "cos": F.cos, "log2": F.log2, "log": F.log, "exp": F.exp, "pow2": lambda v: F.pow(F.lit(2.0), v)}


def fast(name: str, v) -> Column:
    return FAST[name](num(v))
