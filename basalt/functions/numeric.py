"""Arithmetic, comparison, casts and mathematics of a dynamically typed SQL dialect.

Integers are 64 bits wide, results that don't exist (division by zero, values
outside a function's domain) are null and not errors, and text counts by its
numeric prefix.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LOW, HIGH = -(2**63), 2**63 - 1


def nan_null(x: Column) -> Column:
    """NaN is never a value."""
    return F.when(~F.isnan(x), x)


def _overflow(try_function: str, a: Column, b: Column, real: Column) -> Column:
    exact = getattr(F, try_function)(a.cast("bigint"), b.cast("bigint"))
    return F.coalesce(exact.cast("double"), real)


def add(a: Column, b: Column) -> Column:
    """Integer sum as a real where it may leave 64 bits."""
    return _overflow("try_add", a, b, a.cast("double") + b.cast("double"))


def subtract(a: Column, b: Column) -> Column:
    return _overflow("try_subtract", a, b, a.cast("double") - b.cast("double"))


def multiply(a: Column, b: Column) -> Column:
    return _overflow("try_multiply", a, b, a.cast("double") * b.cast("double"))


def int_div(a: Column, b: Column) -> Column:
    """Quotient of integers, truncated towards zero; null for a zero divisor."""
    a, b = a.cast("bigint"), b.cast("bigint")
    # the one quotient beyond 64 bits saturates
    return F.when((a == LOW) & (b == -1), F.lit(HIGH)).otherwise(F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))))


def real_div(a: Column, b: Column) -> Column:
    return F.try_divide(a.cast("double"), b.cast("double"))


def mod(a: Column, b: Column) -> Column:
    """Remainder of both sides truncated to integers, with the sign of the dividend."""
    return F.try_mod(to_integer(a), F.nullif(to_integer(b), F.lit(0).cast("bigint")))


def fmod(a: Column, b: Column) -> Column:
    return F.try_mod(a.cast("double"), b.cast("double"))


def shift_left(a: Column, n: Column) -> Column:
    """Bits shifted; a negative count shifts the other way, 64 or more empties the word."""
    return _shift(a.cast("bigint"), n.cast("bigint"))


def shift_right(a: Column, n: Column) -> Column:
    return _shift(a.cast("bigint"), -n.cast("bigint"))


def _shift(a: Column, n: Column) -> Column:
    steps = F.least(F.abs(n), F.lit(64)).cast("int")
    left = F.when(steps >= 64, F.lit(0).cast("bigint")).otherwise(F.call_function("shiftleft", a, steps))
    right = F.when(steps >= 64, F.when(a < 0, F.lit(-1)).otherwise(F.lit(0)).cast("bigint")).otherwise(F.call_function("shiftright", a, steps))
    return F.when(n >= 0, left).otherwise(right)


def truth(x: Column) -> Column:
    """Whether a number counts as true; null stays unknown."""
    return x != 0


def to_integer(x: Column) -> Column:
    """CAST AS INTEGER: a text's integer prefix (0 without one), a real cut off and saturated."""
    text = x.cast("string")
    prefix = F.regexp_extract(F.trim(text), r"^[+-]?\d+", 0)
    digits = F.when(prefix == "", F.lit("0")).otherwise(prefix)
    saturated = F.when(digits.startswith("-"), F.lit(LOW)).otherwise(F.lit(HIGH))
    real = F.regexp_extract(F.trim(text), r"^[+-]?\d+(\.\d*)?[eE][+-]?\d+", 0)
    wide = real.try_cast("double")
    cut = F.when(wide >= 9.223372036854775e18, F.lit(HIGH)).when(wide <= -9.223372036854775e18, F.lit(LOW)).otherwise(wide.cast("bigint"))
    return F.when(x.isNull(), F.lit(None).cast("bigint")).otherwise(F.when(real != "", cut).otherwise(F.coalesce(digits.try_cast("bigint"), saturated)))


def text_to_integer(x: Column) -> Column:
    """CAST AS INTEGER of text, which ignores an exponent: '12e3' is 12."""
    prefix = F.regexp_extract(F.trim(x), r"^[+-]?\d+", 0)
    digits = F.when(prefix == "", F.lit("0")).otherwise(prefix)
    saturated = F.when(digits.startswith("-"), F.lit(LOW)).otherwise(F.lit(HIGH))
    return F.when(x.isNotNull(), F.coalesce(digits.try_cast("bigint"), saturated))


def text_to_real(x: Column) -> Column:
    """CAST AS REAL of text: its numeric prefix, 0.0 without one."""
    prefix = F.regexp_extract(F.trim(x), r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", 0)
    return F.when(x.isNotNull(), F.coalesce(prefix.try_cast("double"), F.lit(0.0)))


def numeric_affinity(x: Column) -> Column:
    """The number that a text wholly is; null if it isn't one."""
    whole = F.trim(x)
    return F.when(whole.rlike(r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), whole.try_cast("double"))


def scalar_min(*xs: Column) -> Column:
    """The least value; null if any is null."""
    return F.when(_all_there(xs), F.least(*xs))


def scalar_max(*xs: Column) -> Column:
    return F.when(_all_there(xs), F.greatest(*xs))


def _all_there(xs: tuple[Column, ...]) -> Column:
    out = xs[0].isNotNull()
    for x in xs[1:]:
        out = out & x.isNotNull()
    return out


def log(x: Column, base: Column | None = None) -> Column:
    """Base 10 with one argument; the base comes first with two (``log(x, base=b)`` here)."""
    x = x.cast("double")
    if base is None:
        return F.when(x > 0, F.log10(x))
    base = base.cast("double")
    return F.when((x > 0) & (base > 0) & (base != 1), F.ln(x) / F.ln(base))


def trunc(x: Column) -> Column:
    return F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)).cast("double")


def ceil(x: Column) -> Column:
    return F.ceil(x.cast("double")).cast("double")


def floor(x: Column) -> Column:
    return F.floor(x.cast("double")).cast("double")


def sign(x: Column) -> Column:
    return F.signum(x.cast("double")).cast("int")


def round_half_away(x: Column, digits: int = 0) -> Column:
    return F.round(x.cast("double"), max(digits, 0))


def domain(name: str, x: Column) -> Column:
    """acos, asin, acosh, atanh, sqrt, ... with null outside the domain."""
    return nan_null(getattr(F, name)(x.cast("double")))


def random_integer() -> Column:
    """A random 64-bit integer per row."""
    return F.xxhash64(F.rand(), F.monotonically_increasing_id())
