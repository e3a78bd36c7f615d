"""Text functions, with case folding of ASCII letters only."""

from __future__ import annotations

import math
import os
import re
import string

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types

UP, DOWN = string.ascii_uppercase, string.ascii_lowercase


def lower(x: Column) -> Column:
    return F.translate(x, UP, DOWN)


def upper(x: Column) -> Column:
    return F.translate(x, DOWN, UP)


def nocase(x: Column) -> Column:
    """The key under which values compare without regard to (ASCII) case."""
    return lower(x)


def rtrim_key(x: Column) -> Column:
    """The key under which trailing spaces don't count."""
    return F.rtrim(x)


def like(x: Column, pattern: str, escape: str | None = None) -> Column:
    """LIKE: % and _ as wildcards, ASCII letters of either case equal."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        if escape and c == escape and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i].lower() if pattern[i] in UP else pattern[i])
        elif c == "%":
            out += r"[\s\S]*"
        elif c == "_":
            out += r"[\s\S]"
        else:
            out += re.escape(c.lower() if c in UP else c)
        i += 1
    return lower(x).rlike(out + r"\z")


def glob_regex(pattern: str) -> str:
    """The regular expression of a GLOB pattern: * ? [..] [^..], case counts."""
    out, i = "^", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += r"[\s\S]*"
        elif c == "?":
            out += r"[\s\S]"
        elif c == "[":
            j = i + 1
            negate = pattern[j : j + 1] == "^"
            j += negate
            end = pattern.find("]", j + 1)
            if end < 0:
                return r"(?!)"
            body = re.sub(r"([\\\[\]&~^])", r"\\\1", pattern[j:end])
            out += ("[^" if negate else "[") + body + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return out + r"\z"


def glob(x: Column, pattern: str) -> Column:
    return x.rlike(glob_regex(pattern))


@F.pandas_udf(types.BooleanType())
def glob_column(x: pd.Series, pattern: pd.Series) -> pd.Series:
    """GLOB with a pattern per row."""
    known: dict[str, re.Pattern] = {}
    out = []
    for v, p in zip(x, pattern, strict=True):
        if v is None or p is None:
            out.append(None)
            continue
        if p not in known:
            known[p] = re.compile(glob_regex(p).replace(r"\z", r"\Z"))
        out.append(known[p].search(v) is not None)
    return pd.Series(out, dtype="object")


def hex_text(x: Column) -> Column:
    """The bytes of a value's text in hexadecimal."""
    return F.hex(x.cast("string").cast("binary"))


def unhex_text(x: Column, ignore: str = "") -> Column:
    """Bytes of hexadecimal text, characters of ``ignore`` left out; null if anything else is in it."""
    plain = F.translate(x, ignore, "") if ignore else x
    return F.when(plain.rlike("^([0-9A-Fa-f]{2})*$"), F.unhex(plain))


def substr(x: Column, start: Column, length: Column | None = None) -> Column:
    """Characters from a start that counts from 1, or from the end if negative.

    Place 0 is before the first character; a negative length takes those before the start.
    """
    n = F.length(x)
    begin = F.when(start < 0, n + start).when(start > 0, start - 1).otherwise(F.lit(-1))
    if length is None:
        low, high = begin, n
    else:
        low = F.when(length < 0, begin + length).otherwise(begin)
        high = F.when(length < 0, begin).otherwise(begin + length)
        low = F.when((start == 0) & (length < 0), F.lit(0)).otherwise(low)
        high = F.when((start == 0) & (length < 0), F.lit(0)).otherwise(high)
    low, high = F.greatest(low, F.lit(0)), F.least(F.greatest(high, F.lit(0)), n)
    size = F.greatest(high - low, F.lit(0))
    return F.when(x.isNotNull() & start.isNotNull(), F.substring(x, (low + 1).cast("int"), size.cast("int")))


def trim(x: Column, chars: str = " ", side: str = "both") -> Column:
    """Any of ``chars`` taken off either end, the left or the right one."""
    one = "[" + re.sub(r"([\\\[\]&~^-])", r"\\\1", chars) + "]+"
    if side in ("both", "left"):
        x = F.regexp_replace(x, "^" + one, "")
    if side in ("both", "right"):
        x = F.regexp_replace(x, one + r"\z", "")
    return x


def instr(x: Column, part: Column) -> Column:
    return F.call_function("instr", x, part)


def unicode(x: Column) -> Column:
    """The first character's code point; null for empty text."""
    return F.when(F.length(x) > 0, F.call_function("ascii", x))


@F.pandas_udf(types.StringType())
def char(points: pd.Series) -> pd.Series:
    """Text of an array of code points."""
    fix = lambda p: chr(p) if p is not None and 0 <= p < 0x110000 and not 0xD800 <= p < 0xE000 else "�"
    return points.map(lambda ps: None if ps is None else "".join(fix(int(p)) for p in ps))


def quote(x: Column, kind: str) -> Column:
    """A value as an SQL literal."""
    if kind == "string":
        return F.coalesce(F.concat(F.lit("'"), F.replace(x, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))
    if kind == "binary":
        return F.coalesce(F.concat(F.lit("X'"), F.hex(x), F.lit("'")), F.lit("NULL"))
    return F.coalesce(x.cast("string"), F.lit("NULL"))


def typeof(x: Column, kind: str) -> Column:
    """The storage class of a column's values."""
    name = {"string": "text", "binary": "blob", "double": "real", "float": "real"}.get(kind, "integer")
    return F.when(x.isNull(), F.lit("null")).otherwise(F.lit(name))


def concat(*xs: Column) -> Column:
    """All values as text, nulls as nothing."""
    return F.concat_ws("", *[x.cast("string") for x in xs])


def concat_ws(separator: str, *xs: Column) -> Column:
    return F.concat_ws(separator, *[x.cast("string") for x in xs])


def zeroblob(n: Column) -> Column:
    return F.unhex(F.repeat(F.lit("00"), F.greatest(n, F.lit(0)).cast("int")))


@F.pandas_udf(types.BinaryType())
def randomblob(n: pd.Series) -> pd.Series:
    return n.map(lambda k: os.urandom(max(int(k), 1)))


@F.pandas_udf(types.StringType())
def unistr(x: pd.Series) -> pd.Series:
    r"""Text with \XXXX, \+XXXXXX, \uXXXX and \UXXXXXXXX replaced by characters; null if an escape is malformed."""
    escape = re.compile(r"\\(?:\\|u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|\+([0-9A-Fa-f]{6})|([0-9A-Fa-f]{4}))")

    def one(v):
        if v is None or "\\" in escape.sub("", v):
            return None
        return escape.sub(lambda m: chr(int(next(g for g in m.groups() if g), 16)) if any(m.groups()) else "\\", v)

    return x.map(one)


_DIRECTIVE = re.compile(r"%([-+ 0#,!]*)(\*|\d+)?(?:\.(\*|\d+))?(?:ll|l|h)?([diuxXofeEgGscqQwp%])")


def format_text(template: str, values: list) -> str:
    """printf: directives of a template filled with values, missing ones as null."""
    rest = iter(values)

    def take():
        return next(rest, None)

    def number(v, kind=float):
        if isinstance(v, str):
            m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+)" if kind is float else r"\s*[+-]?\d+", v)
            v = m.group() if m else 0
        return kind(0 if v is None else v)

    def whole(v):
        if isinstance(v, float):
            return int(v) if math.isfinite(v) else 0 if v != v else 2**63 - 1 if v > 0 else -(2**63)
        return number(v, int)

    def fill(m: re.Match) -> str:
        flags, width, precision, kind = m.groups()
        if kind == "%":
            return "%"
        width = number(take(), int) if width == "*" else int(width or 0)
        precision = number(take(), int) if precision == "*" else None if precision is None else int(precision)
        if width < 0:
            flags, width = flags + "-", -width
        v = take()
        sign = "+" if flags.rfind("+") > flags.rfind(" ") else " " if " " in flags else ""
        if kind in "diu":
            n = whole(v)
            body = str(abs(n)).rjust(precision or 0, "0")
            if "," in flags:
                body = f"{int(body):,}"
            body, lead = body, "-" if n < 0 else sign
        elif kind in "xXo":
            n = whole(v) & (2**64 - 1)
            body = format(n, kind).rjust(precision or 0, "0")
            lead = {"x": "0x", "X": "0X", "o": "0"}[kind] if "#" in flags and n else ""
        elif kind in "feEgG":
            x = number(v)
            body = format(abs(x), f".{6 if precision is None else precision}{kind}")
            if "," in flags and kind == "f" and math.isfinite(x):
                units, _, part = body.partition(".")
                body = f"{int(units):,}" + ("." + part if part else "")
            lead = "-" if x == x and math.copysign(1, x) < 0 else sign  # zero has a sign of its own
        else:
            lead = ""
            text = "" if v is None else str(v)
            if kind == "q":
                body = "(NULL)" if v is None else text.replace("'", "''")
            elif kind == "Q":
                body = "NULL" if v is None else "'" + text.replace("'", "''") + "'"
            elif kind == "w":
                body = "(NULL)" if v is None else text.replace('"', '""')
            elif kind == "c":
                body = text[:1] * (precision or 1)
            else:
                body = text if precision is None else text[:precision]
        if "0" in flags and "-" not in flags and kind in "diuxXofeEgG":
            return lead + body.rjust(width - len(lead), "0")
        out = lead + body
        return out.ljust(width) if "-" in flags else out.rjust(width)

    return _DIRECTIVE.sub(fill, template)


def printf(template: str, *xs: Column) -> Column:
    """printf with a constant template, in Arrow batches; a null counts as 0 or as no text, NaN as a number."""

    @F.arrow_udf(types.StringType())
    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([format_text(template, vs) for vs in zip(*(c.to_pylist() for c in columns), strict=True)], pa.string())

    return run(*xs)
