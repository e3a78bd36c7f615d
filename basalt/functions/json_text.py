"""JSON: paths, extraction, edits, tables of elements.

Texts are parsed in Arrow batches; one parse serves each distinct text of a batch
and all functions of a query over it, so that no function changes a parsed value: an
edit copies the containers on its path.  Paths are constants: $, .key, ."key", [n],
[#-n], [#] (append).
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

_STEP = re.compile(r'\.(?:"((?:[^"\\]|\\.)*)"|([^.\["]+))|\[(?:(\d+)|#-(\d+)|(#))\]')
MISSING = "\0missing"
#: What null and malformed texts are parsed to; one object in a process, however often this module travels there.
NOT_JSON = Ellipsis
#: Batches of more bytes are parsed row by row, again for each function, so that no task holds all their values.
SHARED_BYTES = 8_000_000


def parse_path(path: str) -> list[tuple[str, object]]:
    """Steps of a path; a malformed one is an error."""
    if not path.startswith("$"):
        raise ValueError(f"bad JSON path: {path}")
    at, steps = 1, []
    while at < len(path):
        m = _STEP.match(path, at)
        if not m:
            raise ValueError(f"bad JSON path: {path}")
        quoted, bare, index, back, end = m.groups()
        if end:
            steps.append(("end", 0))
        elif back is not None:
            steps.append(("back", int(back)))
        elif index is not None:
            steps.append(("index", int(index)))
        else:
            steps.append(("key", json.loads(f'"{quoted}"') if quoted is not None else bare))
        at = m.end()
    return steps


def arrow_path(path: str | int) -> str:
    """The path that the right side of -> and ->> stands for."""
    if isinstance(path, int):
        return f"$[{path}]" if path >= 0 else f"$[#-{-path}]"
    return path if path.startswith("$") else f'$."{path}"'



def loads(text: str):
    return json.loads(text)


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def _process() -> dict:
    """What the copies of this module that travel with functions share in a worker."""
    return sys.__dict__.setdefault("_basalt_json", {})


def dumps(value) -> str:
    encode = _process().get("encode")
    if encode is None:
        # JSONEncoder makes such an encoder for each value, which takes longer than a short value does
        make = json.encoder.c_make_encoder
        fast = make and make(None, _ENCODER.default, json.encoder.encode_basestring, None, ":", ",", False, False, True)
        encode = _process()["encode"] = fast or (lambda v, _: [_ENCODER.encode(v)])
    return "".join(encode(value, 0))


def follow(value, steps):
    for kind, x in steps:
        if kind == "key":
            if not isinstance(value, dict) or x not in value:
                return MISSING
            value = value[x]
        else:
            if not isinstance(value, list):
                return MISSING
            i = x if kind == "index" else len(value) - x if kind == "back" else len(value)
            if not 0 <= i < len(value):
                return MISSING
            value = value[i]
    return value


def kind_of(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    return {int: "integer", float: "real", str: "text", list: "array", dict: "object"}[type(value)]


def as_sql(value) -> str | None:
    """An extracted value as text: nulls as null, booleans as 1 and 0, containers as JSON."""
    if value is MISSING or value is None:
        return None
    if isinstance(value, bool):
        return str(int(value))
    return value if isinstance(value, str) else dumps(value)


def _place(parent, step) -> object:
    """The key or index that a step stands for in a parent; MISSING if it has no such places."""
    kind, x = step
    if isinstance(parent, dict):
        return x if kind == "key" else MISSING
    if not isinstance(parent, list) or kind == "key":
        return MISSING
    return x if kind == "index" else len(parent) - x if kind == "back" else len(parent)


def _below(value, steps, do: Callable):
    """The value with ``do`` applied to what all steps but the last lead to; containers on the way are copied."""
    if len(steps) == 1:
        return do(value, steps[0])
    old = follow(value, steps[:1])
    if old is MISSING:
        return value
    new = _below(old, steps[1:], do)
    if new is old:
        return value
    out = value.copy()
    out[_place(value, steps[0])] = new
    return out


def change(value, steps, new, mode: str):
    """The value with set, insert or replace at a path; ``value`` stays as it is."""
    if not steps:
        return new if mode in ("set", "replace") else value

    def do(parent, step):
        i = _place(parent, step)
        if i is MISSING:
            return parent
        if isinstance(parent, dict):
            if mode == ("insert" if i in parent else "replace"):
                return parent
            return {**parent, i: new}
        if 0 <= i < len(parent):
            if mode == "insert":
                return parent
            return [*parent[:i], new, *parent[i if mode == "array_insert" else i + 1 :]]
        return [*parent, new] if i == len(parent) and mode != "replace" else parent

    return _below(value, steps, do)


def remove(value, steps):
    """The value without what is at a path; ``value`` stays as it is."""
    if not steps:
        return MISSING

    def do(parent, step):
        i = _place(parent, step)
        if isinstance(parent, dict) and i in parent:
            return {k: v for k, v in parent.items() if k != i}
        if isinstance(parent, list) and i is not MISSING and 0 <= i < len(parent):
            return [*parent[:i], *parent[i + 1 :]]
        return parent

    return _below(value, steps, do)


def patch(target, with_):
    """RFC 7396 merge patch."""
    if not isinstance(with_, dict):
        return with_
    out = dict(target) if isinstance(target, dict) else {}
    for k, v in with_.items():
        if v is None:
            out.pop(k, None)
        else:
            out[k] = patch(out.get(k), v)
    return out


def _parse(text: str | None):
    try:
        return NOT_JSON if text is None else loads(text)
    except ValueError:
        return NOT_JSON


def parsed(x: pa.Array) -> tuple[list, list[int]]:
    """The distinct values of a batch's texts and the place of each row's.

    All functions of a query that a task evaluates over a column are given the same
    memory, one function after the other: the first of them parses it.  The last batch
    is kept, so that no other one can be in its place.
    """
    memory = [x.offset, len(x), *(b and b.address for b in x.buffers())]
    last, _, values, at = _process().get("batch", (None, None, [], []))
    if last != memory:
        places: dict = {}
        at = [places.setdefault(t, len(places)) for t in x.to_pylist()]
        values = [_parse(t) for t in places]
        _process()["batch"] = memory, x, values, at
    return values, at


def _mapped(function: Callable, kind: T.DataType = T.StringType()) -> Callable:
    """An Arrow function of JSON texts; null for null and (unless it looks at text itself) malformed ones."""
    arrow_kind = to_arrow_type(kind)

    def one(value):
        try:
            return None if value is NOT_JSON else function(value)
        except ValueError:
            return None

    @F.arrow_udf(kind)
    def run(x: pa.Array) -> pa.Array:
        if x.nbytes > SHARED_BYTES:
            return pa.array((one(_parse(t.as_py())) for t in x), arrow_kind)
        values, at = parsed(x)
        out = [one(v) for v in values]
        return pa.array(out if len(out) == len(at) else [out[i] for i in at], arrow_kind)

    return run


def json_minify(x: Column) -> Column:
    return _mapped(dumps)(x)


def extract(x: Column, *paths: str) -> Column:
    """json_extract: the value as text; with several paths a JSON array of them."""
    steps = [parse_path(p) for p in paths]
    if len(steps) == 1:
        return _mapped(lambda v: as_sql(follow(v, steps[0])))(x)
    return _mapped(lambda v: dumps([None if (y := follow(v, s)) is MISSING else y for s in steps]))(x)


def arrow(x: Column, path: str | int) -> Column:
    """-> : the element as JSON text."""
    steps = parse_path(arrow_path(path))
    return _mapped(lambda v: None if (y := follow(v, steps)) is MISSING else dumps(y))(x)


def arrow_text(x: Column, path: str | int) -> Column:
    """->> : the element as an SQL value's text."""
    return extract(x, arrow_path(path))


def json_type(x: Column, path: str = "$") -> Column:
    steps = parse_path(path)
    return _mapped(lambda v: None if (y := follow(v, steps)) is MISSING else kind_of(y))(x)


def array_length(x: Column, path: str = "$") -> Column:
    steps = parse_path(path)
    return _mapped(lambda v: None if (y := follow(v, steps)) is MISSING else len(y) if isinstance(y, list) else 0, T.LongType())(x)


def valid(x: Column) -> Column:
    return F.when(x.isNotNull(), F.coalesce(_mapped(lambda v: True, T.BooleanType())(x), F.lit(False)))


@F.arrow_udf(T.LongType())
def error_position(x: pa.Array) -> pa.Array:
    """0 for well-formed JSON, else the place (from 1) of the first error."""

    def one(t):
        if t is None:
            return None
        try:
            json.loads(t)
        except json.JSONDecodeError as e:
            return e.pos + 1
        return 0

    return pa.array((one(t.as_py()) for t in x), pa.int64())


def pretty(x: Column, indent: str = "    ") -> Column:
    return _mapped(lambda v: json.dumps(v, ensure_ascii=False, indent=indent))(x)


def json_quote(x: Column, kind: str) -> Column:
    """A value as JSON text."""
    if kind == "string":
        return F.coalesce(F.regexp_replace(F.to_json(F.array(x)), r"^\[|\]\z", ""), F.lit("null"))
    return F.coalesce(x.cast("string"), F.lit("null"))


def json_array(*xs: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *[F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"^\[|\]\z", "") for x in xs]), F.lit("]"))


def json_object(*pairs: tuple[str, Column]) -> Column:
    item = lambda k, x: F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), F.regexp_replace(F.to_json(F.array(x), {"ignoreNullFields": "false"}), r"^\[|\]\z", ""))
    return F.concat(F.lit("{"), F.concat_ws(",", *[item(k, x) for k, x in pairs]), F.lit("}"))


def edit(x: Column, mode: str, *changes: tuple[str, object]) -> Column:
    """json_set, json_insert, json_replace or json_array_insert of constant values at paths."""
    steps = [(parse_path(p), json.loads(json.dumps(v))) for p, v in changes]

    def run(v):
        for s, new in steps:
            v = change(v, s, new, mode)
        return dumps(v)

    return _mapped(run)(x)


def json_remove(x: Column, *paths: str) -> Column:
    steps = [parse_path(p) for p in paths]

    def run(v):
        for s in steps:
            v = remove(v, s)
            if v is MISSING:
                return None
        return dumps(v)

    return _mapped(run)(x)


def json_patch(x: Column, with_: str) -> Column:
    other = json.loads(with_)
    return _mapped(lambda v: dumps(patch(v, other)))(x)


def jsonb(text: Column) -> Column:
    """The binary form, a variant: later paths read it without parsing again; text that isn't JSON is null."""
    return F.try_parse_json(text)


def jsonb_array(*xs: Column) -> Column:
    return jsonb(json_array(*xs))


def jsonb_object(*pairs: tuple[str, Column]) -> Column:
    return jsonb(json_object(*pairs))


def jsonb_edit(x: Column, mode: str, *changes: tuple[str, object]) -> Column:
    """jsonb_set, jsonb_insert, jsonb_replace or jsonb_array_insert."""
    return jsonb(edit(x, mode, *changes))


def jsonb_remove(x: Column, *paths: str) -> Column:
    return jsonb(json_remove(x, *paths))


def jsonb_patch(x: Column, with_: str) -> Column:
    return jsonb(json_patch(x, with_))


ELEMENT = T.ArrayType(
    T.StructType([T.StructField(n, T.StringType() if n not in ("id", "parent") else T.LongType()) for n in ("key", "value", "type", "atom", "id", "parent", "fullkey", "path")])
)


def _elements(value, deep: bool, top: str, steps) -> list[dict]:
    out: list[dict] = []

    def name(k) -> str:
        if isinstance(k, int):
            return f"[{k}]"
        return f".{k}" if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", k) else "." + json.dumps(k, ensure_ascii=False)

    def add(key, v, parent, path, full):
        me = len(out)
        nested = isinstance(v, (list, dict))
        out.append({"key": None if key is None else str(key), "value": as_sql(v), "type": kind_of(v), "atom": None if nested else as_sql(v), "id": me, "parent": parent, "fullkey": full, "path": path})
        if deep:
            for k, x in pairs(v):
                add(k, x, me, full, full + name(k))

    def pairs(v):
        return v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ()

    found = follow(value, steps)
    if found is MISSING:
        return out
    if deep:
        add(None, found, None, top, top)
    elif isinstance(found, (list, dict)):
        for k, x in pairs(found):
            add(k, x, None, top, top + name(k))
    else:
        add(None, found, None, top, top)
    return out


def each(x: Column, path: str = "$") -> Column:
    """Elements of an array or object, for explode: key, value, type, atom, id (place), parent, fullkey, path."""
    steps = parse_path(path)
    return _mapped(lambda v: _elements(v, False, path, steps), ELEMENT)(x)


def tree(x: Column, path: str = "$") -> Column:
    """The element at a path and all below it, in order of place, for explode."""
    steps = parse_path(path)
    return _mapped(lambda v: _elements(v, True, path, steps), ELEMENT)(x)
