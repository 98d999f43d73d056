"""Safe path selectors: parsed once on the driver, then compiled to Columns or read in Python."""

from __future__ import annotations

import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

Step = str | int

_TOKEN = re.compile(
    r"""(?P<dot>\.)
      | \[\s*(?: "(?P<dq>[^"]*)" | '(?P<sq>[^']*)' | (?P<index>[+-]?\d+) | (?P<bad>[^\]]*) )\s*\]
      | (?P<word>[^.\[]+)
      | (?P<open>\[)""",
    re.VERBOSE,
)
_SAFE_ALIAS = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def parse_path(path: str) -> tuple[Step, ...]:
    """Steps of a dotted path with ``[n]`` and ``["key"]``. No wildcards, no negative index.

    ValueError for empty paths and segments, unclosed or empty brackets and anything unquoted in
    brackets that is no index."""
    text = str(path).strip()
    steps: list[Step] = []
    open_segment = True  # a key must follow
    at = 0
    while at < len(text):
        token = _TOKEN.match(text, at)
        at = token.end()
        kind = token.lastgroup
        if kind == "dot":
            if open_segment:
                raise ValueError(f"empty segment in path {path!r}")
            open_segment = True
            continue
        value = token.group(kind)
        if kind in ("bad", "open"):
            raise ValueError(f"bad bracket in path {path!r}")
        if kind == "index":
            if int(value) < 0:
                raise ValueError(f"negative index in path {path!r}")
            steps.append(int(value))
        else:
            value = value.strip() if kind == "word" else value
            if not value:
                raise ValueError(f"empty key in path {path!r}")
            steps.append(value)
        open_segment = False
    if open_segment:
        raise ValueError(f"path {path!r} is empty or ends in a dot")
    return tuple(steps)


def read_path(value: Any, steps: tuple[Step, ...]) -> Any:
    """The value at ``steps``; a wrong container, missing key or index out of range gives None."""
    for step in steps:
        if type(step) is int:
            if (type(value) is not list and not getattr(type(value), "long_list", False)) or step >= len(value):
                return None
            value = value[step]
        elif type(value) is dict:
            value = value.get(step)
        else:
            return None
    return value


def default_alias(steps: tuple[Step, ...]) -> str:
    alias = re.sub(r"[^A-Za-z0-9_]+", "_", "_".join(map(str, steps))).strip("_")
    if not alias:
        raise ValueError(f"path {steps!r} gives no usable alias")
    return "_" + alias if alias[0].isdigit() else alias


def resolve_select(wanted: str | list[str] | tuple[str, ...] | dict[str, str]) -> list[tuple[tuple[Step, ...], str]]:
    """(steps, alias) of each field; a CSV string, a list or {path: alias}. A repeated path is
    emitted once, two paths of one alias are refused."""
    if isinstance(wanted, str):
        pairs = [(p.strip(), None) for p in wanted.split(",")]
    elif isinstance(wanted, dict):
        pairs = list(wanted.items())
    elif isinstance(wanted, (list, tuple)):
        pairs = [(p, None) for p in wanted]
    else:
        raise TypeError("select takes a list, a CSV string or a {path: alias} mapping")
    out: dict[tuple, str] = {}
    for path, alias in pairs:
        if not isinstance(path, str):
            raise TypeError("select paths are strings")
        steps = parse_path(path)
        name = default_alias(steps) if alias is None else alias
        if not isinstance(name, str) or not _SAFE_ALIAS.fullmatch(name):
            raise ValueError(f"unsafe alias {name!r}")
        if steps in out:
            continue
        if name in out.values():
            raise ValueError(f"alias {name!r} is used by two paths")
        out[steps] = name
    if not out:
        raise ValueError("select is empty")
    return list(out.items())


def compile_path(root: Column, dtype: T.DataType, steps: tuple[Step, ...]) -> Column:
    """A null-safe Column for ``steps`` over a typed column (struct, array, map, or JSON text)."""
    col = root
    for i, step in enumerate(steps):
        if isinstance(dtype, T.StructType):
            hit = next((f for f in dtype.fields if f.name == step), None)
            if hit is None:
                return F.lit(None)
            col, dtype = col.getField(step), hit.dataType
        elif isinstance(dtype, T.ArrayType):
            if not isinstance(step, int):
                return F.lit(None)
            col, dtype = F.get(col, F.lit(step)), dtype.elementType
        elif isinstance(dtype, T.MapType):
            col, dtype = F.try_element_at(col, F.lit(step)), dtype.valueType
        elif isinstance(dtype, T.StringType):
            return json_path(col, steps[i:])
        else:
            return F.lit(None)
    return col


def json_path(col: Column, steps: tuple[Step, ...]) -> Column:
    """Text at ``steps`` of a JSON text column: scalars as text, containers as JSON, missing and
    JSON null as null."""
    text = "$"
    for step in steps:
        if isinstance(step, int):
            text += f"[{step}]"
        elif "'" in step:  # which Spark's JSON paths cannot hold
            held = col if text == "$" else F.get_json_object(col, text)
            col, text = F.try_element_at(F.from_json(held, "map<string,string>"), F.lit(step)), "$"
        else:
            text += f"['{step}']"
    return col if text == "$" and steps else F.get_json_object(col, text)


def project(df, fields: list[tuple[tuple[Step, ...], str]]):
    """One column an alias, always: what a row lacks is null. The first step names a column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    columns = []
    for steps, alias in fields:
        head, rest = steps[0], steps[1:]
        known = head in types
        col = compile_path(F.col(f"`{head}`"), types[head], rest) if known else F.lit(None)
        columns.append(col.alias(alias))
    return df.select(*columns)
