"""Value functions whose result must equal Python's: text of a value, blankness, dates, JSON text."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: white space that Python's ``str.strip`` removes, for Java's regex engine.
BLANK_PATTERN = r"^[\s\x{1c}-\x{1f}\x{85}\p{Z}]*$"


def is_blank(col: Column) -> Column:
    """True where ``col.strip() == ""`` in Python; null for null."""
    return col.rlike(BLANK_PATTERN)


def strip_text(col: Column) -> Column:
    """Python's ``str.strip``."""
    inner = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]+"
    return F.regexp_replace(F.regexp_replace(col, "^" + inner, ""), inner + "$", "")


def bool_text(col: Column) -> Column:
    return F.when(col, F.lit("True")).when(~col, F.lit("False"))


def double_text(name: str) -> Column:
    """Python's ``str(float)`` of the double column ``name``, without leaving the JVM for 0 and
    1e-3 <= |x| < 1e16; outside that range Spark's exponent text is rewritten to Python's form."""
    x = f"`{name}`"
    plain = (
        f"case when {x} is null then null"
        f" when isnan({x}) then 'nan'"
        f" when {x} = double('infinity') then 'inf' when {x} = double('-infinity') then '-inf'"
        f" when (abs({x}) >= 1e-3D and abs({x}) < 1e7D) or {x} = 0D then cast({x} as string)"
        f" when abs({x}) >= 1e7D and abs({x}) < 1e16D and {x} = floor({x})"
        f" then concat(cast(cast({x} as decimal(38,0)) as string), '.0')"
        f" when abs({x}) >= 1e7D and abs({x}) < 1e16D"
        f" then rtrim('0', cast(cast(cast({x} as string) as decimal(38,18)) as string)) end"
    )
    text = F.col(name).cast("string")
    mantissa = F.regexp_replace(F.split(text, "E")[0], r"\.0$", "")
    exponent = F.try_element_at(F.split(text, "E"), F.lit(2)).cast("int")
    scientific = F.concat(
        mantissa, F.lit("e"), F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")), F.abs(exponent).cast("string"),
    )
    small = F.when(exponent == -4, F.concat(
        F.when(F.col(name) < 0, F.lit("-")).otherwise(F.lit("")), F.lit("0.0001").substr(1, 5),
        F.regexp_replace(F.regexp_replace(F.split(text, "E")[0], r"[-.]", ""), r"0+$", ""),
    ))
    return F.coalesce(F.expr(plain), small, scientific)


def stringify(name: str, dtype: str) -> Column:
    """Text of one typed column as the landing layer stores it; null stays null."""
    col = F.col(f"`{name}`")
    if dtype == "boolean":
        return bool_text(col)
    if dtype in ("double", "float"):
        return double_text(name)
    return col.cast("string")


def json_string(col: Column) -> Column:
    """``json.dumps(text, ensure_ascii=False)`` of a string column, JVM-side."""
    out = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    rare = out
    for code in range(0x20):
        rare = F.replace(rare, F.lit(chr(code)), F.lit(json.dumps(chr(code))[1:-1]))
    out = F.when(out.rlike(r"[\x00-\x1f]"), rare).otherwise(out)
    return F.concat(F.lit('"'), out, F.lit('"'))


def key_fingerprint(*cols: Column) -> Column:
    """SHA-256 (binary) of the compact JSON array of text keys; null if any key is null."""
    body = F.concat(F.lit("["), F.concat_ws(",", *[json_string(c) for c in cols]), F.lit("]"))
    digest = F.unhex(F.sha2(body, 256))
    ready = cols[0].isNotNull()
    for c in cols[1:]:
        ready = ready & c.isNotNull()
    return F.when(ready, digest)


def parse_date(col: Column) -> Column:
    """Calendar date at the start of a text (ISO dashed form), without a zone shift; otherwise null."""
    text = strip_text(col.cast("string"))
    day = F.expr("null").cast("date")
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(text, 1, 10).try_cast("date")).otherwise(day)


# ---- driver/worker-side Python twins -------------------------------------------------------------

_NAME_UNSAFE = re.compile(r"[^A-Za-z0-9_]")


def column_name(path: str) -> str:
    """Flattened column name of a joined key path."""
    name = _NAME_UNSAFE.sub("_", path)
    return "_" + name if not name or name[0].isdigit() else name


def _refuse_constant(text: str) -> Any:
    raise ValueError(f"{text} is not JSON")


_DECODER = json.JSONDecoder(parse_constant=_refuse_constant)
#: (value, end) of the JSON value at a place in a text
strict_scanner = _DECODER.scan_once


def loads_strict(text: str) -> Any:
    """Standard JSON only (NaN and Infinity are refused); ValueError otherwise, also for
    nesting or digits beyond what the decoder takes."""
    try:
        return _DECODER.decode(text)
    except RecursionError:
        raise ValueError("nested too deep") from None


def json_type(value: Any) -> str:
    """JSON type name; bool before int, as bool is an int in Python."""
    kind = type(value)
    if value is None:
        return "null"
    if kind is bool:
        return "boolean"
    if kind is str:
        return "string"
    if kind is int:
        return "integer"
    if kind is float:
        return "number"
    if kind is list:
        return "array"
    return "object"


def canonical_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
