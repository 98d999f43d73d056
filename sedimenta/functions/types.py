"""Logical column types, identifiers, and declared endpoint schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import types as T

from sedimenta.errors import InvalidIdentifierError

#: Logical type -> accepted spellings and the Spark type it renders to. ``decimal`` has no
#: spelling of its own in declarations that carry precision; bare it is DECIMAL(18,3).
LOGICAL_TYPES = {
    "string": (("str", "string", "varchar", "text"), "STRING"),
    "integer": (("int", "integer", "int32"), "INT"),
    "bigint": (("bigint", "int64"), "BIGINT"),
    "float": (("float", "double", "double precision"), "DOUBLE"),
    "decimal": (("decimal",), "DECIMAL(18,3)"),
    "boolean": (("bool", "boolean"), "BOOLEAN"),
    "date": (("date",), "DATE"),
    "timestamp": (("timestamp", "datetime"), "TIMESTAMP"),
    "json": (("json",), "STRING"),
}
#: Metadata columns of every landed row, in order.
RESERVED = ("_source", "_endpoint", "_ingested_at", "_run_id", "_ingestion_key", "_window_start", "_window_end", "_raw", "_extra")
_IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_SQL_TYPE = re.compile(r"[A-Za-z]\w*(?: +[A-Za-z]\w*){0,3}(?:\( *\d+ *(?:, *\d+ *)?\))?", re.ASCII)


def validate_identifier(name: object, what: str = "name") -> str:
    if not isinstance(name, str) or not _IDENTIFIER.fullmatch(name):
        raise InvalidIdentifierError(f"{what} {name!r} is no safe identifier: letters, digits and _, no digit first")
    return name


def validate_type(dtype: object) -> str:
    text = " ".join(dtype.split()) if isinstance(dtype, str) else ""
    if not _SQL_TYPE.fullmatch(text):
        raise InvalidIdentifierError(f"{dtype!r} is no supported column type")
    return text


def logical_type(dtype: str) -> str | None:
    """The logical type a declaration names, or None for a custom SQL type."""
    text = validate_type(dtype).lower()
    return next((name for name, (spellings, _) in LOGICAL_TYPES.items() if text in spellings), None)


def spark_type(dtype: str) -> str:
    """The Spark SQL type of a declared type; a custom type passes through unchanged."""
    name = logical_type(dtype)
    return LOGICAL_TYPES[name][1] if name else validate_type(dtype)


@dataclass(frozen=True)
class ColumnSpec:
    name: str
    dtype: str = "string"
    description: str = ""

    def __post_init__(self) -> None:
        validate_identifier(self.name, "column")
        validate_type(self.dtype)
        if self.name.lower() in RESERVED:
            raise InvalidIdentifierError(f"column {self.name!r} is reserved for metadata")


@dataclass(frozen=True)
class EndpointSchema:
    """The declared columns of an endpoint, without duplicates."""

    columns: list[ColumnSpec] = field(default_factory=list)

    def __post_init__(self) -> None:
        names = [c.name.lower() for c in self.columns]
        if len(set(names)) < len(names):
            raise ValueError("a column is declared twice")

    @classmethod
    def from_names(cls, names: list[str]) -> EndpointSchema:
        return cls([ColumnSpec(n) for n in names])

    def column_names(self) -> list[str]:
        return [c.name for c in self.columns]

    def struct(self) -> T.StructType:
        """The declared types, as Spark reads them (landed columns are all strings)."""
        ddl = ", ".join(f"`{c.name}` {spark_type(c.dtype)}" for c in self.columns)
        return T.StructType.fromDDL(ddl) if ddl else T.StructType()
