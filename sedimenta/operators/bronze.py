"""The landing layer: flattening, all-text rows with lineage metadata, schema inference, typed staging."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import date, datetime, timezone
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sedimenta.errors import FlattenCollisionError
from sedimenta.functions.types import EndpointSchema, spark_type, validate_identifier
from sedimenta.functions.values import column_name, loads_strict, stringify


@dataclass(frozen=True)
class LoadContext:
    """Identity of one load. The ingestion key is the same for every retry of one window from one checkpoint."""

    run_id: str
    ingestion_key: str
    window_start: date | None = None
    window_end: date | None = None
    started_at: datetime = field(default_factory=lambda: datetime.now(timezone.utc))

    @classmethod
    def for_window(cls, name: str, start: date | None, end: date | None, checkpoint: str = "", run_id: str | None = None) -> LoadContext:
        text = "\n".join([name, start.isoformat() if start else "", end.isoformat() if end else "", checkpoint])
        return cls(run_id or uuid.uuid4().hex, hashlib.sha256(text.encode()).hexdigest()[:32], start, end)

    @classmethod
    def adhoc(cls, name: str) -> LoadContext:
        run = uuid.uuid4().hex
        return cls(run, hashlib.sha256(f"{name}\n{run}".encode()).hexdigest()[:32])


def ingestion_key(*parts: Column) -> Column:
    """First 32 hex digits of the SHA-256 of the parts, one a line; null parts are empty."""
    return F.substring(F.sha2(F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256), 1, 32)


def flatten_columns(schema: T.StructType, prefix: str = "", path: str = "") -> list[tuple[str, Column, T.DataType]]:
    """(name, column, type) of each leaf of a typed schema: structs joined by ``_``, arrays and maps
    whole. Two paths of one name raise FlattenCollisionError when the plan is made."""
    out = []
    for f in schema.fields:
        at = f"{path}.`{f.name}`" if path else f"`{f.name}`"
        name = f"{prefix}_{f.name}" if prefix else f.name
        if isinstance(f.dataType, T.StructType):
            out += flatten_columns(f.dataType, name, at)
        else:
            out.append((column_name(name), F.col(at), f.dataType))
    if not prefix:
        names = [n for n, _, _ in out]
        twice = sorted({n for n in names if names.count(n) > 1})
        if twice:
            raise FlattenCollisionError(f"two paths give the columns {twice}")
    return out


def flatten(df: DataFrame) -> DataFrame:
    """Typed flattening: one column a leaf, arrays and maps as JSON text."""
    out = []
    for name, col, kind in flatten_columns(df.schema):
        out.append((F.to_json(col) if isinstance(kind, (T.ArrayType, T.MapType)) else col).alias(name))
    return df.select(*out)


def stringified(df: DataFrame) -> DataFrame:
    """Every column as the text the landing layer stores."""
    return df.select(*[(F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)) else stringify(f.name, f.dataType.simpleString())).alias(f.name) for f in df.schema.fields])


def _text(value: object) -> str | None:
    """Text of a JSON value: texts as they are, containers as JSON, others as Python prints them."""
    if value is None or type(value) is str:
        return value
    return json.dumps(value, ensure_ascii=False) if type(value) in (dict, list) else str(value)


def flat_record(record: dict) -> dict[str, object]:
    """Flattened record, in the order of its keys; arrays as JSON text, empty objects as nothing."""
    out: dict[str, object] = {}
    came: dict[str, tuple] = {}
    todo: list[tuple[tuple, object]] = [((k,), v) for k, v in reversed(record.items())]
    while todo:
        path, value = todo.pop()
        if type(value) is dict:
            todo += [((*path, k), v) for k, v in reversed(value.items())]
            continue
        name = column_name("_".join(path))
        if came.setdefault(name, path) != path:
            raise FlattenCollisionError(f"{came[name]} and {path} both give the column {name}")
        out[name] = json.dumps(value, ensure_ascii=False) if type(value) is list else value
    return out


def bronze_rows(records: DataFrame, name: str, endpoint: str, schema: EndpointSchema, context: LoadContext, raw: str = "raw", ingested_at: datetime | None = None) -> DataFrame:
    """Landed rows of JSON records: the declared columns as text, the nine metadata columns, the
    record's text in ``_raw``, undeclared flattened fields as JSON in ``_extra`` (null if none).

    Other columns of ``records`` are dropped. A record that is no object lands as ``{"value": ...}``; null or
    invalid JSON fails the job. JSON text spacing follows Python's, which to_json cannot give:
    hence Arrow batches."""
    names = schema.column_names()
    struct = T.StructType([T.StructField(n, T.StringType()) for n in [*names, "_raw", "_extra"]])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = set(names)
        for batch in batches:
            rows: list[list] = [[] for _ in range(len(names) + 2)]
            for text in batch.column(0).to_pylist():
                value = loads_strict(text)
                record = value if type(value) is dict else {"value": value}
                flat = flat_record(record)
                for i, n in enumerate(names):
                    rows[i].append(_text(flat.get(n)))
                extra = {k: v for k, v in flat.items() if k not in known}
                rows[-2].append(json.dumps(record, ensure_ascii=False))
                rows[-1].append(json.dumps(extra, ensure_ascii=False) if extra else None)
            yield pa.RecordBatch.from_arrays([pa.array(r, pa.string()) for r in rows], names=struct.names)

    out = records.select(F.col(f"`{raw}`")).mapInArrow(build, struct)
    return out.select(*[f"`{n}`" for n in names], *metadata(name, endpoint, context, ingested_at), "_raw", "_extra")


def metadata(name: str, endpoint: str, context: LoadContext, ingested_at: datetime | None = None) -> list[Column]:
    at = ingested_at or context.started_at
    return [
        F.lit(name).alias("_source"), F.lit(endpoint).alias("_endpoint"), F.lit(at).cast("timestamp").alias("_ingested_at"),
        F.lit(context.run_id).alias("_run_id"), F.lit(context.ingestion_key).alias("_ingestion_key"),
        F.lit(context.window_start).cast("date").alias("_window_start"), F.lit(context.window_end).cast("date").alias("_window_end"),
    ]


def landed_schema(schema: EndpointSchema) -> T.StructType:
    """The columns of landed rows: the declared ones as text, the metadata, the record and its rest."""
    text = lambda n: T.StructField(n, T.StringType())
    kinds = {"_ingested_at": T.TimestampType(), "_window_start": T.DateType(), "_window_end": T.DateType()}
    meta = [T.StructField(n, kinds.get(n, T.StringType())) for n in ("_source", "_endpoint", "_ingested_at", "_run_id", "_ingestion_key", "_window_start", "_window_end")]
    return T.StructType([*map(text, schema.column_names()), *meta, text("_raw"), text("_extra")])


def landed_arrow_schema(schema: EndpointSchema) -> pa.Schema:
    """The same for Arrow readers and writers."""
    return to_arrow_schema(landed_schema(schema))


def extra_fields_seen(bronze: DataFrame) -> DataFrame:
    """(field_name, records) of the undeclared fields of landed rows."""
    keys = F.explode(F.json_object_keys("_extra"))
    return bronze.filter("_extra is not null").select(keys.alias("field_name")).groupBy("field_name").agg(F.count("*").alias("records"))


def infer_columns(records: DataFrame, order: str, raw: str = "raw", sample: int = 100) -> list[str]:
    """Flattened names in the first ``sample`` records by ``order``, first seen first: the feature is
    a bounded prefix, so the driver gets ``sample`` rows."""
    names: dict[str, None] = {}
    for row in records.orderBy(order).limit(sample).select(raw).collect():
        value = loads_strict(row[0])
        names.update(dict.fromkeys(flat_record(value if type(value) is dict else {"value": value})))
    return list(names)


def staging(bronze: DataFrame, schema: EndpointSchema) -> DataFrame:
    """Declared columns in their types, with source, endpoint and arrival; a text that does not cast
    fails the job, as a cast in a warehouse would."""
    typed = [F.col(f"`{c.name}`").cast(spark_type(c.dtype)).alias(c.name) for c in schema.columns]
    return bronze.select(*typed, "_source", "_endpoint", "_ingested_at")


def staging_sql(table: str, schema: EndpointSchema) -> str:
    """The same as a SQL model over ``table``."""
    for part in table.split("."):
        validate_identifier(part, "table")
    casts = [f"  CAST(`{c.name}` AS {spark_type(c.dtype)}) AS `{c.name}`" for c in schema.columns]
    return "SELECT\n" + ",\n".join([*casts, "  `_source`", "  `_endpoint`", "  `_ingested_at`"]) + f"\nFROM {table}"


def sources_yml(database: str, tables: list[str]) -> str:
    lines = ["version: 2", "sources:", f"  - name: {validate_identifier(database)}", "    tables:"]
    return "\n".join([*lines, *[f"      - name: {validate_identifier(t)}" for t in tables]]) + "\n"


def write_scaffold(folder: str, database: str, tables: dict[str, EndpointSchema]) -> list[str]:
    """Files of a staging project: ``sources.yml`` and one ``stg_<table>.sql`` a landed table. Files that
    are there already are left alone; the names of those written are returned."""
    root, out = Path(folder), []
    texts = {"sources.yml": sources_yml(database, list(tables))} | {f"stg_{validate_identifier(t)}.sql": staging_sql(f"{database}.{t}", s) + "\n" for t, s in tables.items()}
    root.mkdir(parents=True, exist_ok=True)
    for name, text in texts.items():
        try:
            with open(root / name, "x", encoding="utf-8") as f:
                f.write(text)
        except FileExistsError:
            continue
        out.append(name)
    return out
