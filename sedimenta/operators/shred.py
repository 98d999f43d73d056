"""Deeply nested records as flat tables: adjacency rows (node, parent, label, ordinal, scalar) and entity pivots."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.functions.paths import parse_path, read_path
from sedimenta.functions.values import column_name, json_type, loads_strict
from sedimenta.session import free_name, size_checked, spread, staged

_PLAIN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


def _step(key: str) -> str:
    return "." + key if _PLAIN.fullmatch(key) else f'["{key}"]'


def _label(above: str, key: str) -> str:
    """The label of a key below ``above``: plain keys joined by dots, others quoted, so that no two
    paths share a label."""
    return (above + _step(key)).removeprefix(".")


def records_of(body: object, path: str | None) -> list | None:
    """The record list of a page body; None if there is none. A null path takes a list body as the
    list and an object body as the only record."""
    if path is None:
        return body if type(body) is list else [body] if type(body) is dict else None
    try:
        steps = parse_path(path)
    except ValueError:
        return None
    found = read_path(body, steps)
    return found if type(found) is list else None


def _scalar_text(value: object) -> str | None:
    """Texts as they are, numbers and booleans as JSON, null and containers as null."""
    return value if type(value) is str else None if value is None or type(value) in (dict, list) else json.dumps(value)


def adjacency(record: object, scalars: bool | frozenset[str]) -> Iterator[tuple]:
    """(node_path, parent_path, entity, label, ordinal, kind, scalar, parent_entity) of one record.

    Listed nodes (the record, and each object that is an array element at any depth) have kind
    ``object`` or, for a record of another type, its JSON type; ``entity`` is the node path with
    ``[]`` for each position. With ``scalars`` each scalar below a listed node follows, with that
    node as parent and the keys between as label (``a.b``, and ``a["b.c"]`` where a key is not plain);
    elements that are no objects have the label ``key[]``. A set of labels as ``scalars`` gives only those."""
    every = scalars is True
    some = scalars or frozenset()
    yield "$", "", "$", None, None, json_type(record), _scalar_text(record), ""
    # (value, path, entity, owner, label, above): owner is the nearest listed object around the value, above its entity
    stack = [(record, "$", "$", "$", "", "$")]
    while stack:
        value, path, entity, owner, label, above = stack.pop()
        if type(value) is dict:
            for key, child in reversed(value.items()):
                kind = type(child)
                step = _step(key)
                name = _label(label, key)
                if kind is dict or kind is list:
                    stack.append((child, path + step, entity + step, owner, name, above))
                elif every or (some and name in some):
                    yield path + step, owner, entity + step, name, None, json_type(child), _scalar_text(child), above
        elif type(value) is list:
            for i in range(len(value) - 1, -1, -1):
                child, at = value[i], f"{path}[{i}]"
                if type(child) is dict:
                    yield at, owner, entity + "[]", label or None, i, "object", None, above
                    stack.append((child, at, entity + "[]", at, "", entity + "[]"))
                elif type(child) is list:
                    stack.append((child, at, entity + "[]", owner, label + "[]", above))
                elif every or (some and label + "[]" in some):
                    yield at, owner, entity + "[]", label + "[]", i, json_type(child), _scalar_text(child), above


_SCHEMA = "page string, record_no int, node_path string, parent_path string, entity string, label string, ordinal int, kind string, scalar string, parent_entity string"
_KINDS = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()]
_CHUNK = 20_000


def shred(df: DataFrame, key: str, raw: str, path: str | None = None, scalars: bool | frozenset[str] = True) -> DataFrame:
    """Adjacency table (key, record_no, node_path, parent_path, entity, label, ordinal, kind, scalar,
    parent_entity) of the records in the JSON text ``raw``, whose list lies at the path in column ``path`` (no
    column: a list body is the list, an object the only record).

    Null, blank and invalid JSON and pages without a list at the path give no rows; NaN and
    Infinity are not JSON; of equal keys in an object the last counts. Rows stream out of each
    page in chunks, so a large page needs no memory beyond its parsed body. ``scalars=False``
    gives the listed nodes only, a set of labels these and such scalars. A ``key`` with the name of a result column gets a leading underscore."""
    key_type = df.schema[key].dataType
    columns = [F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{raw}`").alias("r"), (F.col(f"`{path}`") if path else F.lit(None).cast("string")).alias("p")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def flush() -> pa.RecordBatch:
            out = list(zip(*rows)) if rows else [[]] * 10
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, _KINDS)], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            for k, r, p in zip(*(batch.column(i) for i in range(3))):
                text = r.as_py()
                if text is None:
                    continue
                try:
                    records = records_of(loads_strict(text), p.as_py())
                except ValueError:
                    continue
                page = k.as_py()
                for n, record in enumerate(records or ()):
                    for node in adjacency(record, scalars):
                        rows.append((page, n, *node))
                    if len(rows) >= _CHUNK:
                        yield flush()
        yield flush()

    out = spread(df.select(*columns)).mapInArrow(walk, _SCHEMA)
    names = [x.split()[0] for x in _SCHEMA.split(", ")][1:]
    return out.select(F.col("page").cast(key_type).alias(free_name(names, key)), *names)


def latest_paths(probes: DataFrame, source: str = "source", at: str = "probed_at", status: str = "status_code", path: str = "records_path") -> DataFrame:
    """(source, records_path) of each source's latest probe with status 200; of equal times the
    larger path counts, null being smallest. One row a source."""
    best = F.max(F.struct(F.col(at).alias("at"), F.col(path).alias("path")))
    return probes.filter(F.col(status) == 200).groupBy(source).agg(best["path"].alias(path))


def page_nodes(pages: DataFrame, probes: DataFrame, scalars: bool | frozenset[str] = True) -> DataFrame:
    """``shred`` of each page at its source's latest good records path; pages of a source without a
    good probe, or with a null source, give no rows. The paths, one row a source, are broadcast while
    they measure little enough; beyond that pages shuffle by source, large sources split by AQE."""
    paths = staged(latest_paths(probes).withColumnRenamed("records_path", "__path"), "records-paths")
    small, _ = size_checked(paths, F.length("source") + F.coalesce(F.length("__path"), F.lit(0)) + 40)
    joined = spread(pages.select("page_id", "source", "raw")).join(F.broadcast(paths) if small else paths, "source")
    return shred(joined, "page_id", "raw", "__path", scalars)


def listed(nodes: DataFrame) -> DataFrame:
    """Records and the objects listed below them."""
    return nodes.filter((F.col("node_path") == "$") | ((F.col("kind") == "object") & F.col("ordinal").isNotNull()))


def entity_table(nodes: DataFrame, key: str, entity: str, fields: dict[str, str]) -> DataFrame:
    """The relational table of one entity (such as ``$.items[]``): a row for each listed node with
    its keys (page, record_no, node_path, parent_path, ordinal) and ``fields`` (label -> type) pivoted
    from its scalar children by one join of nodes with scalars; what does not cast is null, as is a
    missing label. Labels are those of ``adjacency``. Child and parent tables join on (page, record_no, parent_path = node_path)."""
    objects = listed(nodes).filter(F.col("entity") == entity).select(key, "record_no", "node_path", "parent_path", "ordinal")
    if not fields:
        return objects
    scalars = nodes.filter(F.col("label").isin(*fields) & F.col("scalar").isNotNull()).select(key, "record_no", F.col("parent_path").alias("node_path"), "label", "scalar")
    pivot = scalars.groupBy(key, "record_no", "node_path").agg(*[F.max(F.when(F.col("label") == n, F.col("scalar"))).try_cast(t).alias(n.replace(".", "_")) for n, t in fields.items()])
    return objects.join(pivot, [key, "record_no", "node_path"], "left")


def _below(nodes: DataFrame) -> tuple[Column, Column]:
    """Whether a row is a scalar field (no array element) of a listed node, and its path below that node."""
    field = (F.col("node_path") != "$") & F.col("ordinal").isNull()
    return field, F.expr("substring(entity, length(parent_entity) + 1)")


def whole_entity(nodes: DataFrame, key: str, entities: list[str], fields: dict[str, str] | None = None) -> DataFrame:
    """The relational table of all nodes of ``entities`` with every scalar field found below them:
    (entity, key, record_no, node_path, parent_path, ordinal, field...). ``nodes`` must be staged.

    The fields are found in the data, so none is left out; ``fields`` (label -> type) are there also
    if no value is. A column is bigint, double or boolean if all its values are and cast without
    loss, else string. JSON null and missing are null; a field that is null everywhere (a list or
    object not given) has no column. Names are the labels with unsafe characters as ``_``; clashing
    ones get leading underscores. Array elements that are scalars are in ``element_values``."""
    field, below = _below(nodes)
    mine = field & F.col("parent_entity").isin(entities)
    scalar, kinds = F.col("scalar"), F.collect_set("kind")
    whole = scalar.try_cast("bigint")
    exact = F.when(F.col("kind") == "integer", whole.isNotNull())
    found = nodes.filter(mine & scalar.isNotNull()).groupBy(below.alias("below")).agg(
        F.min("label").alias("label"), kinds.alias("kinds"), F.bool_and(exact).alias("fits"),
        F.bool_and(F.when(F.col("kind") == "integer", F.coalesce(F.abs(whole) <= 2**53, F.lit(False)))).alias("exact"),
    ).collect()
    typed: dict[str, tuple[str, str]] = {(n if n.startswith("[") else "." + n): (n, t) for n, t in (fields or {}).items()}
    declared = list(typed)
    for r in found:
        held = set(r["kinds"])
        kind = "string"
        if held == {"integer"} and r["fits"]:
            kind = "bigint"
        elif held == {"number"} or (held == {"integer", "number"} and r["exact"]):
            kind = "double"
        elif held == {"boolean"}:
            kind = "boolean"
        typed[r["below"]] = (r["label"], kind)
    order = declared + sorted(b for b in typed if b not in declared)
    at = F.when(field, F.col("parent_path")).otherwise(F.col("node_path"))
    listed_here = F.col("entity").isin(entities) & ((F.col("node_path") == "$") | ((F.col("kind") == "object") & F.col("ordinal").isNotNull()))
    names = ["entity", key, "record_no", "node_path", "parent_path", "ordinal"]
    columns = []
    for b in order:
        label, kind = typed[b]
        name = free_name(names, column_name(label))
        names.append(name)
        columns.append(F.max(F.when(F.col("field") & (F.col("below") == b), F.col("scalar"))).try_cast(kind).alias(name))
    rows = nodes.filter(mine | listed_here).select(F.col(f"`{key}`"), "record_no", at.alias("__at"), field.alias("field"), below.alias("below"), "scalar", "entity", "parent_path", "ordinal")
    own = lambda c: F.max(F.when(~F.col("field"), F.col(c))).alias(c)
    out = rows.groupBy(key, "record_no", "__at").agg(own("entity"), own("parent_path"), own("ordinal"), *columns)
    return out.withColumnRenamed("__at", "node_path").select(*[f"`{n}`" for n in names])


def other_entities(nodes: DataFrame, key: str, entities: list[str]) -> DataFrame:
    """Every listed node of an entity that is not in ``entities``, with its scalar fields as a map
    from the path below the node to the text: what has no table of its own."""
    field, below = _below(nodes)
    owner = F.when(field, F.col("parent_entity")).otherwise(F.col("entity"))
    kept = (field & F.col("kind").isin("null", "boolean", "integer", "number", "string")) | (F.col("node_path") == "$") | ((F.col("kind") == "object") & F.col("ordinal").isNotNull())
    rows = nodes.filter(kept & ~owner.isin(entities)).select(F.col(f"`{key}`"), "record_no", F.when(field, F.col("parent_path")).otherwise(F.col("node_path")).alias("__at"), field.alias("field"), F.struct(below.alias("key"), F.col("scalar").alias("value")).alias("pair"), "entity", "parent_path", "ordinal")
    own = lambda c: F.max(F.when(~F.col("field"), F.col(c))).alias(c)
    pairs = F.array_sort(F.collect_list(F.when(F.col("field"), F.col("pair"))))
    out = rows.groupBy(key, "record_no", "__at").agg(own("entity"), own("parent_path"), own("ordinal"), F.map_from_entries(pairs).alias("fields"))
    return out.withColumnRenamed("__at", "node_path").select("entity", f"`{key}`", "record_no", "node_path", "parent_path", "ordinal", "fields")


def element_values(nodes: DataFrame, key: str) -> DataFrame:
    """The child table of single values: array elements that are no containers (such as ``tags[]``),
    and records that are no objects, with kind and text; a null element is a row of kind ``null``."""
    element = F.col("ordinal").isNotNull() & (F.col("kind") != "object")
    record = (F.col("node_path") == "$") & (F.col("kind") != "object")
    return nodes.filter(element | record).select(f"`{key}`", "record_no", "node_path", "parent_path", "entity", "label", "ordinal", "kind", F.col("scalar").alias("value"))


def record_counts(nodes: DataFrame, key: str) -> DataFrame:
    """(entity, nodes, parents, max_children): the shape of the shredded tables."""
    per_parent = listed(nodes).groupBy("entity", key, "record_no", "parent_path").agg(F.count("*").alias("n"))
    return per_parent.groupBy("entity").agg(F.sum("n").alias("nodes"), F.count("*").alias("parents"), F.max("n").alias("max_children"))


__all__ = ["adjacency", "element_values", "entity_table", "latest_paths", "listed", "other_entities", "page_nodes", "record_counts", "records_of", "shred", "whole_entity"]
