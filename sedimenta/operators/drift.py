"""Schemas that drift between files: rescue-column ingestion, replay, and a change report per file.

Every record is parsed once: what has no column goes into the rescue column as the exact JSON text it
came as, and the record's shape (its fields and their JSON types) goes beside it. The change report
is read off the shapes, values of fields that may have been renamed off the rescue column."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.values import canonical_json, column_name, json_string, loads_strict, strict_scanner
from sedimenta.session import free_name, kept, passing, size_checked, spread, staged

_TYPES = ("string", "integer", "number", "boolean", "array")
_FLUSH = 200_000
#: Where the rescue column keeps a text that is no JSON object.
BROKEN = "_broken"
#: Between the fields of a shape, and between a field and its type.
_FIELD, _KIND = "\x1f", "\x1e"
_KINDS = {type(None): "null", bool: "boolean", str: "string", int: "integer", float: "number", list: "array"}


# ---- records as exact slices ---------------------------------------------------------------------


_KEY = re.compile(r'"([^"\\\x00-\x1f]*)"[ \n\r\t]*:[ \n\r\t]*')
_GAP = re.compile(r"[ \n\r\t]*")
_COLON = re.compile(r"[ \n\r\t]*:[ \n\r\t]*")
_NEXT = re.compile(r"[ \n\r\t]*([,}])[ \n\r\t]*")


def _object(text: str, at: int, deep: bool) -> tuple[dict, int]:
    """The object that opens at ``at``: key -> (JSON type, exact text) or, if ``deep``, an object's own
    dictionary; the last of equal keys counts."""
    out: dict = {}
    at = _GAP.match(text, at + 1).end()
    if text[at : at + 1] == "}":
        return out, _GAP.match(text, at + 1).end()
    while True:
        hit = _KEY.match(text, at)
        if hit:
            key, at = hit.group(1), hit.end()
        else:  # a key with escapes
            if text[at : at + 1] != '"':
                raise ValueError("a key must follow")
            key, at = scanstring(text, at + 1, True)
            hit = _COLON.match(text, at)
            if not hit:
                raise ValueError("a colon must follow")
            at = hit.end()
        if deep and text[at : at + 1] == "{":
            out[key], at = _object(text, at, True)
        else:
            try:
                value, end = strict_scanner(text, at)
            except StopIteration:
                raise ValueError("a value must follow") from None
            out[key] = (_KINDS.get(type(value), "object"), text[at:end])
            at = end
        hit = _NEXT.match(text, at)
        if not hit:
            raise ValueError("a comma or the end must follow")
        at = hit.end()
        if hit.group(1) == "}":
            return out, at


def record_slices(text: str, deep: bool = True) -> dict | None:
    """The fields of a JSON object with their exact texts; None for other or broken texts."""
    try:
        at = _GAP.match(text).end()
        if text[at : at + 1] != "{":
            return None
        out, at = _object(text, at, deep)
        return out if at == len(text) else None
    except (ValueError, RecursionError):
        return None


@lru_cache(maxsize=1 << 16)
def _joined(prefix: str, key: str) -> tuple[str, str]:
    path = f"{prefix}_{key}" if prefix else key
    return column_name(path), path


def flatten_slices(record: dict) -> list[tuple[str, str, str, str]]:
    """(flattened name, path, JSON type, exact text) of each leaf in the order of the text; arrays
    stay whole, an empty object is a leaf of type object."""
    out: list[tuple[str, str, str, str]] = []

    def walk(prefix: str, value: dict) -> None:
        for key, child in value.items():
            name, path = _joined(prefix, key)
            if type(child) is tuple:
                out.append((name, path, *child))
            elif child:
                walk(path, child)
            else:
                out.append((name, path, "object", "{}"))

    walk("", record)
    return out


@lru_cache(maxsize=1 << 16)
def _member(name: str) -> str:
    return _dumps(name) + ":"


@lru_cache(maxsize=1 << 16)
def _shape(fields: tuple[tuple[str, str], ...]) -> str:
    return _FIELD.join(f"{k}{_KIND}{kind}" for k, kind in sorted(fields))


def _dumps(text: str) -> str:
    return json.dumps(text, ensure_ascii=False)


def _lifted(text: str | None, wanted: tuple[str, ...], deep: bool) -> tuple[str | None, str, dict]:
    """(inner JSON of what is not wanted, shape, wanted name -> (JSON type, exact text))."""
    if text is None:
        return None, "", {}
    record = record_slices(text, deep)
    if record is None:
        return (f"{_dumps(BROKEN)}:{_dumps(text)}" if text.strip() else None), "", {}
    rest: dict[str, str] = {}
    lifted: dict[str, tuple[str, str]] = {}
    shape: dict[str, str] = {}
    leaves = flatten_slices(record) if deep else [(k, k, *v) for k, v in record.items()]
    for name, path, kind, piece in leaves:
        if kind not in ("null", "object") and name not in shape:
            shape[name] = kind
        if name in wanted and name not in lifted:
            lifted[name] = (kind, piece)
        elif name not in rest:
            rest[name] = piece
        elif rest[name] == "null":  # of two paths with one name the first with a value has the name
            rest[name] = piece
        elif piece != "null":
            rest[path if path not in rest else free_name(list(rest), path)] = piece
    inner = ",".join([_member(k) + v for k, v in rest.items()]) if rest else None
    return inner, _shape(tuple(shape.items())), lifted


def lift(text: Column, wanted: list[str], deep: bool = False) -> Column:
    """struct<rest, shape, w0.., q0..> of the JSON objects in ``text``, each parsed once: the inner JSON
    text of all fields but ``wanted`` (exact texts, nulls included; a text that is no object whole,
    as ``_broken``; null if there are none), the shape, and of each wanted field its text (of a JSON
    string the string, else its JSON; null for null) and whether it was a string. ``deep`` flattens
    nested objects; without it they stay JSON. The last of equal keys counts."""
    names = tuple(wanted)
    schema = "struct<" + ", ".join(["rest: string", "shape: string", *(f"w{i}: string, q{i}: boolean" for i in range(len(names)))]) + ">"

    @F.arrow_udf(schema)
    def parse(texts: pa.Array) -> pa.Array:
        rest, shape = [], []
        cells: list[list] = [[] for _ in range(2 * len(names))]
        for text in texts.to_pylist():
            r, s, lifted = _lifted(text, names, deep)
            rest.append(r)
            shape.append(s)
            for i, n in enumerate(names):
                kind, piece = lifted.get(n, ("null", None))
                cells[2 * i].append(None if kind == "null" else json.loads(piece) if kind == "string" else piece)
                cells[2 * i + 1].append(kind == "string")
        columns = [pa.array(rest, pa.string()), pa.array(shape, pa.string())] + [pa.array(c, pa.bool_() if i % 2 else pa.string()) for i, c in enumerate(cells)]
        return pa.StructArray.from_arrays(columns, names=["rest", "shape", *(f"{x}{i}" for i in range(len(names)) for x in "wq")])

    return parse(text)


# ---- the change report ---------------------------------------------------------------------------


def captured(df: DataFrame, source: str, file: str, order: str, raw: str) -> DataFrame:
    """(source, file, place, shape, rescued) of each record: rescue ingestion with no column but the
    rescue column. Null, blank and broken ``raw`` and records that are no objects have no fields."""
    rows = spread(df.select(*[F.col(f"`{n}`").alias(a) for n, a in zip((source, file, order, raw), ("source", "file", "place", "raw"))]))
    rows = rows.select(F.col("source").cast("string").alias("source"), F.col("file").cast("string").alias("file"), F.col("place").cast("long").alias("place"), lift(F.col("raw").cast("string"), [], deep=True).alias("x"))
    return rows.select("source", "file", "place", "x.shape", F.when(F.col("x.rest").isNotNull(), F.concat(F.lit("{"), "x.rest", F.lit("}"))).alias("rescued"))


def shape_fields(rows: DataFrame) -> DataFrame:
    """Rows (source, file, field, first_order, one count per JSON type) from shapes: what each file holds
    of each field, nulls aside; a row with a null field for each file. Shapes are counted in each task
    before the shuffle, and only distinct shapes are taken apart."""
    shapes = rows.groupBy("source", "file", "shape").agg(F.count("*").alias("n"), F.min("place").alias("first_order"))
    fields = shapes.select("source", "file", "n", "first_order", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.filter(F.split("shape", _FIELD), lambda x: x != ""))).alias("x"))
    fields = fields.select("source", "file", "n", F.when(F.col("x").isNull(), F.col("first_order")).alias("first_order"), F.substring_index("x", _KIND, 1).alias("field"), F.substring_index("x", _KIND, -1).alias("kind"))
    counts = [F.sum(F.when(F.col("kind") == t, F.col("n"))).alias(f"n_{t}") for t in _TYPES]
    return fields.groupBy("source", "file", "field").agg(*counts, F.min("first_order").alias("first_order"))


def file_fields(df: DataFrame, source: str, file: str, order: str, raw: str) -> DataFrame:
    """``shape_fields`` of the records in ``raw``."""
    return shape_fields(captured(df, source, file, order, raw).select("source", "file", "place", "shape"))


def _transitions(fields: DataFrame) -> DataFrame:
    """(source, file_no, field, file, file_before, now, before): what came, went or changed type in
    each file after the first; ``now`` and ``before`` are types, null where the field is not."""
    ranked = [F.struct(F.coalesce(F.col(f"n_{t}"), F.lit(0)).alias("n"), F.lit(-i).alias("tie"), F.lit(t).alias("t")) for i, t in enumerate(_TYPES)]
    typed = fields.filter(F.col("field").isNotNull()).select("source", "file", "field", F.greatest(*ranked)["t"].alias("kind"))
    # one row a file: the window sorts files, never records
    order = Window.partitionBy("source").orderBy(F.col("first_order").asc_nulls_last(), "file")
    files = fields.filter(F.col("field").isNull()).select("source", "file", F.row_number().over(order).alias("file_no"), F.lead(F.struct("file")).over(order).alias("next"))
    held = typed.alias("t").join(files.alias("f"), F.col("t.source").eqNullSafe(F.col("f.source")) & F.col("t.file").eqNullSafe(F.col("f.file")))
    held = held.select("t.source", "t.field", "t.kind", "t.file", "f.file_no", "f.next")
    # each field votes in its own file and in the next; one shuffle replaces a self join
    none = F.lit(None).cast("string")
    votes = held.select("source", "file_no", "field", "file", none.alias("file_before"), F.col("kind").alias("now"), none.alias("before")).unionByName(
        held.filter("next is not null").select("source", (F.col("file_no") + 1).alias("file_no"), "field", F.col("next.file").alias("file"), F.col("file").alias("file_before"), none.alias("now"), F.col("kind").alias("before"))
    )
    change = votes.groupBy("source", "file_no", "field").agg(*[F.max(c).alias(c) for c in ("file", "file_before", "now", "before")])
    return change.filter((F.col("file_no") > 1) & ~F.col("now").eqNullSafe(F.col("before")))


def file_changes(df: DataFrame, source: str = "_source", file: str = "_run_id", order: str = "ordinal", raw: str = "_raw") -> DataFrame:
    """(source, run_id, change_kind, field_name, old_name) of each file against the file before it
    of the same source, files ordered by their smallest ``order``.

    A field is in a file if any record has a non-null value; its type is that of most of these
    values (ties: string, integer, number, boolean, array, in this order). Null sources and null
    files form groups of their own; null, blank or broken ``raw`` and records that are no objects
    hold no field; an empty table gives no rows. An added and a removed field of one type pair up
    as ``renamed`` by name (without case and non-alphanumerics) or if at least half of the added
    field's distinct values occur in the removed one; each field pairs once, names first, then the
    larger share, then the field names' order. The records are ingested once; every later step
    reads the ingested table."""
    with passing(df.sparkSession):
        return kept(_file_changes(staged(captured(df, source, file, order, raw), "rescued")), "file-changes")


def _file_changes(rows: DataFrame) -> DataFrame:
    change = staged(_transitions(shape_fields(rows.select("source", "file", "place", "shape"))), "file-changes")
    retyped = change.filter("now is not null and before is not null").select("source", "file", F.lit("retyped").alias("change_kind"), F.col("field").alias("field_name"), F.lit("").alias("old_name"))
    moved = change.filter("now is null or before is null")
    # only files in which a field of some type came while one of that type went need their values
    kind = F.coalesce("now", "before")
    both = moved.groupBy("source", "file_no", kind.alias("kind")).agg(F.max(F.col("now").isNotNull()).alias("a"), F.max(F.col("before").isNotNull()).alias("r")).filter("a and r").select("source", "file_no", "kind")
    wanted = moved.withColumn("kind", kind).alias("m").join(both.alias("b"), F.col("m.source").eqNullSafe(F.col("b.source")) & (F.col("m.file_no") == F.col("b.file_no")) & (F.col("m.kind") == F.col("b.kind")), "left_semi")
    wanted = staged(
        wanted.select("source", "file_no", "kind", "field", F.col("now").isNotNull().alias("added"), F.when(F.col("now").isNotNull(), F.col("file")).otherwise(F.col("file_before")).alias("file")), "rename-candidates"
    )
    values = _candidate_values(rows, wanted)
    pairs = _rename_pairs(wanted, values)
    renamed = pairs.groupBy("source", "file_no").applyInPandas(_match, "source string, file_no int, added string, removed string")
    flat = renamed.select("source", "file_no", F.explode(F.array(F.struct(F.col("added").alias("field"), F.col("removed").alias("old")), F.struct(F.col("removed").alias("field"), F.lit(None).cast("string").alias("old")))).alias("x")).select("source", "file_no", "x.field", "x.old", F.lit(True).alias("hit"))
    joined = moved.alias("m").join(flat.alias("x"), F.col("m.source").eqNullSafe(F.col("x.source")) & (F.col("m.file_no") == F.col("x.file_no")) & (F.col("m.field") == F.col("x.field")), "left")
    verdict = F.when(F.col("x.hit").isNull(), F.when(F.col("m.now").isNotNull(), F.lit("added")).otherwise(F.lit("removed"))).when(F.col("m.now").isNotNull(), F.lit("renamed"))
    moved = joined.select("m.source", "m.file", verdict.alias("change_kind"), F.col("m.field").alias("field_name"), F.coalesce(F.when(F.col("m.now").isNotNull(), F.col("x.old")), F.lit("")).alias("old_name")).filter("change_kind is not null")
    return moved.unionByName(retyped).select("source", F.col("file").alias("run_id"), "change_kind", "field_name", "old_name")


def _candidate_values(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct value digests (source, file, field, value) of the fields that may have been renamed,
    from the rescue column."""
    schema = "source string, file string, field string, value binary"
    per_file = wanted.groupBy("source", "file").agg(F.sort_array(F.collect_set("field")).alias("fields"))
    # no larger than the candidates it is grouped from
    small, _ = size_checked(wanted, F.length(F.coalesce("source", F.lit(""))) + F.length(F.coalesce("file", F.lit(""))) + F.length("field") + 60)
    side = rows.select(F.col("source").alias("s"), F.col("file").alias("f"), F.col("rescued").alias("r")).filter("r is not null")

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()

        def flush() -> pa.RecordBatch:
            columns = list(zip(*seen)) if seen else [[]] * 4
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string()] * 3 + [pa.binary()])], names=["source", "file", "field", "value"])

        for batch in batches:
            for s, f, r, fields in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for name, value in loads_strict(r).items():
                    if value is not None and (fields is None or name in fields):
                        seen.add((s, f, name, hashlib.blake2b(canonical_json(value).encode("utf-8", "surrogatepass"), digest_size=16).digest()))
            if len(seen) > _FLUSH:
                yield flush()
        yield flush()

    match = F.col("d.s").eqNullSafe(F.col("w.source")) & F.col("d.f").eqNullSafe(F.col("w.file"))
    if small:
        found = spread(side).alias("d").join(F.broadcast(per_file).alias("w"), match).select("d.s", "d.f", "d.r", "w.fields")
        return found.mapInArrow(digests, schema).distinct()
    # too many candidates to broadcast: digest all fields, then shuffle the narrow digests, never the records
    every = side.withColumn("fields", F.lit(None).cast("array<string>")).mapInArrow(digests, schema)
    asked = per_file.select("source", "file", F.explode("fields").alias("field"))
    hit = F.col("e.source").eqNullSafe(F.col("a.source")) & F.col("e.file").eqNullSafe(F.col("a.file")) & (F.col("e.field") == F.col("a.field"))
    return every.alias("e").join(asked.alias("a"), hit, "left_semi").distinct()


def _rename_pairs(wanted: DataFrame, values: DataFrame) -> DataFrame:
    """(source, file_no, added, removed, by_name, share) of the pairs that qualify."""
    simple = F.regexp_replace(F.lower("field"), "[^a-z0-9]", "")
    side = wanted.withColumn("simple", simple)
    gone, came = side.filter("not added"), side.filter("added")
    by_name = (
        came.alias("a").join(gone.alias("r"), F.col("a.source").eqNullSafe(F.col("r.source")) & (F.col("a.file_no") == F.col("r.file_no")) & (F.col("a.kind") == F.col("r.kind")) & (F.col("a.simple") == F.col("r.simple")))
        .select("a.source", "a.file_no", F.col("a.field").alias("added"), F.col("r.field").alias("removed"), F.lit(True).alias("by_name"), F.lit(1.0).alias("share"))
    )
    held = staged(
        wanted.alias("w").join(values.alias("v"), F.col("w.source").eqNullSafe(F.col("v.source")) & F.col("w.file").eqNullSafe(F.col("v.file")) & (F.col("w.field") == F.col("v.field")))
        .select("w.source", "w.file_no", "w.kind", "w.field", "w.added", "v.value"),
        "rename-values",
    )
    a, r = held.filter("added").alias("a"), held.filter("not added").alias("r")
    common = (
        a.join(r, F.col("a.source").eqNullSafe(F.col("r.source")) & (F.col("a.file_no") == F.col("r.file_no")) & (F.col("a.kind") == F.col("r.kind")) & (F.col("a.value") == F.col("r.value")))
        .groupBy("a.source", "a.file_no", F.col("a.field").alias("added"), F.col("r.field").alias("removed")).agg(F.count("*").alias("common"))
    )
    size = held.filter("added").groupBy("source", "file_no", F.col("field").alias("added")).agg(F.count("*").alias("size"))
    by_value = (
        common.alias("c").join(size.alias("s"), F.col("c.source").eqNullSafe(F.col("s.source")) & (F.col("c.file_no") == F.col("s.file_no")) & (F.col("c.added") == F.col("s.added")))
        .filter(F.col("common") * 2 >= F.col("size"))
        .select("c.source", "c.file_no", "c.added", "c.removed", F.lit(False).alias("by_name"), (F.col("common") / F.col("size")).alias("share"))
    )
    return by_name.unionByName(by_value)


def _match(pdf):
    """Greedy one-to-one pairing within one file; the group holds field pairs, not records."""
    pdf = pdf.sort_values(["by_name", "share", "added", "removed"], ascending=[False, False, True, True])
    used: set = set()
    keep = []
    for i, a, r in zip(pdf.index, pdf["added"], pdf["removed"]):
        if ("a", a) not in used and ("r", r) not in used:
            used |= {("a", a), ("r", r)}
            keep.append(i)
    return pdf.loc[keep, ["source", "file_no", "added", "removed"]]


# ---- one consistent table ------------------------------------------------------------------------


def exact_cast(text: Column, kind: str, quoted: Column | None = None) -> Column:
    """``text`` as ``kind``, null where it does not cast or would become another value: digits that do
    not fit the scale or precision, a time cut to a date, fractions below a microsecond. Booleans
    are only ``true`` and ``false``, and (``quoted``: was a JSON string) not the string of that."""
    value, name = text.try_cast(kind), kind.lower()
    if name.startswith(("decimal", "double", "float", "bigint", "int", "long", "smallint", "tinyint")):
        wide = "decimal(38,18)"
        same = (text.try_cast(wide) == value.cast("string").try_cast(wide)) | (text.try_cast(wide).isNull() & (text.try_cast("double") == value.cast("double")))
        finite = F.abs(value.cast("double")) < F.lit(float("inf"))  # NaN is larger than any number
        return F.when(F.coalesce(same & finite, F.lit(False)), value)
    if name == "date":
        moment = text.try_cast("timestamp")
        return F.when(moment.isNull() | (moment == value.cast("timestamp")), value)
    if name.startswith("timestamp"):
        return F.when(~text.rlike(r"\.\d{6}\d*[1-9]"), value)
    if name == "boolean":
        return F.when(F.lower(text).isin("true", "false") & (~quoted if quoted is not None else F.lit(True)), value)
    return value


def _json_object(parts: list[Column]) -> Column:
    """The JSON object of the inner texts that are not null; null if all are."""
    inner = F.concat_ws(",", *parts)
    return F.when(inner != "", F.concat(F.lit("{"), inner, F.lit("}")))


def rescue_ingest(df: DataFrame, schema: dict[str, str], extra: str = "_extra", promote: dict[str, str] | None = None, rescued: str = "_rescued") -> DataFrame:
    """One typed table over drifting files: each declared text column is cast to its target type,
    each approved (``promote``) field is lifted out of the ``extra`` JSON and cast; what has no
    column, does not cast or would change its value by it stays, under its name, as JSON in
    ``rescued`` (null if nothing): fields of ``extra`` with the exact text and type they came with.

    Null or blank ``extra`` counts as empty, a broken one is rescued whole as ``_broken``; of equal keys
    the last counts; a missing declared column is null. Other columns are kept; a clashing
    ``rescued`` name gets a leading underscore. ``extra`` is parsed once a row, nothing shuffles."""
    promote = {k: v for k, v in (promote or {}).items() if k not in schema}
    rescued = free_name([*df.columns, *promote], rescued)
    bag = free_name(df.columns, "__bag")
    has = set(df.columns)
    lifted = [n for n in [*schema, *promote] if n not in has]
    clash = [n for n in promote if n in has]
    wanted = [*lifted, *clash]
    out = df.withColumn(bag, lift(F.col(f"`{extra}`").cast("string") if extra in has else F.lit(None).cast("string"), wanted))
    typed, parts = {}, [F.col(f"{bag}.rest")]
    for name, kind in {**schema, **promote}.items():
        if name in has and name not in clash:
            text = F.col(f"`{name}`").cast("string")
            value, left = exact_cast(text, kind), json_string(text)
        else:
            i = wanted.index(name)
            text, quoted = F.col(f"{bag}.w{i}"), F.col(f"{bag}.q{i}")
            value, left = exact_cast(text, kind, quoted), F.when(quoted, json_string(text)).otherwise(text)
        typed[name] = value
        parts.append(F.when(text.isNotNull() & value.isNull(), F.concat(json_string(F.lit(name)), F.lit(":"), left)))
    out = out.withColumn(rescued, _json_object(parts))
    return out.withColumns(typed).drop(bag, *([extra] if extra in has else []))


def replay_rescued(df: DataFrame, field: str, kind: str, rescued: str = "_rescued") -> DataFrame:
    """Lift ``field`` out of ``rescued`` into a typed column: values that cast without change move (an
    existing column keeps its non-null values), the others stay rescued. Only rows that name the
    field are parsed."""
    bag = free_name(df.columns, "__bag")
    here = F.col(f"`{rescued}`").contains(json.dumps(field, ensure_ascii=False))
    out = df.withColumn(bag, lift(F.when(here, F.col(f"`{rescued}`")), [field]))
    text, quoted = F.col(f"{bag}.w0"), F.col(f"{bag}.q0")
    value = exact_cast(text, kind, quoted)
    moved = value.isNotNull()
    if field in df.columns:
        moved = moved & F.col(f"`{field}`").isNull()
        value = F.coalesce(F.col(f"`{field}`"), value)
    left = F.when(moved, _json_object([F.col(f"{bag}.rest")])).otherwise(F.col(f"`{rescued}`"))
    return out.withColumns({rescued: left, field: value}).drop(bag)


def undocumented_fields(df: DataFrame, run_log: DataFrame, declared: list[str]) -> DataFrame:
    """(source, run_id, field_name, in_file, in_log): extra fields of each file against those the
    audit log claims; several log entries of one run are united, unreadable lists count as empty."""
    fields = file_fields(df, "_source", "_run_id", "ordinal", "_raw").filter(F.col("field").isNotNull() & ~F.col("field").isin(*declared))
    claimed = run_log.select(F.col("connector_name").alias("source"), F.col("run_id").alias("file"), F.explode(F.from_json("extra_fields_seen", "array<string>")).alias("field")).filter("field is not null").distinct()
    held = fields.select("source", "file", "field", F.lit(1).alias("f"), F.lit(0).alias("l")).unionByName(claimed.select("source", "file", "field", F.lit(0).alias("f"), F.lit(1).alias("l")))
    return held.groupBy("source", F.col("file").alias("run_id"), F.col("field").alias("field_name")).agg((F.max("f") == 1).alias("in_file"), (F.max("l") == 1).alias("in_log"))
