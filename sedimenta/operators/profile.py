"""Column-level data quality: an exact profile over unpivoted path-value counts, and load comparison."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.values import canonical_json, json_type, loads_strict
from sedimenta.session import kept, passing, size_checked, spread, staged

_EMAIL = re.compile(r"[^@\s]+@[^@\s.]+(?:\.[^@\s.]+)+")
_STAMP = re.compile(r"(\d{4})-(\d{2})-(\d{2})(?:[T ](\d{2}):(\d{2}):(\d{2})(?:\.\d+)?(?:Z|[+-](\d{2}):(\d{2}))?)?", re.ASCII)
_FLUSH = 200_000
#: Records nested deeper count as invalid.
MOST_LEVELS = 500
#: Characters of records a task counts before it hands its counts on.
_FLUSH_CHARS = 64_000_000
TYPES = ("null", "boolean", "integer", "number", "string", "array", "object")


def bad_email(text: str) -> bool:
    """Not one ``@`` between a non-empty local part and a dotted domain, without white space."""
    return _EMAIL.fullmatch(text) is None


def bad_timestamp(text: str) -> bool:
    """Not a real ``YYYY-MM-DD``, alone or with ``HH:MM:SS``, fraction and zone."""
    hit = _STAMP.fullmatch(text)
    if hit is None:
        return True
    year, month, day, hour, minute, second, zone_hour, zone_minute = (int(x) if x else 0 for x in hit.groups())
    try:
        date(year, month, day)
    except ValueError:
        return True
    return hour > 23 or minute > 59 or second > 59 or zone_hour > 23 or zone_minute > 59


def moment(text: str) -> int | None:
    """Microseconds since 1970 of a date or time as ``bad_timestamp`` takes it, without zone in UTC; None for other texts."""
    if len(text) < 10 or text[4] != "-" or bad_timestamp(text):
        return None
    year, month, day, hour, minute, second, zone_hour, zone_minute = (int(x) if x else 0 for x in _STAMP.fullmatch(text).groups())
    zone = (zone_hour * 60 + zone_minute) * (-1 if re.search(r"-\d{2}:\d{2}$", text) and len(text) > 10 else 1)
    fraction = re.search(r"\.(\d+)", text)
    seconds = ((date(year, month, day).toordinal() - 719_163) * 24 + hour) * 3600 + (minute - zone) * 60 + second
    return seconds * 1_000_000 + (int(fraction.group(1)[:6].ljust(6, "0")) if fraction else 0)


#: The patterns the problem names, by path.
CHECKS: dict[str, Callable[[str], bool]] = {"email": bad_email, "updated_at": bad_timestamp}


def walk_paths(record: object) -> Iterator[tuple[str, object]]:
    """(path, value) of every node below the root; keys joined by ``.``, array elements ``[]``."""
    stack: list[tuple[str, object]] = [("", record)]
    while stack:
        path, value = stack.pop()
        if path:
            yield path, value
        if type(value) is dict:
            for key, child in value.items():
                stack.append((f"{path}.{key}" if path else key, child))
        elif type(value) is list:
            below = f"{path}[]" if path else "[]"
            for child in value:
                stack.append((below, child))


def place_of(number: float) -> int:
    """A 64-bit integer that orders like the double: quantiles are found by its bits."""
    bits = struct.unpack(">q", struct.pack(">d", number + 0.0))[0]
    return bits if bits >= 0 else -(bits & 0x7FFF_FFFF_FFFF_FFFF)


def _levels(value: object) -> int:
    depth, layer = 0, [value]
    while layer:
        depth += 1
        layer = [c for v in layer if type(v) in (dict, list) for c in (v.values() if type(v) is dict else v)]
    return depth


class _Node:
    """What one path holds in the records counted so far; ``kids`` and ``item`` are the paths below."""

    __slots__ = ("path", "counted", "present", "last", "values", "kids", "item")

    def __init__(self, path: str | None, counted: bool):
        self.path, self.counted, self.present, self.last = path, counted, 0, -1
        self.values: dict[str, dict] = {}
        self.kids: dict[str, _Node] = {}
        self.item: _Node | None = None


_FREQ = "kind string, value binary, number double, place long, moment long, length int, n long, present long, empty long, blank long, bad long"
_FREQ_NAMES = ["kind", "value", "number", "place", "moment", "length", "n", "present", "empty", "blank", "bad"]
_FREQ_KINDS = [pa.string(), pa.binary(), pa.float64(), pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 5]


def _node_rows(node: _Node, check: Callable[[str], bool] | None) -> Iterator[tuple]:
    """(kind, value, ...) rows of one path; of a path not counted by value one a kind."""
    if node.present:
        yield ("record", None, None, None, None, None, 0, node.present, 0, 0, 0)
    for kind, values in node.values.items():
        total = [0, 0, 0, 0]
        for value, n in values.items():
            empty = blank = bad = 0
            if kind == "string":
                if not value:
                    empty = n
                elif not value.strip():
                    blank = n
                elif check is not None and check(value):
                    bad = n
            elif value in ("[]", "{}"):
                empty = n
            if not node.counted:
                total = [a + b for a, b in zip(total, (n, empty, blank, bad))]
                continue
            number = place = at = length = None
            if kind in ("integer", "number", "boolean"):
                try:
                    number = float(value)
                except OverflowError:  # an integer beyond a double
                    number = float("inf") if value > 0 else float("-inf")
                if kind != "boolean":
                    place = place_of(number)
            elif kind == "string":
                at, length = moment(value), len(value)
            text = value if kind in ("array", "object") else canonical_json(value)
            digest = hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()
            yield (kind, digest, number, place, at, length, n, 0, empty, blank, bad)
        if not node.counted:
            n, empty, blank, bad = total
            yield (kind, None, None, None, None, None, n, 0, empty, blank, bad)


def path_value_counts(df: DataFrame, keys: list[str], raw: str, values: Callable[[str], bool] | None = None, checks: dict[str, Callable[[str], bool]] | None = None) -> DataFrame:
    """The unpivoted frequency table (keys..., path, kind, value, number, place, moment, length, n,
    present, empty, blank, bad) over the JSON records in ``raw``.

    One row for each path, JSON type and distinct value (``value``: 128-bit digest of its canonical
    JSON; ``number`` for integers, numbers and booleans, integers beyond a double being infinite;
    ``place`` orders numbers; ``length`` for strings, ``moment`` for those that are a date or time)
    with its occurrences ``n``. ``values`` tells which paths are counted value by value (default
    all); of others ``value`` is null. The row of kind ``record`` of a path has in ``present`` the
    records that hold it; the row with a null path counts the records. Empty strings, arrays and
    objects count as ``empty``, strings that strip to nothing as ``blank``, non-blank strings that
    fail ``checks[path]`` as ``bad``. Null or invalid JSON is a record without paths. Each task
    counts in a tree of paths before the shuffle, so no key or value, however frequent, gathers
    rows, and looks at each distinct value once."""
    keyed = [F.col(f"`{k}`").alias(k) for k in keys]
    types = {f.name: f.dataType for f in df.schema.fields}
    schema = ", ".join(f"`{k}` {types[k].simpleString()}" for k in keys) + ", path string, " + _FREQ
    checks = checks or {}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots: dict[tuple, _Node] = {}
        width, kinds, number = len(keys), None, 0

        def below(node: _Node, path: str) -> _Node:
            return _Node(path, values is None or bool(values(path)))

        def visit(node: _Node, value: object) -> None:
            if node.last != number:
                node.last = number
                node.present += 1
            kind = json_type(value)
            key = value
            if kind == "object":
                key = canonical_json(value) if node.counted else "{}" if not value else ""
                kids, head = node.kids, f"{node.path}." if node.path else ""
                for name, child in value.items():
                    kid = kids.get(name)
                    if kid is None:
                        kid = kids[name] = below(node, head + name)
                    visit(kid, child)
            elif kind == "array":
                key = canonical_json(value) if node.counted else "[]" if not value else ""
                if value:
                    if node.item is None:
                        node.item = below(node, f"{node.path}[]" if node.path else "[]")
                    for child in value:
                        visit(node.item, child)
            if node.path:
                counts = node.values.get(kind)
                if counts is None:
                    counts = node.values[kind] = {}
                counts[key] = counts.get(key, 0) + 1

        def rows_below(node: _Node) -> Iterator[tuple]:
            stack = [node]
            while stack:
                at = stack.pop()
                stack += at.kids.values()
                if at.item is not None:
                    stack.append(at.item)
                if at.path is None:
                    yield (None, "record", None, None, None, None, None, 0, at.present, 0, 0, 0)
                elif at.path:
                    for row in _node_rows(at, checks.get(at.path)):
                        yield (at.path, *row)

        def flush() -> Iterator[pa.RecordBatch]:
            rows = [(*k, *row) for k, root in roots.items() for row in rows_below(root)]
            roots.clear()
            for i in range(0, len(rows), _FLUSH):
                columns = list(zip(*rows[i : i + _FLUSH]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [*kinds, pa.string(), *_FREQ_KINDS])], names=[*keys, "path", *_FREQ_NAMES])

        seen = 0
        for batch in batches:
            if kinds is None:
                kinds = [batch.column(i).type for i in range(width)]
            for *k, text in zip(*(batch.column(i).to_pylist() for i in range(width + 1))):
                root = roots.get(tuple(k))
                if root is None:
                    root = roots[tuple(k)] = _Node(None, False)
                number += 1
                try:
                    record = loads_strict(text) if text is not None else None
                except ValueError:
                    record = None
                if text is not None and text.count("[") + text.count("{") > MOST_LEVELS and _levels(record) > MOST_LEVELS:
                    record = None
                if type(record) in (dict, list):
                    seen += len(text)
                    visit(root, record)
                else:
                    root.present += 1
            if seen > _FLUSH_CHARS:
                yield from flush()
                seen = 0
        yield from flush()

    rows = spread(df.select(*keyed, F.col(f"`{raw}`").alias("__raw"))).mapInArrow(count, schema)
    sums = [F.sum(c).alias(c) for c in ("n", "present", "empty", "blank", "bad")]
    return rows.groupBy(*keys, "path", "kind", "value", "number", "place", "moment", "length").agg(*sums)


def field_report(freq: DataFrame, keys: list[str], numbers: tuple[str, ...] = ()) -> DataFrame:
    """One row for each (keys..., path): records_present, occurrences, missing, nulls, empties,
    blanks, bad values, a count per JSON type, distinct values (null counts as one; 0 where values
    were not counted), ranges of numbers, of string lengths in characters and of dates and times (strings that are
    one, in UTC; null where values were not counted), and the number of types besides null."""
    per = freq.filter(F.col("path").isNotNull()).groupBy(*keys, "path").agg(
        F.sum(F.when(F.col("kind") == "record", F.col("present"))).alias("records_present"),
        F.sum("n").alias("occurrences"),
        *[F.sum(F.when(F.col("kind") == t, F.col("n")).otherwise(0)).alias(f"n_{t}") for t in TYPES],
        F.sum(F.when(F.col("kind") == "string", F.col("empty")).otherwise(0)).alias("empty_strings"),
        F.sum("blank").alias("blank_strings"),
        F.sum(F.when(F.col("kind") == "array", F.col("empty")).otherwise(0)).alias("empty_arrays"),
        F.sum(F.when(F.col("kind") == "object", F.col("empty")).otherwise(0)).alias("empty_objects"),
        F.sum("bad").alias("bad_values"),
        F.count("value").alias("distinct_values"),
        F.min(F.when(F.col("kind") != "boolean", F.col("number"))).alias("min_number"),
        F.max(F.when(F.col("kind") != "boolean", F.col("number"))).alias("max_number"),
        F.min("length").alias("min_length"),
        F.max("length").alias("max_length"),
        F.timestamp_micros(F.min("moment")).alias("min_time"),
        F.timestamp_micros(F.max("moment")).alias("max_time"),
        F.sum(F.when((F.col("kind") == "boolean") & (F.col("number") == 1), F.col("n")).otherwise(0)).alias("n_true"),
        F.sum(F.when((F.col("kind") == "boolean") & F.col("number").isNotNull(), F.col("n")).otherwise(0)).alias("n_flag"),
    )
    records = freq.filter(F.col("path").isNull()).groupBy(*keys).agg(F.sum("present").alias("records"))
    out = join_nullsafe(per, records, keys)
    mixed = sum((F.when(F.col(f"n_{t}") > 0, 1).otherwise(0) for t in TYPES if t != "null"), F.lit(0))
    return out.withColumns({"missing": F.col("records") - F.col("records_present"), "nulls": F.col("n_null"), "mixed_types": mixed})


def join_nullsafe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", suffix: str = "") -> DataFrame:
    """Equi-join in which null keys match; the left keys stay, other right columns get ``suffix``."""
    a, b = left.alias("a"), right.alias("b")
    on = None
    for k in keys:
        term = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = term if on is None else on & term
    rest = [F.col(f"b.{c}").alias(c + suffix) for c in right.columns if c not in keys]
    return a.join(b, on, how).select("a.*", *rest)


#: Bits of a place looked at in each round of the search for quantiles: what one group gives the
#: window of a round is at most 2 ** this many counts, whatever the number of values.
_ROUNDS = (22, 21, 21)


def exact_quantiles(freq: DataFrame, keys: list[str], ranks: list[Column]) -> DataFrame:
    """(keys..., rank, place, number): the places of the values of the given 0-based ranks (expressions over
    ``total``, the number of values of a group) in ``freq`` (keys..., place, number, n).

    By radix: counts per leading bits of the places, then per the bits that follow within the parts
    that hold a rank, and so on. Each round combines counts before its shuffle, and its window
    orders a bounded number of counts a group, so neither a hot value nor a crowd of close ones
    gathers in a task. The parts still open are one row a group and rank; they are broadcast if
    they measure little enough."""
    rows = freq.select(*keys, "place", "number", "n")
    shift = 64
    open_parts = None
    for i, bits in enumerate(_ROUNDS):
        shift -= bits
        mask = (1 << bits) - 1
        digit = F.shiftright("place", shift) if i == 0 else F.shiftright("place", shift).bitwiseAND(F.lit(mask).cast("long"))
        if open_parts is None:
            counts = rows.groupBy(*keys, digit.alias("digit")).agg(F.sum("n").alias("n"))
            group = list(keys)
            total = F.sum("n").over(Window.partitionBy(*group))
            upto = F.sum("n").over(Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            counts = counts.withColumns({"total": total, "upto": upto})
            wanted = counts.withColumn("rank", F.explode(F.array_distinct(F.array(*[r.cast("long") for r in ranks])))).withColumn("left", F.col("rank"))
        else:
            small, _ = size_checked(open_parts, F.lit(64 + 40 * len(keys)))
            parts = open_parts.groupBy(*keys, "prefix").agg(F.collect_list(F.struct("rank", "left")).alias("asked"))
            joined = join_nullsafe(rows.withColumn("prefix", F.shiftright("place", shift + bits)), F.broadcast(parts) if small else parts, [*keys, "prefix"])
            # in the last round a part is one value
            counts = joined.groupBy(*keys, "prefix", digit.alias("digit")).agg(F.sum("n").alias("n"), F.first("asked").alias("asked"), F.first("number").alias("number"))
            group = [*keys, "prefix"]
            upto = F.sum("n").over(Window.partitionBy(*group).orderBy("digit").rowsBetween(Window.unboundedPreceding, Window.currentRow))
            wanted = counts.withColumn("upto", upto).withColumn("x", F.explode("asked")).select(*keys, "prefix", "digit", "n", "upto", "number", "x.rank", "x.left")
        hit = wanted.filter((F.col("left") < F.col("upto")) & (F.col("left") >= F.col("upto") - F.col("n")))
        prefix = F.col("digit") if open_parts is None else F.shiftleft("prefix", bits).bitwiseOR(F.col("digit"))
        last = i + 1 == len(_ROUNDS)
        open_parts = hit.select(*keys, prefix.alias("prefix"), "rank", (F.col("left") - F.col("upto") + F.col("n")).alias("left"), *(["number"] if last else []))
        open_parts = open_parts if last else staged(open_parts, "quantile-parts")
    return open_parts.select(*keys, "rank", F.col("prefix").alias("place"), "number")


def _places(number: Column) -> Column:
    """``place_of`` of a column of doubles."""

    @F.arrow_udf("long")
    def places(numbers: pa.Array) -> pa.Array:
        bits = (numbers.fill_null(0).to_numpy() + 0.0).view("int64")
        return pa.array(np.where(bits >= 0, bits, -(bits & 0x7FFF_FFFF_FFFF_FFFF)), mask=numbers.is_null().to_numpy(zero_copy_only=False))

    return places(number)


def exact_medians(freq: DataFrame, keys: list[str], path: str, kinds: tuple[str, ...] = ("integer", "number")) -> DataFrame:
    """(keys..., median) of the numeric values at ``path`` (of an even count the mean of the middle
    two), from value counts, by ``exact_quantiles``. No row for groups without numbers."""
    rows = freq.filter((F.col("path") == path) & F.col("kind").isin(*kinds) & F.col("number").isNotNull())
    if "place" not in freq.columns:
        rows = rows.withColumn("place", _places(F.col("number")))
    middle = exact_quantiles(rows, keys, [F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)])
    ends = middle.groupBy(*keys).agg(F.min("number").alias("a"), F.max("number").alias("b"))
    return ends.select(*keys, ((F.col("a") + F.col("b")) / 2).alias("median"))


def _finding(df: DataFrame, keys: list[str], path: Column, name: str) -> DataFrame:
    return df.select(*keys, path.alias("field_path"), F.lit(name).alias("finding"))


def load_findings(records: DataFrame, profiles: DataFrame | None = None, summaries: DataFrame | None = None, shift_fields: tuple[str, ...] = ("email", "name", "active", "tags", "meta.score", "updated_at"), median_field: str = "meta.score", flag_field: str = "active", checks: dict[str, Callable[[str], bool]] | None = None, limit: float = 0.25) -> DataFrame:
    """(source, load_no, field_path, finding) over the JSON records of each (source, load_no),
    against the load before (load_no - 1 of the same source) and the stored reports: mixed_types,
    null_shift, value_shift, bad_pattern, wrong_profile, wrong_summary. Null sources form one
    source; a load before that does not exist gives no shift; a report on a path or load without
    records is compared with zero counts; empty tables give no rows."""
    keys = ["source", "load_no"]
    checks = CHECKS if checks is None else checks
    with passing(records.sparkSession):
        freq = staged(path_value_counts(records, keys, "raw", checks=checks), "profile-counts")
        return kept(_findings(freq, profiles, summaries, keys, shift_fields, median_field, flag_field, limit), "load-findings")


def _findings(freq: DataFrame, profiles: DataFrame | None, summaries: DataFrame | None, keys: list[str], shift_fields: tuple[str, ...], median_field: str, flag_field: str, limit: float) -> DataFrame:
    facts = ["records", "records_present", *(f"n_{t}" for t in TYPES), "mixed_types", "bad_values", "n_true", "n_flag"]
    report = join_nullsafe(field_report(freq, keys).select(*keys, "path", *facts), exact_medians(freq, keys, median_field).withColumn("path", F.lit(median_field)), [*keys, "path"], "left")
    # one row a path and load: all that follows reads this
    report = staged(report, "profile-report")
    loads = freq.filter(F.col("path").isNull()).groupBy(*keys).agg(F.sum("present").alias("records"))
    own = F.array(F.when(F.col("mixed_types") > 1, F.lit("mixed_types")), F.when(F.col("bad_values") > 0, F.lit("bad_pattern")))
    out = [report.select(*keys, F.col("path").alias("field_path"), F.explode(F.array_compact(own)).alias("finding"))]

    # the fields compared with the load before, also where no record of a load has them
    fields = tuple(dict.fromkeys([*shift_fields, median_field, flag_field]))
    grid = loads.select(*keys, F.col("records").alias("total"), F.explode(F.array(*map(F.lit, fields))).alias("path"))
    now = join_nullsafe(grid, report, [*keys, "path"], "left")
    # a record lacks the field if the path is missing or its value is null
    lack = F.col("total") - F.coalesce("records_present", F.lit(0)) + F.coalesce("n_null", F.lit(0))
    now = now.select(*keys, "path", F.struct("load_no", F.col("total").alias("records"), lack.alias("lack"), "median", "n_true", "n_flag").alias("now"))
    pairs = now.withColumn("old", F.lag("now").over(Window.partitionBy("source", "path").orderBy("load_no")))
    pairs = pairs.filter(F.col("old.load_no") == F.col("now.load_no") - 1)
    gap = lambda part, whole: F.abs(F.col(f"now.{part}") * F.col(f"old.{whole}") - F.col(f"old.{part}") * F.col(f"now.{whole}")).cast("double") / (F.col(f"now.{whole}") * F.col(f"old.{whole}"))
    new, old = F.col("now.median"), F.col("old.median")
    shifted = F.when((new >= 0) & (old >= 0), (new != old) & ((new >= old * 2) | (new * 2 <= old))).when((new <= 0) & (old <= 0), (new != old) & ((new <= old * 2) | (new * 2 >= old))).when(new.isNotNull() & old.isNotNull(), True)
    flags = (F.col("path") == flag_field) & (F.col("now.n_flag") > 0) & (F.col("old.n_flag") > 0)
    found = F.array(
        F.when(F.col("path").isin(*shift_fields) & (gap("lack", "records") > limit), F.lit("null_shift")),
        F.when((F.col("path") == median_field) & shifted, F.lit("value_shift")),
        F.when(F.when(flags, gap("n_true", "n_flag") > limit), F.lit("value_shift")),
    )
    out.append(pairs.select(*keys, F.col("path").alias("field_path"), F.explode(F.array_compact(found)).alias("finding")))

    if profiles is not None:
        claims = profiles.select(*keys, "path", F.col("records_present").alias("c_present"), F.col("nulls").alias("c_nulls"), F.col("missing").alias("c_missing"), F.array_sort(F.map_entries("types")).alias("c_types"))
        kinds = F.filter(F.array(*[F.struct(F.lit(t).alias("key"), F.col(f"n_{t}").alias("value")) for t in TYPES]), lambda e: e["value"] > 0)
        facts = report.select(*keys, "path", "records_present", F.col("n_null").alias("nulls"), F.array_sort(kinds).alias("kinds"))
        held = join_nullsafe(join_nullsafe(claims, loads, keys, "left"), facts, [*keys, "path"], "left")
        present, none = F.coalesce("records_present", F.lit(0)), F.array().cast("array<struct<key:string,value:bigint>>")
        differs = lambda claim, fact: F.coalesce(F.col(claim) != fact, F.lit(False))
        text = lambda c: F.to_json(c)
        wrong = differs("c_present", present) | differs("c_nulls", F.coalesce("nulls", F.lit(0))) | differs("c_missing", F.coalesce("records", F.lit(0)) - present) | (F.col("c_types").isNotNull() & (text(F.col("c_types")) != text(F.coalesce("kinds", none))))
        out.append(_finding(held.filter(wrong), keys, F.col("path"), "wrong_profile").distinct())
    if summaries is not None:
        mixed = report.groupBy(*keys).agg(F.sum(F.when(F.col("mixed_types") > 1, 1).otherwise(0)).alias("mixed"))
        held = join_nullsafe(summaries.select(*keys, "mixed_type_fields"), mixed, keys, "left")
        out.append(_finding(held.filter(F.col("mixed_type_fields") != F.coalesce("mixed", F.lit(0))), keys, F.lit(""), "wrong_summary").distinct())
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def _cells(freq: DataFrame) -> tuple[Column, Column]:
    """(axis, cell): the numeric cell a value falls in, about a thousandth of its size wide, or the day
    of a date or time; null for other values. An axis has at most some millions of cells, whatever
    the number of values."""
    number = F.col("kind").isin("integer", "number") & F.col("place").isNotNull()
    axis = F.when(number, F.lit("number")).when(F.col("moment").isNotNull(), F.lit("date"))
    return axis, F.when(number, F.shiftright("place", 64 - _ROUNDS[0])).otherwise(F.floor(F.col("moment") / 86_400_000_000))


def _edges(cells: DataFrame, keys: list[str], bins: int) -> DataFrame:
    """(keys..., path, axis, edges): ascending upper bounds of ``bins`` quantile ranges of the cells on
    each axis, the largest cell last."""
    group = [*keys, "path", "axis"]
    at = cells.groupBy(*group, "cell").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    at = at.withColumns({"upto": upto, "total": F.sum("n").over(Window.partitionBy(*group))})
    share = lambda c: F.floor(c * bins / F.col("total"))
    return at.filter(share(F.col("upto")) > share(F.col("upto") - F.col("n"))).groupBy(*group).agg(F.array_sort(F.collect_list("cell")).alias("edges"))


def load_drift(freq: DataFrame, keys: tuple[str, str] = ("source", "load_no"), bins: int = 16) -> DataFrame:
    """(source, load_no, path, psi, chi_square, n, n_before, missing, missing_before): how far each
    path's values moved from the load before, for each path of either load; the first load of a
    source has no rows. ``freq`` is counted by value and read several times: stage it.

    Numbers and dates fall in ranges, by type, between ``bins`` quantiles of the load before (and
    above its largest value), found on cells of about a thousandth of a number or a day. Nulls and
    booleans are bins of their own; so is each text, array or object that is at least 1 of 2 *
    ``bins`` occurrences in either load, all others of a type are one bin. Records without the path
    are one more bin. Shares of empty bins count as half an occurrence in the population stability
    index; the chi-square statistic compares the two loads as samples of one distribution. ``n`` is
    occurrences and ``missing`` records.

    The value counts are only summed to cells and types and looked up among the frequent values (at
    most 4 * ``bins`` a path and pair of loads, broadcast if they measure little enough)."""
    source, load = keys
    by = [source, load]
    with passing(freq.sparkSession):
        return kept(_load_drift(freq, by, bins), "load-drift")


def _load_drift(freq: DataFrame, by: list[str], bins: int) -> DataFrame:
    load, kind_of = by[1], freq.schema[by[1]].dataType
    next_load = lambda df: df.withColumn(load, (F.col(load) + 1).cast(kind_of))
    zero = F.lit(0).cast("long")

    def votes(rows: DataFrame, what: str, *group: str) -> DataFrame:
        now = rows.select(*group, F.col(what).alias("now"), zero.alias("old"))
        before = next_load(rows).select(*group, zero.alias("now"), F.col(what).alias("old"))
        return now.unionByName(before).groupBy(*group).agg(F.sum("now").alias("now"), F.sum("old").alias("old"))

    axis, cell = _cells(freq)
    # one pass over the value counts: per cell, per type and per path
    values = freq.filter(F.col("path").isNotNull() & (F.col("kind") != "record")).withColumns({"axis": axis, "cell": F.when(axis.isNotNull(), cell)})
    sums = staged(values.groupBy(*by, "path", "kind", "axis", "cell").agg(F.sum("n").alias("n")), "drift-cells")
    records = freq.filter(F.col("path").isNull()).groupBy(*by).agg(F.sum("present").alias("records"))
    present = freq.filter(F.col("path").isNotNull() & (F.col("kind") == "record")).groupBy(*by, "path").agg(F.sum("present").alias("present"))
    pairs = staged(join_nullsafe(records, next_load(records), by, suffix="_before"), "drift-pairs")

    # numbers and dates: cells between the quantiles of the load before
    on_axis = sums.filter(F.col("axis").isNotNull())
    edges = next_load(_edges(on_axis, by, bins))
    cells = join_nullsafe(votes(on_axis, "n", *by, "path", "kind", "axis", "cell"), edges, [*by, "path", "axis"], "left")
    range_no = F.size(F.filter(F.coalesce("edges", F.array().cast("array<bigint>")), lambda e: e < F.col("cell")))
    ranged = cells.select(*by, "path", F.concat_ws(":", "kind", "axis", range_no.cast("string")).alias("bin"), "now", "old")

    # texts, arrays and objects: the frequent values of either load; the rest of the type is one bin
    other = sums.filter(F.col("axis").isNull())
    own = F.col("kind").isin("null", "boolean")
    totals = sums.groupBy(*by, "path").agg(F.sum("n").alias("total"))
    texts = values.filter(F.col("axis").isNull() & (F.col("kind") != "null")).select(*by, "path", "kind", "value", "n")
    frequent = join_nullsafe(texts, totals, [*by, "path"]).filter((F.col("n") * 2 * bins >= F.col("total")) | (F.col("kind") == "boolean")).select(*by, "path", "kind", "value")
    # as load and as load before
    frequent = staged(frequent.unionByName(next_load(frequent)).distinct(), "drift-frequent")
    small, _ = size_checked(frequent, F.length("path") + F.lit(80))
    asked = F.broadcast(frequent) if small else frequent
    label = F.concat_ws(":", "kind", F.lit("is"), F.hex("value"))
    now = join_nullsafe(texts, asked, [*by, "path", "kind", "value"]).select(*by, "path", "kind", label.alias("bin"), F.col("n").alias("now"), zero.alias("old"))
    old = join_nullsafe(next_load(texts), asked, [*by, "path", "kind", "value"]).select(*by, "path", "kind", label.alias("bin"), zero.alias("now"), F.col("n").alias("old"))
    named = now.unionByName(old).groupBy(*by, "path", "kind", "bin").agg(F.sum("now").alias("now"), F.sum("old").alias("old"))
    named = staged(named, "drift-named")
    rest = votes(other.groupBy(*by, "path", "kind").agg(F.sum("n").alias("n")), "n", *by, "path", "kind")
    less = named.groupBy(*by, "path", "kind").agg((-F.sum("now")).alias("now"), (-F.sum("old")).alias("old"))
    rest = rest.unionByName(less).groupBy(*by, "path", "kind").agg(F.sum("now").alias("now"), F.sum("old").alias("old"))
    rest = rest.select(*by, "path", F.concat_ws(":", "kind", F.when(own, F.lit("is")).otherwise(F.lit("other"))).alias("bin"), "now", "old")

    lack = join_nullsafe(votes(present, "present", *by, "path"), pairs, by).select(*by, "path", F.lit("missing").alias("bin"), (F.col("records") - F.col("now")).alias("now"), (F.col("records_before") - F.col("old")).alias("old"))
    per_bin = ranged.unionByName(named.drop("kind")).unionByName(rest)
    per_bin = join_nullsafe(per_bin, pairs.select(*by), by).unionByName(lack).groupBy(*by, "path", "bin").agg(F.sum("now").alias("now"), F.sum("old").alias("old")).filter("now + old > 0")

    both = Window.partitionBy(*by, "path")
    per_bin = per_bin.withColumns({"n": F.sum("now").over(both), "m": F.sum("old").over(both)})
    p, q = F.greatest(F.col("now"), F.lit(0.5)) / F.col("n"), F.greatest(F.col("old"), F.lit(0.5)) / F.col("m")
    total = F.col("now") + F.col("old")
    expect_n, expect_m = total * F.col("n") / (F.col("n") + F.col("m")), total * F.col("m") / (F.col("n") + F.col("m"))
    chi = (F.col("now") - expect_n) ** 2 / expect_n + (F.col("old") - expect_m) ** 2 / expect_m
    of = lambda c, missing: F.sum(F.when((F.col("bin") == "missing") == missing, F.col(c)).otherwise(0))
    return per_bin.groupBy(*by, "path").agg(
        F.sum((p - q) * F.log(p / q)).alias("psi"), F.sum(chi).alias("chi_square"),
        of("now", False).alias("n"), of("old", False).alias("n_before"), of("now", True).alias("missing"), of("old", True).alias("missing_before"),
    )
