"""Profile reports: metric planning, typed and JSON profiles, quality summaries, renderings."""

import hashlib
import html
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.errors import UnknownProfileMetricError
from sedimenta.functions.paths import parse_path, read_path
from sedimenta.functions.values import canonical_json, is_blank, loads_strict
from sedimenta.operators import dedup
from sedimenta.operators.profile import TYPES, field_report, path_value_counts
from sedimenta.session import staged

#: Fixed values.
METRICS = frozenset({"count", "duplicates", "nulls", "missing", "empty", "types", "cardinality", "schema"})
PRESETS = {
    "quality": frozenset({"duplicates", "nulls", "missing", "empty", "types"}),
    "statistics": frozenset({"count", "cardinality"}),
    "schema": frozenset({"schema", "types", "missing"}),
    "all": METRICS,
}
EXACT_LIMIT = 10_000
SKETCH_ERROR = 0.01625
DEFAULT_SAMPLE = 10_000


def resolve_metrics(metrics: tuple[str, ...] | list[str]) -> tuple[str, ...]:
    """Sorted metric names of metrics and presets; none means all."""
    wanted: set[str] = set()
    for name in (str(m).strip().lower() for m in metrics):
        if name in PRESETS:
            wanted |= PRESETS[name]
        elif name in METRICS:
            wanted.add(name)
        elif name:
            raise UnknownProfileMetricError(f"unknown metric {name!r}; there are {', '.join(sorted(METRICS | set(PRESETS)))}")
    return tuple(sorted(wanted or METRICS))


def sample_prefix(df: DataFrame, order: str | None, scope: str = "full", limit: int | None = None) -> DataFrame:
    """All records, or for ``sample`` the first ``limit`` by ``order``, without one in the order of the
    input."""
    if scope not in ("full", "sample"):
        raise ValueError("scope is full or sample")
    if scope == "full":
        if limit is not None:
            raise ValueError("a limit needs scope sample")
        return df
    n = DEFAULT_SAMPLE if limit is None else limit
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("limit is a positive integer")
    return df.orderBy(order).limit(n) if order else df.limit(n)


def adaptive_cardinality(df: DataFrame, columns: list[str], limit: int = EXACT_LIMIT) -> DataFrame:
    """(column_name, distinct_values, precision) with null as a value: one pass of sketches over
    all columns, then exact counts only for columns whose sketch may lie within ``limit``."""
    null = lambda c: F.max(F.col(f"`{c}`").isNull().cast("int"))
    row = df.agg(*[x for i, c in enumerate(columns) for x in (F.approx_count_distinct(f"`{c}`", SKETCH_ERROR).alias(f"a{i}"), null(c).alias(f"n{i}"))]).first()
    near = [c for i, c in enumerate(columns) if row[f"a{i}"] <= limit * (1 + 4 * SKETCH_ERROR)]
    exact = {}
    if near:
        # the sketch bounds each set, so sets merge on the map side where count(distinct) would expand rows
        counts = df.agg(*[F.size(F.collect_set(f"`{c}`")).alias(f"d{i}") for i, c in enumerate(near)]).first()
        exact = {c: counts[f"d{i}"] for i, c in enumerate(near)}
    out = []
    for i, c in enumerate(columns):
        has_null = row[f"n{i}"] or 0
        n = exact.get(c)
        sure = n is not None and n + has_null <= limit
        out.append((c, (n if sure else row[f"a{i}"]) + has_null, "exact" if sure else "approximate"))
    return df.sparkSession.createDataFrame(out, "column_name string, distinct_values long, precision string")


def adaptive_distinct(freq: DataFrame, keys: list[str], limit: int = EXACT_LIMIT) -> DataFrame:
    """(keys..., path, distinct_values, precision) of JSON values in a frequency table: the count where
    it is at most ``limit``, else the estimate of a HyperLogLog sketch (of 4096 registers, as wide an
    error as ``SKETCH_ERROR``), which reports of several tables can be merged by."""
    per = freq.filter(F.col("path").isNotNull() & F.col("value").isNotNull()).groupBy(*keys, "path")
    per = per.agg(F.count("*").alias("held"), F.hll_sketch_estimate(F.hll_sketch_agg("value", 12)).alias("estimate"))
    exact = F.col("held") <= limit
    return per.select(*keys, "path", F.when(exact, F.col("held")).otherwise(F.col("estimate")).alias("distinct_values"), F.when(exact, F.lit("exact")).otherwise(F.lit("approximate")).alias("precision"))


def typed_profile(df: DataFrame) -> DataFrame:
    """One row a top-level column: path, records_present, occurrences, missing, nulls, empty_strings,
    blank_strings, empty_arrays, empty_objects, json_type. One aggregate over one scan; nothing is
    missing in a typed table."""
    parts = []
    for f in df.schema.fields:
        col = F.col(f"`{f.name}`")
        text, array = isinstance(f.dataType, T.StringType), isinstance(f.dataType, T.ArrayType)
        zero = F.lit(0).cast("long")
        parts.append(F.struct(
            F.lit(f.name).alias("path"), F.count("*").alias("records_present"), F.count("*").alias("occurrences"), zero.alias("missing"), F.count_if(col.isNull()).alias("nulls"),
            (F.count_if(col == "") if text else zero).alias("empty_strings"),
            (F.count_if((col != "") & is_blank(col)) if text else zero).alias("blank_strings"),
            (F.count_if(F.size(col) == 0) if array else zero).alias("empty_arrays"),
            (F.count_if(F.size(col) == 0) if isinstance(f.dataType, T.MapType) else zero).alias("empty_objects"),
            F.lit(json_type_of(f.dataType)).alias("json_type"),
        ))
    return df.agg(F.array(*parts).alias("r")).select(F.inline("r"))


def json_type_of(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.IntegralType):
        return "integer"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.ArrayType):
        return "array"
    return "object" if isinstance(kind, (T.StructType, T.MapType)) else "string"


@dataclass
class ProfileReport:
    """Aggregates only, never values. None means not computed, which is not zero."""

    source: str
    metrics: tuple[str, ...]
    records: int | None = None
    fields: list[dict] = field(default_factory=list)
    duplicates: dict | None = None
    warnings: list[str] = field(default_factory=list)
    version: int = 1

    @property
    def quality(self) -> dict:
        """Counts of fields with each defect; None for defects that were not measured."""
        def count(test, metric):
            return sum(map(test, self.fields)) if metric in self.metrics else None

        return {
            "fields_with_missing": count(lambda f: f["missing"] > 0, "missing"),
            "fields_with_nulls": count(lambda f: f["nulls"] > 0, "nulls"),
            "fields_with_empty": count(lambda f: f["empty"] > 0, "empty"),
            "mixed_type_fields": count(lambda f: len(set(f["types"]) - {"null"}) > 1, "types"),
        }

    def to_dict(self) -> dict:
        return asdict(self) | {"quality": self.quality}

    def render_text(self) -> str:
        lines = [f"Profile of {self.source}"]
        if self.records is not None:
            lines.append(f"Records: {self.records:,}")
        if self.duplicates:
            d = self.duplicates
            lines.append(f"Duplicates ({d['mode']}): {d['duplicate_rows']:,} duplicate, {d['invalid_key_rows']:,} invalid, {d['unique_rows']:,} unique")
        for f in self.fields:
            shown = [f"{k}={v}" for k, v in f.items() if k != "path" and v is not None]
            lines.append(f"- {f['path']}: " + ", ".join(shown))
        return "\n".join([*lines, *[f"! {w}" for w in self.warnings]])

    def render_html(self, lang: str = "en") -> str:
        title = {"en": "Data profile", "pt-BR": "Perfil dos dados"}.get(lang, "Data profile")
        heads = list(self.fields[0]) if self.fields else []
        cell = lambda x: "" if x is None else html.escape(str(x))
        body = "".join("<tr>" + "".join(f"<td>{cell(f[h])}</td>" for h in heads) + "</tr>" for f in self.fields)
        notes = "".join(f"<li>{cell(w)}</li>" for w in self.warnings)
        head = "".join(f"<th>{cell(h)}</th>" for h in heads)
        return f'<!doctype html><html lang="{cell(lang)}"><meta charset="utf-8"><title>{title}</title><h1>{title}: {cell(self.source)}</h1><table><tr>{head}</tr>{body}</table><ul>{notes}</ul></html>'


def profile_records(df: DataFrame, *metrics: str, source: str = "records", raw: str = "raw", order: str | None = None, key: str | list[str] | None = None, fields: list[str] | None = None, scope: str = "full", limit: int | None = None) -> ProfileReport:
    """Profile JSON records (text column ``raw``): metrics are planned before anything is read and
    only what they need is computed. ``fields`` keeps exact paths, unseen ones reported as missing
    everywhere. Nulls, repeated rows and empty tables are counted as such; broken JSON counts as a record without fields."""
    wanted = resolve_metrics(metrics)
    rows = sample_prefix(df, order, scope, limit)
    report = ProfileReport(source, wanted)
    counting = "cardinality" in wanted
    if scope == "sample":  # one choice of rows for every pass
        rows = staged(rows, "sample")
    # one constant key stands for the whole table
    freq = staged(path_value_counts(rows.select(F.lit("all").alias("scope"), F.col(f"`{raw}`")), ["scope"], raw, values=None if counting else lambda p: False), "profile")
    report.records = freq.filter("path is null").agg(F.coalesce(F.sum("present"), F.lit(0))).first()[0]
    per_path = field_report(freq, ["scope"]) if report.records else None
    if per_path is not None and counting:
        per_path = per_path.drop("distinct_values").join(adaptive_distinct(freq, ["scope"]).drop("scope"), "path", "left")
    found = {r["path"]: r.asDict() for r in (per_path.filter(F.col("path").isin(fields)) if fields else per_path).orderBy("path").collect()} if per_path is not None else {}
    for path in sorted(set(fields or ()) | set(found)):
        r = found.get(path)
        at = lambda n: r[n] if r else 0  # noqa: E731, B023
        types = {t: r[f"n_{t}"] for t in sorted(TYPES) if r and r[f"n_{t}"]}
        blank = {n: at(n) for n in ("empty_strings", "blank_strings", "empty_arrays", "empty_objects")}
        report.fields.append({
            "path": path, "records_present": at("records_present"), "occurrences": at("occurrences"),
            "missing": report.records - at("records_present") if "missing" in wanted else None,
            "nulls": at("nulls") if "nulls" in wanted else None,
            **{k: v if "empty" in wanted else None for k, v in blank.items()},
            "empty": sum(blank.values()) if "empty" in wanted else None,
            "types": types if {"types", "schema"} & set(wanted) else None,
            "cardinality": at("distinct_values") if counting else None,
            "precision": (r["precision"] if r else "exact") if counting else None,
        })
        if "types" in wanted and len(set(types) - {"null"}) > 1:
            report.warnings.append(f"{path} holds mixed types: {', '.join(t for t in types if t != 'null')}")
    if "duplicates" in wanted:
        report.duplicates = json_duplicates(rows, raw, key).first().asDict()
        if report.duplicates["duplicate_rows"]:
            report.warnings.append(f"{report.duplicates['duplicate_rows']:,} duplicate rows")
        if report.duplicates["invalid_key_rows"]:
            report.warnings.append(f"{report.duplicates['invalid_key_rows']:,} rows without a valid key")
    return report


def json_duplicates(df: DataFrame, raw: str, key: str | list[str] | None = None) -> DataFrame:
    """``duplicate_profile`` of JSON records, typed: 1, "1" and 1.0 are three keys. Without a key
    records compare by canonical JSON; broken JSON is then an invalid row too."""
    paths = [parse_path(p) for p in dedup.resolve_primary_key(key)]

    def identity(text: str | None) -> bytes | None:
        try:
            record = loads_strict(text) if text is not None else None
        except ValueError:
            return None
        values = [read_path(record, p) for p in paths] if paths else record
        if paths and any(v is None or type(v) in (dict, list) or (type(v) is str and not v.strip()) for v in values):
            return None
        return hashlib.sha256(canonical_json(values).encode("utf-8", "surrogatepass")).digest() if text is not None else None

    @F.pandas_udf(T.BinaryType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([identity(t) for t in texts], dtype=object)

    per = df.select(fingerprint(F.col(f"`{raw}`")).alias("k")).groupBy("k").agg(F.count("*").alias("n"))
    bad = F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), F.lit(0))
    out = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.when(F.col("k").isNotNull(), F.col("n") - 1)), F.lit(0)).alias("duplicate_rows"), bad.alias("invalid_key_rows"))
    return out.withColumns({"unique_rows": F.col("records") - F.col("duplicate_rows") - F.col("invalid_key_rows"), "mode": F.lit("key" if paths else "row")})


def quality_summary(report: DataFrame, keys: list[str]) -> DataFrame:
    """Second-level counts over ``field_report`` rows, per key."""
    empty = F.col("empty_strings") + F.col("blank_strings") + F.col("empty_arrays") + F.col("empty_objects")
    count: dict[str, Column] = {"fields_with_missing": F.col("missing") > 0, "fields_with_nulls": F.col("nulls") > 0, "fields_with_empty": empty > 0, "mixed_type_fields": F.col("mixed_types") > 1}
    return report.groupBy(*keys).agg(F.max("records").alias("records_analyzed"), *[F.count_if(c).alias(n) for n, c in count.items()])
