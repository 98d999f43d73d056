"""One query for each operator of the landing library, over the whole test tables, with its SQL."""

from __future__ import annotations

import json
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.functions import text, values
from sedimenta.functions.paths import json_path, parse_path, project, resolve_select
from sedimenta.functions.types import ColumnSpec, EndpointSchema
from sedimenta.operators import bronze, dedup, incremental, profile, report
from sedimenta.operators.bronze import LoadContext
from sedimenta.session import scratch_path, staged, table
from sedimenta.sinks.parquet import ParquetDestination

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return keep


# ---- profiling -----------------------------------------------------------------------------------

_NODES = r"""nodes AS (SELECT p.source, p.record_no, regexp_replace(replace(substr(t.fullkey, 3), '"', ''), '\[[0-9]+\]', '[]', 'g') AS path,
  CASE t.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS kind,
  t.value AS value FROM profile_records p, json_tree(p.raw::JSON) t WHERE t.fullkey <> '$')"""
_TEXT = "json_extract_string(value, '$')"
_BLANK = r"regexp_full_match(" + _TEXT + r", '[\s\x{1c}-\x{1f}\x{85}\p{Z}\v]+')"


def _freq(spark: SparkSession, d: str, all_values: bool = False) -> DataFrame:
    return profile.path_value_counts(table(spark, d, "profile_records"), ["source"], "raw", values=None if all_values else lambda p: False)


def _report(spark: SparkSession, d: str) -> DataFrame:
    return profile.field_report(staged(_freq(spark, d), "profile"), ["source"])


@query("SELECT source, count(*) AS records FROM profile_records GROUP BY source")
def profile_count(spark, d):
    return table(spark, d, "profile_records").groupBy("source").agg(F.count("*").alias("records"))


@query(f"""WITH {_NODES}, n AS (SELECT source, count(*) AS records FROM profile_records GROUP BY source)
SELECT source, path, count(DISTINCT record_no) AS records_present, count(*) AS occurrences, any_value(n.records) - count(DISTINCT record_no) AS missing FROM nodes JOIN n USING (source) GROUP BY source, path""")
def profile_presence(spark, d):
    return _report(spark, d).select("source", "path", "records_present", "occurrences", "missing")


@query(f"""WITH {_NODES} SELECT source, path, count(*) FILTER (kind = 'null') AS nulls,
 count(*) FILTER (kind = 'string' AND {_TEXT} = '') AS empty_strings, count(*) FILTER (kind = 'string' AND {_TEXT} <> '' AND {_BLANK}) AS blank_strings,
 count(*) FILTER (kind = 'array' AND json_array_length(value) = 0) AS empty_arrays, count(*) FILTER (kind = 'object' AND value::VARCHAR = '{{}}') AS empty_objects FROM nodes GROUP BY source, path""")
def profile_empties(spark, d):
    return _report(spark, d).select("source", "path", "nulls", "empty_strings", "blank_strings", "empty_arrays", "empty_objects")


@query(f"WITH {_NODES} SELECT source, path, kind, count(*) AS n FROM nodes GROUP BY source, path, kind")
def profile_types(spark, d):
    return _freq(spark, d).filter("path is not null and kind <> 'record'").groupBy("source", "path", "kind").agg(F.sum("n").alias("n"))


@query(f"WITH {_NODES} SELECT source, path, count(DISTINCT kind || value::VARCHAR) AS distinct_values FROM nodes GROUP BY source, path")
def profile_cardinality(spark, d):
    return profile.field_report(staged(_freq(spark, d, True), "profile"), ["source"]).select("source", "path", "distinct_values")


#: Switch from counting to estimating in profile_cardinality_json, low enough for the test data to pass it.
_JSON_LIMIT = 50


@query(f"""WITH {_NODES}, c AS (SELECT source, path, count(DISTINCT kind || value::VARCHAR) AS n FROM nodes GROUP BY source, path)
SELECT source, path, CASE WHEN n <= {_JSON_LIMIT} THEN 'exact' ELSE 'approximate' END AS "precision", CASE WHEN n <= {_JSON_LIMIT} THEN n ELSE -1 END AS exact_distinct, true AS within_error FROM c""")
def profile_cardinality_json(spark, d):
    """Counts up to the limit, sketches beyond; every estimate is held against the count."""
    freq = staged(_freq(spark, d, True), "profile")
    true_counts = profile.field_report(freq, ["source"]).select("source", "path", F.col("distinct_values").alias("n"))
    out = profile.join_nullsafe(report.adaptive_distinct(freq, ["source"], _JSON_LIMIT), true_counts, ["source", "path"])
    return out.select("source", "path", "precision", F.when(F.col("precision") == "exact", F.col("distinct_values")).otherwise(-1).alias("exact_distinct"), (F.abs(F.col("distinct_values") - F.col("n")) <= F.col("n") * 4 * report.SKETCH_ERROR + 1).alias("within_error"))


_CARDINAL = ["l_orderkey", "l_linenumber", "l_extendedprice", "l_returnflag"]


@query(f"""WITH c AS (SELECT unnest({_CARDINAL}) AS column_name, unnest([{", ".join(f"count(DISTINCT {c})" for c in _CARDINAL)}]) AS n FROM lineitem)
SELECT column_name, CASE WHEN n <= 10000 THEN 'exact' ELSE 'approximate' END AS "precision", CASE WHEN n <= 10000 THEN n ELSE -1 END AS exact_distinct, true AS within_error FROM c""")
def profile_cardinality_adaptive(spark, d):
    """Every estimate is held against the exact count."""
    lines = table(spark, d, "lineitem")
    out = report.adaptive_cardinality(lines, _CARDINAL)
    counts = lines.agg(F.array(*[F.struct(F.lit(c).alias("column_name"), F.count_distinct(c).alias("n")) for c in _CARDINAL]).alias("r")).select(F.inline("r"))
    return out.join(counts, "column_name").select("column_name", "precision", F.when(F.col("precision") == "exact", F.col("distinct_values")).otherwise(F.lit(-1)).alias("exact_distinct"), (F.abs(F.col("distinct_values") - F.col("n")) <= F.col("n") * 4 * report.SKETCH_ERROR).alias("within_error"))


_WANTED = ("id", "meta.score", "meta.unknown")


@query(f"""WITH {_NODES}, n AS (SELECT source, count(*) AS records FROM profile_records GROUP BY source), w AS (SELECT source, records, unnest({list(_WANTED)}) AS path FROM n)
SELECT w.source, w.path, count(DISTINCT record_no) AS records_present, any_value(w.records) - count(DISTINCT record_no) AS missing FROM w LEFT JOIN nodes ON nodes.source = w.source AND nodes.path = w.path GROUP BY w.source, w.path""")
def profile_fields_filter(spark, d):
    rep = _report(spark, d)
    wanted = rep.groupBy("source").agg(F.max("records").alias("records")).select("source", "records", F.explode(F.array(*map(F.lit, _WANTED))).alias("path"))
    present = F.coalesce("records_present", F.lit(0))
    return wanted.join(rep.select("source", "path", "records_present"), ["source", "path"], "left").select("source", "path", present.alias("records_present"), (F.col("records") - present).alias("missing"))


@query("SELECT count(*) AS records, max(event_id) AS last_event FROM (SELECT event_id FROM events ORDER BY event_id LIMIT 500)")
def profile_sample_prefix(spark, d):
    rows = report.sample_prefix(table(spark, d, "events"), "event_id", "sample", 500)
    return rows.agg(F.count("*").alias("records"), F.max("event_id").alias("last_event"))


@query(f"""WITH {_NODES}, n AS (SELECT source, count(*) AS records FROM profile_records GROUP BY source),
f AS (SELECT source, path, count(DISTINCT record_no) AS present, count(*) FILTER (kind = 'null') AS nulls,
 count(*) FILTER (kind = 'string' AND ({_TEXT} = '' OR {_BLANK}) OR kind = 'array' AND json_array_length(value) = 0 OR kind = 'object' AND value::VARCHAR = '{{}}') AS empties,
 count(DISTINCT kind) FILTER (kind <> 'null') AS kinds FROM nodes GROUP BY source, path)
SELECT f.source, any_value(records) AS records_analyzed, count(*) FILTER (present < records) AS fields_with_missing, count(*) FILTER (nulls > 0) AS fields_with_nulls,
 count(*) FILTER (empties > 0) AS fields_with_empty, count(*) FILTER (kinds > 1) AS mixed_type_fields FROM f JOIN n ON n.source = f.source GROUP BY f.source""")
def quality_summary(spark, d):
    return report.quality_summary(_report(spark, d), ["source"])


@query(f"""WITH {_NODES} SELECT source, path || ' holds mixed types: ' || string_agg(DISTINCT kind, ', ' ORDER BY kind) AS warning FROM nodes WHERE kind <> 'null' GROUP BY source, path HAVING count(DISTINCT kind) > 1""")
def profile_warnings(spark, d):
    kinds = _freq(spark, d).filter("path is not null and kind not in ('record', 'null')").groupBy("source", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    return kinds.filter(F.size("kinds") > 1).select("source", F.concat("path", F.lit(" holds mixed types: "), F.array_join("kinds", ", ")).alias("warning"))


_BRONZE = {"ordinal": "integer"} | dict.fromkeys(["id", "customer_id", "updated_at", "amount", "items", "_source", "_endpoint", "_ingested_at", "_run_id", "_ingestion_key", "_window_start", "_window_end", "_raw", "_extra"], "string")
_NO_TEXT = ("ordinal", "_ingested_at", "_window_start", "_window_end")


@query(f"""SELECT path, n AS records_present, n AS occurrences, 0::BIGINT AS missing, nulls, empty_strings, blank_strings, json_type FROM (SELECT unnest({list(_BRONZE)}) AS path, count(*) AS n,
 unnest([{", ".join(f"count(*) FILTER ({c} IS NULL)" for c in _BRONZE)}]) AS nulls, unnest([{", ".join("0" if c in _NO_TEXT else f"count(*) FILTER ({c} = '')" for c in _BRONZE)}]) AS empty_strings,
 unnest([{", ".join("0" if c in _NO_TEXT else f"count(*) FILTER ({c} <> '' AND {_BLANK.replace(_TEXT, c)})" for c in _BRONZE)}]) AS blank_strings, unnest({list(_BRONZE.values())}) AS json_type FROM bronze_orders)""")
def profile_typed_columns(spark, d):
    return report.typed_profile(table(spark, d, "bronze_orders")).select("path", "records_present", "occurrences", "missing", "nulls", "empty_strings", "blank_strings", "json_type")


# ---- identity and deduplication ------------------------------------------------------------------

_DUP = """SELECT records, records - invalid - keys AS duplicate_rows, invalid AS invalid_key_rows, keys AS unique_rows, invalid = 0 AS key_complete, invalid = 0 AND records - invalid = keys AS key_unique FROM (%s)"""
_DUP_COLUMNS = ["records", "duplicate_rows", "invalid_key_rows", "unique_rows", "key_complete", "key_unique"]


@query(_DUP % "SELECT count(*) AS records, 0 AS invalid, count(DISTINCT l_orderkey) AS keys FROM lineitem")
def dup_pk_single(spark, d):
    return dedup.duplicate_profile(table(spark, d, "lineitem").select("l_orderkey"), ["l_orderkey"]).select(*_DUP_COLUMNS)


@query(_DUP % "SELECT count(*) AS records, 0 AS invalid, count(DISTINCT (l_orderkey, l_linenumber)) AS keys FROM lineitem")
def dup_pk_composite(spark, d):
    return dedup.duplicate_profile(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"]).select(*_DUP_COLUMNS)


_BLANK_ID = r"(id IS NULL OR regexp_full_match(id, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\v]*'))"


@query(_DUP % f"SELECT count(*) AS records, count(*) FILTER ({_BLANK_ID}) AS invalid, count(DISTINCT (_source, id)) FILTER (NOT {_BLANK_ID}) AS keys FROM bronze_orders")
def dup_pk_invalid(spark, d):
    return dedup.duplicate_profile(table(spark, d, "bronze_orders").select("_source", "id"), ["_source", "id"]).select(*_DUP_COLUMNS)


@query("SELECT count(*) AS records, count(*) - count(DISTINCT (text, lang, source)) AS duplicate_rows FROM documents")
def dup_complete_row(spark, d):
    return dedup.duplicate_profile(table(spark, d, "documents").select("text", "lang", "source")).select("records", "duplicate_rows")


@query("SELECT count(*) AS records, count(*) FILTER (k IS NULL) AS invalid_key_rows, count(DISTINCT k) AS unique_rows FROM (SELECT CASE WHEN json_type(raw::JSON, '$.id') IN ('UBIGINT', 'BIGINT', 'DOUBLE', 'BOOLEAN') OR json_type(raw::JSON, '$.id') = 'VARCHAR' AND trim(raw::JSON->>'$.id') <> '' THEN (raw::JSON->'$.id')::VARCHAR END AS k FROM profile_records)")
def dup_json_key(spark, d):
    return report.json_duplicates(table(spark, d, "profile_records"), "raw", "id").select("records", "invalid_key_rows", "unique_rows")


_LINE = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(_LINE)}) = 1")
def dedup_first_wins(spark, d):
    return dedup.first_wins(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"], _LINE, salts=8).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(f"SELECT _source, id, ordinal FROM bronze_orders WHERE NOT {_BLANK_ID} QUALIFY row_number() OVER (PARTITION BY _source, id ORDER BY ordinal) = 1")
def dedup_lenient(spark, d):
    rows = table(spark, d, "bronze_orders").select("_source", "id", "ordinal")
    return dedup.first_wins(rows, ["_source", "id"], ["ordinal"], strict=False, salts=8)


@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedup_after_select(spark, d):
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    return dedup.first_wins(rows, ["user_id", "event_type"], ["event_id"], salts=8)


@query("SELECT count(DISTINCT (text, lang, source)) AS distinct_rows FROM documents")
def dedup_rows(spark, d):
    return dedup.distinct_rows(table(spark, d, "documents").select("text", "lang", "source")).agg(F.count("*").alias("distinct_rows"))


@query("""SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderdate":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%g') || '","o_orderkey":' || o_orderkey || ',"o_orderpriority":' || to_json(o_orderpriority) || ',"o_orderstatus":"' || o_orderstatus || '","o_totalprice":' || o_totalprice || '}') AS fingerprint FROM orders""")
def row_fingerprint(spark, d):
    return table(spark, d, "orders").transform(lambda o: o.select("o_orderkey", dedup.row_fingerprint(o).alias("fingerprint")))


# ---- projection and shaping ----------------------------------------------------------------------


@query("SELECT record_no, raw::JSON->>'$.id' AS raw_id, raw::JSON->>'$.email' AS raw_email, raw::JSON->>'$.meta.score' AS score, raw::JSON->>'$.tags[0]' AS raw_tags_0, NULL::VARCHAR AS raw_nowhere FROM profile_records")
def select_paths(spark, d):
    """Default aliases, a given one, and a path no record has."""
    fields = resolve_select("record_no, raw.id, raw.email, raw.tags[0], raw.nowhere") + resolve_select({"raw.meta.score": "score"})
    return project(table(spark, d, "profile_records"), fields)


@query("SELECT count(*) FILTER (raw::JSON->>'$.email' IS NULL) AS email_null_or_missing, count(*) FILTER (json_exists(raw::JSON, '$.email')) AS email_present FROM profile_records")
def select_missing_null(spark, d):
    rows = table(spark, d, "profile_records")
    keys = F.json_object_keys("raw")
    return rows.agg(F.count_if(json_path(F.col("raw"), parse_path("email")).isNull()).alias("email_null_or_missing"), F.count_if(F.array_contains(keys, "email")).alias("email_present"))


@query("""SELECT ordinal, (i - 1)::BIGINT AS position, x->>'$.sku' AS sku FROM (SELECT ordinal, unnest((_raw::JSON->'$.items')::JSON[]) AS x, generate_subscripts((_raw::JSON->'$.items')::JSON[], 1) AS i FROM bronze_orders WHERE json_type(_raw::JSON, '$.items') = 'ARRAY')""")
def records_explode(spark, d):
    rows = table(spark, d, "bronze_orders").select("ordinal", F.from_json("_raw", "items array<struct<sku:string>>")["items"].alias("items"))
    return rows.select("ordinal", F.posexplode("items").alias("position", "x")).select("ordinal", F.col("position").cast("bigint").alias("position"), F.col("x.sku").alias("sku"))


@query("SELECT o_orderkey::VARCHAR AS o_orderkey, o_custkey::VARCHAR AS o_custkey, o_orderstatus, o_totalprice::VARCHAR AS o_totalprice, CASE WHEN o_totalprice > 100000 THEN 'True' ELSE 'False' END AS large FROM orders")
def stringify(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") > 100000).alias("large"))
    return bronze.stringified(rows)


@query("""SELECT event_id, props::JSON->>'$.k' AS props_k, event_type AS who_event_type, user_id AS who_user_id, '["' || event_type || '"]' AS labels FROM events""")
def flatten_columns(spark, d):
    rows = table(spark, d, "events").select("event_id", F.from_json("props", "k string").alias("props"), F.struct("event_type", "user_id").alias("who"), F.array("event_type").alias("labels"))
    return bronze.flatten(rows)


_CONTEXT = LoadContext("run-1", LoadContext.for_window("profile", date(2026, 1, 1), date(2026, 1, 31)).ingestion_key, date(2026, 1, 1), date(2026, 1, 31), datetime(2026, 2, 1, tzinfo=timezone.utc))


def _bronze(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "profile_records").filter(F.col("raw").isNotNull())
    return bronze.bronze_rows(rows, "customers", "/v1/customers", EndpointSchema.from_names(["id", "email", "name", "active"]), _CONTEXT)


_PY_ARRAY = """'[' || array_to_string(list_transform(%s::JSON[], lambda x: CASE json_type(x) WHEN 'OBJECT' THEN '{' || array_to_string(list_transform(json_keys(x), lambda k: '"' || k || '": ' || json_extract(x, '$."' || k || '"')::VARCHAR), ', ') || '}' ELSE x::VARCHAR END), ', ') || ']'"""
_PY_TEXT = f"CASE json_type(%s) WHEN 'VARCHAR' THEN %s->>'$' WHEN 'BOOLEAN' THEN CASE %s::VARCHAR WHEN 'true' THEN 'True' ELSE 'False' END WHEN 'ARRAY' THEN {_PY_ARRAY} WHEN 'NULL' THEN NULL WHEN 'OBJECT' THEN NULL ELSE %s::VARCHAR END"
_DECLARED = ["id", "email", "name", "active"]


def _declared_text(name: str) -> str:
    at = f"json_extract(raw::JSON, '$.{name}')"
    return _PY_TEXT.replace("%s", at)


@query(f"""WITH leaves AS (SELECT p.record_no, t.id, regexp_replace(replace(substr(t.fullkey, 3), '"', ''), '[^A-Za-z0-9_]', '_', 'g') AS name, t.type, t.value FROM profile_records p, json_tree(p.raw::JSON) t WHERE t.fullkey <> '$' AND t.type <> 'OBJECT' AND t.fullkey NOT LIKE '%[%'),
extra AS (SELECT record_no, '{{' || string_agg('"' || name || '": ' || CASE type WHEN 'ARRAY' THEN to_json({_PY_ARRAY.replace("%s", "value")})::VARCHAR WHEN 'NULL' THEN 'null' ELSE value::VARCHAR END, ', ' ORDER BY id) || '}}' AS _extra FROM leaves WHERE name NOT IN ('id', 'email', 'name', 'active') GROUP BY record_no)
SELECT {", ".join(f"{_declared_text(c)} AS {c}" for c in _DECLARED)}, 'customers' AS _source, '/v1/customers' AS _endpoint, TIMESTAMP '2026-02-01' AS _ingested_at, 'run-1' AS _run_id,
 substr(sha256('profile' || chr(10) || '2026-01-01' || chr(10) || '2026-01-31' || chr(10)), 1, 32) AS _ingestion_key, DATE '2026-01-01' AS _window_start, DATE '2026-01-31' AS _window_end, raw AS _raw, _extra FROM profile_records LEFT JOIN extra USING (record_no) WHERE raw IS NOT NULL""")
def bronze_rows(spark, d):
    return _bronze(spark, d)


@query("""WITH t AS (SELECT p.record_no, t.fullkey, t.type FROM profile_records p, json_tree(p.raw::JSON) t WHERE t.fullkey <> '$' AND t.type <> 'OBJECT' AND t.fullkey NOT LIKE '%[%')
SELECT regexp_replace(replace(substr(fullkey, 3), '"', ''), '[^A-Za-z0-9_]', '_', 'g') AS field_name, count(*) AS records FROM t WHERE substr(fullkey, 3) NOT IN ('id', 'email', 'name', 'active') GROUP BY 1""")
def bronze_extra_fields(spark, d):
    return bronze.extra_fields_seen(_bronze(spark, d))


@query("""WITH first AS (SELECT record_no, raw FROM profile_records ORDER BY record_no LIMIT 100), t AS (SELECT replace(replace(substr(t.fullkey, 3), '"', ''), '.', '_') AS column_name, min((record_no, t.id)) AS place FROM first, json_tree(first.raw::JSON) t WHERE t.fullkey <> '$' AND t.type <> 'OBJECT' AND t.fullkey NOT LIKE '%[%' GROUP BY 1)
SELECT row_number() OVER (ORDER BY place) - 1 AS position, column_name FROM t""")
def schema_infer_prefix(spark, d):
    names = bronze.infer_columns(table(spark, d, "profile_records"), "record_no")
    return spark.createDataFrame(list(enumerate(names)), "position long, column_name string")


_ORDER_SCHEMA = EndpointSchema([ColumnSpec("o_orderkey", "bigint"), ColumnSpec("o_custkey", "int64"), ColumnSpec("o_orderstatus", "text"), ColumnSpec("o_totalprice", "double"), ColumnSpec("o_orderdate", "timestamp")])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::DATE AS o_orderdate FROM orders")
def staging_cast(spark, d):
    rows = bronze.stringified(table(spark, d, "orders").select(*_ORDER_SCHEMA.column_names()))
    landed = rows.select("*", *bronze.metadata("orders", "/v1/orders", _CONTEXT))
    return bronze.staging(landed, _ORDER_SCHEMA).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderdate").cast("date").alias("o_orderdate"))


# ---- incremental ---------------------------------------------------------------------------------

_WINDOW = incremental.IncrementalWindow(date(2024, 1, 5), date(2024, 1, 20))


@query("SELECT event_id, ts::DATE AS day FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def incremental_filter(spark, d):
    day = F.col("ts").cast("date")
    return incremental.filter_window(table(spark, d, "events"), day, _WINDOW, strict=False).select("event_id", day.alias("day"))


_DAY = r"CASE WHEN regexp_matches(trim(updated_at), '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN try_cast(substr(trim(updated_at), 1, 10) AS DATE) END"


@query(f"SELECT _source, max({_DAY}) AS max_data_date, count(*) FILTER ({_DAY} IS NULL) AS invalid_dates FROM bronze_orders GROUP BY _source")
def incremental_invalid_dates(spark, d):
    day = values.parse_date(F.col("updated_at"))
    return table(spark, d, "bronze_orders").groupBy("_source").agg(F.max(day).alias("max_data_date"), F.count_if(day.isNull()).alias("invalid_dates"))


@query("SELECT event_type, max(ts)::DATE AS next_start FROM events GROUP BY event_type")
def watermark_next_window(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.max("ts").cast("date").alias("next_start"))


@query("SELECT connector_name, run_id, substr(sha256(concat_ws(chr(10), coalesce(connector_name, ''), coalesce(window_start::VARCHAR, ''), coalesce(window_end::VARCHAR, ''), coalesce(watermark_before, ''))), 1, 32) AS key FROM run_log")
def ingestion_key(spark, d):
    key = bronze.ingestion_key(F.col("connector_name"), F.col("window_start"), F.col("window_end"), F.col("watermark_before"))
    return table(spark, d, "run_log").select("connector_name", "run_id", key.alias("key"))


# ---- sinks ---------------------------------------------------------------------------------------


def _load(spark, d, mode: str, loads: list[tuple[str, str]]) -> DataFrame:
    sink = ParquetDestination(scratch_path(spark, f"sink-{mode}"), mode)
    rows = table(spark, d, "events").select("event_id", "event_type", "value")
    for condition, key in loads:
        sink.load(rows.filter(condition).withColumn("_ingestion_key", F.lit(key)), "lake.events", key)
    return sink.read(spark, "lake.events")


@query("SELECT CASE WHEN event_type = 'click' THEN 'a' ELSE 'b' END AS _ingestion_key, count(*) AS n, sum(event_id)::BIGINT AS total FROM events WHERE event_type = 'click' OR event_id % 3 = 0 AND event_type <> 'click' GROUP BY 1")
def append_retry_idempotent(spark, d):
    out = _load(spark, d, "append", [("event_type = 'click' and event_id % 2 = 0", "a"), ("event_id % 3 = 0 and event_type <> 'click'", "b"), ("event_type = 'click'", "a")])
    return out.groupBy("_ingestion_key").agg(F.count("*").alias("n"), F.sum("event_id").alias("total"))


@query("SELECT 'b' AS _ingestion_key, count(*) AS n FROM events WHERE event_id % 3 = 0")
def overwrite_mode(spark, d):
    return _load(spark, d, "overwrite", [("true", "a"), ("event_id % 3 = 0", "b")]).groupBy("_ingestion_key").agg(F.count("*").alias("n"))


@query("SELECT 'b' AS _ingestion_key, count(*) AS n FROM events WHERE event_id % 3 = 0")
def empty_retry(spark, d):
    return _load(spark, d, "append", [("true", "a"), ("event_id % 3 = 0", "b"), ("false", "a")]).groupBy("_ingestion_key").agg(F.count("*").alias("n"))


@query("SELECT 'b' AS _ingestion_key, count(*) AS n FROM events HAVING count(*) < 0")
def overwrite_to_empty(spark, d):
    return _load(spark, d, "overwrite", [("true", "a"), ("false", "b")]).groupBy("_ingestion_key").agg(F.count("*").alias("n"))


@query("SELECT 0::BIGINT AS n, 0::BIGINT AS total")
def last_window_empty(spark, d):
    out = _load(spark, d, "append", [("true", "a"), ("false", "a")])
    return out.agg(F.count("*").alias("n"), F.coalesce(F.sum("event_id"), F.lit(0)).alias("total"))


@query("SELECT * FROM (SELECT 0 AS position, 'bronze.clicks' AS table_name, count(*) AS n, least(count(*), 200) AS shown FROM events WHERE event_type = 'click' UNION ALL SELECT 1, 'bronze.empty', 0, 0 UNION ALL SELECT 2, 'silver.views', count(*), least(count(*), 200) FROM events WHERE event_type = 'view')")
def landed_catalogue(spark, d):
    """The tables of a destination in order, their rows, and what a preview shows."""
    sink = ParquetDestination(scratch_path(spark, "catalogue"))
    rows = table(spark, d, "events").select("event_id", "event_type")
    for name, condition in (("silver.views", "event_type = 'view'"), ("bronze.clicks", "event_type = 'click'"), ("bronze.empty", "false")):
        sink.load(rows.filter(condition), name, name)
    out = [(i, t, sink.read(spark, t).count(), sink.preview(spark, t).count()) for i, t in enumerate(sink.tables(spark))]
    return spark.createDataFrame(out, "position int, table_name string, n long, shown long")


# ---- run log, catalogue, models ------------------------------------------------------------------


@query("SELECT connector_name, run_id, rows_loaded FROM run_log QUALIFY row_number() OVER (PARTITION BY connector_name ORDER BY finished_at DESC NULLS LAST, run_id, rows_loaded) = 1")
def latest_run_per_key(spark, d):
    log = table(spark, d, "run_log").select("connector_name", "run_id", "rows_loaded", "finished_at")
    # a partial aggregate finds the newest time; only runs of that time are ranked
    newest = log.groupBy("connector_name").agg(F.max("finished_at").alias("newest"))
    tied = profile.join_nullsafe(log, newest, ["connector_name"]).filter(F.col("finished_at").eqNullSafe(F.col("newest")))
    by = Window.partitionBy("connector_name").orderBy(F.col("run_id").asc_nulls_last(), F.col("rows_loaded").asc_nulls_last())
    return tied.withColumn("r", F.row_number().over(by)).filter("r = 1").select("connector_name", "run_id", "rows_loaded")


@query("SELECT connector_name, run_id, status, rows_loaded FROM (SELECT DISTINCT connector_name, run_id, status, rows_loaded, finished_at FROM run_log) QUALIFY row_number() OVER (PARTITION BY connector_name ORDER BY finished_at DESC NULLS LAST, run_id, status, rows_loaded) <= 20")
def run_history_top20(spark, d):
    """The 20 newest runs of each connector."""
    rows = table(spark, d, "run_log").select("connector_name", "run_id", "status", "rows_loaded", "finished_at").distinct()
    order = [F.col("finished_at").desc_nulls_last(), F.col("run_id").asc_nulls_last(), F.col("status").asc_nulls_last(), F.col("rows_loaded").asc_nulls_last()]
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("connector_name").orderBy(*order)))  # Spark keeps 20 a group before the shuffle
    return ranked.filter("r <= 20").select("connector_name", "run_id", "status", "rows_loaded")


_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "bronze_orders", "run_log")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def table_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("table_name"), "n") for t in _TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT event_type, substr(ts::VARCHAR, 1, 10) AS day, count(*) AS n FROM events GROUP BY 1, 2")
def daily_summary(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.substring(F.col("ts").cast("string"), 1, 10).alias("day")).agg(F.count("*").alias("n"))


@query("SELECT lower(trim(status)) AS status, count(DISTINCT run_id) AS runs, sum(CASE WHEN r = 1 THEN rows_loaded END)::BIGINT AS rows_loaded FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY finished_at NULLS LAST, rows_loaded NULLS LAST) AS r FROM run_log) GROUP BY 1")
def run_totals(spark, d):
    by = Window.partitionBy("run_id").orderBy(F.col("finished_at").asc_nulls_last(), F.col("rows_loaded").asc_nulls_last())
    rows = table(spark, d, "run_log").withColumn("r", F.row_number().over(by))
    return rows.groupBy(F.lower(F.trim("status")).alias("status")).agg(F.count_distinct("run_id").alias("runs"), F.sum(F.when(F.col("r") == 1, F.col("rows_loaded"))).alias("rows_loaded"))


# ---- text ----------------------------------------------------------------------------------------

_URL = "'https://user' || c_custkey || '@API.example:8443/v1/' || c_mktsegment || '/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '?token=' || c_name ELSE '' END"


def _urls(spark, d) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    url = F.concat(F.lit("https://user"), key, F.lit("@API.example:8443/v1/"), F.col("c_mktsegment"), F.lit("/"), key, F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("?token="), F.col("c_name"))).otherwise(F.lit("")))
    return table(spark, d, "customer").select("c_custkey", url.alias("url"))


def _redacted(column: str) -> str:
    """SQL of ``text.redact``."""
    for pattern in text.CREDENTIAL_PATTERNS:
        column = f"regexp_replace({column}, '{pattern}', '\\1{text.REDACTED}', 'g')"
    return column



@query(f"SELECT doc_id, {_redacted('text')} AS redacted FROM documents")
def redact_documents(spark, d):
    """Every document, whole."""
    return table(spark, d, "documents").select("doc_id", text.redact(F.col("text"), limit=None).alias("redacted"))


@query(f"SELECT c_custkey, {_redacted(f'({_URL})')} AS redacted FROM customer")
def redact_urls(spark, d):
    return _urls(spark, d).select("c_custkey", text.redact(F.col("url")).alias("redacted"))


@query("SELECT c_custkey, 'https://api.example:8443/v1/' || c_mktsegment || '/' || c_custkey || CASE WHEN c_custkey % 3 = 0 THEN '?<redacted>' ELSE '' END AS target FROM customer")
def request_target(spark, d):
    return _urls(spark, d).select("c_custkey", text.request_target(F.col("url")).alias("target"))


@query("SELECT c_custkey, 'https' AS scheme, 'api.example' AS host, 8443 AS port FROM customer")
def url_origin(spark, d):
    return _urls(spark, d).select("c_custkey", text.origin(F.col("url")).alias("o")).select("c_custkey", "o.scheme", "o.host", "o.port")


@query("SELECT c_custkey, 'api_' || c_custkey AS name FROM customer")
def infer_name(spark, d):
    return _urls(spark, d).select("c_custkey", text.infer_name(F.col("url")).alias("name"))


@query("SELECT p_partkey, regexp_full_match(p_name, '[A-Za-z_][A-Za-z0-9_]*') AS valid, regexp_replace(p_name, '[^A-Za-z0-9_]', '_', 'g') AS safe FROM part")
def valid_identifiers(spark, d):
    safe = F.regexp_replace("p_name", "[^A-Za-z0-9_]", "_")
    return table(spark, d, "part").select("p_partkey", F.col("p_name").rlike("^[A-Za-z_][A-Za-z0-9_]*$").alias("valid"), safe.alias("safe"))


@query(f"SELECT arrival_no, {_BLANK_ID.replace('id IS NULL OR ', '')} AS blank FROM incoming_orders WHERE id IS NOT NULL")
def blank_strings(spark, d):
    return table(spark, d, "incoming_orders").filter("id is not null").select("arrival_no", values.is_blank(F.col("id")).alias("blank"))


def _json_text(column: str) -> str:
    """SQL of ``values.json_string``."""
    out = f"""replace(replace({column}, '\\', '\\\\'), '"', '\\"')"""
    for code in range(1, 0x20):
        out = f"replace({out}, chr({code}), '{json.dumps(chr(code))[1:-1]}')"
    return f"""'"' || {out} || '"'"""


@query(f"SELECT arrival_no, sha256('[' || {_json_text('source')} || ',' || {_json_text('id')} || ']') AS fingerprint FROM incoming_orders")
def key_fingerprint(spark, d):
    """Of every arrival; null without a source or id."""
    rows = table(spark, d, "incoming_orders")
    return rows.select("arrival_no", F.lower(F.hex(values.key_fingerprint(F.col("source"), F.col("id")))).alias("fingerprint"))
