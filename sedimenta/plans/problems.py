"""The queries of problems 1 and 3 to 5, with production parameters, over their whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.operators import drift, profile, shred, upsert
from sedimenta.session import spread, staged, table

DECLARED = {"id": "string", "customer_id": "bigint", "updated_at": "timestamp", "amount": "decimal(18,2)", "items": "string"}
APPROVED = {"status": "string", "locale": "string", "loyalty_points": "bigint", "is_gift": "boolean"}


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.file_changes(table(spark, d, "bronze_orders"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    rows = drift.rescue_ingest(table(spark, d, "bronze_orders"), DECLARED, promote=APPROVED)
    rows = drift.replay_rescued(rows, "freight_cost", "double")
    return rows.select("ordinal", "_source", "_run_id", *DECLARED, *APPROVED, "freight_cost", "_rescued")


def p1_undocumented(spark: SparkSession, d: str) -> DataFrame:
    return drift.undocumented_fields(table(spark, d, "bronze_orders"), table(spark, d, "run_log"), list(DECLARED))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = shred.page_nodes(table(spark, d, "parsed_pages"), table(spark, d, "probe_results"), scalars=False)
    return shred.listed(nodes).select("page_id", "record_no", "node_path", "parent_path")


_LINES = ("$.lineItems[]", '$["line-items"][]', "$.items[]")
#: The entities of the pages: table -> entities (one thing under several spellings is one table) and the fields it always has.
PAGE_ENTITIES: dict[str, tuple[list[str], dict[str, str]]] = {
    "p3_records": (["$"], {"id": "bigint", "customer.id": "bigint", "note": "string"}),
    "p3_line_items": ([*_LINES], {"sku": "string", "qty": "string", "product.name": "string"}),
    "p3_discounts": ([f"{e}.discounts[]" for e in _LINES], {"code": "string", "amount": "double"}),
    "p3_rules": ([f"{e}.discounts[].rules[]" for e in _LINES], {"kind": "string", "value": "bigint"}),
    "p3_attrs": ([f"{e}.product.attrs[]" for e in _LINES], {"k": "string", "v": "bigint"}),
    "p3_shipments": (["$.shipments[]"], {"carrier": "string", "address.city": "string", "address.geo.zone": "bigint"}),
    "p3_events": (["$.shipments[].events[]"], {"status": "string", "at": "string"}),
    "p3_contacts": (["$.customer.contacts[]"], {"kind": "string", "rank": "bigint"}),
    "p3_audit_trail": (['$.meta["audit.trail"][]'], {"by": "string", "step": "bigint"}),
    "p3_bundles": (["$.bundles[][]"], {"sku": "string"}),
    "p3_bundle_parts": (["$.bundles[][].parts[]"], {"no": "bigint"}),
}


def _page_nodes(spark: SparkSession, d: str) -> DataFrame:
    return shred.page_nodes(table(spark, d, "parsed_pages"), table(spark, d, "probe_results"))


def _page_entity(name: str):
    entities, fields = PAGE_ENTITIES[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        wanted = F.col("entity").isin(entities) | F.col("parent_entity").isin(entities)
        return shred.whole_entity(staged(_page_nodes(spark, d).filter(wanted), "page-nodes"), "page_id", entities, fields)

    run.__name__ = name
    return run


def p3_other_objects(spark: SparkSession, d: str) -> DataFrame:
    return shred.other_entities(_page_nodes(spark, d), "page_id", [e for entities, _ in PAGE_ENTITIES.values() for e in entities])


def p3_values(spark: SparkSession, d: str) -> DataFrame:
    return shred.element_values(_page_nodes(spark, d), "page_id")


def p3_order_items(spark: SparkSession, d: str) -> DataFrame:
    fields = {"sku": "string", "qty": "bigint"}
    orders = spread(table(spark, d, "bronze_orders").select(F.col("ordinal").alias("order_no"), "_raw"))
    nodes = staged(shred.shred(orders, "order_no", "_raw", scalars=frozenset(fields)), "order-nodes")
    return shred.entity_table(nodes, "order_no", "$.items[]", fields)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return upsert.redelivered(table(spark, d, "bronze_orders"))


def p4_orders(spark: SparkSession, d: str) -> DataFrame:
    return upsert.exactly_once(table(spark, d, "bronze_orders"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.load_findings(table(spark, d, "profile_records"), table(spark, d, "field_profiles"), table(spark, d, "quality_summaries"))


def p5_profile(spark: SparkSession, d: str) -> DataFrame:
    freq = profile.path_value_counts(table(spark, d, "profile_records"), ["source", "load_no"], "raw", checks=profile.CHECKS)
    return profile.field_report(staged(freq, "profile-counts"), ["source", "load_no"])


def p5_drift(spark: SparkSession, d: str) -> DataFrame:
    freq = profile.path_value_counts(table(spark, d, "profile_records"), ["source", "load_no"], "raw")
    return profile.load_drift(staged(freq, "profile-counts"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_table, p1_undocumented, p3_found, *map(_page_entity, PAGE_ENTITIES), p3_other_objects, p3_values, p3_order_items, p4_found, p4_orders, p5_found, p5_profile, p5_drift)}


_BLANK = r"regexp_full_match(id, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\v]*')"


def oracle_sql() -> dict[str, str]:
    """SQL of the problems that have it; the others are held against brute force in the tests."""
    numbered = f"row_number() OVER (PARTITION BY _source, id ORDER BY ordinal) AS n FROM bronze_orders WHERE id IS NOT NULL AND NOT {_BLANK} AND coalesce(json_type(_raw::JSON, '$.id'), '') <> 'ARRAY'"
    # one row a record and field with a value; of two paths with one name the first counts
    leaves = """leaves AS (SELECT o._source AS source, o._run_id AS file, o.ordinal, regexp_replace(regexp_replace(replace(substr(t.fullkey, 3), '"', ''), '[^A-Za-z0-9_]', '_', 'g'), '^([0-9])', '_\\1') AS field, min(t.id) AS first, arg_min(t.type, t.id) AS type, arg_min(t.value::VARCHAR, t.id) AS value
  FROM bronze_orders o, json_tree(CASE WHEN json_valid(o._raw) THEN o._raw::JSON END) t WHERE t.type NOT IN ('OBJECT', 'NULL') AND t.fullkey <> '$' AND NOT regexp_matches(regexp_replace(t.fullkey, '"[^"]*"', '', 'g'), '\\[') GROUP BY ALL)"""
    p1 = f"""WITH {leaves},
files AS (SELECT _source AS source, _run_id AS file, row_number() OVER (PARTITION BY _source ORDER BY min(ordinal), _run_id) AS no FROM bronze_orders GROUP BY 1, 2),
kinds AS (SELECT source, file, field, CASE WHEN type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN type = 'DOUBLE' THEN 'number' WHEN type = 'BOOLEAN' THEN 'boolean' WHEN type = 'ARRAY' THEN 'array' ELSE 'string' END AS kind, count(*) AS n FROM leaves GROUP BY ALL),
typed AS (SELECT source, no, field, kind FROM kinds JOIN files USING (source, file) QUALIFY row_number() OVER (PARTITION BY source, no, field ORDER BY n DESC, list_position(['string', 'integer', 'number', 'boolean', 'array'], kind)) = 1),
pairs AS (SELECT f.source, f.no, f.file, t.field, t.kind AS now, NULL AS before FROM typed t JOIN files f ON f.source = t.source AND f.no = t.no UNION ALL SELECT f.source, f.no, f.file, t.field, NULL, t.kind FROM typed t JOIN files f ON f.source = t.source AND f.no = t.no + 1),
change AS (SELECT source, no, file, field, max(now) AS now, max(before) AS before FROM pairs WHERE no > 1 GROUP BY ALL HAVING max(now) IS DISTINCT FROM max(before)),
vals AS (SELECT DISTINCT source, no, field, type, value FROM leaves JOIN files USING (source, file)),
sizes AS (SELECT source, no, field, count(*) AS size FROM vals GROUP BY ALL),
pair AS (SELECT a.source, a.no, a.field AS came, r.field AS went, lower(regexp_replace(a.field, '[^A-Za-z0-9]', '', 'g')) = lower(regexp_replace(r.field, '[^A-Za-z0-9]', '', 'g')) AS named,
  (SELECT count(*) FROM vals x JOIN vals y ON x.type = y.type AND x.value = y.value WHERE x.source = a.source AND x.no = a.no AND x.field = a.field AND y.source = a.source AND y.no = a.no - 1 AND y.field = r.field) AS common, s.size
  FROM change a JOIN change r ON r.source = a.source AND r.no = a.no AND a.before IS NULL AND r.now IS NULL AND a.now = r.before JOIN sizes s ON s.source = a.source AND s.no = a.no AND s.field = a.field),
fit AS (SELECT *, row_number() OVER (PARTITION BY source, no, came ORDER BY named DESC, common / size DESC, went) AS i, row_number() OVER (PARTITION BY source, no, went ORDER BY named DESC, common / size DESC, came) AS j FROM pair WHERE named OR common * 2 >= size),
ren AS (SELECT source, no, came, went FROM fit WHERE i = 1 AND j = 1)
SELECT c.source, c.file AS run_id, CASE WHEN now IS NOT NULL AND before IS NOT NULL THEN 'retyped' WHEN r.came IS NOT NULL THEN 'renamed' WHEN now IS NOT NULL THEN 'added' ELSE 'removed' END AS change_kind, c.field AS field_name, coalesce(r.went, '') AS old_name
FROM change c LEFT JOIN ren r ON r.source = c.source AND r.no = c.no AND r.came = c.field AND c.before IS NULL WHERE NOT EXISTS (SELECT 1 FROM ren g WHERE g.source = c.source AND g.no = c.no AND g.went = c.field AND c.now IS NULL)"""
    undocumented = f"""WITH {leaves}, held AS (SELECT DISTINCT source, file, field, 1 AS f, 0 AS l FROM leaves WHERE field NOT IN ('id', 'customer_id', 'updated_at', 'amount', 'items')
  UNION ALL SELECT DISTINCT connector_name, run_id, x, 0, 1 FROM (SELECT connector_name, run_id, unnest(CASE WHEN json_valid(extra_fields_seen) THEN from_json(extra_fields_seen, '["VARCHAR"]') END) AS x FROM run_log) WHERE x IS NOT NULL)
SELECT source, file AS run_id, field AS field_name, max(f) = 1 AS in_file, max(l) = 1 AS in_log FROM held GROUP BY ALL"""
    nodes = r"""nodes AS (SELECT p.source, p.load_no, p.record_no, regexp_replace(replace(substr(t.fullkey, 3), '"', ''), '\[[0-9]+\]', '[]', 'g') AS path,
  CASE t.type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'UBIGINT' THEN 'integer' WHEN 'BIGINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'object' END AS kind,
  t.value AS value, json_extract_string(t.value, '$') AS text FROM profile_records p, json_tree(p.raw::JSON) t WHERE t.fullkey <> '$')"""
    blank = r"regexp_full_match(text, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\v]*')"
    email = r"regexp_full_match(text, '[^@\s\p{Z}]+@[^@\s.\p{Z}]+(\.[^@\s.\p{Z}]+)+')"
    stamp = r"(regexp_full_match(text, '[0-9]{4}-[0-9]{2}-[0-9]{2}([T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])?)?') AND try_cast(substr(text, 1, 10) AS DATE) IS NOT NULL)"
    bad = f"kind = 'string' AND NOT {blank} AND (path = 'email' AND NOT {email} OR path = 'updated_at' AND NOT {stamp})"
    fields = "['email', 'name', 'active', 'tags', 'meta.score', 'updated_at']"
    p5 = f"""WITH {nodes}, loads AS (SELECT source, load_no, count(*) AS records FROM profile_records GROUP BY ALL),
facts AS (SELECT source, load_no, path, count(DISTINCT record_no) AS present, count(*) FILTER (kind = 'null') AS nulls, count(DISTINCT kind) FILTER (kind <> 'null') AS kinds, count(*) FILTER ({bad}) AS bad,
  median(try_cast(text AS DOUBLE)) FILTER (kind IN ('integer', 'number')) AS median, count(*) FILTER (kind = 'boolean' AND text = 'true') AS yes, count(*) FILTER (kind = 'boolean') AS flags FROM nodes GROUP BY ALL),
types AS (SELECT source, load_no, path, string_agg(kind || '=' || n, ',' ORDER BY kind) AS types FROM (SELECT source, load_no, path, kind, count(*) AS n FROM nodes GROUP BY ALL) GROUP BY ALL),
grid AS (SELECT source, load_no, records, unnest({fields}) AS path FROM loads),
now AS (SELECT g.*, records - coalesce(present, 0) + coalesce(nulls, 0) AS lack, median, yes, flags FROM grid g LEFT JOIN facts USING (source, load_no, path)),
pairs AS (SELECT n.source, n.load_no, n.path, n.lack / n.records AS a, o.lack / o.records AS b, n.median AS m, o.median AS k, n.yes / nullif(n.flags, 0) AS y, o.yes / nullif(o.flags, 0) AS z FROM now n JOIN now o ON o.source = n.source AND o.path = n.path AND o.load_no = n.load_no - 1),
claims AS (SELECT p.source, p.load_no, p.path, p.records_present, p.nulls, p.missing, (SELECT string_agg(e.key || '=' || e.value, ',' ORDER BY e.key) FROM unnest(map_entries(p.types)) AS u(e)) AS types, p.types IS NOT NULL AS typed FROM field_profiles p)
SELECT source, load_no, path AS field_path, 'mixed_types' AS finding FROM facts WHERE kinds > 1
UNION ALL SELECT source, load_no, path, 'bad_pattern' FROM facts WHERE bad > 0
UNION ALL SELECT source, load_no, path, 'null_shift' FROM pairs WHERE abs(a - b) > 0.25
UNION ALL SELECT source, load_no, path, 'value_shift' FROM pairs WHERE path = 'meta.score' AND m <> k AND (m >= 0 AND k >= 0 AND (m >= 2 * k OR 2 * m <= k) OR m <= 0 AND k <= 0 AND (m <= 2 * k OR 2 * m >= k) OR m * k < 0)
UNION ALL SELECT source, load_no, path, 'value_shift' FROM pairs WHERE path = 'active' AND abs(y - z) > 0.25
UNION SELECT c.source, c.load_no, c.path, 'wrong_profile' FROM claims c LEFT JOIN loads l USING (source, load_no) LEFT JOIN facts f USING (source, load_no, path) LEFT JOIN types t USING (source, load_no, path)
  WHERE c.records_present <> coalesce(f.present, 0) OR c.nulls <> coalesce(f.nulls, 0) OR c.missing <> coalesce(l.records, 0) - coalesce(f.present, 0) OR c.typed AND coalesce(c.types, '') <> coalesce(t.types, '')
UNION ALL SELECT s.source, s.load_no, '', 'wrong_summary' FROM quality_summaries s LEFT JOIN (SELECT source, load_no, count(*) AS mixed FROM facts WHERE kinds > 1 GROUP BY ALL) m USING (source, load_no) WHERE s.mixed_type_fields <> coalesce(m.mixed, 0)"""
    moment = f"CASE WHEN kind = 'string' AND {stamp} THEN CASE WHEN regexp_matches(text, '[+-][0-9]{{2}}:[0-9]{{2}}$') AND length(text) > 10 OR text LIKE '%Z' THEN (try_cast(text AS TIMESTAMPTZ) AT TIME ZONE 'UTC') ELSE try_cast(text AS TIMESTAMP) END END"
    count = lambda kind: f"count(*) FILTER (kind = '{kind}') AS n_{kind}"
    profile_sql = f"""WITH {nodes}, loads AS (SELECT source, load_no, count(*) AS records FROM profile_records GROUP BY ALL)
SELECT n.source, n.load_no, path, any_value(l.records) AS records, count(DISTINCT record_no) AS records_present, count(*) AS occurrences, {", ".join(map(count, profile.TYPES))},
 count(*) FILTER (kind = 'string' AND text = '') AS empty_strings, count(*) FILTER (kind = 'string' AND text <> '' AND {blank}) AS blank_strings, count(*) FILTER (kind = 'array' AND json_array_length(value) = 0) AS empty_arrays, count(*) FILTER (kind = 'object' AND value::VARCHAR = '{{}}') AS empty_objects,
 count(*) FILTER ({bad}) AS bad_values, count(DISTINCT kind || value::VARCHAR) AS distinct_values, min(try_cast(text AS DOUBLE)) FILTER (kind IN ('integer', 'number')) AS min_number, max(try_cast(text AS DOUBLE)) FILTER (kind IN ('integer', 'number')) AS max_number,
 min(length(text)) FILTER (kind = 'string')::INTEGER AS min_length, max(length(text)) FILTER (kind = 'string')::INTEGER AS max_length, min({moment}) AS min_time, max({moment}) AS max_time,
 count(*) FILTER (kind = 'boolean' AND text = 'true') AS n_true, count(*) FILTER (kind = 'boolean') AS n_flag, any_value(l.records) - count(DISTINCT record_no) AS missing, count(*) FILTER (kind = 'null') AS nulls, (count(DISTINCT kind) FILTER (kind <> 'null'))::INTEGER AS mixed_types
FROM nodes n JOIN loads l USING (source, load_no) GROUP BY ALL"""
    # every node of every record with its nearest listed object; paths as the task spells them
    spelt = r"""regexp_replace(regexp_replace(%s, '\."([^"]*)"', '["\1"]', 'g'), '\["([A-Za-z_][A-Za-z0-9_]*)"\]', '.\1', 'g')"""
    pages = r"""WITH probe AS (SELECT source, records_path AS path FROM probe_results WHERE status_code = 200 QUALIFY row_number() OVER (PARTITION BY source ORDER BY probed_at DESC, records_path DESC NULLS LAST) = 1),
bodies AS (SELECT g.page_id, p.path, CASE WHEN json_valid(g.raw) THEN g.raw::JSON END AS body FROM parsed_pages g JOIN probe p ON p.source = g.source),
found AS (SELECT page_id, CASE WHEN path IS NULL THEN CASE json_type(body) WHEN 'ARRAY' THEN body WHEN 'OBJECT' THEN json_array(body) END ELSE json_extract(body, '$.' || regexp_replace(path, '\["([^"]*)"\]', '."\1"', 'g')) END AS list FROM bodies),
records AS (SELECT page_id, unnest(list::JSON[]) AS rec, (generate_subscripts(list::JSON[], 1) - 1)::INTEGER AS record_no FROM found WHERE json_type(list) = 'ARRAY'),
nodes AS (SELECT page_id, record_no, '$' AS node, coalesce(json_type(rec), 'NULL') AS type, rec AS value FROM records UNION ALL SELECT r.page_id, r.record_no, t.fullkey, t.type, t.value FROM records r, json_tree(r.rec) t WHERE t.type <> 'ARRAY' AND t.fullkey LIKE '%]'),
up AS (SELECT a.page_id, a.record_no, a.node, a.type, any_value(a.value) AS value, coalesce(arg_max(b.node, length(b.node)), '') AS above FROM nodes a LEFT JOIN (SELECT * FROM nodes WHERE node = '$' OR type = 'OBJECT') b
  ON b.page_id = a.page_id AND b.record_no = a.record_no AND length(b.node) < length(a.node) AND (starts_with(a.node, b.node || '.') OR starts_with(a.node, b.node || '[')) GROUP BY ALL),
""" + f"""named AS (SELECT page_id, record_no, type, value, {spelt % "node"} AS node_path, {spelt % "above"} AS parent_path, try_cast(nullif(regexp_extract(node, '\\[([0-9]+)\\]$', 1), '') AS INTEGER) AS ordinal FROM up),
placed AS (SELECT *, regexp_replace(node_path, '\\[[0-9]+\\]', '[]', 'g') AS entity FROM named)"""
    p3 = f"{pages} SELECT page_id, record_no, node_path, parent_path FROM placed WHERE node_path = '$' OR type = 'OBJECT'"
    scalar = "CASE json_type(%s) WHEN 'VARCHAR' THEN %s->>'$' WHEN 'NULL' THEN NULL WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL ELSE %s::VARCHAR END"
    entity_sql = {}
    for name, (entities, fields) in PAGE_ENTITIES.items():
        columns = [f"try_cast({scalar.replace('%s', f'json_extract(value, {chr(39)}$.{f}{chr(39)})')} AS {t.upper().replace('STRING', 'VARCHAR')}) AS {f.replace('.', '_')}" for f, t in fields.items()]
        listed = ", ".join("'" + e.replace("'", "''") + "'" for e in entities)
        entity_sql[name] = f"{pages} SELECT entity, page_id, record_no, node_path, parent_path, ordinal, {', '.join(columns)} FROM placed WHERE (node_path = '$' OR type = 'OBJECT') AND entity IN ({listed})"
    entity_sql["p3_values"] = f"""{pages} SELECT page_id, record_no, node_path, parent_path, entity, CASE WHEN node_path <> '$' THEN ltrim(regexp_replace(substr(node_path, length(parent_path) + 1), '\\[[0-9]+\\]', '[]', 'g'), '.') END AS label, ordinal,
 CASE type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'DOUBLE' THEN 'number' WHEN 'VARCHAR' THEN 'string' WHEN 'ARRAY' THEN 'array' ELSE 'integer' END AS kind, {scalar.replace("%s", "value")} AS value FROM placed WHERE type <> 'OBJECT'"""
    lifted = [*APPROVED, "freight_cost"]
    texts = ", ".join(f"json_type(x, '$.{n}') AS {n}_type, CASE json_type(x, '$.{n}') WHEN 'VARCHAR' THEN x->>'$.{n}' WHEN 'NULL' THEN NULL ELSE json_extract(x, '$.{n}')::VARCHAR END AS {n}_text" for n in lifted)
    number = r"regexp_full_match(%s, '\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*')"
    left = lambda n: f"CASE WHEN {n} IS NULL AND {n}_text IS NOT NULL THEN '\"{n}\":' || CASE WHEN {n}_type = 'VARCHAR' THEN to_json({n}_text)::VARCHAR ELSE {n}_text END END"
    failed = lambda n: f"CASE WHEN {n} IS NULL AND {n}_raw IS NOT NULL THEN '\"{n}\":' || to_json({n}_raw)::VARCHAR END"
    p1_table = f"""WITH bags AS (SELECT *, CASE WHEN json_valid(_extra) AND json_type(_extra::JSON) = 'OBJECT' THEN _extra::JSON END AS x FROM bronze_orders),
lifted AS (SELECT ordinal, _source, _run_id, id, customer_id AS customer_id_raw, updated_at AS updated_at_raw, amount AS amount_raw, items, {texts}, CASE WHEN x IS NULL AND trim(coalesce(_extra, '')) <> '' THEN '"_broken":' || to_json(_extra)::VARCHAR END AS broken,
  (SELECT string_agg('"' || e.key || '":' || e.value::VARCHAR, ',' ORDER BY e.id) FROM json_each(x) e WHERE e.key NOT IN ({", ".join(f"'{n}'" for n in lifted)})) AS rest FROM bags),
typed AS (SELECT *, CASE WHEN regexp_full_match(customer_id_raw, '\\s*[+-]?[0-9]+\\s*') THEN try_cast(customer_id_raw AS BIGINT) END AS customer_id,
  CASE WHEN updated_at_raw LIKE '____-%' THEN try_cast(updated_at_raw AS TIMESTAMPTZ) AT TIME ZONE 'UTC' END AS updated_at,
  CASE WHEN {number % "amount_raw"} AND try_cast(amount_raw AS DECIMAL(38,18)) = try_cast(amount_raw AS DECIMAL(18,2)) THEN try_cast(amount_raw AS DECIMAL(18,2)) END AS amount,
  status_text AS status, locale_text AS locale, CASE WHEN regexp_full_match(loyalty_points_text, '\\s*[+-]?[0-9]+\\s*') THEN try_cast(loyalty_points_text AS BIGINT) END AS loyalty_points,
  CASE WHEN is_gift_type = 'BOOLEAN' THEN is_gift_text = 'true' END AS is_gift, CASE WHEN {number % "freight_cost_text"} THEN try_cast(freight_cost_text AS DOUBLE) END AS freight_cost FROM lifted)
SELECT ordinal, _source, _run_id, id, customer_id, updated_at, amount, items, status, locale, loyalty_points, is_gift, freight_cost,
  '{{' || nullif(concat_ws(',', broken, rest, {left("freight_cost")}, {", ".join(map(failed, ("customer_id", "updated_at", "amount")))}, {", ".join(map(left, ("loyalty_points", "is_gift")))}), '') || '}}' AS _rescued FROM typed"""
    return {
        "p1_table": p1_table,
        "p3_found": p3,
        **entity_sql,
        "p5_found": p5,
        "p5_profile": profile_sql,
        "p1_found": p1,
        "p1_undocumented": undocumented,
        "p3_order_items": """SELECT ordinal AS order_no, 0 AS record_no, '$.items[' || (i - 1) || ']' AS node_path, '$' AS parent_path, (i - 1)::INTEGER AS ordinal, x->>'$.sku' AS sku, try_cast(x->>'$.qty' AS BIGINT) AS qty
FROM (SELECT ordinal, unnest((_raw::JSON->'$.items')::JSON[]) AS x, generate_subscripts((_raw::JSON->'$.items')::JSON[], 1) AS i FROM bronze_orders WHERE json_type(_raw::JSON, '$.items') = 'ARRAY') WHERE json_type(x) = 'OBJECT'""",
        "p4_found": f"SELECT ordinal FROM (SELECT ordinal, {numbered}) WHERE n > 1",
        "p4_orders": f"SELECT * REPLACE (_ingested_at AT TIME ZONE 'UTC' AS _ingested_at) FROM bronze_orders WHERE ordinal NOT IN (SELECT ordinal FROM (SELECT ordinal, {numbered}) WHERE n > 1)",
    }


__all__ = ["queries"]
