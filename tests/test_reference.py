"""The landing library: paths, values, flattening, deduplication, windows, sinks, sources, pipelines."""

import json
import multiprocessing
import sys
from datetime import date, datetime, timezone

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import cloudpickle
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from sedimenta import errors
from sedimenta import session as session_module
from sedimenta.functions import paths, text, types, values
from sedimenta.operators import bronze, dedup, incremental, profile, report
from sedimenta.operators.incremental import IncrementalStrategy, IncrementalWindow, Watermark
from sedimenta.plans import config, pipeline, reference, schedule
from sedimenta.plans import landing as sites
from sedimenta.plans.pipeline import Pipeline
from sedimenta.sinks.parquet import ParquetDestination, batch_size, write_mode
from sedimenta.sinks.state import InspectionStateStore, JsonlRunLog, JsonStateStore, MemoryStateStore
from sedimenta.sources import http, pagination, rest
from sedimenta.sources.http import HttpClient, Response
from sedimenta.sources.rest import Endpoint, RestConnector, find_records_path
from sedimenta.sources.secrets import FileSecrets, SecretError, StaticSecrets
from sedimenta.streaming import landing

# the canned sites of this module travel to the reading task by value
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# ---- paths and values ----------------------------------------------------------------------------


def test_paths():
    assert paths.parse_path('data.items[0]["odd.key"].x') == ("data", "items", 0, "odd.key", "x")
    assert paths.parse_path("payload['k-y']") == ("payload", "k-y")
    for bad in ("", " ", ".a", "a..b", "a.", "a[", "a[]", "a[-1]", "a[x]", 'a[""]'):
        with pytest.raises(ValueError):
            paths.parse_path(bad)
    value = {"a": [{"b": 1}], "n": None}
    assert paths.read_path(value, ("a", 0, "b")) == 1
    assert [paths.read_path(value, p) for p in (("a", 1), ("a", "b"), ("n", "x"), ("z",))] == [None] * 4


def test_select():
    assert paths.resolve_select("a.b, c[0]") == [(("a", "b"), "a_b"), (("c", 0), "c_0")]
    assert paths.resolve_select({"a.b": "x"}) == [(("a", "b"), "x")]
    assert len(paths.resolve_select(["a", "a"])) == 1
    for bad in (["a.b", "a_b"], {"a": "no no"}, [], [""]):
        with pytest.raises(ValueError):
            paths.resolve_select(bad)
    assert paths.default_alias(("0a-b", "c")) == "_0a_b_c"


def test_projection_over_types(spark):
    df = spark.sql("select named_struct('x', array(1, 2)) as s, map('k', 'v') as m, '{\"a\": {\"b\": [7]}}' as j, 1 as extra")
    out = paths.project(df, paths.resolve_select({"s.x[1]": "a", "s.x[9]": "b", "m.k": "c", "m.z": "d", "j.a.b[0]": "e", "q.r": "f", "s.nope": "g"}))
    assert [str(x) for x in out.first()] == ["2", "None", "v", "None", "7", "None", "None"]


def test_double_text(spark):
    xs = [0.0, -0.0, 1.0, -1.5, 1e-3, 123456.789, 1e7, 12345678.9, 1e15, 9999999999999998.0, 1e16, 1.5e300, 1e-5, 1.25e-7, float("nan"), float("inf"), float("-inf"), None, 0.0001, -0.00025, 1e100]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double")
    got = {r["i"]: r["t"] for r in df.select("i", values.double_text("x").alias("t")).collect()}
    assert [got[i] for i in range(len(xs))] == [None if x is None else str(x) for x in xs]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=8), min_size=1, max_size=40))
def test_blank_and_json_text(texts):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", values.is_blank(F.col("t")).alias("b"), values.json_string(F.col("t")).alias("j"), values.strip_text(F.col("t")).alias("s")).collect():
        t = texts[r["i"]]
        assert r["b"] == (t.strip() == "") and r["j"] == json.dumps(t, ensure_ascii=False) and r["s"] == t.strip()


test_blank_and_json_text = pytest.mark.usefixtures("spark")(test_blank_and_json_text)


def test_dates(spark):
    cases = {"2024-01-15T23:30:00-05:00": date(2024, 1, 15), "2024-01-15garbage": date(2024, 1, 15), " 2024-01-15 ": date(2024, 1, 15), "2024-1-5": None, "2024": None, "": None, "2024-02-30": None, "x": None}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "d string")
    assert {r["d"]: r["x"] for r in df.select("d", values.parse_date(F.col("d")).alias("x")).collect()} == {**cases, None: None}


def test_strict_json():
    for bad in ("NaN", "[Infinity]", "{", "", "[" * 200_000):
        with pytest.raises(ValueError):
            values.loads_strict(bad)


def test_redaction(spark):
    cases = {
        "Authorization: Bearer abc.def": "Authorization: Bearer <redacted>", "password=hunter2, x": "password=<redacted>, x", "see https://h/p?q=1#f": "see https://h/p?<redacted>#f", "plain": "plain",
        "sent bearer abcdefgh12": "sent bearer <redacted>", "my S3CRET here": "my <redacted> here",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["x"] for r in df.select("t", text.redact(F.col("t"), ("S3CRET",)).alias("x")).collect()} == cases
    assert {k: text.redact_text(k, ("S3CRET",)) for k in cases} == cases
    assert text.redact_text("a" * 300_000).endswith("<output truncated>")
    shown = spark.range(1).select(text.percentage(F.lit(1), F.lit(8)), text.percentage(F.lit(1), F.lit(0)), text.thousands(F.lit(1234567))).first()
    assert list(shown) == ["12.5%", "0.0%", "1,234,567"]


def test_types():
    assert [types.spark_type(t) for t in ("INT64", "Double  Precision", "decimal", "DECIMAL(18, 2)", "json", "geometry")] == ["BIGINT", "DOUBLE", "DECIMAL(18,3)", "DECIMAL(18, 2)", "STRING", "geometry"]
    for bad in ("", "a; drop", "int)", None):
        with pytest.raises(errors.InvalidIdentifierError):
            types.spark_type(bad)
    for bad in ([types.ColumnSpec("a"), types.ColumnSpec("A")],):
        with pytest.raises(ValueError):
            types.EndpointSchema(bad)
    with pytest.raises(errors.InvalidIdentifierError):
        types.ColumnSpec("_raw")
    assert types.EndpointSchema([types.ColumnSpec("a", "int"), types.ColumnSpec("b", "datetime")]).struct().simpleString() == "struct<a:int,b:timestamp>"


# ---- landing -------------------------------------------------------------------------------------


def test_flattening(spark):
    assert bronze.flat_record({"a": {"b": 1, "e": {}}, "user-agent": {"raw value": "x"}, "l": [{"z": 1}], "n": None, "1x": 2}) == {"a_b": 1, "user_agent_raw_value": "x", "l": '[{"z": 1}]', "n": None, "_1x": 2}
    with pytest.raises(errors.FlattenCollisionError):
        bronze.flat_record({"a": {"b": 1}, "a_b": 2})
    with pytest.raises(errors.FlattenCollisionError):
        bronze.flatten(spark.sql("select named_struct('b', 1) as a, 2 as a_b"))
    assert bronze.flatten(spark.sql("select named_struct('b', named_struct('c', 1)) as a, array(1) as l")).first().asDict() == {"a_b_c": 1, "l": "[1]"}


def test_bronze_rows(spark, records):
    df = records([{"id": 1, "ok": True, "x": {"y": 1.5}}, {"id": "é", "ok": None}, 7]).withColumn("_source", F.lit("clash"))
    context = bronze.LoadContext("r", "k", date(2026, 1, 1), None, datetime(2026, 1, 2, tzinfo=timezone.utc))
    out = bronze.bronze_rows(df, "src", "/e", types.EndpointSchema.from_names(["id", "ok", "gone"]), context)
    assert out.columns == ["id", "ok", "gone", *types.RESERVED]
    got = sorted((r["id"] or "", r["ok"], r["gone"], r["_source"], r["_raw"], r["_extra"]) for r in out.collect())
    assert got == [("", None, None, "src", '{"value": 7}', '{"value": 7}'), ("1", "True", None, "src", '{"id": 1, "ok": true, "x": {"y": 1.5}}', '{"x_y": 1.5}'), ("é", None, None, "src", '{"id": "é", "ok": null}', None)]
    assert rows(bronze.extra_fields_seen(out)) == [("value", 1), ("x_y", 1)]
    assert bronze.infer_columns(df, "ordinal") == ["id", "ok", "x_y", "value"]
    assert bronze.bronze_rows(df.limit(0), "s", "/", types.EndpointSchema.from_names(["id"]), context).count() == 0
    typed = bronze.staging(out.filter("id = '1'"), types.EndpointSchema([types.ColumnSpec("id", "bigint"), types.ColumnSpec("ok", "boolean")])).first()
    assert typed["id"] == 1 and typed["ok"] is True
    assert "CAST(`id` AS BIGINT)" in bronze.staging_sql("lake.t", types.EndpointSchema([types.ColumnSpec("id", "bigint")]))


def test_ingestion_key_is_the_same_for_a_retry():
    a = bronze.LoadContext.for_window("n", date(2026, 1, 1), date(2026, 1, 2), "c")
    b = bronze.LoadContext.for_window("n", date(2026, 1, 1), date(2026, 1, 2), "c")
    assert a.ingestion_key == b.ingestion_key and a.run_id != b.run_id and a.ingestion_key != bronze.LoadContext.adhoc("n").ingestion_key


# ---- deduplication and profiles ------------------------------------------------------------------


def test_first_wins(spark):
    df = spark.createDataFrame([(1, "k", "a"), (1, "k", "a"), (2, "k", "b"), (3, None, "c"), (4, " ", "d"), (5, "j", None)], "o int, k string, __rank string")
    assert rows(dedup.first_wins(df, ["k"], ["o"], strict=False, salts=4)) == rows(dedup.first_wins(df, ["k"], ["o"], strict=False)) == [(1, "k", "a"), (5, "j", None)]
    with pytest.raises(PySparkException, match="InvalidDeduplicationKeyError"):
        dedup.first_wins(df, ["k"], ["o"]).collect()
    assert dedup.duplicate_profile(df, ["k"]).first().asDict() == {"records": 6, "duplicate_rows": 2, "invalid_key_rows": 2, "unique_rows": 2, "key_complete": False, "key_unique": False, "mode": "key"}
    assert dedup.duplicate_profile(df).first()["duplicate_rows"] == 1
    assert dedup.duplicate_profile(df.limit(0), ["k"]).first()["records"] == 0
    assert dedup.assert_key_limit(df, ["k"]) == 2
    with pytest.raises(errors.DeduplicationError):
        dedup.assert_key_limit(df, ["k"], 1)
    assert dedup.resolve_primary_key(["a", "b", "a"]) == ("a", "b")
    for bad in (True, [1], [], "a..b"):
        with pytest.raises((TypeError, ValueError)):
            dedup.resolve_primary_key(bad)


SAMPLE = [{"id": 1, "email": None, "name": "", "active": True, "tags": ["a"], "meta": {"score": 1}}, {"id": 1, "name": "   ", "active": True, "tags": [], "meta": {"score": 2}}, {"id": 2, "email": "x", "name": 5, "active": False, "tags": ["a", "b"], "meta": {}}]


def test_profile_report(spark, records):
    r = report.profile_records(records(SAMPLE), source="s", key="id", order="ordinal")
    by = {f["path"]: f for f in r.fields}
    assert r.records == 3 and by["email"]["nulls"] == 1 and by["email"]["missing"] == 1 and by["name"]["empty_strings"] == 1 and by["name"]["blank_strings"] == 1
    assert by["tags[]"]["occurrences"] == 3 and by["tags[]"]["records_present"] == 2 and by["tags[]"]["cardinality"] == 2 and by["tags"]["empty_arrays"] == 1 and by["meta"]["empty_objects"] == 1
    assert by["email"]["cardinality"] == 2 and by["name"]["types"] == {"integer": 1, "string": 2}
    assert r.duplicates["duplicate_rows"] == 1 and r.quality["mixed_type_fields"] == 1 and len(r.warnings) == 2
    assert "name" in r.render_text() and "<script>" not in report.ProfileReport("<script>", ()).render_html()
    part = report.profile_records(records(SAMPLE), "nulls", fields=["email", "never"], order="ordinal")
    assert [f["path"] for f in part.fields] == ["email", "never"] and part.fields[1]["missing"] is None and part.duplicates is None and part.quality["fields_with_missing"] is None
    assert report.profile_records(records(SAMPLE), "count", scope="sample", limit=2, order="ordinal").records == 2
    assert report.profile_records(records([]), key="id").records == 0


def test_metrics():
    assert report.resolve_metrics(["Statistics"]) == ("cardinality", "count") and set(report.resolve_metrics([])) == report.METRICS
    with pytest.raises(errors.UnknownProfileMetricError):
        report.resolve_metrics(["quantiles"])


LEAF = st.one_of(st.none(), st.booleans(), st.integers(-3, 3), st.sampled_from([1.0, 1.5]), st.sampled_from(["", " ", "a", "é"]))
TREE = st.recursive(LEAF, lambda c: st.one_of(st.lists(c, max_size=3), st.dictionaries(st.sampled_from(["a", "b", "c d", "e.f"]), c, max_size=3)), max_leaves=8)


@settings(max_examples=12, deadline=None)
@given(st.lists(st.dictionaries(st.sampled_from(["a", "b", "x"]), TREE, max_size=3), min_size=1, max_size=6))
def test_profile_against_a_plain_model(items):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    df = spark.createDataFrame([("s", json.dumps(x)) for x in items], "source string, raw string")
    got = {r["path"]: r for r in profile.field_report(profile.path_value_counts(df, ["source"], "raw"), ["source"]).collect()}
    nodes = []

    def visit(v, path, i):
        if path:
            nodes.append((path, i, v))
        if isinstance(v, dict):
            for k, c in v.items():
                visit(c, f"{path}.{k}" if path else k, i)
        elif isinstance(v, list):
            for c in v:
                visit(c, path + "[]", i)

    for i, x in enumerate(items):
        visit(x, "", i)
    assert set(got) == {p for p, _, _ in nodes}
    for path, r in got.items():
        own = [(i, v) for p, i, v in nodes if p == path]
        assert r["occurrences"] == len(own) and r["records_present"] == len({i for i, _ in own}) and r["nulls"] == sum(v is None for _, v in own)
        assert r["distinct_values"] == len({json.dumps(v, sort_keys=True) for _, v in own}) and r["empty_strings"] == sum(v == "" and isinstance(v, str) for _, v in own)
        assert r["n_integer"] == sum(type(v) is int for _, v in own) and r["n_number"] == sum(type(v) is float for _, v in own)


test_profile_against_a_plain_model = pytest.mark.usefixtures("spark")(test_profile_against_a_plain_model)


def test_adaptive_cardinality(spark):
    df = spark.range(3000).select((F.col("id") % 50).alias("few"), F.col("id").alias("many"), F.lit(None).cast("int").alias("none"))
    got = {r["column_name"]: (r["distinct_values"], r["precision"]) for r in report.adaptive_cardinality(df, ["few", "many", "none"], limit=1000).collect()}
    assert got["few"] == (50, "exact") and got["none"] == (1, "exact") and got["many"][1] == "approximate" and abs(got["many"][0] - 3000) < 200


# ---- windows, state, sinks -----------------------------------------------------------------------


def test_windows(spark):
    store = MemoryStateStore()
    s = IncrementalStrategy(store, "k", initial_start="2026-01-01")
    w = s.resolve_window(date(2026, 1, 10))
    assert (w.start, w.end) == (date(2026, 1, 1), date(2026, 1, 10))
    s.commit(w, date(2026, 1, 7))
    assert s.resolve_window(date(2026, 2, 1)).start == date(2026, 1, 7)
    with pytest.raises(errors.StateConflictError):
        s.commit(w, date(2026, 1, 8))
    empty = s.resolve_window(date(2026, 2, 1))
    assert s.commit(empty, None).last_data_date == date(2026, 2, 1)  # an empty window moves to its end
    df = spark.createDataFrame([("2026-01-01",), ("2026-01-10T23:00:00Z",), ("2026-01-11",)], "d string")
    assert incremental.filter_window(df, values.parse_date(F.col("d")), w).count() == 2
    with pytest.raises(PySparkException, match="MissingDateFieldError"):
        incremental.filter_window(df.union(spark.createDataFrame([("x",)], "d string")), values.parse_date(F.col("d")), w).collect()
    with pytest.raises(RuntimeError):
        InspectionStateStore().compare_and_set("k", None, None)


def _race(path, out):
    try:
        JsonStateStore(path).compare_and_set("k", None, Watermark(datetime.now(timezone.utc)))
        out.put("won")
    except errors.StateConflictError:
        out.put("lost")


def test_json_state(tmp_path):
    path = tmp_path / "d" / "state.json"
    store, mark = JsonStateStore(str(path)), Watermark(datetime(2026, 1, 1, tzinfo=timezone.utc), date(2026, 1, 2), "c")
    assert store.get("k") is None
    store.compare_and_set("other", None, mark)
    assert JsonStateStore(str(path)).get("other") == mark and path.stat().st_mode & 0o777 == 0o600
    context = multiprocessing.get_context("spawn")
    out = context.Queue()
    racers = [context.Process(target=_race, args=(str(path), out)) for _ in range(3)]
    [p.start() for p in racers], [p.join() for p in racers]
    assert sorted(out.get() for _ in racers) == ["lost", "lost", "won"]
    for bad in ("", "a\n", "x" * 513, 5):
        with pytest.raises(ValueError):
            store.get(bad)


def test_parquet_destination(spark, tmp_path):
    rows_of = lambda n, key: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit(key).alias("_ingestion_key"), F.lit('{"x": 1}').alias("_extra"))
    sink = ParquetDestination(str(tmp_path / "lake"))
    assert sink.load(rows_of(3, "a"), "s.t", "a").extra_fields_seen == ["x"]
    sink.load(rows_of(2, "b"), "s.t", "b")
    assert sink.load(rows_of(5, "a"), "s.t", "a").rows_loaded == 5
    count = lambda: {r["_ingestion_key"]: r["count"] for r in sink.read(spark, "s.t").groupBy("_ingestion_key").count().collect()}
    assert count() == {"a": 5, "b": 2}
    assert sink.load(rows_of(0, "a"), "s.t", "a").rows_loaded == 0 and count() == {"b": 2}
    bad = rows_of(1, "c").select(F.raise_error(F.lit("boom")).cast("string").alias("id"), "_ingestion_key", "_extra")
    over = ParquetDestination(str(tmp_path / "lake"), "overwrite")
    with pytest.raises(PySparkException):
        over.load(bad, "s.t", "c")
    assert count() == {"b": 2} and [p.name for p in (tmp_path / "lake/s").iterdir()] == ["t"]
    over.load(rows_of(1, "z"), "s.t", "z")
    assert count() == {"z": 1}
    assert batch_size(100) == 100 and write_mode(" Append ") == "append"
    for f, v in ((batch_size, 99), (batch_size, True), (write_mode, "merge")):
        with pytest.raises(ValueError):
            f(v)


# ---- sources -------------------------------------------------------------------------------------


class Site:
    """Canned answers by URL part; a picklable transport."""

    def __init__(self, pages):
        self.pages, self.calls = pages, []

    def __call__(self, method, url, headers, body, timeout):
        self.calls.append(url)
        for part, answer in self.pages:
            if part in url:
                status, head, data = answer if isinstance(answer, tuple) else (200, {}, answer)
                return Response(status, head, data if isinstance(data, bytes) else json.dumps(data).encode(), url)
        return Response(404, {}, b"")


def connector(pages, **kw):
    return RestConnector("https://api.example/v1/orders", client=HttpClient(transport=Site(pages), backoff=0), **kw)


def pages_of(c):
    return [r for page, _, _ in c.endpoint.pages() for r in page.records]


@pytest.mark.parametrize(
    ("kind", "pages", "ids"),
    [
        ("page", [("page=2", [{"i": 3}]), ("page=3", []), ("page=1", [{"i": 1}, {"i": 2}])], [1, 2, 3]),
        ({"type": "offset", "size": 2}, [("offset=2", [{"i": 3}]), ("offset=4", []), ("offset=0", [{"i": 1}, {"i": 2}])], [1, 2, 3]),
        ({"type": "page", "short_page_ends": True, "size": 2}, [("page=1", [{"i": 1}])], [1]),
        ("cursor", [("cursor=b", {"data": [{"i": 2}], "next_cursor": ""}), ("orders", {"data": [{"i": 1}], "next_cursor": "b"})], [1, 2]),
        ("next_url", [("p=2", {"items": [{"i": 2}]}), ("orders", {"items": [{"i": 1}], "next": "/v1/orders?p=2"})], [1, 2]),
        ("link", [("p=2", [{"i": 2}]), ("orders", (200, {"link": '<https://api.example/a,b>; rel="prev", </v1/orders?p=2>; title="x, y"; rel="last next"'}, [{"i": 1}]))], [1, 2]),
        (None, [("cursor=b", {"results": [{"i": 2}]}), ("orders", {"results": [{"i": 1}], "meta": {"next_cursor": "b"}})], [1, 2]),
        (False, [("orders", {"results": [{"i": 1}], "next": "x"})], [1]),
    ],
)
def test_pagination(kind, pages, ids):
    assert [r["i"] for r in pages_of(connector(pages, pagination=kind))] == ids


def test_pagination_guards():
    loop = connector([("orders", {"items": [{"i": 1}], "next": "/v1/orders"})], pagination="next_url")
    with pytest.raises(errors.PaginationLoopError):
        pages_of(loop)
    away = connector([("orders", {"items": [{"i": 1}], "next": "https://evil.example/x"})], pagination="next_url")
    with pytest.raises(errors.CrossOriginPaginationError):
        pages_of(away)
    endless = connector([("page=", [{"i": 1}])], pagination="page", max_pages=3)
    with pytest.raises(errors.PaginationLimitError):
        pages_of(endless)
    assert pages_of(connector([("orders", (204, {}, b""))])) == []
    for bad in ("sideways", {"type": "page", "size": True}, {"type": "page", "nope": 1}, {"type": "offset", "size": 0}):
        with pytest.raises(ValueError):
            pagination.resolve_pagination(bad)
    with pytest.raises(TypeError):
        pagination.resolve_pagination(3)


def test_records_path():
    assert find_records_path({"meta": {"x": 1}, "data": {"orders": [{"id": 1}]}}) == "data.orders"
    assert find_records_path({"errors": [], "items": [{}]}) == "items"
    assert find_records_path({"a": [1], "b": 2}) is None
    with pytest.raises(ValueError):
        find_records_path({"x": [{}], "y": [{}]})
    assert Endpoint("https://h/x").items({"a": 1}) == [{"a": 1}] and Endpoint("https://h/x").items([1]) == [{"value": 1}]
    with pytest.raises(TypeError):
        Endpoint("https://h/x", records="a").items({"a": 5})
    with pytest.raises(errors.InvalidHttpMethodError):
        Endpoint("https://h/x", "PUT")


def test_http_client():
    for url in ("http://h/x", "https://u:p@h/x", "ftp://h/x", "https://169.254.169.254/x", "https://[::ffff:169.254.0.1]/", "https://0.0.0.0/"):
        with pytest.raises(errors.UnsafeUrlError):
            http.check_url(url)
    http.check_url("https://10.0.0.1/x")
    flaky = [(503, {}, b""), (200, {}, b"[]")]
    client = HttpClient(transport=lambda *a: Response(*flaky.pop(0)), backoff=0)
    assert client.request("GET", "https://h/x").status == 200
    with pytest.raises(errors.HttpRequestError, match="https://h/x"):
        HttpClient(transport=lambda *a: Response(500, {}, b""), backoff=0).request("POST", "https://h/x", json_body={"token": "t"})
    with pytest.raises(errors.UnsafeRedirectError):
        HttpClient(transport=lambda *a: Response(302, {"Location": "https://other/"}, b"")).request("GET", "https://h/x")
    auth = http.resolve_auth("bearer:KEY")
    sent = {}
    HttpClient(auth, StaticSecrets({"KEY": "v"}), transport=lambda m, u, h, b, t: sent.update(h) or Response(200, {}, b"[]")).request("GET", "https://h/x")
    assert sent["Authorization"] == "Bearer v" and "v'" not in repr(auth)
    with pytest.raises(errors.InvalidAuthValueError):
        HttpClient(auth, StaticSecrets({"KEY": "a\r\nb"}), transport=lambda *a: None).request("GET", "https://h/x")
    with pytest.raises(errors.InsecureTlsError):
        HttpClient(verify_tls=False)
    assert http.safe_target("https://u:p@h:1/p?q=1") == "https://h:1/p?<redacted>"


def test_file_secrets(tmp_path):
    folder = tmp_path / "secrets"
    folder.mkdir()
    (folder / "KEY").write_text("v\n")
    (tmp_path / "outside").write_text("x")
    (folder / "LINK").symlink_to(tmp_path / "outside")
    (folder / "BIG").write_text("x" * 70_000)
    secrets = FileSecrets(str(folder))
    assert secrets.get("KEY") == "v"
    for bad in ("../outside", "LINK", "a/b", "", "NONE", "BIG"):
        with pytest.raises(SecretError):
            secrets.get(bad)


ORDERS = [("orders", {"data": [{"id": 1, "c": {"n": "a"}, "d": "2026-01-05"}, {"id": 1, "c": {"n": "b"}, "d": "2026-01-06"}, {"id": 2, "c": {}, "d": "2026-01-09T10:00:00Z"}, {"id": 3, "d": "2026-02-01"}]})]


def test_extraction(spark):
    store = MemoryStateStore()
    c = connector(ORDERS, select={"id": "id", "c.n": "n"}, primary_key="id", dedup=True, date_field="d", incremental=IncrementalStrategy(store, "orders", initial_start="2026-01-01"), pagination=False)
    assert c.collect(spark, date(2026, 1, 31)) == [{"id": 1, "n": "a"}, {"id": 2, "n": None}]
    assert store.get("orders").last_data_date == date(2026, 1, 9)
    session = c.session(spark, date(2026, 1, 31))
    with pytest.raises(RuntimeError):
        session.commit()
    session.abort()
    with pytest.raises(RuntimeError):
        session.records  # noqa: B018
    with pytest.raises(ValueError):
        connector(ORDERS, dedup=True)
    with pytest.raises(errors.MissingDateFieldError):
        connector(ORDERS, incremental=IncrementalStrategy(store, "x"))
    assert [len(b) for b in connector(ORDERS, pagination=False).stream(spark, batch_size=3)] == [3, 1]
    probe = c.probe(2)
    assert len(probe.records) == 2 and probe.records_path == "data" and probe.status_code == 200
    r = connector(ORDERS, pagination=False).profile(spark, "count", "types")
    assert r.records == 4 and {f["path"] for f in r.fields} == {"id", "c", "c.n", "d"}
    assert "secret" not in json.dumps(c.explain()["url"])


def test_limits_reach_the_reader(spark, tmp_path):
    log = tmp_path / "calls"

    class Logged(Site):
        def __call__(self, method, url, headers, body, timeout):
            with open(log, "a") as f:
                f.write(url + "\n")
            return super().__call__(method, url, headers, body, timeout)

    c = RestConnector("https://api.example/v1/orders", pagination="page", client=HttpClient(transport=Logged([("page=", [{"i": 1}, {"i": 2}])])), max_pages=50)
    assert c.raw_records(spark, max_records=3).count() == 3
    assert len(log.read_text().splitlines()) == 2


def test_pipeline(spark, tmp_path):
    class Stuck(MemoryStateStore):
        broken = True

        def compare_and_set(self, *a):
            if self.broken:
                raise errors.StateConflictError("password=abc lost")
            super().compare_and_set(*a)

    store = Stuck()
    make = lambda: connector(ORDERS, name="orders", pagination=False, date_field="d", incremental=IncrementalStrategy(store, "orders"))
    sink, log = ParquetDestination(str(tmp_path / "lake")), JsonlRunLog(str(tmp_path / "runs.jsonl"))
    broken = RestConnector("https://api.example/none", name="none", client=HttpClient(transport=Site([]), backoff=0))
    p = Pipeline([(make(), None, "bronze.orders"), (broken, None, "bronze.none")], sink, log)
    first = p.run(spark, date(2026, 1, 31))
    assert [s.status for s in first.steps] == ["checkpoint_error", "error"] and "<redacted>" in first.steps[0].error and not first.success
    store.broken = False
    again = Pipeline([(make(), None, "bronze.orders")], sink, log).run(spark, date(2026, 1, 31))
    assert again.success and again.steps[0].ingestion_key == first.steps[0].ingestion_key and again.rows_loaded == 3
    assert sink.read(spark, "bronze.orders").count() == 3  # the retry replaced its own rows
    runs = log.read(spark)
    assert rows(runs.groupBy("connector_name", "status").count()) == [("none", "error", 1), ("orders", "checkpoint_error", 1), ("orders", "success", 1)]
    assert pipeline.latest_runs(runs).count() == 2
    result, models = make().to(ParquetDestination(str(tmp_path / "flow")), "bronze.orders").models({"stg": "select cast(id as int) as id from landed", "silver": "select count(distinct id) as n from stg"}).run(spark, date(2026, 1, 31))
    assert result.success and models["silver"].first()["n"] == 1
    with pytest.raises(errors.ScheduledPipelineError):
        pipeline.run_scheduled(Pipeline([(broken, None, "t")], sink), spark)
    with pytest.raises(errors.AdapterNotFoundError):
        pipeline.destination("oracle")
    assert "cursor" in pipeline.capabilities()["pagination"]


def test_config(spark, tmp_path):
    yaml = pytest.importorskip("yaml")
    path = tmp_path / "p.yaml"
    path.write_text(yaml.safe_dump({"name": "p", "destination": {"type": "parquet", "root": str(tmp_path / "lake")}, "state": {"path": str(tmp_path / "s.json")}, "run_log": False, "connector": {"name": "orders", "base_url": "https://api.example/v1/orders", "pagination": "none", "incremental": "d", "auth": {"type": "bearer", "secret_key": "K"}, "schema": ["id", {"name": "d", "type": "date"}]}}))
    built = config.build_pipeline(config.load_config(str(path)), transport=Site(ORDERS))
    built.steps[0][0].endpoint.client.secrets = StaticSecrets({"K": "v"})
    assert built.run(spark, date(2026, 3, 1)).rows_loaded == 4
    for text_ in ("a: 1\na: 2\n", "- 1\n", "a: [", "x" * 2_000_000):
        path.write_text(text_)
        with pytest.raises(errors.PipelineConfigError):
            config.load_config(str(path))
    for bad in ({"nope": 1}, {"connector": {"base_url": "https://h/"}, "sources": []}, {}, {"connector": {"base_url": "https://h/", "params": {"api_key": "x"}}}, {"connector": {"base_url": "https://h/", "colour": 1}}):
        with pytest.raises(errors.PipelineConfigError):
            config.build_pipeline({"destination": {"root": "x"}, **bad})
    config.save_config({"name": "p"}, str(tmp_path / "p.json"))
    assert config.load_config(str(tmp_path / "p.json")) == {"name": "p"}


def test_schedule():
    monday = datetime(2026, 3, 2, 10, 30, 20)
    for line, at in {"*/15 * * * *": datetime(2026, 3, 2, 10, 45), "0 6 * * 1-5": datetime(2026, 3, 3, 6), "0 0 1 * *": datetime(2026, 4, 1), "0 0 29 2 *": datetime(2028, 2, 29), "0 0 13 * 5": datetime(2026, 3, 6), "0 0 * * 7": datetime(2026, 3, 8)}.items():
        assert schedule.CronTrigger(line).after(monday) == at, line
    for bad in ("* * * *", "60 * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *"):
        with pytest.raises(ValueError):
            schedule.CronTrigger(bad)
    waits, runs = [], iter([1, 2, ValueError("x")])

    def job():
        r = next(runs)
        if isinstance(r, Exception):
            raise r
        return r

    s = schedule.Scheduler(job, schedule.IntervalTrigger(30), clock=lambda: monday, sleep=waits.append)
    assert s.run(2) == [1, 2] and waits == [30.0, 30.0]
    with pytest.raises(errors.ScheduledPipelineError):
        s.run()


def test_delta_needs_its_package(spark, tmp_path):
    with pytest.raises(errors.AdapterNotFoundError):
        pipeline.destination("delta", root=str(tmp_path)).load(spark.range(1), "t", "k")


def test_callable_date_field(spark):
    store = MemoryStateStore()
    c = connector(ORDERS, pagination=False, date_field=lambda r: r["d"][:10], incremental=IncrementalStrategy(store, "o"))
    assert len(c.collect(spark, date(2026, 1, 6))) == 2 and store.get("o").last_data_date == date(2026, 1, 6)


# ---- streaming -----------------------------------------------------------------------------------


def test_landing_stream(spark, tmp_path):
    sink = ParquetDestination(str(tmp_path / "lake"))
    put = lambda items: spark.createDataFrame([(json.dumps(x),) for x in items], "raw string").write.mode("append").parquet(str(tmp_path / "in"))
    land = lambda: landing.land_stream(spark, str(tmp_path / "in"), "s", "/e", types.EndpointSchema.from_names(["id"]), sink, "b.t", str(tmp_path / "cp")).awaitTermination(60)
    put([{"id": 1}, {"id": 2}])
    land()
    put([{"id": 3}])
    land()
    land()
    assert sorted(r["id"] for r in sink.read(spark, "b.t").collect()) == ["1", "2", "3"]


def test_streamed_windows(spark, tmp_path):
    spark.createDataFrame([("a", datetime(2026, 1, 1, 0, 1)), ("a", datetime(2026, 1, 1, 0, 2)), ("a", datetime(2026, 1, 1, 0, 2)), ("b", datetime(2026, 1, 1, 5, 0))], "k string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    for name, df in (("once", landing.once_within(stream, ["k"], "ts", "1 hour")), ("windows", landing.event_windows(stream, "ts", "5 minutes", "1 minute", ["k"]))):
        df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(60)
    assert sorted(r["k"] for r in spark.table("once").collect()) == ["a", "b"]
    assert [(r["k"], r["n"]) for r in spark.table("windows").collect()] == [("a", 3)]


# ---- every query against its SQL -----------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(reference.SQL | sites.SQL))
def test_query_equals_sql(spark, name):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    df = (reference.QUERIES | sites.QUERIES)[name](spark, DATA)
    names = sorted(df.columns)
    cursor = con.execute((reference.SQL | sites.SQL)[name])
    found = [c[0] for c in cursor.description]
    expected = sorted((tuple(r[found.index(c)] for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted(found) == names and sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == expected


def test_empty_loads_leave_readable_tables(spark, tmp_path):
    rows_of = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("_ingestion_key"), F.lit(None).cast("string").alias("_extra"))
    sink, over = ParquetDestination(str(tmp_path / "lake")), ParquetDestination(str(tmp_path / "lake"), "overwrite")
    sink.load(rows_of(3), "s.t", "a")
    assert sink.load(rows_of(0), "s.t", "a").rows_loaded == 0 and sink.read(spark, "s.t").count() == 0
    assert sink.read(spark, "s.t").columns == ["id", "_ingestion_key", "_extra"]
    sink.load(rows_of(0), "s.u", "a")
    assert sink.read(spark, "s.u").count() == 0
    over.load(rows_of(2), "s.t", "a")
    over.load(rows_of(0), "s.t", "b")
    assert over.read(spark, "s.t").count() == 0
    sink.load(rows_of(1).withColumn("more", F.lit(1)), "s.t", "c")
    assert sink.read(spark, "s.t").columns == ["id", "_ingestion_key", "_extra", "more"]


def test_a_failed_swap_brings_the_old_rows_back(spark, tmp_path, monkeypatch):
    from sedimenta.sinks import parquet

    rows_of = lambda n: spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("_ingestion_key"))
    sink = ParquetDestination(str(tmp_path / "lake"))
    sink.load(rows_of(3), "s.t", "a")
    move = parquet.Folder.rename

    def stuck(self, to):
        if "__staging_" in str(self.path):
            raise OSError("disk full")
        move(self, to)

    monkeypatch.setattr(parquet.Folder, "rename", stuck)
    with pytest.raises(OSError):
        sink.load(rows_of(9), "s.t", "a")
    assert sink.read(spark, "s.t").count() == 3


def test_landed_schemas_previews_and_scaffolds(spark, tmp_path):
    from sedimenta.functions.types import ColumnSpec, EndpointSchema
    from sedimenta.operators.bronze import LoadContext

    schema = EndpointSchema([ColumnSpec("id", "bigint"), ColumnSpec("day", "date")])
    landed = bronze.bronze_rows(spark.createDataFrame([('{"id": 1, "x": 2}',)], "raw string"), "s", "/e", schema, LoadContext.adhoc("s"))
    assert [(f.name, f.dataType) for f in landed.schema] == [(f.name, f.dataType) for f in bronze.landed_schema(schema)]
    assert bronze.landed_arrow_schema(schema).names == landed.columns
    sink = ParquetDestination(str(tmp_path / "lake"))
    assert sink.tables(spark) == []
    sink.load(landed, "b.t", "k")
    assert sink.tables(spark) == ["b.t"] and sink.preview(spark, "b.t", 5).count() == 1
    for bad in (0, 201, True, "9"):
        with pytest.raises(ValueError):
            sink.preview(spark, "b.t", bad)
    assert bronze.write_scaffold(str(tmp_path / "dbt"), "lake", {"t": schema}) == ["sources.yml", "stg_t.sql"]
    assert bronze.write_scaffold(str(tmp_path / "dbt"), "lake", {"t": schema, "u": schema}) == ["stg_u.sql"]
    assert "as `id`" in (tmp_path / "dbt/stg_t.sql").read_text().lower()


def test_state_and_log_registries(spark, tmp_path):
    from sedimenta.sinks import state

    new, later = Watermark(datetime(2026, 1, 1, tzinfo=timezone.utc), date(2026, 1, 1), "c"), Watermark(datetime(2026, 1, 2, tzinfo=timezone.utc))
    for store in (state.state_store("sqlite", path=str(tmp_path / "s.db")), state.state_store("auto", spark, ParquetDestination(str(tmp_path / "lake"))), state.state_store("memory")):
        assert store.get("k") is None
        store.compare_and_set("k", None, new)
        for expected in (None, later):
            with pytest.raises(errors.StateConflictError):
                store.compare_and_set("k", expected, later)
        store.compare_and_set("k", new, later)
        assert store.get("k") == later
    entry = state.RunLogEntry("c", "2026-01-01T00:00:00+00:00", "2026-01-01T00:01:00+00:00", "success", 3, ["x"], None, "r", "k", "d", "2026-01-01")
    for log in (state.run_log("auto", spark, ParquetDestination(str(tmp_path / "lake"))), state.run_log("parquet", spark, None, path=str(tmp_path / "runs"))):
        log.record(entry), log.record(entry)
        assert rows(log.read(spark).select("connector_name", "rows_loaded", F.col("window_start").cast("string"), "extra_fields_seen")) == [("c", 3, "2026-01-01", ["x"])] * 2
    for make, name in ((state.state_store, "oracle"), (state.run_log, "x")):
        with pytest.raises(errors.AdapterNotFoundError):
            make(name)
    with pytest.raises(errors.AdapterNotFoundError):
        state.state_store("auto", spark, ParquetDestination("s3://bucket/lake"))


def test_incremental_intents(spark, tmp_path):
    intent = incremental.incremental_intent
    for off in (None, False, "off", " None ", ""):
        assert intent(off, "n", "d") == (None, "d")
    for wanted, mode, field in ((True, "data_date", "d"), ("ingestion_date", "ingestion_date", "d"), ("updated_at", "data_date", "updated_at"), ({"field": "u", "start": "2026-01-01", "key": "k"}, "data_date", "u")):
        strategy, got = intent(wanted, "n", "d")
        assert (strategy.mode, got, strategy.store) == (mode, field, None)
    for bad in (5, {"when": 1}):
        with pytest.raises(TypeError):
            intent(bad, "n")
    c = connector(ORDERS, name="orders", pagination=False, incremental="d")
    with pytest.raises(errors.MissingStateStoreError):
        c.session(spark)
    result, _ = c.to(ParquetDestination(str(tmp_path / "lake")), "bronze.orders").run(spark, date(2026, 1, 31))
    assert result.success and json.loads((tmp_path / "lake/_state.json").read_text())["orders"]["last_data_date"] == "2026-01-09"
    with pytest.raises(errors.MissingDateFieldError):
        connector(ORDERS, incremental=True)
    sent = connector([("from=2026-01-05", {"data": [{"id": 1, "d": "2026-01-06"}]})], pagination=False, date_field="d", date_params={"start": "from", "end": "to"}, incremental=IncrementalStrategy(MemoryStateStore(), "o", initial_start="2026-01-05"))
    assert sent.collect(spark, date(2026, 1, 31)) == [{"id": 1, "d": "2026-01-06"}]


def test_older_extraction_and_key_rules(spark):
    store = MemoryStateStore()
    c = connector(ORDERS, pagination=False, date_field="d", incremental=IncrementalStrategy(store, "o"))
    with pytest.raises(RuntimeError):
        c.commit_watermark()
    assert len(list(c.extract(spark, date(2026, 1, 31)))) == 3 and store.get("o") is None
    c.commit_watermark()
    assert store.get("o").last_data_date == date(2026, 1, 9)
    keyed = lambda ids, **kw: connector([("orders", {"data": [{"id": i} for i in ids]})], pagination=False, primary_key="id", dedup=True, **kw)
    assert keyed(["[abc", "{x}", "[abc", "a'b"]).collect(spark) == [{"id": "[abc"}, {"id": "{x}"}, {"id": "a'b"}]
    for bad in ([1], {"x": 1}, None, "  "):
        with pytest.raises(PySparkException):
            keyed(["ok", bad]).collect(spark)
    with pytest.raises(errors.DeduplicationError):
        keyed([1, 2, 3], max_unique_keys=2).collect(spark)


def test_redirects_that_change_the_method():
    calls = []

    def site(status):
        def transport(method, url, headers, body, timeout):
            calls.append((method, body, "Content-Type" in headers))
            return Response(200, {}, b"{}") if url.endswith("/b") else Response(status, {"Location": "/b"}, b"")

        return HttpClient(transport=transport, backoff=0)

    for status, method, kept in ((303, "POST", False), (301, "POST", False), (302, "POST", False), (307, "POST", True), (308, "POST", True), (302, "GET", False)):
        calls.clear()
        site(status).request(method, "https://api.example/a", json_body={"q": 1} if method == "POST" else None)
        assert calls[1] == ((method, calls[0][1], True) if kept else ("GET", None, False))


def test_samples_keep_the_order_of_the_input(spark):
    df = spark.createDataFrame([(json.dumps({"z": 9}),), (json.dumps({"a": 1}),)], "raw string").coalesce(1)
    assert [f["path"] for f in report.profile_records(df, "types", scope="sample", limit=1).fields] == ["z"]
    many = spark.range(12_000).select(F.concat(F.lit('{"n":'), F.col("id").cast("string"), F.lit(',"k":1}')).alias("raw"))
    got = {f["path"]: (f["cardinality"], f["precision"]) for f in report.profile_records(many, "cardinality").fields}
    assert got["k"] == (1, "exact") and got["n"][1] == "approximate" and abs(got["n"][0] - 12_000) < 12_000 * 4 * report.SKETCH_ERROR


def test_config_blocks_and_commands(spark, tmp_path, capsys):
    from sedimenta.plans import cli

    made = {"name": "p", "destination": {"root": str(tmp_path / "lake")}, "state": "memory", "run_log": {"type": "parquet", "path": str(tmp_path / "runs")}, "transform": {"models": {"n": "select count(*) as n from orders"}},
            "connector": {"name": "orders", "base_url": "https://api.example/v1/orders", "pagination": "none", "incremental": {"field": "d", "start": "2026-01-06"}, "date_params": {"start": "from"}}}
    config.save_config(made, str(tmp_path / "p.json"))
    (tmp_path / "q.json").write_text('{"nonsense": 1}')
    result, models = config.run_config(config.load_config(str(tmp_path / "p.json")), spark, date(2026, 1, 31), transport=Site(ORDERS))
    assert result.success and models["n"].first()["n"] == 4 and spark.read.parquet(str(tmp_path / "runs")).count() == 1
    listed = config.list_configs(str(tmp_path))
    assert [(x["file"], x["name"], x["error"] is None) for x in listed] == [("p.json", "p", True), ("q.json", "q", False)]
    assert config.models_of({"transform": [{"name": "a", "sql": "select 1"}]}) == {"a": "select 1"}
    for bad in ({"transform": {"a": 1}}, {"transform": [{"id": 1}]}):
        with pytest.raises(errors.PipelineConfigError):
            config.models_of(bad)
    for bad in ({"state": "oracle"}, {"run_log": {"type": "x"}}, {"state": {"type": "json", "password": "x"}}):
        with pytest.raises(errors.PipelineConfigError):
            config.build_pipeline({**made, **bad})
    assert cli.main(["adapters"]) == 0 and "sqlite" in capsys.readouterr().out
    assert cli.main(["list", str(tmp_path)]) == 0 and "q.json" in capsys.readouterr().out


def test_public_names():
    import sedimenta

    assert all(getattr(sedimenta, name) is not None for name in sedimenta.__all__) and "RestConnector" in dir(sedimenta)
    with pytest.raises(AttributeError):
        sedimenta.nothing  # noqa: B018


def test_windows_are_inclusive():
    assert IncrementalWindow(date(2026, 1, 1), date(2026, 1, 1)).watermark_before is None


def test_whole_documents_are_redacted(spark, tmp_path):
    """Long texts, texts without the usual words and null."""
    from sedimenta.plans import reference

    long = "plain words " * 30_000
    texts = ["client_secret=abc, x", "api_key: abc", "account_key=abc", "connection_string=abc", long + "password=hunter2", None, "", "plain"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r["redacted"] for r in reference.QUERIES["redact_documents"](spark, str(tmp_path)).collect()}
    assert [got[i] for i in range(8)] == ["client_secret=<redacted>, x", "api_key: <redacted>", "account_key=<redacted>", "connection_string=<redacted>", long + "password=<redacted>", None, "", "plain"]


def test_all_landed_rows_and_fingerprints(spark, tmp_path):
    """Odd values of declared fields land with all columns; ids with control characters have a fingerprint."""
    import hashlib

    from sedimenta.plans import reference

    values_ = ["a@b", ["x", 1.0, None, True], {"k": "é"}, True, False, "[odd", "True", None, 1e16, 0.1]
    data = [json.dumps({"id": i, "email": v, "meta": {"n": i}}, ensure_ascii=False) for i, v in enumerate(values_)]
    spark.createDataFrame([(i, t) for i, t in enumerate(data)], "record_no long, raw string").write.parquet(str(tmp_path / "profile_records.parquet"))
    ids = ["plain", "ctl\x01\x1f", "new\nline", 'quo"te', None]
    spark.createDataFrame([(i, "s", k) for i, k in enumerate(ids)], "arrival_no long, source string, id string").write.parquet(str(tmp_path / "incoming_orders.parquet"))
    landed = reference.QUERIES["bronze_rows"](spark, str(tmp_path))
    got = {r["id"]: r for r in landed.collect()}
    assert {"id", "email", "name", "active", "_source", "_endpoint", "_ingested_at", "_run_id", "_ingestion_key", "_window_start", "_window_end", "_raw", "_extra"} == set(landed.columns)
    expected = ["a@b", '["x", 1.0, null, true]', None, "True", "False", "[odd", "True", None, "1e+16", "0.1"]
    assert [got[str(i)]["email"] for i in range(10)] == expected
    assert json.loads(got["2"]["_extra"]) == {"email_k": "é", "meta_n": 2} and json.loads(got["0"]["_extra"]) == {"meta_n": 0}
    prints = {r["arrival_no"]: r["fingerprint"] for r in reference.QUERIES["key_fingerprint"](spark, str(tmp_path)).collect()}
    assert [prints[i] for i in range(5)] == [None if k is None else hashlib.sha256(json.dumps(["s", k], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest() for k in ids]


# ---- sources larger than a page, a body or the memory ---------------------------------------------


def test_long_bodies_are_read_as_json_loads_reads_them(monkeypatch):
    from sedimenta.sources import body as bodies

    monkeypatch.setattr(bodies, "WINDOW", 64)
    items = [{"i": i, "t": "é\"\\,]}" * (i % 9), "n": [1, {"a": None}], "x": -1.5e3} for i in range(60)]
    read = lambda text, cut=7: bodies.decode(bodies.Spool(text[i : i + cut] for i in range(0, len(text), cut)))
    plain = lambda v: [plain(x) for x in v] if isinstance(v, bodies.LongList) else {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else v
    for value in (items, {"meta": {"n": 1}, "payload": {"odd.key": items}, "next": "b"}, [items, [], 1], {"a": "y" * 500, "b": {}}, [], 12345):
        for text in (json.dumps(value), json.dumps(value, ensure_ascii=False, indent=1), json.dumps(value, separators=(",", ":"))):
            assert plain(read(text.encode())) == value
    assert plain(read(json.dumps(items).encode("utf-16"))) == items
    found = read(json.dumps({"data": items}).encode())["data"]
    assert isinstance(found, bodies.LongList) and len(found) == 60 and found[:2] == items[:2] and found[-1] == items[-1] and list(found) == items
    assert paths.read_path({"data": found}, ("data", 1, "i")) == 1 and find_records_path({"data": found}) == "data"
    whole = json.dumps({"data": items}).encode()
    for bad in (whole[:-1], whole[:-40], whole + b"x", whole.replace(b'"i": 5,', b'"i" 5,')):
        with pytest.raises(ValueError):
            read(bad)


def test_a_body_beyond_64_mib():
    text = "x" * 1000
    body = lambda: (json.dumps([{"i": i, "t": text}]).encode()[bool(i) : -1] if not i else b", " + json.dumps({"i": i, "t": text}).encode() for i in range(70_000))

    def site(*_):
        def chunks():
            yield from body()
            yield b"]"

        return Response(200, {}, chunks())

    with pytest.raises(errors.ResponseTooLargeError):
        next(RestConnector("https://api.example/v1/all", pagination=False, client=HttpClient(transport=site)).endpoint.pages())
    for records in (None, lambda b: b):
        page, _, _ = next(RestConnector("https://api.example/v1/all", pagination=False, records=records, client=HttpClient(transport=site, max_body=None)).endpoint.pages())
        assert len(page.records) == 70_000 and sum(r["i"] for r in page.records) == 70_000 * 69_999 // 2


def test_a_site_of_more_pages_than_the_default_limit(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sites, "PAGE", 1)
    n = 10_050
    spark.range(n).selectExpr("id as event_id", "timestamp_ntz'2024-01-06 00:00:00' as ts", "id % 7 as user_id", "'view' as event_type").orderBy("ts", "user_id").write.parquet(str(tmp_path / "events.parquet"))
    endpoint = sites._connector(spark, str(tmp_path), "cursor", pagination={"type": "cursor", "cursor_path": "meta.next_cursor"}).endpoint
    got = [r["event_id"] for page, _, _ in endpoint.pages() for r in page.records]
    assert got == list(range(n))


def test_the_site_reads_one_row_group_at_a_time(spark, tmp_path):
    spark.range(3000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 40)) as ts", "id as user_id", "'view' as event_type").repartition(7).write.parquet(str(tmp_path / "events.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        site = sites.TableSite(spark, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sites._groups(site.path)[1]) > 1
    assert [r["event_id"] for r in sites._records(site.path, 700, 2100, None)] == list(range(700, 2100))
    days = ("2024-01-05", "2024-01-06")
    assert [r["event_id"] for r in sites._records(site.path, 3, 9999, days)] == [i for i in range(3000) if i % 40 in (4, 5)][3:]
    assert sites._records(site.path, 3000, 3500, None) == []


def test_a_record_is_written_as_json_dumps_writes_it():
    encode = rest._encoder()
    for x in ({}, {"a": None, "b": [True, 1.0, 1e300, float("nan"), -0.0, 10**30], "ü ": 'q"\\\n\x00\ud800'}, {"n": {"m": [{}, []]}, "1": "1"}):
        assert encode(x) == json.dumps(x, ensure_ascii=False) == encode(x)
    with pytest.raises(TypeError):
        encode({"a": object()})


def test_the_site_writes_values_as_json_dumps_does():
    at = [datetime(2024, 1, 6), datetime(2024, 1, 6, 1, 2, 3, 40), datetime(1950, 12, 31, 23, 59, 59, 120000)]
    for values_, kind in ((at, pa.timestamp("us")), ([1, -5, 2**60], pa.int64()), (['a"b\\', "ü ", "a\nb"], pa.string())):
        assert sites._values(pa.chunked_array([values_[:2], [None, values_[2]]], kind)).to_pylist() == [json.dumps(v.isoformat() if kind == pa.timestamp("us") else v) for v in values_[:2]] + ["null"] + [json.dumps(values_[2].isoformat() if kind == pa.timestamp("us") else values_[2])]


def test_staged_pages_can_be_read_by_several_tasks(spark, tmp_path):
    spark.range(60_000).selectExpr("id as event_id", "timestamp_ntz'2024-01-06 00:00:00' as ts", "id as user_id", "repeat(sha2(cast(id as string), 256), 3) as event_type").write.parquet(str(tmp_path / "events.parquet"))
    pages = sites._connector(spark, str(tmp_path), "whole", pagination=False).raw_records(spark)
    files = [f.removeprefix("file:").replace("///", "/") for f in pages.inputFiles()]
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) > 1
    assert pages.selectExpr("count(*)", "count(distinct ordinal)", "max(ordinal)").first() == (60_000, 60_000, 59_999)


def test_the_reader_finds_the_day_as_parse_date_does(spark):
    texts = ["2024-01-06", " \x1c2024-01-06T10:00:00Z", "2024-13-45", "20240115", "x2024-01-06", "", "2024-02-30", "　2024-01-06", "٠2024-01-06", None, 5, True, 2024.5, ["2024-01-06"], {"e": "2024-01-06"}]
    records = [{"d": {"at": t}} for t in texts] + [{"d": "2024-01-06"}, {"d": [{"at": "2024-01-06"}]}, {}]
    c = connector([("", {"data": records})], pagination=False)
    got = c.raw_records(spark, day=("d", "at"))
    plain = values.parse_date(paths.json_path(F.col("raw"), ("d", "at")))
    found = got.select(F.col("day").try_cast("date").alias("a"), plain.alias("b")).collect()
    assert [r["a"] for r in found] == [r["b"] for r in found] and sum(r["a"] is not None for r in found) == 3
    assert connector([("", {"data": records})], pagination=False).raw_records(spark).columns == ["ordinal", "raw"]


def test_batches_come_to_the_driver_packed(spark, monkeypatch):
    monkeypatch.setattr(rest, "PACK", 40)
    records = [{"i": i, "t": "ü,]" * (i % 5)} for i in range(230)]
    taken, kind = [], type(spark.range(1))
    whole = kind.toLocalIterator
    monkeypatch.setattr(kind, "toLocalIterator", lambda df, *a, **k: (taken.append(r) or r for r in whole(df, *a, **k)))
    got = list(connector([("", {"data": records})], pagination=False).stream(spark, batch_size=50))
    assert [len(b) for b in got] == [50, 50, 50, 50, 30] and [r for b in got for r in b] == records
    assert len(taken) < len(records)


def test_records_written_at_once_are_those_written_one_by_one():
    odd = [{}, {"a": "}, {"}, {"a": [{}, {"b": 1}, {}]}, {"a": "x\ny\u2028\r"}, {"}, {": None}, {"a": {"b": {}}}]
    for records in (odd, odd[:1] * 3, [odd[3], odd[5], odd[0]], [odd[1]], odd[2:3], []):
        assert rest._texts(records, rest._encoder()) == [json.dumps(x, ensure_ascii=False) for x in records]
    written = []
    assert rest._texts([{"a": i} for i in range(50)], lambda x: written.append(x) or json.dumps(x, ensure_ascii=False))[49] == '{"a": 49}'
    assert len(written) == 1


def test_pages_beside_each_other_share_what_the_site_wrote(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sites, "PIECE", 70)
    spark.range(1000).selectExpr("id as event_id", "timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, int(id % 40)) as ts", "id as user_id", "'view' as event_type").write.parquet(str(tmp_path / "events.parquet"))
    site, whole = sites.TableSite(spark, str(tmp_path)), sites._values
    written = []
    monkeypatch.setattr(sites, "_values", lambda column: written.append(len(column)) or whole(column))
    assert [r["event_id"] for at in range(0, 1000, 30) for r in sites._records(site.path, at, at + 30, None)] == list(range(1000))
    assert sum(written) == 4 * 1000
    days = ("2024-01-05", "2024-01-06")
    assert [r["event_id"] for at in range(0, 50, 9) for r in sites._records(site.path, at, at + 9, days)] == [i for i in range(1000) if i % 40 in (4, 5)]


def test_the_reader_leaves_out_valid_dates_beyond_the_window(spark):
    texts = ["2024-01-04", "2024-01-05", "2024-01-06T23:00:00", " 2024-01-07", "2024-01-08", "2024-02-30", None, "0000-01-01"]
    c = connector([("", {"data": [{"at": t, "i": i} for i, t in enumerate(texts)]})], pagination=False)
    got = lambda **k: [(r["ordinal"], r["day"]) for r in c.raw_records(spark, day=("at",), **k).orderBy("ordinal").collect()]
    assert got(within=IncrementalWindow(date(2024, 1, 5), date(2024, 1, 7), None)) == [(1, "2024-01-05"), (2, "2024-01-06"), (3, "2024-01-07"), (5, "2024-02-30"), (6, None), (7, "0000-01-01")]
    assert [n for n, _ in got(within=IncrementalWindow(None, date(2024, 1, 6), None))] == [0, 1, 2, 5, 6, 7]
    assert [n for n, _ in got()] == list(range(8))


def test_pages_are_staged_once_and_go(spark):
    def left():
        return [p.rpartition("/")[2].partition("-")[0] for own, p in session_module._STAGED if own is spark and p not in before]

    def dated(**options):
        return connector([("", {"data": [{"at": "2024-01-06", "i": i % 3} for i in range(9)]})], pagination=False, date_field="at", incremental=IncrementalStrategy(MemoryStateStore(), "k", initial_start="2024-01-05"), **options)

    before = {p for _, p in session_module._STAGED}
    with dated().session(spark, "2024-01-20") as s:
        assert s.records.count() == 9 and s.records.columns == ["ordinal", "raw"] and left() == ["pages"]
    s.release()
    assert left() == []
    with dated(select="i", primary_key="i", dedup=True).session(spark, "2024-01-20") as s:
        assert s.records.count() == 3 and left() == ["records"]
    s.release()


def test_a_profile_leaves_no_pages(spark):
    before = {p for _, p in session_module._STAGED}
    c = connector([("", {"data": [{"i": i} for i in range(9)]})], pagination=False)
    assert c.profile(spark, "count").records == 9
    assert not [p for _, p in session_module._STAGED if p not in before and "/pages-" in p]


def test_a_landed_step_leaves_nothing_staged(spark, tmp_path):
    c = connector([("", {"data": [{"at": "2024-01-06", "i": i} for i in range(9)]})], pagination=False, date_field="at", incremental=IncrementalStrategy(MemoryStateStore(), "k", initial_start="2024-01-05"))
    before = {p for _, p in session_module._STAGED}
    sink = ParquetDestination(str(tmp_path / "lake"))
    assert Pipeline([(c, None, "bronze.t")], sink).run(spark, "2024-01-20").rows_loaded == 9
    assert sink.read(spark, "bronze.t").count() == 9
    assert not [p for _, p in session_module._STAGED if p not in before]


@pytest.mark.parametrize("name", ["incremental_windows", "pipeline_landed", "pipeline_log"])
def test_two_extractions_share_one_site(spark, name, monkeypatch):
    built, site = [], sites.TableSite
    monkeypatch.setattr(sites, "TableSite", lambda *a: built.append(a) or site(*a))
    sites.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert len(built) == 1
