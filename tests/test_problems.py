"""Problems 1 and 3 to 5 on small cases: nulls, blanks, ties, repeats, empty tables, clashing names."""

import json
import random

import duckdb
import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from sedimenta.operators import drift, profile, shred, upsert
from sedimenta.operators.firstkeep import collapse_sorted_runs
from sedimenta.plans import problems

ORDERS = "ordinal long, _source string, _run_id string, id string, _raw string, field string"


def deliveries(spark, items):
    """(source, run, raw object or text); an extra column has a clashing name."""
    out = []
    for i, (s, f, o) in enumerate(items):
        raw = o if isinstance(o, str) or o is None else json.dumps(o)
        v = o.get("id") if isinstance(o, dict) else None
        out.append((i, s, f, None if v is None else v if isinstance(v, str) else json.dumps(v), raw, "x"))
    return spark.createDataFrame(out, ORDERS)


def test_file_changes(spark):
    df = deliveries(spark, [
        ("a", "f1", {"id": 1, "x": {"y": 2}, "tag": "t1", "old": "v1", "gone": None}),
        ("a", "f1", {"id": 2, "tag": "t2", "old": "v2"}),
        ("a", "f1", None), ("a", "f1", "not json"), ("a", "f1", "[1]"),
        ("a", "f2", {"id": 1, "X-Y": 3, "tag": 5, "new": "v2", "flag": True, "e": {}}),
        ("a", "f2", {"id": 2, "tag": 6, "new": "v9", "gone": None}),
        ("b", "f3", {"id": 1}),
        (None, None, {"n": 1}), (None, "g", {"n": 1.0}),
        ("a", "f4", None),
    ])
    assert rows(drift.file_changes(df)) == sorted([
        ("a", "f2", "renamed", "X_Y", "x_y"), ("a", "f2", "retyped", "tag", ""), ("a", "f2", "renamed", "new", "old"), ("a", "f2", "added", "flag", ""),
        (None, "g", "retyped", "n", ""),
        *[("a", "f4", "removed", f, "") for f in ("id", "X_Y", "tag", "new", "flag")],
    ], key=repr)


def test_file_changes_without_rows(spark):
    assert rows(drift.file_changes(deliveries(spark, []))) == []


def test_renames_pair_once_and_need_the_type(spark):
    df = deliveries(spark, [("a", "1", {"p": "k", "q": "k", "n": 1}), ("a", "2", {"r": "k", "N": "1"})])
    assert rows(drift.file_changes(df)) == sorted([("a", "2", "renamed", "r", "p"), ("a", "2", "removed", "q", ""), ("a", "2", "removed", "n", ""), ("a", "2", "added", "N", "")], key=repr)


def test_rename_values_beyond_the_broadcast_limit(spark, monkeypatch):
    df = deliveries(spark, [("a", "1", {"p": "k", "z": 1}), ("a", "2", {"r": "k", "z": 2})])
    expected = rows(drift.file_changes(df))
    monkeypatch.setattr(drift, "size_checked", lambda *a, **k: (False, 0))
    assert rows(drift.file_changes(df)) == expected == [("a", "2", "renamed", "r", "p")]


def test_rescue_and_replay(spark):
    df = spark.createDataFrame([(1, "7", '{"status": "ok", "k": "1"}', "z"), (2, "x", None, "z"), (3, None, "broken", "z"), (4, "9", '{"status": null}', "z")], "ordinal int, amount string, _extra string, _rescued string")
    out = drift.rescue_ingest(df, {"amount": "int", "absent": "date"}, promote={"status": "string"})
    got = {r["ordinal"]: r for r in out.collect()}
    assert got[1]["amount"] == 7 and got[1]["status"] == "ok" and json.loads(got[1]["__rescued"]) == {"k": "1"} and got[1]["_rescued"] == "z"
    assert got[2]["amount"] is None and json.loads(got[2]["__rescued"]) == {"amount": "x"}
    assert json.loads(got[3]["__rescued"]) == {"_broken": "broken"} and got[3]["absent"] is None
    again = drift.replay_rescued(out, "k", "int", rescued="__rescued")
    assert {r["ordinal"]: (r["k"], r["__rescued"]) for r in again.collect()}[1] == (1, None)


def test_rescue_keeps_types_and_exact_texts(spark):
    extras = ['{"a":1,"b":"1","c":true,"d":1.10,"e":{"x":1.0},"f":[1, "é"],"g":null,"h":12345678901234567890123}', '{"a":1,"a":2}', '{"n":"7","ok":"true"}', '{"n":7,"ok":true}', "[1]", " ", '{"n":7} x', '{"n":NaN}', '{"u":"\\u00e9","n":1e400}', '{"k\'ey":1,"":2}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(extras)], "i int, _extra string")
    out = {r["i"]: r for r in drift.rescue_ingest(df, {}, promote={"n": "double", "ok": "boolean"}).collect()}
    left = [out[i]["_rescued"] for i in range(len(extras))]
    assert left[0] == extras[0] and left[1] == '{"a":2}' and left[2] == '{"ok":"true"}' and left[3] is None and left[5] is None
    assert [json.loads(left[i])["_broken"] for i in (4, 6, 7)] == [extras[i] for i in (4, 6, 7)]
    assert left[8] == '{"u":"\\u00e9","n":1e400}' and json.loads(left[9]) == {"k'ey": 1, "": 2}
    assert (out[2]["n"], out[2]["ok"], out[3]["n"], out[3]["ok"]) == (7.0, None, 7.0, True)


def test_casts_that_would_change_a_value_are_rescued(spark):
    cases = [("12.345", "decimal(18,2)"), ("12.30", "decimal(18,2)"), ("9007199254740993", "double"), ("0.1", "double"), ("1e3", "double"), ("NaN", "double"), ("3.5", "bigint"), ("3", "bigint"), ("2024-02-30", "date"), ("2024-02-29", "date"),
             ("2024-02-29T10:00:00", "date"), ("2024-02-29T10:00:00.1234567", "timestamp"), ("2024-02-29T10:00:00.123456", "timestamp"), ("yes", "boolean"), ("TRUE", "boolean"), ("x", "string")]
    kept = [spark.createDataFrame([(t,)], "t string").select(drift.exact_cast(F.col("t"), k).isNotNull()).first()[0] for t, k in cases]
    assert kept == [False, True, False, True, True, False, False, True, False, True, False, False, True, False, True, True]


def test_slices():
    assert drift.record_slices(' { "a" : 1 , "b":{"c": [1,{"d":2}] ,"c":2.50} } ') == {"a": ("integer", "1"), "b": {"c": ("number", "2.50")}}
    for bad in ("", "{", '{"a"}', '{"a":}', '{"a":1,}', '{"a":1}}', "{'a':1}", '{"a":1 "b":2}', '{"a":[1}', "1", "null", '{"a":-Infinity}', '{"a":' * 5000):
        assert drift.record_slices(bad) is None, bad
    assert [x[0] for x in drift.flatten_slices(drift.record_slices('{"a":{"b":1,"e":{}},"9":[],"x-y":null}'))] == ["a_b", "a_e", "_9", "x_y"]


def test_paths_that_share_a_name_are_all_kept(spark):
    df = spark.createDataFrame([('{"a":{"b":null},"a_b":2,"a-b":3}',)], "raw string")
    r = df.select(drift.lift(F.col("raw"), [], deep=True).alias("x")).select("x.*").first()
    assert json.loads("{" + r["rest"] + "}") == {"a_b": 2, "a-b": 3} and r["shape"] == "a_b\x1einteger"


def test_collapse_sorted_runs(spark):
    df = spark.createDataFrame([(3, b"k"), (1, b"k"), (2, None), (5, None), (4, b"j")], "n int, k binary").coalesce(1)
    assert sorted((r["n"], r["again"]) for r in collapse_sorted_runs(df, "k", "n", "again").collect()) == [(1, False), (2, False), (3, True), (4, False), (5, True)]


PAGES = "page_id long, source string, raw string, node_path string"


def test_shredding(spark):
    body = {"d": {"list": [{"a": [{"b": 1}, 5, {"c d": [[{"z": None}], {}]}], "o": {"in": [{"k": "v"}]}}, 7, [{"q": 1}]]}}
    pages = spark.createDataFrame([(1, "p", json.dumps(body), ""), (2, "p", json.dumps({"d": {}}), ""), (3, "p", None, ""), (4, "p", "  ", ""), (5, "p", '{"d": [1', ""), (6, "n", '[{"x": 1}]', ""), (7, "n", '{"x": 1}', ""), (8, "n", "3", ""), (9, "q", "[]", ""), (10, None, "[]", ""), (11, "n", "[NaN]", "")], PAGES)
    probes = spark.createDataFrame([("p", 1, "old", 200), ("p", 2, "d.list", 200), ("p", 3, None, 500), ("n", 1, None, 200), ("q", 1, "x", 404)], "source string, probed_at int, records_path string, status_code int")
    nodes = shred.page_nodes(pages, probes, scalars=False)
    got = rows(shred.listed(nodes).select("page_id", "record_no", "node_path", "parent_path"))
    assert got == sorted([
        (1, 0, "$", ""), (1, 0, "$.a[0]", "$"), (1, 0, "$.a[2]", "$"), (1, 0, '$.a[2]["c d"][0][0]', "$.a[2]"), (1, 0, '$.a[2]["c d"][1]', "$.a[2]"), (1, 0, "$.o.in[0]", "$"),
        (1, 1, "$", ""), (1, 2, "$", ""), (1, 2, "$[0]", "$"), (6, 0, "$", ""), (7, 0, "$", ""),
    ], key=repr)
    assert rows(shred.page_nodes(pages.limit(0), probes)) == []


def test_entities(spark, records):
    df = records([{"id": 1, "lines": [{"sku": "a", "qty": 2, "p": {"n": "x"}}, {"sku": "b", "qty": "many"}, 3]}, {"id": 2, "lines": []}])
    nodes = shred.shred(df, "ordinal", "raw")
    assert nodes.columns[0] == "_ordinal"  # clashes with the position column
    out = shred.entity_table(nodes.withColumnRenamed("_ordinal", "page"), "page", "$[]", {})
    assert rows(out) == []
    items = shred.entity_table(nodes.withColumnRenamed("_ordinal", "page"), "page", "$.lines[]", {"sku": "string", "qty": "int", "p.n": "string"})
    assert sorted((r["page"], r["node_path"], r["sku"], r["qty"], r["p_n"]) for r in items.collect()) == [(0, "$.lines[0]", "a", 2, "x"), (0, "$.lines[1]", "b", None, None)]
    shape = {r["entity"]: r["nodes"] for r in shred.record_counts(nodes, "_ordinal").collect()}
    assert shape == {"$": 2, "$.lines[]": 2}


def test_labels_tell_keys_with_dots_apart(spark, records):
    nodes = shred.shred(records([{"a": {"b": 1}, "a.b": 2, "9": 3, "x": [{"p": {"q": "in"}, "p.q": "out"}]}]), "ordinal", "raw").cache()  # the key clashes: _ordinal
    r = shred.entity_table(nodes, "_ordinal", "$", {"a.b": "int"}).first()
    assert r["a_b"] == 1
    whole = shred.whole_entity(nodes, "_ordinal", ["$"], {"a.b": "int"}).first().asDict()
    assert whole["a_b"] == 1 and 2 in whole.values() and 3 in whole.values()  # columns by path
    assert set(r["label"] for r in nodes.filter("label is not null").collect()) >= {"a.b", '["a.b"]', '["9"]', "p.q", '["p.q"]'}


def test_redelivered(spark):
    df = deliveries(spark, [
        ("a", "1", {"id": "x"}), ("a", "1", {"id": "x"}), ("b", "1", {"id": "x"}), ("a", "2", {"id": 5}), ("a", "2", {"id": "5"}), ("a", "2", {"id": None}), ("a", "2", {}), ("a", "2", {"id": " \xa0"}), ("a", "2", {"id": " \xa0"}),
        ("a", "3", {"id": [1]}), ("a", "3", {"id": [1]}), ("a", "3", {"id": "[1]"}), ("a", "3", {"id": "[1]"}), (None, "3", {"id": "x"}), (None, "3", {"id": "x"}), ("a", "4", {"id": "x"}), ("", "5", {"id": "x"}),
    ]).repartition(3)
    assert rows(upsert.redelivered(df)) == [(1,), (12,), (14,), (15,), (4,)]
    assert upsert.exactly_once(df).count() == 12 and set(upsert.exactly_once(df).columns) == set(df.columns)
    assert rows(upsert.redelivered(df.limit(0))) == []


def test_upsert_of_a_batch_again_replaces_it(spark):
    batch = lambda *r: spark.createDataFrame(r, "key string, ord long")
    store = upsert.BucketedRuns(spark, 3)
    store.upsert(batch(("k", 1), ("j", 2)), "one", "key", "ord")
    store.upsert(batch(("k", 3), (None, 4), (None, 5)), "two", "key", "ord")
    store.upsert(batch(("k", 3), (None, 4), (None, 5)), "two", "key", "ord")
    got = sorted((r["ord"], r["copy"]) for r in store.merged("key", "ord").collect())
    assert got == [(1, 1), (2, 1), (3, 2), (4, 1), (5, 1)]
    plan = store.merged("key", "ord")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1  # the layout of the runs is the partitioning
    store.drop()


def test_runs_merge_without_exchange_or_sort_and_compact(spark):
    store = upsert.BucketedRuns(spark, 3)
    rng = random.Random(3)
    items = [(rng.choice(["a", "ab", "b\0", "b", "é", "k" * 500, *map(str, range(40))]), i, f"run {i % 7}") for i in range(1000)]
    df = spark.createDataFrame(items, "key string, ord long, batch string").repartition(5)
    store.upsert_many(df.filter("ord < 900"), "batch", "key", "ord", 4)
    store.upsert(df.filter("ord >= 900"), "late", "key", "ord")
    plan = store.merged()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan
    first = {}
    for k, i, _ in items:
        first.setdefault(k, i)
    done = store.compact()
    assert sorted(r["ord"] for r in done.filter("copy = 1").collect()) == sorted(first.values()) and done.count() == 1000
    assert len(store.runs) == 1 and sorted(r["ord"] for r in store.merged().filter("copy = 1").collect()) == sorted(first.values())
    store.upsert(spark.createDataFrame([("a", 5000), ("new", 5001)], "key string, ord long"), "next", "key", "ord")
    assert {r["ord"]: r["copy"] for r in store.merged().filter("ord >= 5000").collect()} == {5000: 2, 5001: 1}
    store.drop()


def test_merging_sorted_runs():
    rng = np.random.default_rng(4)
    runs = []
    for n in (0, 1, 50, 700):
        keys, order = rng.choice(["a\x01", "ab\x01", "abc\x01", "z\x01"], n).astype("S"), rng.permutation(np.arange(-n, n))[:n]
        by = np.lexsort([order, keys])
        runs.append((keys[by], order[by]))
    keys, order = upsert.merge_runs(runs)
    every = sorted((k, o) for ks, os in runs for k, o in zip(ks.tolist(), os.tolist()))
    assert list(zip(keys.tolist(), order.tolist())) == every and len(upsert.merge_runs([])[0]) == 0


def test_stores_leave_nothing_behind(spark):
    from sedimenta import session

    df = deliveries(spark, [("a", "1", {"id": "x"}), ("a", "2", {"id": "x"}), ("a", None, {"id": "y"})])
    before = {t.name for t in spark.catalog.listTables()}
    assert rows(upsert.redelivered(df)) == [(1,)] and rows(upsert.redelivered(df.drop("_run_id"))) == [(1,)]
    assert {t.name for t in spark.catalog.listTables()} == before
    session.release(spark)
    assert not [x for x in session._STAGED if x[0] is spark]


def test_hot_key_is_spread(spark):
    df = spark.range(40_000).select(F.col("id").alias("ordinal"), F.lit("a").alias("_source"), F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("id"), F.lit("{}").alias("_raw"))
    found = upsert.redelivered(df.repartition(8))
    assert found.count() == 13_333


def test_load_findings(spark):
    good = lambda i: {"id": i, "email": f"u{i}@mail.example", "name": "n", "active": True, "tags": ["a"], "meta": {"score": 10}, "updated_at": "2026-01-31T10:00:00Z"}
    load1 = [good(i) for i in range(8)]
    load2 = [good(i) | {"meta": {"score": 20}, "active": i > 3} for i in range(8)]
    load2[0] |= {"email": "no-mail", "updated_at": "2026-02-30", "id": "x"}
    for r in load2[:4]:
        r["name"] = None
        del r["tags"]
    data = [(n, s, load, json.dumps(r), "z") for n, (s, load, r) in enumerate([("a", 1, r) for r in load1] + [("a", 2, r) for r in load2])] + [(99, "b", 1, None, "z")]
    df = spark.createDataFrame(data, "record_no long, source string, load_no int, raw string, path string")
    profiles = spark.createDataFrame([("a", 1, "id", 8, 0, 0, {"integer": 8}), ("a", 2, "id", 8, 0, 0, {"integer": 8}), ("a", 1, "name", None, None, None, None), ("a", 1, "nothing", 0, 0, 8, {}), ("a", 1, "tags", 8, 1, 0, None)], "source string, load_no int, path string, records_present long, nulls long, missing long, types map<string,long>")
    summaries = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 1, None)], "source string, load_no int, mixed_type_fields long")
    assert rows(profile.load_findings(df, profiles, summaries)) == sorted([
        ("a", 2, "id", "mixed_types"), ("a", 2, "name", "null_shift"), ("a", 2, "tags", "null_shift"), ("a", 2, "meta.score", "value_shift"), ("a", 2, "active", "value_shift"),
        ("a", 2, "email", "bad_pattern"), ("a", 2, "updated_at", "bad_pattern"), ("a", 2, "id", "wrong_profile"), ("a", 1, "tags", "wrong_profile"), ("a", 2, "", "wrong_summary"),
    ], key=repr)
    assert rows(profile.load_findings(df.limit(0), profiles.limit(0), summaries.limit(0))) == []


def test_patterns():
    for text, bad in {"a@b.c": 0, "a@b": 1, "@b.c": 1, "a@@b.c": 1, "a b@c.d": 1, "a@b..c": 1, "a@.b.c": 1, "a@b.c.": 1}.items():
        assert profile.bad_email(text) == bool(bad), text
    for text, bad in {"2026-02-28": 0, "2026-02-29": 1, "2024-02-29T23:59:59.5-03:00": 0, "2026-01-01 10:00:00": 0, "2026-01-01T10:00": 1, "2026-1-1": 1, "2026-01-01T25:00:00Z": 1, "٢٠٢٦-01-01": 1, "2026-01-01\n": 1, "20260101": 1}.items():
        assert profile.bad_timestamp(text) == bool(bad), text


def test_exact_medians(spark):
    import statistics

    rng = random.Random(4)
    data = [(g, rng.choice([rng.randint(-5, 5), rng.random() * 1e6, 3.5])) for g in "abc" for _ in range(rng.randint(1, 300))]
    freq = spark.createDataFrame([("s" + g, 1, "p", "number", float(v), 1) for g, v in data], "source string, load_no int, path string, kind string, number double, n long")
    got = {r["source"]: r["median"] for r in profile.exact_medians(freq, ["source", "load_no"], "p").collect()}
    assert got == {"s" + g: statistics.median(v for h, v in data if h == g) for g in "abc"}


def test_drift_statistics(spark):
    same = [("s", load, json.dumps({"v": i % 4})) for load in (1, 2) for i in range(400)]
    moved = [("t", load, json.dumps({"v": i % 4 if load == 1 else 0})) for load in (1, 2) for i in range(400)]
    df = spark.createDataFrame(same + moved, "source string, load_no int, raw string")
    got = {r["source"]: (r["psi"], r["chi_square"]) for r in profile.load_drift(profile.path_value_counts(df, ["source", "load_no"], "raw")).collect()}
    assert got["s"] == pytest.approx((0, 0)) and got["t"][0] > 1 and got["t"][1] > 100


def test_page_tables_hold_every_object_and_scalar(spark, tmp_path):
    """Every listed object of the pages is in one table, with every scalar below it."""
    from sedimenta.plans import problems

    line = lambda n: {"sku": f"s{n}", "qty": n if n % 2 else "many", "product": {"name": "p", "attrs": [{"k": "c", "v": n}]}, "discounts": [{"code": "d", "amount": 1.5, "rules": [{"kind": "r", "value": n}]}]}
    data = [
        {"id": 1, "customer": {"id": 7, "contacts": [{"kind": "tel", "rank": 1}]}, "note": None, "tags": ["a", None, "b"], "lineItems": [line(1), 5], "meta": {"score": 3, "audit.trail": [{"by": "x", "step": 1}]}},
        {"id": 2, "line-items": [line(2)], "items": [line(3)], "shipments": [{"carrier": "c", "address": {"city": "C", "geo": {"zone": 4}}, "events": [{"status": "ok", "at": "t"}]}], "bundles": [[{"sku": "z", "parts": [{"no": 1}]}]], "novel": [{"a": {"b": 1}, "ordinal": "o"}]},
        "text", None, [{"deep": 2}],
    ]
    spark.createDataFrame([(1, "s", json.dumps(data)), (2, "s", None)], "page_id long, source string, raw string").write.parquet(str(tmp_path / "parsed_pages.parquet"))
    spark.createDataFrame([("s", 1, None, 200)], "source string, probed_at int, records_path string, status_code int").write.parquet(str(tmp_path / "probe_results.parquet"))
    queries, d = problems.queries(), str(tmp_path)
    tables = {n: queries[n](spark, d) for n in [*problems.PAGE_ENTITIES, "p3_other_objects"]}
    keys = ("page_id", "record_no", "node_path", "parent_path")
    assert sorted((r for t in tables.values() for r in rows(t.select(*keys))), key=repr) == rows(queries["p3_found"](spark, d))
    records = {r["record_no"]: r for r in tables["p3_records"].collect()}
    assert (records[0]["id"], records[0]["customer_id"], records[0]["meta_score"], records[1]["id"]) == (1, 7, 3, 2)
    assert sorted((r["sku"], r["qty"], r["product_name"]) for r in tables["p3_line_items"].collect()) == [("s1", "1", "p"), ("s2", "many", "p"), ("s3", "3", "p")]
    assert rows(tables["p3_shipments"].select("carrier", "address_city", "address_geo_zone")) == [("c", "C", 4)]
    assert sorted((r["entity"], r["fields"].get(".a.b") or r["fields"].get(".deep")) for r in tables["p3_other_objects"].collect()) == [("$.novel[]", "1"), ("$[]", "2")]
    values = rows(queries["p3_values"](spark, d).select("record_no", "node_path", "kind", "value"))
    assert values == sorted([(0, "$.tags[0]", "string", "a"), (0, "$.tags[1]", "null", None), (0, "$.tags[2]", "string", "b"), (0, "$.lineItems[1]", "integer", "5"), (2, "$", "string", "text"), (3, "$", "null", None), (4, "$", "array", None)], key=repr)


def test_drift_of_many_values_and_of_paths_in_one_load(spark):
    rng = random.Random(3)
    made = lambda load, f: [("s" if f is not None else None, load, json.dumps(f(i))) for i in range(400)]
    steady = lambda i: {"far": rng.gauss(50, 9), "day": f"2026-01-{rng.randint(1, 28):02d}", "word": rng.choice("abcd"), "key": f"k{rng.random()}", "some": 1, "old": i}
    moved = lambda i: {"far": rng.gauss(90, 9), "day": f"2026-03-{rng.randint(1, 28):02d}", "word": rng.choice("aaab"), "key": "same" if i % 2 else f"k{rng.random()}", "new": i} | ({"some": 1} if i % 2 else {})
    df = spark.createDataFrame([*made(1, steady), *made(2, steady), *made(3, moved), (None, 1, '{"x": 1}'), (None, 2, '{"y": 1}')], "source string, load_no int, raw string")
    got = {(r["source"], r["load_no"], r["path"]): r for r in profile.load_drift(profile.path_value_counts(df, ["source", "load_no"], "raw")).collect()}
    for path in ("far", "day", "word", "key", "some"):
        assert got["s", 2, path]["psi"] < 0.2 and got["s", 3, path]["psi"] > 0.4, path
    assert got["s", 3, "far"]["psi"] > 3 and got["s", 3, "day"]["psi"] > 3
    assert (got["s", 3, "old"]["n"], got["s", 3, "old"]["missing"], got["s", 3, "new"]["n_before"], got["s", 3, "new"]["missing_before"]) == (0, 400, 0, 400)
    assert got["s", 3, "old"]["psi"] > 3 and got["s", 3, "new"]["chi_square"] > 400
    assert {k for k in got if k[0] is None} == {(None, 2, "x"), (None, 2, "y")} and not [k for k in got if k[1] in (1, 4)]


def test_moments():
    from datetime import datetime

    for text in ("2026-02-28", "2024-02-29T23:59:59.5-03:00", "2026-01-01 10:00:00", "1969-12-31T23:00:00Z", "2026-01-01T00:30:00+05:30"):
        at = datetime.fromisoformat(text)
        assert profile.moment(text) == round((at if at.tzinfo else at.replace(tzinfo=__import__("datetime").timezone.utc)).timestamp() * 1e6), text
    assert profile.moment("2026-02-30") is None and profile.moment("plain text here") is None


def test_profile_has_patterns_and_ranges_of_text(spark, tmp_path):
    from sedimenta.plans import problems

    data = [{"email": "a@b.example", "updated_at": "2026-01-31T10:00:00+02:00"}, {"email": "no-mail", "updated_at": "2026-02-30"}, {"email": " ", "updated_at": "2025-12-01"}, {"email": 5}]
    spark.createDataFrame([("s", 1, json.dumps(r)) for r in data], "source string, load_no int, raw string").write.parquet(str(tmp_path / "profile_records.parquet"))
    got = {r["path"]: r for r in problems.p5_profile(spark, str(tmp_path)).withColumns({c: F.col(c).cast("string") for c in ("min_time", "max_time")}).collect()}
    assert (got["email"]["bad_values"], got["email"]["min_length"], got["email"]["max_length"], got["email"]["min_time"]) == (1, 1, 11, None)
    assert (got["updated_at"]["bad_values"], got["updated_at"]["min_time"], got["updated_at"]["max_time"]) == (1, "2025-12-01 00:00:00", "2026-01-31 08:00:00")


def test_quantiles_of_crowded_values(spark):
    rng = np.random.default_rng(5)
    groups = {"crowd": [float(x) for x in rng.integers(0, 1000, 5000)] + [1e15], "hot": [7.0] * 900 + [1.0] * 100, "one": [-0.5], "wide": [float(x) for x in rng.normal(0, 1e6, 501)], "close": [1.0 + i * 2.0**-52 for i in range(64)]}
    rows_ = [(g, "p", "number", v, 1) for g, vs in groups.items() for v in vs]
    freq = spark.createDataFrame(rows_, "source string, path string, kind string, number double, n long").groupBy("source", "path", "kind", "number").agg(F.sum("n").alias("n"))
    assert {r["source"]: r["median"] for r in profile.exact_medians(freq, ["source"], "p").collect()} == {g: float(np.median(v)) for g, v in groups.items()}
    ranks = [F.lit(0), F.col("total") - 1, F.floor(F.col("total") / 4)]
    for size_checked in (profile.size_checked, lambda *a: (False, 0)):
        profile_size, profile.size_checked = profile.size_checked, size_checked
        try:
            placed = freq.withColumn("place", profile._places(F.col("number")))
            got = {(r["source"], r["rank"]): r["number"] for r in profile.exact_quantiles(placed, ["source"], ranks).collect()}
        finally:
            profile.size_checked = profile_size
        for g, v in groups.items():
            v = sorted(v)
            assert all(got[g, k] == v[k] for k in (0, len(v) - 1, len(v) // 4))


def test_places_order_like_numbers():
    numbers = sorted([0.0, 1.0, -1.0, 1e300, -1e300, 5e-324, -5e-324, float("inf"), float("-inf"), 3.14, -2.5])
    assert [profile.place_of(x) for x in numbers] == sorted(profile.place_of(x) for x in numbers) and profile.place_of(-0.0) == profile.place_of(0.0)


def test_numbers_beyond_doubles_and_deep_records(spark):
    data = ['{"a": 1}', '{"a": 1%s}' % ("0" * 309), '{"a": 1e400}', '{"a": -1%s}' % ("0" * 309), '{"b":' * 600 + "1" + "}" * 600, "[" * 100_000]
    df = spark.createDataFrame([("s", x) for x in data], "source string, raw string")
    got = {r["path"]: r for r in profile.field_report(profile.path_value_counts(df, ["source"], "raw"), ["source"]).collect()}
    assert set(got) == {"a"} and (got["a"]["records"], got["a"]["missing"], got["a"]["distinct_values"]) == (6, 2, 4)
    assert (got["a"]["min_number"], got["a"]["max_number"]) == (float("-inf"), float("inf"))


def test_shifted_numbers_stand_out(spark):
    rng = random.Random(8)
    data = [("s", load, json.dumps({"x": rng.gauss(100, 20) * (2 if load == 3 else 1), "day": f"2026-0{load}-{rng.randint(10, 28)}", "c": rng.choice("abc")})) for load in (1, 2, 3) for _ in range(400)]
    freq = profile.path_value_counts(spark.createDataFrame(data, "source string, load_no int, raw string"), ["source", "load_no"], "raw").cache()
    got = {(r["load_no"], r["path"]): r for r in profile.load_drift(freq).collect()}
    assert got[2, "x"]["psi"] < 0.25 < 2 < got[3, "x"]["psi"] and got[3, "x"]["chi_square"] > 5 * got[2, "x"]["chi_square"]
    assert got[2, "c"]["psi"] < 0.1 and got[3, "c"]["psi"] < 0.1 and got[2, "day"]["psi"] > 2


# ---- every query against its SQL -----------------------------------------------------------------

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(problems.oracle_sql()))
def test_query_equals_sql(spark, name):
    import os

    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{DATA}/{f}')")
    df = problems.queries()[name](spark, DATA)
    names = sorted(df.columns)
    cursor = con.execute(problems.oracle_sql()[name])
    found = [c[0] for c in cursor.description]
    expected = sorted((tuple(r[found.index(c)] for c in names) for r in cursor.fetchall()), key=repr)
    assert sorted(found) == names and sorted((tuple(r[c] for c in names) for r in df.collect()), key=repr) == expected
