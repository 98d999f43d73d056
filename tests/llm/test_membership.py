"""Problem 2: filters, store and verdicts against brute force."""

import hashlib
import json

import numpy as np
from conftest import rows

from sedimenta.llm import membership


def fingerprint(source, ident):
    return hashlib.sha256(json.dumps([source, ident], ensure_ascii=False, separators=(",", ":")).encode()).digest()


ODD = ["plain", 'quo"te', "back\\slash", "tab\t", "ctl\x01\x1f\x7f", "é中🙂", "a/b", "new\nline", " "]


def test_seen_before(spark):
    keys = [("s", k) for k in ODD]
    seen = spark.createDataFrame([(bytearray(fingerprint(*k)), 1) for k in keys[::2]] + [(None, 1), (bytearray(b"short"), 1)], "fingerprint binary, arrival int")
    arrivals = [*keys, *keys[1::2], ("s", None), ("s", ""), ("s", "\xa0 \x1c"), (None, "plain"), ("t", "plain"), ("t", "plain")]
    df = spark.createDataFrame([(i, s, k, "x") for i, (s, k) in enumerate(arrivals)], "arrival_no long, source string, id string, fp string").repartition(3)
    known, expected = {fingerprint(*k) for k in keys[::2]}, []
    for i, (s, k) in enumerate(arrivals):
        if s is None or k is None or not k.strip():
            continue
        if fingerprint(s, k) in known:
            expected.append((i,))
        known.add(fingerprint(s, k))
    assert rows(membership.seen_before(df, seen, ["source", "id"], "arrival_no", id_key="id")) == sorted(expected, key=repr)
    assert rows(membership.seen_before(df.limit(0), seen, ["source", "id"], "arrival_no", id_key="id")) == []
    assert len(rows(membership.seen_before(df, seen.limit(0), ["source", "id"], "arrival_no", id_key="id"))) == 5


def test_filter_error_rate():
    rng = np.random.default_rng(1)
    for fpp in (0.01, 0.001):
        bloom = membership.BlockedBloom(50_000, fpp)
        keys = rng.integers(0, 2**64 - 1, 50_000, dtype=np.uint64)
        bloom.insert(keys)
        assert bloom.query(keys).all()
        assert bloom.query(rng.integers(0, 2**64 - 1, 200_000, dtype=np.uint64)).mean() < 1.6 * fpp


def test_errors_are_measured(spark):
    seen = spark.createDataFrame([(bytearray(fingerprint("s", str(i))),) for i in range(2000)], "fingerprint binary")
    df = spark.createDataFrame([(i, "s", str(i)) for i in range(1000, 3000)], "arrival_no long, source string, id string")
    r = membership.seen_before_errors(df, seen, ["source", "id"], "arrival_no", id_key="id", fpp=0.01).first()
    assert r["keys"] == 4000 and r["asked"] == 2000 and 1000 <= r["maybe"] <= 1060 and r["maybe"] - r["false_maybe"] == 1000 and 0 < r["absent_rate"] < 0.03
    none = membership.seen_before_errors(df.limit(0), seen.limit(0), ["source", "id"], "arrival_no").first()
    assert none["keys"] == 0 and none["incoming_rate"] is None


def test_store_takes_batches_and_grows(spark):
    fps = lambda ids: spark.createDataFrame([(bytearray(fingerprint("s", str(i))), i) for i in ids], "fp binary, arrival long").repartition(3)
    store = membership.SeenStore(spark, 4000, 0.001)
    store.insert(fps(range(1000)), 1000)
    first = store.ask(fps(range(500, 1500)))
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # the arrivals; stored keys and filters lie where they are needed
    got = {r["arrival"]: r["sure"] for r in first.collect()}
    assert all(got[i] == (i < 1000) for i in range(500, 1500))
    store.insert(fps(range(1000, 1500)), 500)
    asked = {r["arrival"]: r["sure"] for r in store.ask(fps(range(1400, 1600))).collect()}
    assert all(asked[i] == (i < 1500) for i in range(1400, 1600))
    maybe = [r["maybe"] for r in store.ask(fps(range(5000, 9000)), exact=False).collect()]
    assert len(maybe) == 4000 and sum(maybe) <= 20
    store = store.grown(50_000)
    again = {r["arrival"]: r["sure"] for r in store.ask(fps(range(1400, 1600))).collect()}
    assert again == asked
    store.drop()


def test_hot_keys_and_repeated_fingerprints(spark):
    df = spark.range(30_000).selectExpr("id as arrival_no", "'s' as source", "case when id % 3 = 0 then 'hot' else cast(id as string) end as id").repartition(6)
    seen = spark.createDataFrame([(bytearray(fingerprint("s", "1")),)] * 500, "fingerprint binary")
    assert membership.seen_before(df, seen, ["source", "id"], "arrival_no", id_key="id").count() == 9_999 + 1
