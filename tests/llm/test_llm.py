"""Encoding against the libraries, mixing against its budgets, residue against written cases."""

import json
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")

from sedimenta.llm import mixing, queries, residue  # noqa: E402
from sedimenta.llm.mixing import Part, fit_mix  # noqa: E402
from sedimenta.llm.tokenizer import ByteBPE, _Encoder, count_tokens, encode  # noqa: E402

BPE = ByteBPE(P.path("byte_bpe_50k.json"))
LIBRARY = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
LIBRARY.encode_special_tokens = True


def by_library(texts):
    return [e.ids for e in LIBRARY.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def ours(texts, encoder=None):
    ids, offsets = (encoder or _Encoder(BPE))(texts)
    ids = ids.tolist()
    return [ids[a:b] for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text(alphabet="ab '’sLtredvm\n\t\x00\xa0\x85　é中1²!<|>endoftx"), st.sampled_from(["<|endoftext|>", "a" * 999, "ab" * 500, "  \n  x"])), max_size=8))
def test_ids_equal_the_library(texts):
    assert ours(texts) == by_library(texts)


def test_every_code_point():
    texts = [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    assert ours(texts) == by_library(texts)


def test_kept_words_do_not_change_the_ids(monkeypatch):
    monkeypatch.setattr("sedimenta.llm.tokenizer.CACHE_WORDS", 3)
    encoder, rng = _Encoder(BPE), random.Random(2)
    for _ in range(30):
        texts = [" ".join(rng.choice(["alpha", "beta", "gamma9", "é"]) for _ in range(rng.randint(0, 9))) for _ in range(4)]
        assert ours(texts, encoder) == by_library(texts)


def test_encode(spark, monkeypatch):
    monkeypatch.setattr("sedimenta.llm.tokenizer.CHUNK_CHARS", 50)
    texts = ["Hello world", "", None, "  ", "Hello world", "<|endoftext|>", "long words " * 500]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r["doc_id"]: r["ids"] for r in encode(df, BPE).collect()}
    assert [got[i] for i in range(len(texts))] == by_library(texts)
    assert encode(df.limit(0), BPE).count() == 0
    sizes = count_tokens(df.withColumn("tokens", F.lit(1)), BPE)
    assert {r["doc_id"]: r["_tokens"] for r in sizes.collect()} == {i: len(x) for i, x in enumerate(by_library(texts))}
    assert encode(df.select(F.col("doc_id").alias("ids"), "text"), BPE, key="ids").columns == ["ids", "_ids"]


def test_fit_meets_targets_where_limits_allow():
    parts = [Part("m", "a", 3.0, 2, 1000), Part("m", "b", 1.0, 1, 1000)]
    assert fit_mix(parts, 1000) == 0 and [p.budget for p in parts] == [750, 250]


def test_fit_meets_limits():
    parts = [Part("m", "a", 0.9, 2, 100), Part("m", "b", 0.1, 1, 10_000)]
    e = fit_mix(parts, 1000)
    assert 0 < e < 1 and parts[0].budget == pytest.approx(200, rel=1e-6) and sum(p.budget for p in parts) == pytest.approx(1000)
    everything = [Part("m", "a", 0.9, 2, 100), Part("m", "b", 0.1, 1, 50)]
    fit_mix(everything, 1000)
    assert [p.budget for p in everything] == pytest.approx([200, 50])


def test_fit_to_an_entropy():
    parts = [Part("m", "a", 0.99, 9, 1000), Part("m", "b", 0.01, 9, 1000)]
    fit_mix(parts, 500, entropy=0.5)
    assert -sum(p.share * __import__("math").log(p.share) for p in parts) == pytest.approx(0.5, abs=1e-6)


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, rng.choice(["a", "a", "a", "b"]), rng.choice([0, 1, 5, 30])) for i in range(3000)] + [(9000, None, 4), (9001, "B ", 10)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long").withColumn("source", mixing.clean_source("source"))
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.4), ("m", "B", 0.5, 3, 0.4), ("m", "none", 0.3, 3, 0.4), ("n", "b", 1.0, None, 9.0), ("o", "a", None, 2, 1.0), (None, "a", 1.0, 1, 1.0)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    parts = mixing.plan_mixes(sized, targets)
    mixed = mixing.mix_documents(sized, parts).cache()
    used = {(r["mix"], r["source"], r["doc_id"]): r["copies"] for r in mixed.collect()}
    total = {s: sum(t for _, x, t in docs if x and x.strip().lower() == s) for s in "ab"}
    reached = {}
    for (m, s, d), n in used.items():
        assert n <= {"m": {"a": 1, "b": 3}, "n": {"b": 1}}[m][s]
        reached[m, s] = reached.get((m, s), 0) + n * next(t for i, _, t in docs if i == d)
    for p in parts:
        if p.budget:
            assert abs(reached[p.mix, p.source] - p.budget) <= 15.5
    assert reached["n", "b"] == total["b"]
    report = {(r["mix"], r["source"]): r for r in mixing.mix_report(mixed, parts).collect()}
    assert report["m", "none"]["reached_tokens"] == 0 and report["o", "a"]["reached_share"] is None
    assert report["m", "a"]["reached_share"] == pytest.approx(reached["m", "a"] / (reached["m", "a"] + reached["m", "b"]))
    assert sorted(used.items()) == sorted(((r["mix"], r["source"], r["doc_id"]), r["copies"]) for r in mixing.mix_documents(sized.repartition(7), parts).collect())


def test_schedule(spark):
    rng = random.Random(6)
    docs = [(i, "big" if i % 3 else "small", rng.randint(1, 9)) for i in range(6000)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    parts = [Part("m", "big", 0.5, 1, sum(t for _, s, t in docs if s == "big")), Part("m", "small", 0.5, 3, sum(t for _, s, t in docs if s == "small"))]
    fit_mix(parts, 25_000)
    uses = mixing.mix_schedule(sized, parts).collect()
    copies = {(r["source"], r["doc_id"]): r["copies"] for r in mixing.mix_documents(sized, parts).collect()}
    passes = {}
    for r in uses:
        passes.setdefault((r["source"], r["doc_id"]), []).append(r["pass_no"])
        assert 0 <= r["position"] <= 1
    assert {k: len(v) for k, v in passes.items()} == copies and all(sorted(v) == list(range(len(v))) for v in passes.values())
    uses.sort(key=lambda r: (r["position"], r["source"], r["doc_id"]))
    for i in range(0, len(uses) - 1000, 1000):  # each stretch has the shares of the whole
        piece = uses[i : i + 1000]
        assert abs(sum(r["tokens"] for r in piece if r["source"] == "small") / sum(r["tokens"] for r in piece) - 0.5) < 0.06
    first, second = ({r["doc_id"]: r["position"] for r in uses if r["source"] == "small" and r["pass_no"] == n} for n in (0, 1))
    assert sorted(first, key=first.get)[:20] != sorted(second, key=second.get)[:20]


def test_evenness(spark):
    sized = spark.createDataFrame([(i, s, 10) for i, s in enumerate("a" * 100 + "b" * 100)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 0.99, 9, 0.5), ("m", "b", 0.01, 9, 0.5)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    shares = [p.share for p in mixing.plan_mixes(sized, targets, evenness=0.9)]
    assert -sum(s * __import__("math").log(s) for s in shares) == pytest.approx(0.9 * __import__("math").log(2), abs=1e-6)


def test_mix_of_nothing(spark):
    sized = spark.createDataFrame([], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("m", "a", 1.0, 1, 1.0)], "mix string, source string, target_share double, max_repeats int, size_factor double")
    parts = mixing.plan_mixes(sized, targets)
    mixed = mixing.mix_documents(sized, parts)
    assert mixed.count() == 0 and mixing.mix_report(mixed, parts).count() == 1
    assert mixing.mix_report(mixing.mix_documents(sized, []), []).count() == 0


CASES = json.loads((Path(__file__).parent / "residue_cases.json").read_text(encoding="utf-8"))


@pytest.mark.parametrize("text", CASES["residue"])
def test_residue(text):
    assert residue.residue_kinds(text), text


@pytest.mark.parametrize("text", CASES["clean"])
def test_clean(text):
    assert residue.residue_kinds(text) == [], text


def test_detection(spark):
    texts = ["Dear {{name}}, the load is done.", None, "", " \xa0", "A plain sentence about loads.", "404 Not Found", "Dear {{name}}, the load is done.", "x" * 300_000, "word " * 60_000]
    df = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, __residue boolean")
    assert sorted(r["doc_id"] for r in residue.detect_residue(df).filter(F.size("kinds") > 0).collect()) == [0, 5, 6, 8]
    clean = residue.without_residue(df)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [1, 2, 3, 4, 7]
    assert residue.detect_residue(df.limit(0)).count() == 0


def test_queries_are_registered():
    assert {"p6_ids", "p7_mix", "p8_found"} <= set(queries.queries())


def test_error_pages_of_any_length():
    menu = "Home | Docs | Pricing\n" * 400
    assert residue.is_error_page(menu + "404 Not Found\n" + menu)
    assert residue.is_error_page("Please enable JavaScript to continue.\n" * 60)
    assert residue.is_error_page("<div>" * 1000 + "404 Not Found" + "</div>" * 1000)
    assert not residue.is_error_page(menu + "404 Not Found\n" + "The loader keeps every page it has read.\n" * 9)


@pytest.mark.parametrize("notice", ["503 Service Unavailable\nPlease try again later.", "Please enable JavaScript to continue.", "Access denied\nYou do not have permission to view this resource on this server."])
def test_notices_of_any_length(notice):
    links = "Home | " + " | ".join(["Docs", "Pricing", "About us"] * 300)
    assert residue.is_error_page(links + "\n" + notice)
    assert residue.is_error_page((notice + "\n") * 45)
    assert residue.is_error_page("Home | Docs | Pricing\n" * 300 + notice + "\n" + links)
    assert not residue.is_error_page(notice + "\n" + "The loader keeps every page it has read.\n" * 3)
    assert not residue.is_error_page("The loader keeps every page it has read.\n" * 200 + notice)


@pytest.mark.parametrize("residue_line", ["Dear %NAME%, hello there.", "Work in progress.", "To be defined.", "[ insert name ]", "Muy pronto.", "Dear &lbrace;&lbrace; name &rbrace;&rbrace;, hello", "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 400])
def test_residue_in_lines_of_any_length(residue_line):
    assert residue.residue_kinds(residue_line)
    assert residue.residue_kinds("The loader keeps each record as it came, whatever it holds. " * 300 + residue_line)


def test_gates_change_nothing():
    for text in [*CASES["residue"], *CASES["clean"], *(a + "\n" + b for a, b in zip(CASES["residue"], CASES["clean"]))]:
        lines = residue.text_lines(text)
        tokens = [residue._WORDS.findall(line.lower()) for line, _ in lines]
        assert residue.has_slot(lines, tokens) == residue.has_slot(lines), text
        assert residue.has_filler(lines, tokens) == residue.has_filler(lines), text
        for sentence in text.lower().split("\n"):
            gated = residue._says_notice(sentence, residue._WORDS.findall(sentence))
            assert gated or not any(p.search(sentence) for i, p in enumerate(residue._NOTICE_GROUPS) if residue.NOTICES[i][0].split()[0] not in ("javascript", "browser")), sentence


def test_long_texts_take_linear_time():
    import time

    start = time.time()
    for text in ["word " * 100_000, "{{ " * 30_000, "[ insert " * 10_000, "<a " * 30_000, "\n" * 100_000, "lorem " * 30_000, "__a" * 30_000, "javascript " * 10_000, "page " * 20_000, '"a ' * 30_000]:
        residue.residue_kinds(text)
    assert time.time() - start < 30


_SIGNS = st.text(alphabet=st.sampled_from(list("aA bñ_19 \t\xa0 \x1c{}[]<>()%$#@|*~:&.,'‹›/-ſ\n")), max_size=60)


@settings(max_examples=600, deadline=None)
@given(_SIGNS, st.lists(st.sampled_from(["the text", "ab cd", "x1 foo", "foo", "añb", ". ", "… ", " ", "7", "' "]), max_size=14))
def test_quick_ways_of_residue_change_nothing(text, parts):
    spot = lambda m: m and m.span()
    assert residue._even(text) == residue._SPACES.sub(" ", text)
    assert residue._words(text) == residue._WORDS.findall(text)
    assert spot(residue._slot(text)) == spot(residue._SLOT.search(text))
    low = "".join(parts)
    hit = residue._REPEAT.search(low)
    if hit and re.search(r"[^\W\d_]{3}", hit.group(1)):
        assert residue._thrice(residue._words(low))
