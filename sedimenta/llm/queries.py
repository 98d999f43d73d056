"""The queries of problems 2 and 6 to 8, over their whole tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm import membership, mixing, residue
from sedimenta.llm.tokenizer import ByteBPE, count_tokens, encode
from sedimenta.session import staged, table

_LOADED: dict[str, ByteBPE] = {}


def vocabulary(path: str | None = None) -> ByteBPE:
    """The byte-level BPE in the tokenizer file ``path`` (default: SEDIMENTA_TOKENIZER, else the
    installed public vocabulary)."""
    path = path or os.environ.get("SEDIMENTA_TOKENIZER")
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    if path not in _LOADED:
        _LOADED[path] = ByteBPE(path)
    return _LOADED[path]


#: False positives the filters of problem 2 are built for.
FPP = 1e-3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return membership.seen_before(table(spark, d, "incoming_orders"), table(spark, d, "seen"), ["source", "id"], "arrival_no", id_key="id", fpp=FPP)


def p2_errors(spark: SparkSession, d: str) -> DataFrame:
    return membership.seen_before_errors(table(spark, d, "incoming_orders"), table(spark, d, "seen"), ["source", "id"], "arrival_no", id_key="id", fpp=FPP)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode(table(spark, d, "documents").select("doc_id", "text"), vocabulary())


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", mixing.clean_source("source").alias("source"), "text")
    return staged(count_tokens(docs, vocabulary()), "document-sizes")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """Each use of a document with its pass and its position in the mix."""
    sized = _sized(spark, d)
    return mixing.mix_schedule(sized, mixing.plan_mixes(sized, table(spark, d, "mix_targets")))


#: Part of the entropy of equal shares that p7_even tempers the mixes to.
EVENNESS = 0.9


def p7_even(spark: SparkSession, d: str) -> DataFrame:
    """The shares reached where every mix is tempered to a target entropy."""
    sized = _sized(spark, d)
    parts = mixing.plan_mixes(sized, table(spark, d, "mix_targets"), evenness=EVENNESS)
    return mixing.mix_report(mixing.mix_documents(sized, parts), parts)


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    sized = _sized(spark, d)
    parts = mixing.plan_mixes(sized, table(spark, d, "mix_targets"))
    return mixing.mix_report(mixing.mix_documents(sized, parts), parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.detect_residue(table(spark, d, "documents")).filter(F.size("kinds") > 0).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.detect_residue(table(spark, d, "documents")).filter(F.size("kinds") > 0)


def p8_clean(spark: SparkSession, d: str) -> DataFrame:
    return residue.without_residue(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_errors, p6_ids, p7_mix, p7_shares, p7_even, p8_found, p8_kinds, p8_clean)}


_BLANK = r"regexp_full_match(id, '[\s\x{1c}-\x{1f}\x{85}\p{Z}\v]*')"


def oracle_sql() -> dict[str, str]:
    """SQL of problem 2; encoding, mixing and detection have none: tests hold them against libraries,
    brute force and labelled cases."""
    fingerprint = """sha256('["' || source || '","' || replace(replace(replace(id, '\\', '\\\\'), '"', '\\"'), chr(9), '\\t') || '"]')"""
    return {
        "p2_found": f"""WITH k AS (SELECT arrival_no, {fingerprint} AS f FROM incoming_orders WHERE id IS NOT NULL AND source IS NOT NULL AND NOT {_BLANK})
SELECT arrival_no FROM (SELECT arrival_no, f, row_number() OVER (PARTITION BY f ORDER BY arrival_no) AS n FROM k) WHERE n > 1 OR f IN (SELECT lower(hex(fingerprint)) FROM seen)""",
    }
