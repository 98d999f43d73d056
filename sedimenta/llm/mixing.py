"""Mixing sources to target weights: temperature-fitted shares, realised as budgeted block permutations."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_BITS = 12
SEED = 7


@dataclass
class Part:
    """One source of one mix: what it should and may give."""

    mix: str
    source: str
    target: float
    limit: int
    tokens: int
    share: float = 0.0
    budget: float = 0.0
    exponent: float = 0.0


def fit_mix(parts: list[Part], size: float, entropy: float | None = None) -> float:
    """Fills ``share`` and ``budget`` of the parts of one mix; returns the exponent.

    Shares are the targets, tempered towards the source's own token shares (each source counted as
    often as it may repeat): share ~ target^(1-e) * capacity^e. The exponent e is the smallest in
    [0, 1], by bisection, at which no source passes its repetition limit - and, if ``entropy`` is
    given, at which the shares have at least that entropy (if any e has it). At 0 the targets are
    met exactly; at 1 all sources repeat alike. If ``size`` passes all capacity, every source gives all it may."""
    live = [p for p in parts if p.target > 0 and p.tokens > 0 and p.limit > 0]
    capacity = sum(p.limit * p.tokens for p in live)
    size = min(size, capacity)
    if not live or size <= 0:
        return 0.0
    total = sum(p.target for p in live)

    def shares(e: float) -> list[float]:
        raw = [math.exp((1 - e) * math.log(p.target / total) + e * math.log(p.limit * p.tokens / capacity)) for p in live]
        return [r / sum(raw) for r in raw]

    def fits(e: float) -> bool:
        now = shares(e)
        if entropy is not None and -sum(s * math.log(s) for s in now) < entropy:
            return False
        return all(s * size <= p.limit * p.tokens * (1 + 1e-12) for s, p in zip(now, live))

    low, high = 0.0, 1.0
    if fits(0.0):
        high = 0.0
    else:
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (low, middle) if fits(middle) else (middle, high)
    for s, p in zip(shares(high), live):
        p.share, p.budget, p.exponent = s, min(s * size, float(p.limit * p.tokens)), high
    return high


def clean_source(column: str):
    """Source names are compared without case and outer white space."""
    return F.lower(F.trim(F.col(column)))


def plan_mixes(sized: DataFrame, targets: DataFrame, evenness: float | None = None) -> list[Part]:
    """The fitted parts of all mixes. ``sized`` has source and tokens of each document; the driver
    gets one row a named source, never more rows than ``targets`` has.

    Targets of one source in a mix add up, the smallest limit holds; a null share or limit: no
    share is wanted, and no document is used twice. A null size factor counts as 1. With ``evenness``
    the shares of each mix are tempered until their entropy is that part of the entropy of equal
    shares, where an exponent gives it."""
    wanted = (
        targets.withColumn("source", clean_source("source")).filter("mix is not null and source is not null")
        .groupBy("mix", "source")
        .agg(F.coalesce(F.sum("target_share"), F.lit(0.0)).alias("target"), F.coalesce(F.min("max_repeats"), F.lit(1)).alias("limit"), F.coalesce(F.max("size_factor"), F.lit(1.0)).alias("factor"))
    )
    rows = wanted.collect()
    names = wanted.select("source").distinct()
    held = {r["source"]: r["t"] for r in sized.join(names, "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("t")).collect()}
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    parts = []
    for mix in sorted({r["mix"] for r in rows}):
        own = [r for r in rows if r["mix"] == mix]
        mine = [Part(mix, r["source"], max(r["target"], 0.0), r["limit"], held.get(r["source"], 0)) for r in sorted(own, key=lambda r: r["source"])]
        live = sum(p.target > 0 and p.tokens > 0 and p.limit > 0 for p in mine)
        fit_mix(mine, max(r["factor"] for r in own) * total, evenness * math.log(live) if evenness is not None and live else None)
        parts += mine
    return parts


_PLAN = "mix string, source string, whole int, rest double"


def _cuts(docs: DataFrame) -> DataFrame:
    """(mix, source, cut, cut_doc): up to which document of the permutation one more copy is used.

    ``docs`` has mix, source, whole, rest, doc_id, tokens and the place ``h`` in the permutation (a
    62-bit hash). The permutation is cut in 4096 blocks, the block in which the budget ends in
    4096 again, and only the documents of one such piece are put in order: no task sees a whole
    source, however much of the corpus it holds."""
    keys = ["mix", "source"]
    left = F.col("rest")
    docs = docs.filter("rest > 0")
    for level in (1, 2):
        block = F.shiftright("h", 62 - _BITS * level).bitwiseAND((1 << _BITS) - 1)
        docs = docs.withColumn(f"b{level}", block)
        sums = docs.groupBy(*keys, f"b{level}").agg(F.sum("tokens").alias("sum"), F.max("rest").alias("rest"))
        upto = F.sum("sum").over(Window.partitionBy(*keys).orderBy(f"b{level}").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        # the block in which the running sum passes the rest: one a part
        edge = sums.withColumn("upto", upto).filter((F.col("upto") >= left) & (F.col("upto") - F.col("sum") < left))
        edge = edge.select(*keys, f"b{level}", (left - (F.col("upto") - F.col("sum"))).alias("rest"))
        docs = docs.drop("rest").join(F.broadcast(edge), [*keys, f"b{level}"])  # edge: at most one row a part of the plan
    order = Window.partitionBy(*keys).orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = F.sum("tokens").over(order)
    # the document that crosses the budget is used if that comes closer to it
    ends = docs.withColumn("upto", upto).filter(F.col("upto") - F.col("tokens") / 2 <= left)
    last = ends.groupBy(*keys).agg(F.max(F.struct("h", "doc_id")).alias("last"), F.max("b1").alias("b1"), F.max("b2").alias("b2"))
    inner = last.select(*keys, F.col("last.h").alias("cut"), F.col("last.doc_id").alias("cut_doc"))
    # nothing of the last piece used: the cut is the piece's lower edge
    low = docs.groupBy(*keys).agg(F.min(F.struct("h", "doc_id")).alias("low")).select(*keys, (F.col("low.h")).alias("low"), F.col("low.doc_id").alias("low_doc"))
    return low.join(inner, keys, "left").select(*keys, F.coalesce("cut", "low").alias("cut"), F.when(F.col("cut").isNull(), F.col("low_doc") - 1).otherwise(F.col("cut_doc")).alias("cut_doc"))


def _used(sized: DataFrame, parts: list[Part], seed: int) -> DataFrame:
    """The documents each mix uses with their copies, their place ``h`` in the permutation of the
    last, partial pass, and the ``whole`` passes and ``cut`` of their source."""
    spark = sized.sparkSession
    plan = [(p.mix, p.source, *_passes(p)) for p in parts if p.budget > 0]
    table = spark.createDataFrame(plan, _PLAN)
    docs = sized.filter("tokens > 0 and source is not null").join(F.broadcast(table), "source")  # one row a mix and source: bounded by the target table
    docs = docs.withColumn("h", F.shiftrightunsigned(F.xxhash64("mix", "doc_id", F.lit(seed)), 2))
    cut = _cuts(docs.select("mix", "source", "rest", "doc_id", "tokens", "h"))
    docs = docs.join(F.broadcast(cut), ["mix", "source"], "left")  # as many rows as the plan
    more = F.coalesce((F.col("h") < F.col("cut")) | ((F.col("h") == F.col("cut")) & (F.col("doc_id") <= F.col("cut_doc"))), F.lit(False))
    return docs.withColumn("copies", F.col("whole") + more.cast("int")).filter("copies > 0")


def mix_documents(sized: DataFrame, parts: list[Part], seed: int = SEED) -> DataFrame:
    """(mix, source, doc_id, tokens, copies) of each used document: all documents of a source as
    often as its budget holds them whole, and one copy more along a seeded permutation until the
    budget is spent (to within half a document). ``sized``: doc_id, source, tokens; documents of
    null source or without tokens are never used."""
    return _used(sized, parts, seed).select("mix", "source", "doc_id", "tokens", "copies")


def mix_schedule(sized: DataFrame, parts: list[Part], seed: int = SEED) -> DataFrame:
    """(mix, source, doc_id, tokens, pass_no, position) of each use of a document, of which
    ``mix_documents`` has the number. Passes of a source are counted from 0; each has a seeded
    permutation of its own, the last one that of the budget. ``position``, in [0, 1], spreads the
    passes of every source evenly over the mix: read in its order (documents of equal position by
    source and id), each stretch of the mix has the shares of the whole, whatever length. Nothing is
    sorted or shuffled for it."""
    span = float(1 << 62)
    used = _used(sized, parts, seed).withColumn("pass_no", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    place = F.when(F.col("pass_no") == F.col("whole"), F.col("h")).otherwise(F.shiftrightunsigned(F.xxhash64("mix", "doc_id", F.lit(seed), "pass_no"), 2)) / F.lit(span)
    passes = F.col("whole") + F.coalesce(F.col("cut") / F.lit(span), F.lit(0.0))
    return used.select("mix", "source", "doc_id", "tokens", "pass_no", F.least((F.col("pass_no") + place) / F.greatest(passes, F.lit(1e-18)), F.lit(1.0)).alias("position"))


def _passes(p: Part) -> tuple[int, float]:
    whole = min(int(p.budget // p.tokens), p.limit)
    return whole, 0.0 if whole == p.limit else max(0.0, p.budget - whole * p.tokens)


def mix_report(mixed: DataFrame, parts: list[Part]) -> DataFrame:
    """One row for each (mix, source) of the targets: wanted and fitted share, budget, and what the
    mixture reached."""
    spark = mixed.sparkSession
    table = spark.createDataFrame(
        [(p.mix, p.source, p.target, p.limit, p.tokens, p.share, p.budget, p.exponent) for p in parts],
        "mix string, source string, target_share double, max_repeats int, source_tokens long, fitted_share double, budget_tokens double, exponent double",
    )
    per = mixed.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"), F.count("*").alias("documents"), F.max("copies").alias("most_copies"))
    out = table.join(per, ["mix", "source"], "left").fillna(0, ["reached_tokens", "documents", "most_copies"])
    all_of = Window.partitionBy("mix")
    return out.withColumns({
        "target_share": F.try_divide("target_share", F.sum("target_share").over(all_of)),
        "reached_share": F.try_divide(F.col("reached_tokens").cast("double"), F.sum("reached_tokens").over(all_of)),
    })
