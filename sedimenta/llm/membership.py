"""Has this key been seen before: hash-partitioned blocked Bloom filters, query then insert.

The filters and the sorted fingerprints of the keys seen so far live in a store bucketed by hash, so
that a batch of arrivals is all that shuffles."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.values import is_blank, key_fingerprint
from sedimenta.operators.firstkeep import collapse_sorted_runs
from sedimenta.operators.upsert import BucketTable
from sedimenta.session import kept, passing, shuffle_partitions, staged

#: Keys a slot is planned for; its filter, its keys and its arrivals are all a task holds at a time.
SLOT_KEYS = 131_072
#: Fewest slots a bucket, so that buckets fill evenly.
LEAST_SLOTS = 8
_WORDS = 8
#: Unrelated odd multipliers, one a word of a block: eight bit positions from one hash.
_ODD = np.array([int.from_bytes(hashlib.sha256(bytes([i])).digest()[:4], "big") | 1 for i in range(_WORDS)], dtype=np.uint64)


class BlockedBloom:
    """A blocked Bloom filter: a key touches one 256-bit block, one bit in each of its 8 words.

    Sized for ``fpp`` false positives at ``keys`` keys; the extra blocks that uneven block loads
    need are included in the formula for one bit a word."""

    def __init__(self, keys: int, fpp: float, words: bytes | None = None):
        """``words``: the state of a filter of the same ``keys`` and ``fpp``."""
        bits = -8.0 * max(keys, 1) / math.log(1.0 - fpp ** (1.0 / 8.0)) * 1.15
        self.blocks = max(1, math.ceil(bits / 256))
        self.words = np.zeros(self.blocks * _WORDS, dtype=np.uint32) if words is None else np.frombuffer(words, dtype=np.uint32).copy()

    def _places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        block = ((h >> np.uint64(32)) * np.uint64(self.blocks)) >> np.uint64(32)
        low = h & np.uint64(0xFFFFFFFF)
        bit = ((low[:, None] * _ODD[None, :]) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)
        at = block[:, None] * np.uint64(_WORDS) + np.arange(_WORDS, dtype=np.uint64)[None, :]
        return at.astype(np.int64), np.left_shift(np.uint32(1), bit.astype(np.uint32))

    def insert(self, h: np.ndarray) -> None:
        at, mask = self._places(h)
        np.bitwise_or.at(self.words, at.ravel(), mask.ravel())

    def query(self, h: np.ndarray) -> np.ndarray:
        at, mask = self._places(h)
        return ((self.words[at] & mask) == mask).all(axis=1)


def _digests(column: pa.Array) -> np.ndarray:
    """The 32-byte fingerprints as rows of four 64-bit words."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, 4).astype(np.uint64)


def _known(seen: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Exact: which rows of ``asked`` are rows of ``seen``, compared over all 256 bits."""
    if not len(asked):
        return np.zeros(0, dtype=bool)
    both = np.concatenate([seen, asked])
    code = pd.MultiIndex.from_arrays(list(both.T)).factorize()[0]
    return np.isin(code[len(seen) :], code[: len(seen)])


def _judge(bloom: BlockedBloom, seen: np.ndarray | None, fps: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One slot: (filter verdict, exact verdict) of each arriving key, in any row order: in blocks by
    ``order``, query, then insert. The exact check looks only at what the filter let through;
    without ``seen`` it is left out."""
    by = np.argsort(order, kind="stable")
    maybe = np.zeros(len(fps), dtype=bool)
    for start in range(0, len(by), 4096):
        block = by[start : start + 4096]
        h = fps[block, 1]
        maybe[block] = bloom.query(h)
        _, lead = np.unique(h, return_index=True)  # a repeat within the block would have met the insert
        again = np.ones(len(block), dtype=bool)
        again[lead] = False
        maybe[block] |= again
        bloom.insert(h)
    sure = maybe.copy()
    if seen is not None and maybe.any():
        first = np.ones(len(fps), dtype=bool)
        keys = pd.MultiIndex.from_arrays(list(fps[by].T)).factorize()[0]
        first[by] = ~pd.Series(keys).duplicated().to_numpy()
        asked = np.flatnonzero(maybe & first)
        sure[asked] = _known(seen, fps[asked])
    return maybe, sure


class SeenStore:
    """The keys seen so far: for each slot (a range of key hashes) one blocked Bloom filter and the
    sorted 32-byte fingerprints, in runs, bucketed by slot in the shared folder.

    ``insert`` adds a run and the next generation of the filters it touches, ``ask`` judges arrivals;
    only the rows given to either shuffle. With ``exact=False`` only the filters are read. Built for
    ``keys`` keys at ``fpp`` false positives; ``grown`` gives a larger store when they pass that."""

    def __init__(self, spark: SparkSession, keys: int, fpp: float):
        self.spark, self.fpp = spark, fpp
        buckets = max(shuffle_partitions(spark), math.ceil(keys / SLOT_KEYS / LEAST_SLOTS))
        self.slots = max(buckets * LEAST_SLOTS, math.ceil(keys / SLOT_KEYS))
        self.capacity = math.ceil(keys / self.slots * 1.05) + 1
        self.planned, self.held = keys, 0
        self.table = BucketTable(spark, "fp binary, words binary", ["fp"], buckets)
        self.parts: list[str] = []
        self.filters = 0

    def _slot(self) -> Column:
        return F.pmod(F.xxhash64("fp"), F.lit(self.slots)).cast("int")

    def insert(self, rows: DataFrame, count: int) -> None:
        """Adds the ``count`` keys in ``fp`` (repeats count once in the filters)."""
        run = f"keys{len(self.parts)}"
        self.table.put(rows.select(self._slot().alias("slot"), "fp", F.lit(None).cast("binary").alias("words")), run)
        capacity, fpp = self.capacity, self.fpp

        def fill(key: tuple, group: pa.Table) -> pa.Table:
            old = [w for w in group.column("words").to_pylist() if w is not None]
            bloom = BlockedBloom(capacity, fpp, old[0] if old else None)
            bloom.insert(_digests(group.column("fp").drop_null())[:, 1])
            return pa.table({"slot": pa.array([key[0].as_py()], pa.int32()), "fp": pa.nulls(1, pa.binary()), "words": pa.array([bloom.words.tobytes()], pa.binary())})

        old, self.filters = f"filters{self.filters}", self.filters + 1
        both = self.table.read().filter(F.col("part").isin(run, old)).drop("part")
        made = both.groupBy("slot").applyInArrow(fill, "slot int, fp binary, words binary")
        self.table.put(staged(made, "seen-filters"), f"filters{self.filters}")
        self.table.drop_parts([old])
        self.parts.append(run)
        self.held += count

    def ask(self, arrivals: DataFrame, exact: bool = True, probes: int = 0) -> DataFrame:
        """(arrival, maybe, sure) of each row (fp, arrival); with ``probes`` instead one row a slot:
        keys, bits of the filter, arrivals, verdicts, wrong verdicts, and how many of ``probes``
        random absent keys the filter let through. ``exact=False``: ``sure`` is ``maybe``."""
        wanted = [f"filters{self.filters}", *(self.parts if exact else [])]
        held = self.table.read().filter(F.col("part").isin(wanted)).select("slot", "fp", "words")
        asked = arrivals.select(self._slot().alias("slot"), "fp", "arrival").repartition(self.table.buckets, "slot")
        capacity, fpp = self.capacity, self.fpp
        names = ["keys", "filter_bits", "asked", "maybe", "false_maybe", "absent_asked", "absent_maybe"]

        def judge(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            words = [w for w in left.column("words").to_pylist() if w is not None]
            bloom = BlockedBloom(capacity, fpp, words[0] if words else None)
            seen = _digests(left.column("fp").drop_null())
            fps = _digests(right.column("fp"))
            maybe, sure = _judge(bloom, seen if exact else None, fps, right.column("arrival").to_numpy())
            if not probes:
                return pa.table({"arrival": right.column("arrival"), "maybe": maybe, "sure": sure})
            absent = np.random.default_rng(key[0].as_py()).integers(0, 2**64 - 1, size=probes, dtype=np.uint64)
            report = [len(seen) + len(fps), bloom.words.size * 32, len(fps), maybe.sum(), (maybe & ~sure).sum(), probes, bloom.query(absent).sum()]
            return pa.table({n: pa.array([int(x)], pa.int64()) for n, x in zip(names, report)})

        schema = ", ".join(f"{n} long" for n in names) if probes else "arrival long, maybe boolean, sure boolean"
        return held.groupBy("slot").cogroup(asked.groupBy("slot")).applyInArrow(judge, schema)

    def grown(self, keys: int) -> SeenStore:
        """A store for ``keys`` keys with all keys of this one, which is dropped."""
        out = SeenStore(self.spark, keys, self.fpp)
        if self.parts:
            out.insert(self.table.read().filter("fp is not null").select("fp"), self.held)
        self.drop()
        return out

    def drop(self) -> None:
        self.table.drop()


def _prepared(incoming: DataFrame, keys: list[str], order: str, id_key: str | None) -> DataFrame:
    valid = ~is_blank(F.col(f"`{id_key}`")) if id_key else F.lit(True)
    fp = key_fingerprint(*[F.col(f"`{k}`") for k in keys])
    return collapse_sorted_runs(incoming.select(F.col(f"`{order}`").cast("long").alias("arrival"), F.when(valid, fp).alias("fp")).filter("fp is not null"), "fp", "arrival", "repeat")


def _known_rows(seen: DataFrame, fingerprint: str) -> DataFrame:
    rows = seen.select(F.col(f"`{fingerprint}`").alias("fp")).filter("fp is not null and length(fp) = 32")
    # a fingerprint repeated within a split leaves it once
    return collapse_sorted_runs(rows.withColumn("at", F.lit(0)), "fp", "at", "repeat").filter("not repeat").select("fp")


def seen_before(incoming: DataFrame, seen: DataFrame, keys: list[str], order: str, id_key: str | None = None, fingerprint: str = "fingerprint", fpp: float = 1e-3, verdict: str = "found") -> DataFrame:
    """``order`` values of the incoming rows whose key is in ``seen`` or on an earlier row.

    Rows with a null key column, or a null or blank ``id_key``, are never returned; of rows with
    equal key the one with the smallest ``order`` is the first. Null and repeated fingerprints in
    ``seen`` count once; ``seen`` or ``incoming`` may be empty. With ``verdict="maybe"`` the filters'
    own answer is returned, false positives included. ``seen`` is put into a store (dropped at the
    end), fingerprints shuffle once; repeats inside one split are settled before."""
    total = seen.count() + incoming.count()
    with passing(incoming.sparkSession):
        rows = staged(_prepared(incoming, keys, order, id_key), "incoming-keys")
        store = SeenStore(incoming.sparkSession, max(total, 1), fpp)
        store.insert(_known_rows(seen, fingerprint), total)
        found = store.ask(rows.filter("not repeat"), exact=verdict == "found").filter("sure").select("arrival")
        # repeats settled in their own split meet the insert of their first row: the filter lets them pass
        found = kept(found.unionByName(rows.filter("repeat").select("arrival")), "seen-before")
        store.drop()
    return found.select(F.col("arrival").cast(incoming.schema[order].dataType).alias(order))


def seen_before_errors(incoming: DataFrame, seen: DataFrame, keys: list[str], order: str, id_key: str | None = None, fingerprint: str = "fingerprint", fpp: float = 1e-3, probes: int = 20_000) -> DataFrame:
    """One row: how often the filters are wrong, by ``probes`` known absent keys asked of each
    slot's filter and by the exact check of the incoming keys. An empty input gives zero counts
    and null rates."""
    total = seen.count() + incoming.count()
    with passing(incoming.sparkSession):
        store = SeenStore(incoming.sparkSession, max(total, 1), fpp)
        store.insert(_known_rows(seen, fingerprint), total)
        per = kept(store.ask(_prepared(incoming, keys, order, id_key).filter("not repeat"), probes=probes), "seen-errors")
        store.drop()
    names = ["keys", "filter_bits", "asked", "maybe", "false_maybe", "absent_asked", "absent_maybe"]
    out = per.agg(F.count("*").alias("buckets"), *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names])
    return out.withColumns({
        "target_rate": F.lit(fpp),
        "absent_rate": F.try_divide(F.col("absent_maybe").cast("double"), "absent_asked"),
        "incoming_rate": F.try_divide(F.col("false_maybe").cast("double"), F.col("asked") - F.col("maybe") + F.col("false_maybe")),
        "bits_per_key": F.try_divide(F.col("filter_bits").cast("double"), "keys"),
    })
