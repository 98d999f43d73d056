"""Exactly one copy per identifier: idempotent upserts into hash-bucketed sorted runs, merged by compaction."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.values import is_blank
from sedimenta.operators.firstkeep import collapse_sorted_runs
from sedimenta.session import kept, passing, scratch_path, shuffle_partitions, size_checked

#: Rows a bucket is planned for: what one task merges at a time.
BUCKET_ROWS = 1_000_000
#: Slots a bucket.
SLOTS = 64
#: Rows a run is planned for, and the fewest and most runs a delivery is split into.
RUN_ROWS, LEAST_RUNS, MOST_RUNS = 50_000_000, 4, 64
#: Identifiers of more bytes are stored as their SHA-256.
KEY_BYTES = 120


class BucketTable:
    """Rows in numbered slots below the shared folder, in parts that are replaced whole.

    One bucketed, sorted table partitioned by ``part``: a scan is partitioned by ``slot`` without
    an exchange, whatever number of parts it reads, and each file of a bucket is sorted by slot and
    ``sort``. There are many slots a bucket, so that buckets fill evenly."""

    def __init__(self, spark: SparkSession, columns: str, sort: list[str], buckets: int, path: str | None = None):
        self.spark, self.buckets, self.sort = spark, buckets, sort
        self.path = path or scratch_path(spark, "buckets")
        self.name = "buckets_" + uuid.uuid4().hex[:12]
        self.columns = [c.split()[0] for c in columns.split(", ")]
        ordered = ", ".join(["slot", *sort])
        spark.sql(f"CREATE TABLE {self.name} (slot int, {columns}, part string) USING parquet PARTITIONED BY (part) CLUSTERED BY (slot) SORTED BY ({ordered}) INTO {buckets} BUCKETS LOCATION '{self.path}'")

    def put(self, rows: DataFrame, part: str) -> None:
        """Writes ``rows`` (with ``slot``) over the part."""
        view = f"{self.name}_rows"
        rows.select("slot", *self.columns).repartition(self.buckets, "slot").createOrReplaceTempView(view)
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.name} PARTITION (part = '{part}') SELECT * FROM {view}")
        self.spark.catalog.dropTempView(view)

    def put_many(self, rows: DataFrame) -> None:
        """Adds ``rows`` (with ``slot`` and ``part``) of parts that are not there yet."""
        rows.select("slot", *self.columns, "part").repartition(self.buckets, "slot").write.insertInto(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def by_bucket(self) -> DataFrame:
        """A scan of which each task gets one bucket, part after part, with no exchange and no sort. In
        a session of its own, as Spark otherwise gives up such scans where no operator asks for them."""
        own = self.spark.newSession()
        own.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
        own.conf.set("spark.sql.sources.bucketing.enabled", "true")
        return own.table(self.name)

    def drop_parts(self, parts: list[str]) -> None:
        jvm = self.spark.sparkContext._jvm
        for part in parts:
            try:  # catalogs that keep partitions must forget it, too
                self.spark.sql(f"ALTER TABLE {self.name} DROP IF EXISTS PARTITION (part = '{part}')")
            except AnalysisException:
                pass
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/part={part}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        self.spark.catalog.refreshTable(self.name)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges runs of (key bytes, order), each sorted by both: pairs of runs first, then pairs of the
    merged, each by one binary search of the shorter in the longer; nothing is sorted again. Keys do
    not end in a zero byte."""
    if not runs:
        return np.zeros(0, "S1"), np.zeros(0, np.int64)
    width = max(k.dtype.itemsize for k, _ in runs)
    joined = []
    for keys, order in runs:
        # the order value as eight bytes that compare like it; fixed widths keep key and order apart
        tail = (order.astype(np.int64).view(np.uint64) ^ np.uint64(1 << 63)).astype(">u8").view(np.uint8).reshape(-1, 8)
        head = keys.astype(f"S{width}").view(np.uint8).reshape(-1, width)
        joined.append(np.ascontiguousarray(np.concatenate([head, tail], axis=1)).view(f"S{width + 8}").ravel())
    while len(joined) > 1:
        joined.sort(key=len)
        a, b = joined.pop(0), joined.pop(0)
        at = np.searchsorted(b, a) + np.arange(len(a))
        out = np.empty(len(a) + len(b), dtype=b.dtype)
        rest = np.ones(len(out), dtype=bool)
        rest[at] = False
        out[at], out[rest] = a, b
        joined.append(out)
    both = joined[0].view(np.uint8).reshape(-1, width + 8)
    order = (np.ascontiguousarray(both[:, width:]).view(">u8").ravel().astype(np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
    return np.ascontiguousarray(both[:, :width]).view(f"S{width}").ravel(), order


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One bucket: (slot, part, key, ord, settled) in, (slot, key, ord, copy) out."""
    runs: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    schema = pa.schema([("slot", pa.int32()), ("key", pa.binary()), ("ord", pa.int64()), ("copy", pa.int32())])

    def out(slots: np.ndarray, keys: pa.Array, order: np.ndarray, copy: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), keys, pa.array(order), pa.array(copy.astype(np.int32))], schema=schema)

    for batch in batches:
        if not batch.num_rows:
            continue
        slots, part, key, order = batch.column(0).to_numpy(), batch.column(1), batch.column(2), batch.column(3).to_numpy()
        settled = batch.column(4).to_numpy(zero_copy_only=False)
        free = key.is_null().to_numpy(zero_copy_only=False)
        # settled rows are later copies as they stand; rows without identifier are no copies
        apart = settled | free
        if apart.any():
            yield out(slots[apart], key.filter(pa.array(apart)), order[apart], np.where(free[apart], 1, 2))
        mine = ~apart
        if mine.any():
            names = part.filter(pa.array(mine)).to_numpy(zero_copy_only=False)
            # slot first, as in the files; the end mark keeps zero bytes at the end of a key
            keys = np.array([n.to_bytes(4, "big") + k + b"\x01" for n, k in zip(slots[mine].tolist(), key.filter(pa.array(mine)).to_pylist())], dtype="S")
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1), len(names)]
            for a, b in zip(cuts, cuts[1:]):
                runs.setdefault(names[a], []).append((keys[a:b], order[mine][a:b]))
    if runs:
        # the batches of a run follow each other in order
        whole = [(np.concatenate([k for k, _ in parts]), np.concatenate([o for _, o in parts])) for parts in runs.values()]
        keys, order = merge_runs(whole)
        first = np.concatenate([[True], keys[1:] != keys[:-1]])
        at = np.arange(len(keys))
        copy = at - np.maximum.accumulate(np.where(first, at, 0)) + 1
        step = 100_000
        for i in range(0, len(keys), step):
            some = keys[i : i + step].tolist()
            yield out(np.array([int.from_bytes(k[:4], "big") for k in some]), pa.array([k[4:-1] for k in some], pa.binary()), order[i : i + step], copy[i : i + step])


class BucketedRuns:
    """Sorted runs, bucketed by identifier, in the shared folder.

    Each upserted batch becomes one run; upserting a batch id again replaces its run, so a batch
    that is delivered or retried twice counts once. ``merged`` reads all runs bucket by bucket (no
    shuffle and no sort: the layout is the partitioning and the order) and merges them, equal
    identifiers collapsing to the row of the smallest order; ``compact`` makes the kept rows the one
    run there is. In a run, rows that an earlier row of their own split already settles are kept
    apart, spread over the buckets, so one identifier with a third of all rows fills no bucket."""

    def __init__(self, spark: SparkSession, buckets: int, path: str | None = None):
        self.table = BucketTable(spark, "key binary, ord bigint, settled boolean", ["key", "ord"], buckets, path)
        self.spark = spark
        self.runs: dict[str, str] = {}

    def _placed(self, rows: DataFrame, key: str, order: str, *more: str) -> DataFrame:
        """Key, order and slot of the rows; ``more`` columns tell runs apart."""
        text = F.col(f"`{key}`").cast("binary")
        rows = rows.select(F.when(F.octet_length(text) > KEY_BYTES, F.unhex(F.sha2(text, 256))).otherwise(text).alias("key"), F.col(f"`{order}`").cast("bigint").alias("ord"), *more)
        marked = collapse_sorted_runs(rows.filter("key is not null"), "key", "ord", "settled")
        rows = marked.unionByName(rows.filter("key is null").withColumn("settled", F.lit(False)))
        place = F.when(F.col("settled") | F.col("key").isNull(), F.xxhash64("ord")).otherwise(F.xxhash64("key"))
        return rows.withColumn("slot", F.pmod(place, F.lit(self.table.buckets * SLOTS)).cast("int"))

    def upsert(self, batch: DataFrame, batch_id: str, key: str, order: str) -> None:
        """``batch`` has the identifier in ``key`` (null: not an identifier, never collapsed) and a
        unique ``order``."""
        part = self.runs.setdefault(batch_id, f"run{len(self.runs)}")
        self.table.put(self._placed(batch, key, order), part)

    def upsert_many(self, batches: DataFrame, batch: str, key: str, order: str, runs: int) -> None:
        """Many delivered batches (named by ``batch``) in one pass: ``runs`` runs of whole batches."""
        part = F.concat(F.lit("many"), F.pmod(F.xxhash64(F.col(f"`{batch}`")), F.lit(runs)).cast("string")).alias("part")
        self.table.put_many(self._placed(batches, key, order, part))
        self.runs |= {f"many{i}": f"many{i}" for i in range(runs)}

    def merged(self, key: str = "key", order: str = "ord") -> DataFrame:
        """(slot, key, order, copy) of every stored row: 1 for the kept copy, above for later ones
        (2 for those settled before)."""
        rows = self.table.by_bucket().select("slot", "part", "key", "ord", "settled").mapInArrow(_merge, "slot int, key binary, ord bigint, copy int")
        return rows.withColumnsRenamed({"key": key, "ord": order})

    def compact(self) -> DataFrame:
        """Merges all runs, leaves the kept rows as the only run, and gives what ``merged`` gave."""
        stored = kept(self.merged(), "merged-runs", self.spark)
        old = list(self.runs.values())
        new = f"compacted{uuid.uuid4().hex[:8]}"
        self.table.put(stored.filter("copy = 1").select("slot", "key", "ord", F.lit(False).alias("settled")), new)
        self.table.drop_parts(old)
        self.runs = {new: new}
        return stored

    def drop(self) -> None:
        self.table.drop()


def identifier(df: DataFrame, source: str = "_source", ident: str = "id", raw: str = "_raw"):
    """The identifier text (source, id) of a delivered row: null for a null or blank id, or one that
    is an array in the record."""
    text = F.col(f"`{ident}`")
    array = F.when(F.ltrim(text).startswith("["), F.from_json(F.col(f"`{raw}`"), "id array<string>")["id"].isNotNull()).otherwise(F.lit(False))
    # length prefix: no two pairs share a text
    origin = F.coalesce(F.col(f"`{source}`"), F.lit(""))
    mark = F.when(F.col(f"`{source}`").isNull(), F.lit("n")).otherwise(F.length(origin).cast("string"))
    return F.when(text.isNotNull() & ~is_blank(text) & ~array, F.concat(mark, F.lit(":"), origin, text))


def delivery_copies(df: DataFrame, source: str = "_source", ident: str = "id", order: str = "ordinal", raw: str = "_raw", batch: str | None = "_run_id") -> DataFrame:
    """(order, copy) of each row with an identifier: ``copy`` 1 is the first by ``order``, larger ones
    are further deliveries. Rows without an identifier are left out. ``order`` is unique; null
    sources form one source, null batches one batch; without the ``batch`` column all rows are one
    batch; an empty table gives no rows. The rows go through a store of sorted runs, one a group of
    batches, which is compacted and dropped."""
    spark = df.sparkSession
    total = df.count()
    with passing(spark):
        store = BucketedRuns(spark, max(shuffle_partitions(spark), -(-total // BUCKET_ROWS)))
        named = F.col(f"`{batch}`").cast("string") if batch in df.columns else F.lit("all")
        rows = df.select(F.col(f"`{order}`").alias("ord"), identifier(df, source, ident, raw).alias("key"), F.coalesce(named, F.lit("")).alias("batch")).filter("key is not null")
        store.upsert_many(rows, "batch", "key", "ord", max(LEAST_RUNS, min(MOST_RUNS, -(-total // RUN_ROWS))))
        done = store.compact()
        store.drop()
    return done.select(F.col("ord").cast(df.schema[order].dataType).alias(order), "copy")


def redelivered(df: DataFrame, source: str = "_source", ident: str = "id", order: str = "ordinal", raw: str = "_raw") -> DataFrame:
    """``order`` of each row whose identifier is already on a row of smaller ``order``."""
    return delivery_copies(df, source, ident, order, raw).filter("copy > 1").select(order)


def exactly_once(df: DataFrame, source: str = "_source", ident: str = "id", order: str = "ordinal", raw: str = "_raw") -> DataFrame:
    """The rows that stay: the first copy of each identifier and every row without one. The wide
    rows do not shuffle while the order values of later copies in the compacted store measure
    little enough to broadcast."""
    later = redelivered(df, source, ident, order, raw)
    small, _ = size_checked(later, F.lit(8))
    return df.join(F.broadcast(later) if small else later, order, "left_anti")


__all__ = ["BucketTable", "BucketedRuns", "delivery_copies", "exactly_once", "identifier", "merge_runs", "redelivered"]
