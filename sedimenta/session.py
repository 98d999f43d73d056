"""Session helpers: shared scratch storage, staged tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its measured size stays below this many bytes.
BROADCAST_LIMIT_BYTES = 32 * 1024 * 1024

_STAGED: list[tuple[SparkSession, str]] = []
_KEPT: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's
    checkpoint folder, else (single-machine tests only) a fresh temporary folder."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="sedimenta-")
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def _forget(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session is already gone
        pass


@atexit.register
def _forget_all() -> None:
    for spark, path in _STAGED:
        _forget(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed when the driver ends."""
    path = f"{shared_dir(spark)}/sedimenta/{name}-{uuid.uuid4().hex}"
    _STAGED.append((spark, path))
    return path


def staged(df: DataFrame, name: str, row_group: int | None = None, paths: list[str] | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it: the lineage is cut
    and any executor can be lost without recomputing what came before. ``row_group``: bytes of a row
    group, which is the least that one task reads. ``paths`` gets the path, for ``drop``."""
    path = scratch_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    (df.write.option("parquet.block.size", row_group) if row_group else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Removes staged tables that nothing reads any more, and no others (threads may stage theirs)."""
    gone = set(paths)
    paths.clear()
    for path in gone:
        _forget(spark, path)
    _STAGED[:] = [x for x in _STAGED if x[1] not in gone]


@contextmanager
def passing(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is removed at the end: for steps whose result is staged after them
    (see ``kept``) or collected."""
    mark = len(_STAGED)
    try:
        yield
    finally:
        for own, path in _STAGED[mark:]:
            if path not in _KEPT:
                _forget(own, path)
        _STAGED[mark:] = [x for x in _STAGED[mark:] if x[1] in _KEPT]


def kept(df: DataFrame, name: str, spark: SparkSession | None = None) -> DataFrame:
    """``staged``, and not removed by the ``passing`` blocks around it; ``spark``: the session that
    reads it, if not that of ``df``."""
    spark = spark or df.sparkSession
    path = scratch_path(spark, name)
    _KEPT.add(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove all that was staged in this session so far: long-lived drivers call it between
    queries, once results are read."""
    mine = [x for x in _STAGED if x[0] is spark]
    for own, path in mine:
        _forget(own, path)
        _KEPT.discard(path)
    _STAGED[:] = [x for x in _STAGED if x[0] is not spark]


def size_checked(df: DataFrame, row_bytes: Column, limit: int = BROADCAST_LIMIT_BYTES) -> tuple[bool, int]:
    """Measure ``sum(row_bytes)`` of a staged table; True if it may be broadcast."""
    total = df.agg(F.coalesce(F.sum(row_bytes), F.lit(0)).cast("long").alias("b")).first()["b"]
    return total <= limit, total


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out anew if the files below have fewer splits than half the cores, as a Parquet row
    group is one task however long Python takes over it. Only small inputs have so few splits, so
    what shuffles here is less than a split a core; larger inputs pass unchanged."""
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    files = df.inputFiles()
    if not files or len(files) * 2 > cores:
        return df
    split = _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes"))
    jvm, hadoop = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    sizes = []
    for name in files:
        path = jvm.org.apache.hadoop.fs.Path(name)
        sizes.append(path.getFileSystem(hadoop).getFileStatus(path).getLen())
    split = min(split, max(_bytes(spark.conf.get("spark.sql.files.openCostInBytes")), sum(sizes) // cores))
    return df.repartition(cores) if sum(-(-n // split) for n in sizes) * 2 <= cores else df


def _bytes(size: str) -> int:
    """Spark's size texts: ``134217728b``, ``16m``, ``4MB``."""
    text = size.strip().lower().rstrip("b")
    unit = {"k": 10, "m": 20, "g": 30, "t": 40}.get(text[-1:], 0)
    return int(text[:-1] if unit else text) << unit


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(columns: list[str], wanted: str) -> str:
    """A column name no user column has (Spark compares names without case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
