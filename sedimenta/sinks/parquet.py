"""Parquet destination: one partition an ingestion key, replaced whole on retry; overwrite by swap."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sedimenta.sinks.base import Destination

#: Bounds and default of rows a file.
MIN_BATCH, DEFAULT_BATCH, MAX_BATCH = 100, 5_000, 100_000
#: Fixed value: most rows of a preview.
PREVIEW_ROWS = 200


def batch_size(value: int = DEFAULT_BATCH) -> int:
    from sedimenta.errors import InvalidBatchSizeError

    if isinstance(value, bool) or not isinstance(value, int) or not MIN_BATCH <= value <= MAX_BATCH:
        raise InvalidBatchSizeError(f"batch size {value!r} is not between {MIN_BATCH} and {MAX_BATCH}")
    return value


def write_mode(value: str) -> str:
    mode = str(value).strip().lower()
    if mode not in ("append", "overwrite"):
        raise ValueError(f"write mode {value!r} is neither append nor overwrite")
    return mode


@dataclass
class LoadResult:
    table: str
    rows_loaded: int
    extra_fields_seen: list[str] = field(default_factory=list)


class Folder:
    """Hadoop file system calls on one path: local disks, HDFS and object stores alike."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark.sparkContext._jvm
        self.path = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = self.path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        return self.fs.exists(self.path)

    def delete(self) -> None:
        self.fs.delete(self.path, True)

    def make(self) -> None:
        self.fs.mkdirs(self.path)

    def write(self, text: str) -> None:
        out = self.fs.create(self.path, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()

    def read(self) -> str:
        source = self.fs.open(self.path)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode("utf-8")
        finally:
            source.close()

    def rename(self, to: Folder) -> None:
        if not self.fs.rename(self.path, to.path):
            raise OSError(f"cannot move {self.path} to {to.path}")


def extra_names(rows: DataFrame) -> list[str]:
    """The sorted field names in ``_extra`` of landed rows; distinct names are all that shuffles."""
    if "_extra" not in rows.columns:
        return []
    names = rows.filter("_extra is not null").select(F.explode(F.json_object_keys("_extra")).alias("n")).distinct()
    return sorted(r["n"] for r in names.collect())


class ParquetDestination(Destination):
    """Tables below ``root``, one folder each, partitioned by ``part`` = a token of the ingestion key.

    ``append`` replaces the partition of the load's own key and no other, so a retried window never
    doubles; a retry without rows removes the partition. ``overwrite`` writes beside the table and
    swaps. Either moves what it replaces aside first and brings it back if the new rows cannot take
    their place. The table's columns are kept in a file of their own, so a table without rows reads
    as an empty one. Rows are counted by an Observation of the write; the names of extra fields are
    read from what was written."""

    def __init__(self, root: str, mode: str = "append", max_records_per_file: int = 0):
        self.root, self.mode, self.per_file = root.rstrip("/"), write_mode(mode), max_records_per_file

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def _schema_file(self, table: str) -> str:
        return f"{self.path(table)}/_landed_schema.json"

    def schema(self, spark: SparkSession, table: str) -> T.StructType | None:
        file = Folder(spark, self._schema_file(table))
        return T.StructType.fromJson(json.loads(file.read())) if file.exists() else None

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        schema = self.schema(spark, table)
        reader = spark.read.schema(schema) if schema is not None else spark.read
        return reader.parquet(self.path(table)).drop("part")

    def tables(self, spark: SparkSession) -> list[str]:
        """The names of the landed tables below ``root``, sorted."""
        root = Folder(spark, self.root)
        if not root.exists():
            return []
        files, found, base = root.fs.listFiles(root.path, True), [], root.fs.makeQualified(root.path).toUri().getPath()
        while files.hasNext():
            path = files.next().getPath()
            if path.getName() == "_landed_schema.json" and "__staging_" not in str(path) and "__backup_" not in str(path):
                found.append(path.getParent().toUri().getPath()[len(base) :].strip("/").replace("/", "."))
        return sorted(found)

    def preview(self, spark: SparkSession, table: str, limit: int = PREVIEW_ROWS) -> DataFrame:
        """Some rows of a table, at most PREVIEW_ROWS."""
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= PREVIEW_ROWS:
            raise ValueError(f"a preview has 1 to {PREVIEW_ROWS} rows")
        return self.read(spark, table).limit(limit)

    def load(self, rows: DataFrame, table: str, ingestion_key: str) -> LoadResult:
        """``rows`` are landed rows of one ingestion key."""
        spark = rows.sparkSession
        target = Folder(spark, self.path(table))
        seen = Observation(f"load-{uuid.uuid4().hex}")
        watched = rows.observe(seen, F.count(F.lit(1)).alias("rows"))
        part = hashlib.sha256(ingestion_key.encode()).hexdigest()[:24]
        staging = Folder(spark, f"{self.path(table)}__staging_{uuid.uuid4().hex}")
        writer = watched.withColumn("part", F.lit(part)).write.partitionBy("part").mode("overwrite")
        if self.per_file:
            writer = writer.option("maxRecordsPerFile", self.per_file)
        try:
            writer.parquet(str(staging.path))
            count: int = seen.get["rows"]
            names = extra_names(spark.read.schema(rows.schema).parquet(str(staging.path))) if count else []
            held = self.schema(spark, table) if self.mode == "append" else None
            known = {f.name for f in held.fields} if held else set()
            schema = T.StructType([*(held.fields if held else []), *(f for f in rows.schema.fields if f.name not in known)]).json()
            if self.mode == "overwrite":
                Folder(spark, f"{staging.path}/_landed_schema.json").write(schema)
                self._swap(spark, staging, target)
            else:
                target.make()
                Folder(spark, self._schema_file(table)).write(schema)
                self._swap(spark, Folder(spark, f"{staging.path}/part={part}") if count else None, Folder(spark, f"{target.path}/part={part}"), f"{target.path}__backup_{uuid.uuid4().hex}")
        finally:
            staging.delete()
        return LoadResult(table, count, names)

    def _swap(self, spark: SparkSession, new: Folder | None, target: Folder, aside: str | None = None) -> None:
        """``new`` (None: nothing) takes the place of ``target``, which comes back if that fails."""
        backup = Folder(spark, aside or f"{target.path}__backup_{uuid.uuid4().hex}")
        had = target.exists()
        if had:
            target.rename(backup)
        try:
            if new is not None:
                new.rename(target)
        except Exception:
            if had:
                backup.rename(target)
            raise
        if had:
            backup.delete()


__all__ = ["DEFAULT_BATCH", "Folder", "LoadResult", "ParquetDestination", "batch_size", "extra_names", "write_mode"]
