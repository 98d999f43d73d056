"""Delta destination, where the Delta data source is on the session's class path."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import AdapterNotFoundError, StateConflictError
from sedimenta.operators.incremental import Watermark
from sedimenta.sinks.base import Destination
from sedimenta.sinks.parquet import LoadResult, extra_names, write_mode
from sedimenta.sinks.state import StateStore, validate_state_key


def available(spark: SparkSession) -> bool:
    try:
        spark._jvm.java.lang.Class.forName("org.apache.spark.sql.delta.sources.DeltaDataSource", False, spark._jvm.java.lang.Thread.currentThread().getContextClassLoader())
        return True
    except Exception:
        return False


class DeltaDestination(Destination):
    """The contract of the Parquet destination on Delta tables: ``append`` replaces the rows of the
    load's own ingestion key by predicate, ``overwrite`` the table, each in one transaction."""

    def __init__(self, root: str, mode: str = "append", partition_by: list[str] | None = None):
        self.root, self.mode, self.partition_by = root.rstrip("/"), write_mode(mode), partition_by or []

    def path(self, table: str) -> str:
        return f"{self.root}/{table.replace('.', '/')}"

    def read(self, spark: SparkSession, table: str) -> DataFrame:
        return spark.read.format("delta").load(self.path(table))

    def load(self, rows: DataFrame, table: str, ingestion_key: str) -> LoadResult:
        spark = rows.sparkSession
        if not available(spark):
            raise AdapterNotFoundError("the Delta data source is not on this session's class path")
        seen = Observation(f"load-{uuid.uuid4().hex}")
        writer = rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.format("delta").mode("overwrite")
        if self.mode == "append":
            key = ingestion_key.replace("'", "''")
            writer = writer.option("replaceWhere", f"_ingestion_key = '{key}'")
        else:
            writer = writer.option("overwriteSchema", "true")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.save(self.path(table))
        count = seen.get["rows"]
        mine = self.read(spark, table).filter(F.col("_ingestion_key") == ingestion_key) if count and "_ingestion_key" in rows.columns else None
        return LoadResult(table, count, extra_names(mine) if mine is not None else [])


class DeltaStateStore(StateStore):
    """Checkpoints in a Delta table: one MERGE moves a watermark if it still is the expected one."""

    #: Fixed value: the columns of the state table.
    SCHEMA = "state_key string, last_run_at timestamp, last_data_date date, cursor_value string, version bigint"

    def __init__(self, spark: SparkSession, path: str):
        if not available(spark):
            raise AdapterNotFoundError("the Delta data source is not on this session's class path")
        self.spark, self.path = spark, path

    def _rows(self) -> DataFrame:
        return self.spark.read.format("delta").load(self.path)

    def get(self, key):
        from pyspark.errors import AnalysisException

        try:
            row = self._rows().filter(F.col("state_key") == validate_state_key(key)).first()
        except AnalysisException:  # no table yet
            return None
        return row and Watermark(row["last_run_at"], row["last_data_date"], row["cursor_value"])

    def compare_and_set(self, key, expected, new):
        held = self.spark.createDataFrame([(validate_state_key(key), new.last_run_at, new.last_data_date, new.cursor_value, 1)], self.SCHEMA)
        if self.get(key) != expected:
            raise StateConflictError(f"another run moved the checkpoint of {key!r}")
        if expected is None:
            self.spark.createDataFrame([], self.SCHEMA).write.format("delta").mode("append").save(self.path)
        held.createOrReplaceTempView("new_state")
        same = "t.last_run_at <=> timestamp'{}' and t.cursor_value <=> {}".format(expected.last_run_at.isoformat(), "null" if expected.cursor_value is None else "'" + expected.cursor_value.replace("'", "''") + "'") if expected else "false"
        self.spark.sql(f"MERGE INTO delta.`{self.path}` t USING new_state s ON t.state_key = s.state_key WHEN MATCHED AND {same} THEN UPDATE SET last_run_at = s.last_run_at, last_data_date = s.last_data_date, cursor_value = s.cursor_value, version = t.version + 1 WHEN NOT MATCHED THEN INSERT *")
        if self.get(key) != new:
            raise StateConflictError(f"another run moved the checkpoint of {key!r}")
