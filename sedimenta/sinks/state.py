"""Checkpoints and run logs kept by the driver: small, atomic, compare-and-set."""

from __future__ import annotations

import contextlib
import fcntl
import json
import os
import sqlite3
import tempfile
import threading
from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import date, datetime
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import AdapterNotFoundError, StateConflictError
from sedimenta.functions.types import validate_identifier
from sedimenta.operators.incremental import Watermark
from sedimenta.sinks.base import RunLog


def validate_state_key(key: object) -> str:
    if not isinstance(key, str) or not 1 <= len(key) <= 512 or any(ord(c) < 32 or ord(c) == 127 for c in key):
        raise ValueError("a state key has 1 to 512 characters and no control characters")
    return key


class StateStore:
    """``compare_and_set`` moves a watermark only if it still is the expected one."""

    def get(self, key: str) -> Watermark | None:
        raise NotImplementedError

    def compare_and_set(self, key: str, expected: Watermark | None, new: Watermark) -> None:
        raise NotImplementedError


class InspectionStateStore(StateStore):
    """For profiling: knows nothing, refuses writes."""

    def get(self, key):
        return None

    def compare_and_set(self, key, expected, new):
        raise RuntimeError("inspection never moves a checkpoint")


class MemoryStateStore(StateStore):
    def __init__(self):
        self._held: dict[str, Watermark] = {}
        self._lock = threading.Lock()

    def get(self, key):
        return self._held.get(validate_state_key(key))

    def compare_and_set(self, key, expected, new):
        with self._lock:
            if self.get(key) != expected:
                raise StateConflictError(f"another run moved the checkpoint of {key!r}")
            self._held[key] = new


class JsonStateStore(StateStore):
    """One JSON file for all keys: locked, replaced whole, synced, readable by its owner only."""

    def __init__(self, path: str):
        self.path = Path(path)

    @contextlib.contextmanager
    def _locked(self):
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(f"{self.path}.lock", "a") as lock:
            fcntl.flock(lock, fcntl.LOCK_EX)
            yield

    def _read(self) -> dict:
        try:
            return json.loads(self.path.read_text(encoding="utf-8"))
        except FileNotFoundError:
            return {}

    def get(self, key):
        held = self._read().get(validate_state_key(key))
        return None if held is None else _from_text(json.dumps(held))

    def compare_and_set(self, key, expected, new):
        with self._locked():
            if self.get(key) != expected:
                raise StateConflictError(f"another run moved the checkpoint of {key!r}")
            everything = self._read() | {key: json.loads(json.dumps(asdict(new), default=lambda v: v.isoformat()))}
            handle, name = tempfile.mkstemp(dir=self.path.parent)  # mode 0600
            with os.fdopen(handle, "w", encoding="utf-8") as f:
                json.dump(everything, f, ensure_ascii=False, sort_keys=True)
                f.flush()
                os.fsync(f.fileno())
            os.replace(name, self.path)


class SqlStateStore(StateStore):
    """Checkpoints in a table of any DB-API database (``connect`` opens a connection; default: the
    SQLite file ``path``). A watermark moves by one conditional UPDATE or INSERT."""

    def __init__(self, path: str | None = None, connect: Callable[[], Any] | None = None, table: str = "ingestion_state", mark: str = "?"):
        self.table, self.mark = validate_identifier(table, "table"), mark
        self.connect = connect or (lambda: sqlite3.connect(path or "state.sqlite3", timeout=30))
        self._run(f"CREATE TABLE IF NOT EXISTS {table} (state_key VARCHAR(512) PRIMARY KEY, watermark VARCHAR(4000) NOT NULL)")

    def _run(self, sql: str, *values: str) -> tuple[list, int]:
        link = self.connect()
        try:
            cursor = link.cursor()
            cursor.execute(sql.replace("?", self.mark), values)
            rows = cursor.fetchall() if cursor.description else []
            link.commit()
            return rows, cursor.rowcount
        finally:
            link.close()

    def get(self, key):
        rows, _ = self._run(f"SELECT watermark FROM {self.table} WHERE state_key = ?", validate_state_key(key))
        return _from_text(rows[0][0]) if rows else None

    def compare_and_set(self, key, expected, new):
        validate_state_key(key)
        if expected is None:
            try:
                _, moved = self._run(f"INSERT INTO {self.table} (state_key, watermark) VALUES (?, ?)", key, _to_text(new))
            except Exception as e:  # drivers have their own errors for a key that is there
                if self.get(key) is None:
                    raise
                raise StateConflictError(f"another run moved the checkpoint of {key!r}") from e
        else:
            _, moved = self._run(f"UPDATE {self.table} SET watermark = ? WHERE state_key = ? AND watermark = ?", _to_text(new), key, _to_text(expected))
        if moved != 1:
            raise StateConflictError(f"another run moved the checkpoint of {key!r}")


def _to_text(mark: Watermark) -> str:
    return json.dumps(asdict(mark), default=lambda v: v.isoformat(), sort_keys=True)


def _from_text(text: str) -> Watermark:
    held = json.loads(text)
    day = held.get("last_data_date")
    return Watermark(datetime.fromisoformat(held["last_run_at"]), date.fromisoformat(day) if day else None, held.get("cursor_value"))


@dataclass(frozen=True)
class RunLogEntry:
    connector_name: str
    started_at: str
    finished_at: str
    status: str
    rows_loaded: int
    extra_fields_seen: list[str]
    error_message: str | None
    run_id: str
    ingestion_key: str
    destination: str
    window_start: str | None = None
    window_end: str | None = None
    watermark_before: str | None = None
    watermark_after: str | None = None


#: Fixed value: the audit's columns as Spark reads them.
RUN_LOG_SCHEMA = "connector_name string, started_at timestamp, finished_at timestamp, status string, rows_loaded long, extra_fields_seen array<string>, error_message string, run_id string, ingestion_key string, destination string, window_start date, window_end date, watermark_before string, watermark_after string"


class JsonlRunLog(RunLog):
    """One line a run, appended under a lock."""

    def __init__(self, path: str):
        self.path = Path(path)

    def record(self, entry: RunLogEntry) -> None:
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with open(self.path, "a", encoding="utf-8") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.write(json.dumps(asdict(entry), ensure_ascii=False) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(RUN_LOG_SCHEMA).json(str(self.path))


class ParquetRunLog(RunLog):
    """One small Parquet file a run, on any file system Spark writes to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def record(self, entry: RunLogEntry) -> None:
        line = json.dumps(asdict(entry), ensure_ascii=False)
        row = self.spark.createDataFrame([(line,)], "line string").select(F.from_json("line", RUN_LOG_SCHEMA).alias("r")).select("r.*")
        row.coalesce(1).write.mode("append").parquet(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(RUN_LOG_SCHEMA).parquet(self.path)


#: State stores and run logs by name; each takes (spark, destination, options).
STATE_STORES: dict[str, Callable[..., StateStore]] = {
    "memory": lambda spark, sink, **o: MemoryStateStore(),
    "json": lambda spark, sink, path=".sedimenta/state.json": JsonStateStore(path),
    "sqlite": lambda spark, sink, path=".sedimenta/state.sqlite3": SqlStateStore(path),
    "inspection": lambda spark, sink, **o: InspectionStateStore(),
}
RUN_LOGS: dict[str, Callable[..., RunLog]] = {
    "jsonl": lambda spark, sink, path=".sedimenta/runs.jsonl": JsonlRunLog(path),
    "parquet": lambda spark, sink, path=None: ParquetRunLog(spark, path or f"{sink.root}/run_log"),
}


def _local(sink) -> str | None:
    root = getattr(sink, "root", None)
    return None if root is None or ("://" in root and not root.startswith("file://")) else root.removeprefix("file://")


def state_store(name: str = "auto", spark: SparkSession | None = None, sink=None, **options) -> StateStore:
    """A state store by name. ``auto`` keeps the state beside the destination: in a Delta table for a
    Delta destination, in a JSON file for one on this machine's disks; there is no silent fallback."""
    kind = str(name).strip().lower()
    if kind == "auto":
        from sedimenta.sinks.delta import DeltaDestination, DeltaStateStore

        if isinstance(sink, DeltaDestination):
            return DeltaStateStore(spark, f"{sink.root}/_state")
        if _local(sink) is None:
            raise AdapterNotFoundError("no state store goes with this destination; name one")
        return JsonStateStore(f"{_local(sink)}/_state.json")
    if kind not in STATE_STORES:
        raise AdapterNotFoundError(f"no state store {name!r}; there are auto, {', '.join(sorted(STATE_STORES))}")
    return STATE_STORES[kind](spark, sink, **options)


def run_log(name: str = "auto", spark: SparkSession | None = None, sink=None, **options) -> RunLog:
    """A run log by name. ``auto`` keeps it beside the destination: one JSON line a run on this
    machine's disks, else Parquet files."""
    kind = str(name).strip().lower()
    if kind == "auto":
        return JsonlRunLog(f"{_local(sink)}/run_log.jsonl") if _local(sink) else ParquetRunLog(spark, f"{sink.root}/run_log")
    if kind not in RUN_LOGS:
        raise AdapterNotFoundError(f"no run log {name!r}; there are auto, {', '.join(sorted(RUN_LOGS))}")
    return RUN_LOGS[kind](spark, sink, **options)
