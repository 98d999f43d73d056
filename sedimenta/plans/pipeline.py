"""Managed ingestion: extract, load, move the checkpoint, audit - in this order, with safe retries."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import AdapterNotFoundError, ScheduledPipelineError
from sedimenta.functions.text import redact_text
from sedimenta.functions.types import EndpointSchema, validate_identifier
from sedimenta.operators import bronze
from sedimenta.operators.bronze import LoadContext
from sedimenta.sinks.delta import DeltaDestination
from sedimenta.sinks.base import Destination, RunLog
from sedimenta.sinks.parquet import LoadResult, ParquetDestination
from sedimenta.sinks.state import RUN_LOGS, STATE_STORES, RunLogEntry, state_store
from sedimenta.sources.base import Source

DESTINATIONS = {"parquet": ParquetDestination, "delta": DeltaDestination}


def destination(name: str, **options):
    """A sink by name; there is no silent fallback."""
    if name not in DESTINATIONS:
        raise AdapterNotFoundError(f"no destination {name!r}; there are {', '.join(sorted(DESTINATIONS))}")
    return DESTINATIONS[name](**options)


def register_destination(name: str, build) -> None:
    DESTINATIONS[validate_identifier(name)] = build


@dataclass
class StepResult:
    name: str
    status: str
    rows_loaded: int = 0
    extra_fields_seen: list[str] = field(default_factory=list)
    error: str | None = None
    run_id: str = ""
    ingestion_key: str = ""


@dataclass
class PipelineResult:
    steps: list[StepResult]

    @property
    def rows_loaded(self) -> int:
        return sum(s.rows_loaded for s in self.steps)

    @property
    def success(self) -> bool:
        return all(s.status == "success" for s in self.steps)


def checkpoint_identity(connector: Source, window) -> str:
    """The retry identity: source configuration (secret names only) and the checkpoint before."""
    config = hashlib.sha256(json.dumps(connector.explain(), sort_keys=True, default=str).encode()).hexdigest()
    before = asdict(window.watermark_before) if window.watermark_before else None
    return json.dumps({"source": config, "key": getattr(connector.incremental, "key", connector.name), "watermark": before}, sort_keys=True, default=lambda v: v.isoformat())


class Pipeline:
    """Steps (connector, schema or None, target) into one destination.

    A failed step leaves checkpoint and other steps alone. Data are written before the checkpoint
    moves, so a crash between both repeats the window under the same ingestion key, which replaces
    its own rows. A failing audit does not fail the run."""

    def __init__(self, steps: list[tuple[Source, EndpointSchema | None, str]], sink: Destination, run_log: RunLog | None = None, sample: int = 100):
        if not steps:
            raise ValueError("a pipeline needs a step")
        self.steps, self.sink, self.run_log, self.sample = steps, sink, run_log, sample

    def run(self, spark: SparkSession, end: date | str = "today") -> PipelineResult:
        return PipelineResult([self._step(spark, *s, end) for s in self.steps])

    def _step(self, spark, connector: Source, schema: EndpointSchema | None, target: str, end) -> StepResult:
        began = datetime.now(timezone.utc)
        out = StepResult(connector.name, "error", run_id=uuid.uuid4().hex)
        window = after = session = None
        try:
            if connector.incremental.store is None and connector.incremental.key != "none":
                connector.incremental.store = state_store("auto", spark, self.sink)  # the checkpoint lies beside the data
            session = connector.session(spark, end)
            window = session.window
            context = LoadContext.for_window(connector.name, window.start, window.end, checkpoint_identity(connector, window), out.run_id)
            out.ingestion_key = context.ingestion_key
            with session:
                records = session.records
                shape = schema or EndpointSchema.from_names([c for c in bronze.infer_columns(records, "ordinal", sample=self.sample)])
                rows = bronze.bronze_rows(records, connector.name, connector.endpoint.url.partition("?")[0], shape, context)
                loaded: LoadResult = self.sink.load(rows, target, context.ingestion_key)
                out.rows_loaded, out.extra_fields_seen = loaded.rows_loaded, loaded.extra_fields_seen
                try:
                    session.commit()
                    out.status, after = "success", session.max_data_date
                except Exception as e:
                    out.status, out.error = "checkpoint_error", redact_text(e)
        except Exception as e:
            out.error = redact_text(e)
        finally:
            if hasattr(session, "release"):  # the rows are in the sink, or the step failed
                session.release()
        self._audit(out, began, window, after)
        return out

    def _audit(self, step: StepResult, began: datetime, window, after) -> None:
        if self.run_log is None:
            return
        text = lambda v: None if v is None else str(v)
        before = window.watermark_before.last_run_at.isoformat() if window and window.watermark_before else None
        entry = RunLogEntry(step.name, began.isoformat(), datetime.now(timezone.utc).isoformat(), step.status, step.rows_loaded, step.extra_fields_seen, step.error, step.run_id, step.ingestion_key, type(self.sink).__name__, text(window and window.start), text(window and window.end), before, text(after))
        try:
            self.run_log.record(entry)
        except OSError:  # the audit is best effort
            pass


class Flow:
    """``connector.to(sink, "schema.table").models({...}).run(spark)``."""

    def __init__(self, connector: Source, sink, target: str, schema: EndpointSchema | None = None, run_log: RunLog | None = None, sample: int = 100):
        for part in target.split("."):
            validate_identifier(part, "target")
        self.target, self._models = target, {}
        self.pipeline = Pipeline([(connector, schema, target)], sink, run_log, sample)

    def models(self, sql: dict[str, str]) -> Flow:
        """SQL models over the landed table (view ``landed``), run in order after a successful load."""
        self._models |= sql
        return self

    def run(self, spark: SparkSession, end: date | str = "today") -> tuple[PipelineResult, dict[str, DataFrame]]:
        result = self.pipeline.run(spark, end)
        if not result.success:
            return result, {}
        return result, run_models(spark, self._models, {"landed": self.pipeline.sink.read(spark, self.target)})


def run_models(spark: SparkSession, models: dict[str, str], inputs: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Each model is a SELECT over the inputs and the models before it, as temporary views."""
    for name, df in inputs.items():
        df.createOrReplaceTempView(validate_identifier(name, "model input"))
    out = {}
    for name, sql in models.items():
        out[name] = spark.sql(sql)
        out[name].createOrReplaceTempView(validate_identifier(name, "model"))
    return out


def latest_runs(log: DataFrame) -> DataFrame:
    """The newest run of each connector."""
    best = F.max_by(F.struct("*"), F.struct("finished_at", "run_id"))
    return log.groupBy("connector_name").agg(best.alias("r")).select("r.*")


def run_scheduled(pipeline: Pipeline, spark: SparkSession, end: date | str = "today") -> PipelineResult:
    """For schedulers: a failed run raises, so the job is seen to fail."""
    result = pipeline.run(spark, end)
    if not result.success:
        raise ScheduledPipelineError("; ".join(f"{s.name}: {s.error}" for s in result.steps if s.status != "success"))
    return result


def capabilities() -> dict:
    from sedimenta.operators.report import METRICS, PRESETS
    from sedimenta.sinks.parquet import DEFAULT_BATCH, MAX_BATCH, MIN_BATCH
    from sedimenta.sources.pagination import KINDS

    return {"pagination": sorted(KINDS), "metrics": sorted(METRICS), "presets": sorted(PRESETS), "destinations": sorted(DESTINATIONS), "state_stores": ["auto", *sorted(STATE_STORES)], "run_logs": ["auto", *sorted(RUN_LOGS)], "auth": ["api_key", "bearer", "none"], "batch": {"least": MIN_BATCH, "default": DEFAULT_BATCH, "most": MAX_BATCH}}
