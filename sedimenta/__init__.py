"""Sedimenta: a Spark-native engine to capture, profile and land semi-structured records."""

from importlib import import_module

__version__ = "0.2.0"

#: Public names and where they live; each module is imported when its name is first used.
_PUBLIC = {
    "sedimenta.sources.rest": ("RestConnector", "DateParams", "ExtractionSession", "ProbeResult", "Endpoint"),
    "sedimenta.sources.base": ("Source",),
    "sedimenta.sources.http": ("HttpClient", "Response"),
    "sedimenta.sources.secrets": ("EnvSecrets", "FileSecrets", "StaticSecrets"),
    "sedimenta.sinks.base": ("Destination", "RunLog"),
    "sedimenta.sinks.parquet": ("ParquetDestination", "LoadResult"),
    "sedimenta.sinks.delta": ("DeltaDestination", "DeltaStateStore"),
    "sedimenta.sinks.state": ("StateStore", "JsonStateStore", "MemoryStateStore", "SqlStateStore", "InspectionStateStore", "JsonlRunLog", "ParquetRunLog", "RunLogEntry", "state_store", "run_log"),
    "sedimenta.operators.incremental": ("IncrementalStrategy", "NoIncrementalStrategy", "IncrementalWindow", "Watermark", "incremental_intent"),
    "sedimenta.operators.bronze": ("LoadContext", "bronze_rows", "staging"),
    "sedimenta.operators.report": ("ProfileReport", "profile_records", "typed_profile", "adaptive_cardinality"),
    "sedimenta.operators.drift": ("file_changes", "rescue_ingest", "replay_rescued"),
    "sedimenta.operators.shred": ("shred", "entity_table", "whole_entity"),
    "sedimenta.operators.upsert": ("BucketedRuns", "exactly_once", "redelivered"),
    "sedimenta.operators.profile": ("path_value_counts", "field_report", "load_findings", "load_drift"),
    "sedimenta.functions.types": ("ColumnSpec", "EndpointSchema"),
    "sedimenta.plans.pipeline": ("Pipeline", "Flow", "PipelineResult", "capabilities", "register_destination", "run_models"),
    "sedimenta.plans.schedule": ("CronTrigger", "IntervalTrigger", "Scheduler"),
}
_MODULE_OF = {name: module for module, names in _PUBLIC.items() for name in names}
__all__ = sorted(_MODULE_OF)


def __getattr__(name: str):
    if name not in _MODULE_OF:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_MODULE_OF[name]), name)


def __dir__() -> list[str]:
    return [*globals(), *__all__]
