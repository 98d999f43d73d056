"""Pipelines from configuration files: strict keys, bounded size, secrets by name only."""

from __future__ import annotations

import os
from pathlib import Path

from sedimenta.errors import AdapterNotFoundError, PipelineConfigError
from sedimenta.functions.types import ColumnSpec, EndpointSchema
from sedimenta.operators.incremental import NO_INCREMENT, incremental_intent
from sedimenta.plans.pipeline import Pipeline, destination
from sedimenta.sinks.state import InspectionStateStore, run_log, state_store
from sedimenta.sources.http import HttpClient, resolve_auth
from sedimenta.sources.rest import RestConnector
from sedimenta.sources.secrets import EnvSecrets, FileSecrets

#: Fixed values.
MAX_BYTES = 1024 * 1024
TOP = {"name", "sources", "connector", "schema", "destination", "state", "run_log", "secrets", "target", "transform"}
SOURCE = {"name", "base_url", "method", "params", "records", "select", "pagination", "auth", "incremental", "date_field", "initial_start", "start_param", "end_param", "date_format", "date_params", "primary_key", "dedup", "max_pages", "schema", "target"}
SENSITIVE = ("authorization", "api_key", "apikey", "token", "access_token", "password", "secret", "client_secret")


def _known(mapping: dict, names: set[str], where: str) -> dict:
    if not isinstance(mapping, dict):
        raise PipelineConfigError(f"{where} is a mapping")
    extra = sorted(set(mapping) - names)
    if extra:
        raise PipelineConfigError(f"{where} does not know {', '.join(map(str, extra))}")
    return mapping


def load_config(path: str) -> dict:
    """A YAML or JSON mapping of at most 1 MiB; a key may not come twice."""
    import json

    file = Path(path)
    if file.stat().st_size > MAX_BYTES:
        raise PipelineConfigError(f"{file.name} is larger than {MAX_BYTES} bytes")
    try:
        text = file.read_bytes().decode("utf-8")
    except UnicodeDecodeError:
        raise PipelineConfigError(f"{file.name} is not UTF-8") from None

    def once(pairs):
        keys = [k for k, _ in pairs]
        if len(set(keys)) < len(keys):
            raise PipelineConfigError(f"a key comes twice in {file.name}")
        return dict(pairs)

    if file.suffix == ".json":
        out = json.loads(text, object_pairs_hook=once)
    else:
        try:
            import yaml
        except ImportError:
            raise PipelineConfigError("YAML files need the yaml package; JSON works without it") from None

        class Loader(yaml.SafeLoader):
            pass

        def mapping(loader, node):
            return once([(loader.construct_object(k, deep=True), loader.construct_object(v, deep=True)) for k, v in node.value])

        Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        try:
            out = yaml.load(text, Loader=Loader)  # noqa: S506 - a SafeLoader
        except yaml.YAMLError as e:
            raise PipelineConfigError(f"{file.name} is no valid YAML: {type(e).__name__}") from None
    if not isinstance(out, dict):
        raise PipelineConfigError(f"{file.name} is no mapping")
    return out


def save_config(config: dict, path: str) -> None:
    """Written as JSON, readable by its owner only."""
    import json

    with open(os.open(path, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(config, f, ensure_ascii=False, indent=2)


def _refuse_secrets(mapping: dict, where: str) -> None:
    for key in mapping:
        if str(key).lower().replace("-", "_") in SENSITIVE:
            raise PipelineConfigError(f"{where}.{key} holds a credential; use auth with secret_key")


def build_connector(source: dict, store, secrets, inspect: bool = False, transport=None) -> RestConnector:
    s = _known(source, SOURCE, "source")
    if "base_url" not in s:
        raise PipelineConfigError("a source needs base_url")
    _refuse_secrets(s.get("params") or {}, "params")
    wanted = s.get("incremental")
    if s.get("initial_start") is not None and wanted not in (None, False):
        wanted = {"mode": "data_date"} if wanted is True else {"mode": wanted} if wanted in ("data_date", "ingestion_date") else {"field": wanted} if isinstance(wanted, str) and wanted.strip().lower() not in NO_INCREMENT else wanted
        wanted = wanted | {"start": wanted.get("start") or s["initial_start"]} if isinstance(wanted, dict) else wanted
    try:
        strategy, field = incremental_intent(wanted, s.get("name") or s["base_url"], s.get("date_field"), InspectionStateStore() if inspect else store)
    except TypeError as e:
        raise PipelineConfigError(str(e)) from None
    client = HttpClient(resolve_auth(s.get("auth")), secrets, **({"transport": transport} if transport else {}))
    return RestConnector(s["base_url"], s.get("name"), method=s.get("method", "GET"), params=s.get("params"), records=s.get("records"), select=s.get("select"), pagination=s.get("pagination"), client=client, incremental=strategy, date_field=field, start_param=s.get("start_param"), end_param=s.get("end_param"), date_format=s.get("date_format", "%Y-%m-%d"), date_params=s.get("date_params"), primary_key=s.get("primary_key"), dedup=bool(s.get("dedup", False)), max_pages=s.get("max_pages", 10_000))


def build_schema(columns: list | None) -> EndpointSchema | None:
    if not columns:
        return None
    return EndpointSchema([ColumnSpec(c) if isinstance(c, str) else ColumnSpec(c["name"], c.get("type", "string")) for c in columns])


def _named(make, wanted, default: str, sink):
    """A registered adapter from its short form (a name), its block ({type, ...options}) or nothing."""
    if isinstance(wanted, str):
        wanted = {"type": wanted}
    options = dict(wanted) if isinstance(wanted, dict) else {}
    _refuse_secrets(options, "adapter")
    from pyspark.sql import SparkSession

    return make(options.pop("type", default), SparkSession.getActiveSession(), sink, **options)


def list_configs(folder: str) -> list[dict]:
    """(file, name, sources, error) of each pipeline file in a folder, by file name; broken files are
    listed with what is wrong."""
    out = []
    for file in sorted(p for p in Path(folder).iterdir() if p.suffix in (".json", ".yaml", ".yml")):
        try:
            config = _known(load_config(str(file)), TOP, "pipeline")
            out.append({"file": file.name, "name": config.get("name") or file.stem, "sources": len(config.get("sources") or [config.get("connector")]), "error": None})
        except (PipelineConfigError, ValueError) as e:
            out.append({"file": file.name, "name": file.stem, "sources": 0, "error": str(e)})
    return out


def models_of(config: dict) -> dict[str, str]:
    """The SQL models of the transform block: a mapping name -> SELECT, or a list of {name, sql}."""
    block = config.get("transform") or {}
    block = block.get("models", block) if isinstance(block, dict) else block
    pairs = block.items() if isinstance(block, dict) else [(_known(m, {"name", "sql"}, "transform").get("name"), m.get("sql")) for m in block]
    out = dict(pairs)
    if not all(isinstance(k, str) and isinstance(v, str) for k, v in out.items()):
        raise PipelineConfigError("transform maps model names to SELECT texts")
    return out


def run_config(config: dict, spark, end="today", transport=None):
    """The pipeline's result and, after a successful run, its models over the landed tables (each a view
    named like the last part of its target)."""
    from sedimenta.plans.pipeline import run_models

    pipeline, models = build_pipeline(config, transport), models_of(config)
    result = pipeline.run(spark, end)
    if not result.success or not models:
        return result, {}
    return result, run_models(spark, models, {target.split(".")[-1]: pipeline.sink.read(spark, target) for _, _, target in pipeline.steps})


def build_pipeline(config: dict, transport=None) -> Pipeline:
    c = _known(config, TOP, "pipeline")
    if ("sources" in c) == ("connector" in c):
        raise PipelineConfigError("a pipeline has either connector or sources")
    where = c.get("secrets") or {}
    secrets = FileSecrets(where["folder"]) if where.get("folder") else EnvSecrets()
    sink_options = dict(c.get("destination") or {})
    _refuse_secrets(sink_options, "destination")
    try:
        sink = destination(sink_options.pop("type", "parquet"), **sink_options)
    except TypeError as e:
        raise PipelineConfigError(f"bad destination: {e}") from None
    try:
        store = _named(state_store, c.get("state"), "json", sink)
        log = None if c.get("run_log") is False else _named(run_log, c.get("run_log"), "jsonl", sink)
    except (TypeError, AdapterNotFoundError) as e:
        raise PipelineConfigError(f"bad state or run_log: {e}") from None
    steps = []
    for s in c.get("sources") or [c["connector"]]:
        connector = build_connector(s, store, secrets, transport=transport)
        steps.append((connector, build_schema(s.get("schema") or c.get("schema")), s.get("target") or c.get("target") or f"bronze.{connector.name}"))
    return Pipeline(steps, sink, log)
