"""One query for each operator of sources, pipelines and schedules, over a paged site that serves a test table."""

from __future__ import annotations

import json
from bisect import bisect_right
from datetime import date, datetime
from functools import lru_cache
from itertools import accumulate
from urllib.parse import parse_qs, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.errors import StateConflictError, UnsafeUrlError
from sedimenta.functions import text
from sedimenta.operators import report
from sedimenta.operators.incremental import IncrementalStrategy, Watermark
from sedimenta.plans import config, pipeline
from sedimenta.plans.schedule import CronTrigger
from sedimenta.session import scratch_path, table
from sedimenta.sinks import state
from sedimenta.sinks.parquet import ParquetDestination
from sedimenta.sources.http import HttpClient, Response, check_url
from sedimenta.sources.rest import MAX_PAGES, DateParams, RestConnector

QUERIES: dict = {}
SQL: dict[str, str] = {}
PAGE = 500
#: Records the site puts in one piece of an answer that has no pages.
CHUNK = 5_000
#: Rows the site turns into JSON at once.
PIECE = 20_000
COLUMNS = ("event_id", "ts", "user_id", "event_type")


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return keep


# ---- the site ------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def _groups(path: str) -> tuple:
    """The file system and (file, row group, rows) of a table's files, in order."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, folder = fs.FileSystem.from_uri(path)
    files = sorted(f.path for f in system.get_file_info(fs.FileSelector(folder)) if f.path.endswith(".parquet"))
    groups = []
    for file in files:
        with system.open_input_file(file) as source:
            meta = pq.ParquetFile(source).metadata
            groups += [(file, g, meta.row_group(g).num_rows) for g in range(meta.num_row_groups)]
    return system, groups


@lru_cache(maxsize=4)
def _group(path: str, n: int, days: tuple[str, str] | None, columns: tuple[str, ...] = COLUMNS):
    """One row group, of it the rows of these days."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    system, groups = _groups(path)
    file, g, _ = groups[n]
    with system.open_input_file(file) as source:
        rows = pq.ParquetFile(source).read_row_group(g, columns=list(columns))
    if days is None:
        return rows
    day, (first, last) = rows["ts"].cast(pa.date32()), map(date.fromisoformat, days)
    return rows.filter(pc.and_(pc.greater_equal(day, pa.scalar(first)), pc.less_equal(day, pa.scalar(last))))


@lru_cache(maxsize=4)
def _starts(path: str, days: tuple[str, str] | None) -> list[int]:
    """How many rows (of these days) lie before each row group, and at last all of them."""
    groups = _groups(path)[1]
    counts = [rows for *_, rows in groups] if days is None else [_group(path, n, days, ("ts",)).num_rows for n in range(len(groups))]
    return [0, *accumulate(counts)]


def _values(column):
    """The JSON text of each value, as ``json.dumps`` gives it; dates and times as ``isoformat`` does."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_integer(column.type):
        texts = column.cast(pa.string())
    elif column.type == pa.timestamp("us"):
        day = pc.replace_substring(column.cast(pa.string()), " ", "T", max_replacements=1)
        texts = pc.binary_join_element_wise('"', pc.replace_substring_regex(day, r"\.000000$", ""), '"', "")
    else:
        codes = column.dictionary_encode()
        texts = pa.array([json.dumps(v.isoformat() if isinstance(v, date) else v) for v in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
    return pc.fill_null(texts, "null")


@lru_cache(maxsize=2)
def _texts(path: str, n: int, piece: int, days: tuple[str, str] | None) -> list[str]:
    """The records of one piece of a row group, as JSON: pages beside each other share it."""
    import pyarrow.compute as pc

    rows = _group(path, n, days).slice(piece * PIECE, PIECE)
    event, ts, user, kind = (_values(rows[c]) for c in COLUMNS)
    return pc.binary_join_element_wise('{"event_id": ', event, ', "at": ', ts, ', "who": {"id": ', user, '}, "event_type": ', kind, "}", "").to_pylist()


def _text(path: str, first: int, last: int, days: tuple[str, str] | None) -> str:
    """The records from ``first`` up to ``last``, in order, as the inside of a JSON array."""
    out, starts = [], _starts(path, days)
    last = min(last, starts[-1])
    n = bisect_right(starts, first) - 1
    while first < last:
        piece, at = divmod(first - starts[n], PIECE)
        upto = min(last, starts[n + 1], first - at + PIECE)
        out += _texts(path, n, piece, days)[at : at + upto - first]
        first, n = upto, n + (upto == starts[n + 1])
    return ", ".join(out)


def _records(path: str, first: int, last: int, days: tuple[str, str] | None) -> list[dict]:
    return json.loads(f"[{_text(path, first, last, days)}]")


class TableSite:
    """A transport that answers as a paged API would, from the events table of a folder; the last part
    of the URL's path tells how it pages. The table is staged in the order of its identifiers; the site
    travels to the reading task and reads there the row groups it is asked for, one at a time."""

    def __init__(self, spark: SparkSession, folder: str):
        self.path = scratch_path(spark, "site")
        table(spark, folder, "events").select(*COLUMNS).orderBy("event_id").write.parquet(self.path)
        if self.path.startswith("file:"):
            self.path = urlsplit(self.path).path

    @property
    def pages(self) -> int:
        """Pages of the whole table, with the empty one that ends it."""
        return _starts(self.path, None)[-1] // PAGE + 2

    def _whole(self, days, before: str, after: str):
        total = _starts(self.path, days)[-1]
        yield before.encode() + b"["
        for at in range(0, total, CHUNK):
            yield (", " * (at > 0) + _text(self.path, at, at + CHUNK, days)).encode()
        yield b"]" + after.encode()

    def __call__(self, method, url, headers, body, timeout):
        parts = urlsplit(url)
        style = parts.path.rsplit("/", 1)[-1]
        asked = json.loads(body) if body else {k: v[0] for k, v in parse_qs(parts.query).items()}
        days = (asked["from"], asked["to"]) if "from" in asked else None
        if style not in ("numbered", "offset", "cursor", "links", "next"):
            return Response(200, {}, self._whole(days, *(('{"payload": {"odd.key": ', "}}") if style == "nested" else ("", ""))), url)
        total = _starts(self.path, days)[-1]
        head: dict[str, str] = {}
        at = int(asked.get("cursor") or 0) if style == "cursor" else int(asked.get("at", 0))
        size = PAGE
        if style == "numbered":
            size = int(asked["per_page"])
            at = (int(asked["page"]) - 1) * size
        elif style == "offset":
            at, size = int(asked["offset"]), int(asked["limit"])
        answer = f"[{_text(self.path, at, at + size, days)}]"
        more = at + PAGE < total
        if style == "offset":
            answer = f'{{"results": {answer}}}'
        elif style == "cursor":
            answer = f'{{"data": {answer}, "meta": {json.dumps({"next_cursor": str(at + PAGE) if more else None})}}}'
        elif style == "links":
            head = {"Link": f'</v1/events/links?at={at + PAGE}>; rel="next"'} if more else {}
        elif style == "next":
            answer = f'{{"items": {answer}, "next": {json.dumps(f"/v1/events/next?at={at + PAGE}" if more else None)}}}'
        return Response(200, head, answer.encode(), url)


def _connector(spark: SparkSession, d: str, style: str, site: TableSite | None = None, **options) -> RestConnector:
    """Its guards are set to the table: as many pages as it has, and a whole answer of any size."""
    site = site or TableSite(spark, d)
    client = HttpClient(transport=site, backoff=0, max_body=None)
    return RestConnector(f"https://site.example/v1/events/{style}", name="events", client=client, max_pages=max(MAX_PAGES, site.pages), **options)


def _typed(records: DataFrame) -> DataFrame:
    row = F.from_json("raw", "event_id bigint, at string, who struct<id: bigint>, event_type string")
    return records.select(row.alias("r")).select("r.event_id", F.col("r.who.id").alias("user_id"), "r.event_type")


_ALL = "SELECT event_id, user_id, event_type FROM events"


def _paged(name: str, style: str, **options) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _typed(_connector(spark, d, style, **options).raw_records(spark))

    run.__name__ = name
    query(_ALL)(run)


_paged("source_numbered", "numbered", pagination={"type": "page", "size": PAGE})
_paged("source_offset", "offset", pagination={"type": "offset", "size": PAGE, "short_page_ends": True})
_paged("source_cursor", "cursor", pagination={"type": "cursor", "cursor_path": "meta.next_cursor"})
_paged("source_links", "links", pagination="link")
_paged("source_next_url", "next", pagination="next_url")
_paged("source_auto_cursor", "cursor")
_paged("source_auto_links", "links", pagination="auto")
_paged("source_whole", "whole", pagination=False)
_paged("source_post", "offset", method="POST", pagination={"type": "offset", "size": PAGE})
_paged("source_records_path", "nested", records='payload["odd.key"]', pagination=False)
_paged("source_records_function", "nested", records=lambda body: body["payload"]["odd.key"], pagination=False)


# ---- extraction ----------------------------------------------------------------------------------

_START, _END = date(2024, 1, 5), date(2024, 1, 20)
_WINDOW = "ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'"


def _dated(spark: SparkSession, d: str, style: str = "cursor", store=None, **options) -> RestConnector:
    options = {"date_field": "at", **options}
    return _connector(spark, d, style, incremental=IncrementalStrategy(store or state.MemoryStateStore(), "events", initial_start=_START), **options)


@query(f"SELECT min(event_id) AS event_id, user_id, event_type FROM events WHERE {_WINDOW} GROUP BY user_id, event_type")
def source_session(spark, d):
    """The window on the client, then the projection, then the first record of each key."""
    c = _dated(spark, d, select={"event_id": "event_id", "who.id": "user_id", "event_type": "event_type"}, primary_key=["user_id", "event_type"], dedup=True)
    with c.session(spark, _END) as session:
        rows = session.records
        session.commit()
    return rows.select(F.from_json("raw", "event_id bigint, user_id bigint, event_type string").alias("r")).select("r.*")


@query(f"SELECT event_id, user_id, event_type FROM events WHERE {_WINDOW}")
def source_date_params(spark, d):
    """The window is sent to the source."""
    with _dated(spark, d, "whole", pagination=False, date_params=DateParams("from", "to")).session(spark, _END) as session:
        rows = session.records
        session.commit()
    return _typed(rows)


@query("SELECT event_id, upper(event_type) AS event_type, length(event_type)::INTEGER AS size FROM events")
def source_transform(spark, d):
    """A function over each record, before the projection."""
    c = _connector(spark, d, "cursor", record_transform=lambda r: r | {"event_type": r["event_type"].upper(), "size": len(r["event_type"])}, select="event_id, event_type, size")
    with c.session(spark) as session:
        rows = session.records
    return rows.select(F.from_json("raw", "event_id bigint, event_type string, size int").alias("r")).select("r.*")


@query("SELECT event_no // 300 AS batch, count(*) AS n, min(event_id) AS first_event FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS event_no FROM events) GROUP BY batch")
def source_batches(spark, d):
    """The batches of a stream."""
    c = _connector(spark, d, "numbered", pagination={"type": "page", "size": PAGE})
    out = [(n, len(batch), batch[0]["event_id"]) for n, batch in enumerate(c.stream(spark, batch_size=300))]
    return spark.createDataFrame(out, "batch long, n long, first_event long")


@query("SELECT 25::BIGINT AS records, 'data' AS records_path, 'cursor' AS pagination, 200 AS status_code, min(event_id) AS first_event FROM events")
def source_probe(spark, d):
    probe = _connector(spark, d, "cursor").probe()
    return spark.createDataFrame([(len(probe.records), probe.records_path, probe.pagination, probe.status_code, probe.records[0]["event_id"])], "records long, records_path string, pagination string, status_code int, first_event long")


@query("""SELECT unnest(['at', 'event_id', 'event_type', 'who', 'who.id']) AS path, count(*) AS records_present, unnest(['string', 'integer', 'string', 'object', 'integer']) AS kind, 0::BIGINT AS missing, 0::BIGINT AS nulls FROM events""")
def source_profile(spark, d):
    """Native values, no checkpoint moved."""
    r = _dated(spark, d, store=state.InspectionStateStore()).profile(spark, "missing", "nulls", "types")
    return spark.createDataFrame([(f["path"], f["records_present"], ",".join(f["types"]), f["missing"], f["nulls"]) for f in r.fields], "path string, records_present long, kind string, missing long, nulls long")


@query(f"""WITH w AS (SELECT max(ts)::DATE AS last FROM events WHERE {_WINDOW}) SELECT 1 AS step, DATE '2024-01-05' AS window_start, DATE '2024-01-20' AS window_end, (SELECT count(*) FROM events WHERE {_WINDOW}) AS records, last AS watermark FROM w
UNION ALL SELECT 2, last, DATE '2024-01-25', (SELECT count(*) FROM events WHERE ts::DATE BETWEEN last AND DATE '2024-01-25'), (SELECT coalesce(max(ts)::DATE, DATE '2024-01-25') FROM events WHERE ts::DATE BETWEEN last AND DATE '2024-01-25') FROM w""")
def incremental_windows(spark, d):
    """Two windows: the second starts on the watermark of the first, whose day is read again."""
    store, site, out = state.MemoryStateStore(), TableSite(spark, d), []
    for step, end in ((1, _END), (2, date(2024, 1, 25))):
        with _dated(spark, d, store=store, site=site).session(spark, end) as session:
            n = session.records.count()
            session.commit()
        session.release()
        out.append((step, session.window.start, session.window.end, n, store.get("events").last_data_date))
    return spark.createDataFrame(out, "step int, window_start date, window_end date, records long, watermark date")


# ---- pipelines -----------------------------------------------------------------------------------


def _landed(spark: SparkSession, d: str, sink: ParquetDestination, end: date, store, site: TableSite) -> pipeline.PipelineResult:
    return pipeline.Pipeline([(_dated(spark, d, store=store, site=site), None, "bronze.events")], sink, state.ParquetRunLog(spark, f"{sink.root}/log")).run(spark, end)


@query(f"SELECT event_id::VARCHAR AS event_id, event_type, user_id::VARCHAR AS who_id, DATE '2024-01-05' AS _window_start, DATE '2024-01-20' AS _window_end, 'events' AS _source FROM events WHERE {_WINDOW}")
def pipeline_landed(spark, d):
    """A window whose first run failed to move the checkpoint, run again: its rows land once."""

    class Stuck(state.MemoryStateStore):
        def compare_and_set(self, key, expected, new):
            raise StateConflictError("another run was faster")

    sink, site = ParquetDestination(scratch_path(spark, "landed")), TableSite(spark, d)
    _landed(spark, d, sink, _END, Stuck(), site)
    _landed(spark, d, sink, _END, state.MemoryStateStore(), site)
    return sink.read(spark, "bronze.events").select("event_id", "event_type", "who_id", "_window_start", "_window_end", "_source")


@query(f"SELECT unnest(['checkpoint_error', 'success']) AS status, 'events' AS connector_name, count(*) AS rows_loaded, DATE '2024-01-05' AS window_start, 1::BIGINT AS runs FROM events WHERE {_WINDOW}")
def pipeline_log(spark, d):
    sink, site = ParquetDestination(scratch_path(spark, "logged")), TableSite(spark, d)

    class Stuck(state.MemoryStateStore):
        def compare_and_set(self, key, expected, new):
            raise StateConflictError("another run was faster")

    for store in (Stuck(), state.MemoryStateStore()):
        _landed(spark, d, sink, _END, store, site)
    log = state.ParquetRunLog(spark, f"{sink.root}/log").read(spark)
    return log.groupBy("status", "connector_name", "rows_loaded", "window_start").agg(F.count("*").alias("runs"))


@query(f"SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events WHERE {_WINDOW} GROUP BY event_type")
def flow_models(spark, d):
    """Landing, then SQL models over the landed table."""
    sink = ParquetDestination(scratch_path(spark, "flow"))
    models = {"staging": "select cast(event_id as bigint) as event_id, event_type, who_id from landed", "daily": "select event_type, count(*) as n, count(distinct who_id) as users from staging group by event_type"}
    _, out = _dated(spark, d).to(sink, "bronze.events").models(models).run(spark, _END)
    return out["daily"]


@query(f"SELECT count(*) AS n, max(event_id)::VARCHAR AS last_event FROM (SELECT event_id FROM events WHERE {_WINDOW})")
def config_pipeline(spark, d):
    """The same from a configuration, with a transform block."""
    site = TableSite(spark, d)
    made = {
        "name": "events", "destination": {"type": "parquet", "root": scratch_path(spark, "configured")}, "state": "memory", "run_log": False,
        "connector": {"name": "events", "base_url": "https://site.example/v1/events/cursor", "pagination": "auto", "max_pages": max(MAX_PAGES, site.pages), "incremental": {"field": "at", "start": "2024-01-05"}},
        "transform": {"counted": "select count(*) as n, cast(max(cast(event_id as bigint)) as string) as last_event from events"},
    }
    return config.run_config(made, spark, _END, transport=site)[1]["counted"]


@query("""SELECT s.store, t.step, t.outcome FROM (VALUES ('json'), ('memory'), ('sqlite')) s(store), (VALUES (1, 'moved'), (2, 'refused'), (3, 'moved'), (4, 'refused')) t(step, outcome)""")
def checkpoint_race(spark, d):
    """Compare and set: the first wins, a second first is refused, the expected one moves, the stale one is refused."""
    import tempfile

    first, second = Watermark(datetime(2024, 1, 1), date(2024, 1, 1)), Watermark(datetime(2024, 1, 2), date(2024, 1, 2))
    out = []
    with tempfile.TemporaryDirectory() as folder:  # the driver's own files, as these stores are
        for name, options in (("json", {"path": f"{folder}/s.json"}), ("memory", {}), ("sqlite", {"path": f"{folder}/s.db"})):
            store = state.state_store(name, spark, None, **options)
            for step, (expected, new) in enumerate(((None, first), (None, second), (first, second), (first, first)), 1):
                try:
                    store.compare_and_set("k", expected, new)
                    out.append((name, step, "moved"))
                except StateConflictError:
                    out.append((name, step, "refused"))
    return spark.createDataFrame(out, "store string, step int, outcome string")


@query("""SELECT moment FROM (SELECT unnest(generate_series(TIMESTAMP '2024-02-28 00:00:00', TIMESTAMP '2024-03-05 23:59:00', INTERVAL 1 MINUTE)) AS moment)
WHERE minute(moment) % 20 = 0 AND hour(moment) BETWEEN 3 AND 4 AND isodow(moment) BETWEEN 1 AND 5""")
def cron_moments(spark, d):
    trigger, at, out = CronTrigger("*/20 3-4 * * 1-5"), datetime(2024, 2, 27, 23, 59), []
    while (at := trigger.after(at)) < datetime(2024, 3, 6):
        out.append((at,))
    return spark.createDataFrame(out, "moment timestamp_ntz")


@query("""SELECT * FROM (VALUES ('https://api.example/v1', true), ('http://api.example/v1', false), ('ftp://api.example/v1', false), ('https://user:pass@api.example/v1', false), ('https://', false), ('file:///etc/passwd', false), ('https://api.example:8443/x?y=1', true)) t(url, safe)""")
def url_safety(spark, d):
    def safe(url: str) -> bool:
        try:
            check_url(url, False)
            return True
        except (UnsafeUrlError, ValueError):
            return False

    urls = ["https://api.example/v1", "http://api.example/v1", "ftp://api.example/v1", "https://user:pass@api.example/v1", "https://", "file:///etc/passwd", "https://api.example:8443/x?y=1"]
    return spark.createDataFrame([(u, safe(u)) for u in urls], "url string, safe boolean")


@query("""SELECT * FROM (VALUES ('quality', 'duplicates,empty,missing,nulls,types'), ('statistics', 'cardinality,count'), ('schema', 'missing,schema,types'), ('all', 'cardinality,count,duplicates,empty,missing,nulls,schema,types'), ('nulls,statistics', 'cardinality,count,nulls')) t(asked, metrics)""")
def metric_plans(spark, d):
    asked = ["quality", "statistics", "schema", "all", "nulls,statistics"]
    return spark.createDataFrame([(a, ",".join(report.resolve_metrics(a.split(",")))) for a in asked], "asked string, metrics string")


@query("""WITH n AS (SELECT source, count(*) AS records FROM profile_records GROUP BY source) SELECT source, 'Profile of ' || source || chr(10) || 'Records: ' || format('{:,}', records) AS rendered FROM n""")
def report_rendering(spark, d):
    """The text form of a count per source."""
    counts = spark.read.parquet(f"{d}/profile_records.parquet").groupBy("source").agg(F.count("*").alias("n"))
    return spark.createDataFrame([(r["source"], report.ProfileReport(r["source"], ("count",), r["n"]).render_text()) for r in counts.collect()], "source string, rendered string")


@query("SELECT source, format('{:,}', sum(n)::BIGINT) AS records, printf('%.1f%%', 100.0 * sum(n) FILTER (empty) / sum(n)) AS without_email FROM (SELECT source, coalesce(trim(raw::JSON->>'$.email'), '') = '' AS empty, count(*) AS n FROM profile_records GROUP BY ALL) GROUP BY source")
def number_formats(spark, d):
    empty = F.coalesce(F.trim(F.get_json_object("raw", "$.email")), F.lit("")) == ""
    counts = spark.read.parquet(f"{d}/profile_records.parquet").groupBy("source").agg(F.count("*").alias("n"), F.count_if(empty).alias("e"))
    return counts.select("source", text.thousands(F.col("n")).alias("records"), text.percentage(F.col("e"), F.col("n")).alias("without_email"))


__all__ = ["QUERIES", "SQL", "TableSite"]
