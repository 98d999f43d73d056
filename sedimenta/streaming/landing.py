"""Landing as a stream: page files in, idempotent micro-batches out."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.functions.types import EndpointSchema
from sedimenta.operators import bronze
from sedimenta.operators.bronze import LoadContext
from sedimenta.sinks.parquet import ParquetDestination


def land_stream(spark: SparkSession, source: str, name: str, endpoint: str, schema: EndpointSchema, sink: ParquetDestination, table: str, checkpoint: str, file_format: str = "parquet", raw: str = "raw"):
    """Every file of records below ``source`` (text column ``raw``) lands once: the micro-batch id is
    the ingestion key, so a batch replayed after a failure replaces its own partition. Runs over
    what is there, then ends."""
    stream = spark.readStream.format(file_format).schema(f"`{raw}` string").load(source)

    def land(batch: DataFrame, batch_id: int) -> None:
        key = hashlib.sha256(f"{name}\n{checkpoint}\n{batch_id}".encode()).hexdigest()[:32]
        context = LoadContext(f"batch-{batch_id}", key)
        sink.load(bronze.bronze_rows(batch, name, endpoint, schema, context, raw=raw), table, key)

    return stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_within(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """Drop repeats of a key that arrive within ``delay``; the state is bounded by the watermark."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def event_windows(stream: DataFrame, at: str, width: str, delay: str, keys: list[str], slide: str | None = None) -> DataFrame:
    """Counts per event-time window and keys; late rows up to ``delay`` are counted, later ones dropped."""
    window = F.window(at, width, slide) if slide else F.window(at, width)
    return stream.withWatermark(at, delay).groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n")


__all__ = ["event_windows", "land_stream", "once_within"]
