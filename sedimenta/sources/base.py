"""The contract of a source of records."""

from __future__ import annotations

from abc import ABC, abstractmethod
from datetime import date

from pyspark.sql import SparkSession


class Source(ABC):
    """What pipelines ask of a connector. It has ``name``, ``incremental`` and an ``endpoint`` with its
    ``url``; ``session`` gives one extraction with ``records`` (ordinal, raw), ``window``,
    ``max_data_date`` and ``commit``."""

    name: str

    @abstractmethod
    def session(self, spark: SparkSession, end: date | str = "today"):
        """Opens one extraction of the next window."""

    @abstractmethod
    def explain(self) -> dict:
        """What would be read, without reading and without secrets."""
