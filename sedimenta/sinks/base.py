"""The contracts of a destination, a checkpoint store and a run log."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession


class Destination(ABC):
    """Where landed rows go. A load of an ingestion key that was loaded before replaces its rows; one
    without rows leaves a readable table."""

    @abstractmethod
    def load(self, rows: DataFrame, table: str, ingestion_key: str):
        """Writes the rows of one ingestion key; a LoadResult."""

    @abstractmethod
    def read(self, spark: SparkSession, table: str) -> DataFrame:
        """The table as landed."""


class RunLog(ABC):
    """The audit of runs: append only."""

    @abstractmethod
    def record(self, entry) -> None:
        """Adds one run."""

    @abstractmethod
    def read(self, spark: SparkSession) -> DataFrame:
        """All runs, in RUN_LOG_SCHEMA."""
