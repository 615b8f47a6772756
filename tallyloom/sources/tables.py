"""Table access: declared schemas, lazy reads, one place that knows where data lives."""

from __future__ import annotations

import re
from copy import copy

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from tallyloom.session import tune
from tallyloom.sources import requests, roles, samples, schemas

DEFINITIONS = {**samples.TABLES, **requests.FEEDS}
_PLACEHOLDER = re.compile(r"\{(\w+)\}")


class ParquetTables:
    """Business tables stored as ``<root>/<table>`` parquet with the declared schema."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root

    def table(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(schemas.BUSINESS[name]).parquet(f"{self.root}/{name}")
        except AnalysisException as missing:
            # roles that nobody has stored are those of the catalogue
            if name != "roles" or missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return roles.role_table(self.spark).select("id", "name", "permissions")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.table(name)


class SampleTables(ParquetTables):
    """Business tables and feeds derived from the landing tables under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(tune(spark), root)
        self._known: dict[str, DataFrame] = {}

    def landing(self, name: str) -> DataFrame:
        return self.spark.read.schema(schemas.LANDING[name]).parquet(
            f"{self.root}/{name}.parquet"
        )

    def table(self, name: str) -> DataFrame:
        if name not in self._known:
            self._known[name] = self._build(name)
        return self._known[name]

    def replaced(self, **frames: DataFrame) -> SampleTables:
        """The same tables, but for the named ones."""
        other = copy(self)
        other._known = {**self._known, **frames}
        return other

    def _build(self, name: str) -> DataFrame:
        if name in schemas.LANDING:
            return self.landing(name)
        if name == "roles":
            return roles.role_table(self.spark).select("id", "name", "permissions")
        text = DEFINITIONS[name].replace("{ntz}", "TIMESTAMP_NTZ")
        inputs = {used: self.table(used) for used in set(_PLACEHOLDER.findall(text))}
        return self.spark.sql(text, **inputs)


class StreamTables(SampleTables):
    """The same definitions with the events arriving as a file stream, from a folder of their
    own if one is named."""

    def __init__(self, spark: SparkSession, root: str, arrivals: str | None = None):
        super().__init__(spark, root)
        self.arrivals = arrivals

    def landing(self, name: str) -> DataFrame:
        if name != "events":
            return super().landing(name)
        return (
            self.spark.readStream.schema(schemas.LANDING[name])
            .option("pathGlobFilter", "*.parquet" if self.arrivals else "events*.parquet")
            .parquet(self.arrivals or self.root)
        )
