"""Parquet tables of one database directory."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


class Tables:
    """Lazy access to ``<root>/<name>.parquet``; every read is a plain column-pruned scan."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def scan(self, name: str) -> DataFrame:
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._frames[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self.scan(name)
        raise AttributeError(name)

    def sql(self, text: str, **frames: DataFrame) -> DataFrame:
        """Spark SQL in which ``{orders}`` stands for the table of that name."""
        used = {n: self.scan(n) for n in TABLE_NAMES if "{" + n + "}" in text}
        used.update(frames)
        return self.spark.sql(text, **used)
