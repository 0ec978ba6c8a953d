"""Tables of records in a shared folder: append, update and delete, each a new version of the folder."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Records:
    """A Parquet table whose rows are appended in place and rewritten as a new version."""

    def __init__(self, spark: SparkSession, folder: str, version: str | None = None):
        self.spark, self.folder, self.version = spark, folder, version or uuid.uuid4().hex

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.version}"

    def append(self, rows: DataFrame) -> Records:
        rows.write.mode("append").parquet(self.path)
        return self

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def update(self, where: Column, values: Mapping[str, Column]) -> Records:
        """Rows for which the condition holds get the values; one whose condition is null stays."""
        hit = F.coalesce(where, F.lit(False))
        old = self.rows()
        return Records(self.spark, self.folder).append(old.withColumns({c: F.when(hit, v).otherwise(F.col(c)).cast(old.schema[c].dataType) for c, v in values.items()}))

    def delete(self, where: Column) -> Records:
        return Records(self.spark, self.folder).append(self.rows().where(~F.coalesce(where, F.lit(False))))
