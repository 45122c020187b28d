"""Tables kept as a folder of versions: what is read is never written over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import complete


class VersionedTable:
    """A Parquet table at its latest complete version; a write makes the next one.

    A folder that isn't there is an empty table.  A write that was broken off leaves no version and is
    written over by the next.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema
        self.version = max((int(n[1:]) for n in complete(spark, path) if n[:1] == "v" and n[1:].isdigit()), default=0)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{self.version}") if self.version else self.spark.createDataFrame([], self.schema)

    def write(self, rows: DataFrame) -> None:
        rows.select(*self.read().columns).write.mode("overwrite").parquet(f"{self.path}/v{self.version + 1}")
        self.version += 1
