"""Tables of rows by key: an upsert writes the buckets of its keys anew, a lookup reads one.

Rows lie in buckets by a hash of their key.  A manifest, one small file a version, says in which folder each bucket is;
a write puts the touched buckets into new folders and then the next manifest beside the others, so what is
read is never written over and a write that was broken off is as if it hadn't been.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKETS = 64
_BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has made this version."""


class KeyedTable:
    """A Parquet table in ``buckets`` buckets by ``keys``; a folder that isn't there is an empty table.

    The number of buckets is the one that the table was made with, until ``rebucket``; one for every 100 MB or so keeps
    a lookup small.  Rows with the same key are the caller's matter: ``upsert`` says which one stays.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys = spark, path.rstrip("/"), list(keys)
        self.schema = StructType.fromDDL(schema)
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.version, self.buckets, self.folders = 0, buckets, {}
        self.refresh()

    def refresh(self) -> None:
        """Take up the latest version."""
        where = self._path(f"{self.path}/manifests")
        found = [x.getPath().getName() for x in self._fs.listStatus(where)] if self._fs.exists(where) else []
        self.version = max((int(n[1:-5]) for n in found if n.startswith("v") and n.endswith(".json")), default=0)
        if self.version:
            stream = self._fs.open(self._path(self._manifest(self.version)))
            try:
                read = json.loads(bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
            finally:
                stream.close()
            self.buckets, self.folders = read["buckets"], {int(k): v for k, v in read["folders"].items()}

    def _manifest(self, version: int) -> str:
        return f"{self.path}/manifests/v{version:012d}.json"

    def _commit(self, folders: dict[int, str], buckets: int) -> None:
        """The next version: its manifest is written aside and renamed, which fails if another writer was first."""
        aside = self._path(f"{self.path}/aside/{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"buckets": buckets, "folders": folders}).encode()))
        out.close()
        target = self._path(self._manifest(self.version + 1))
        self._fs.mkdirs(target.getParent())
        if self._fs.exists(target) or not self._fs.rename(aside, target):
            self._fs.delete(aside, False)
            raise Conflict(f"version {self.version + 1} of {self.path} is there already")
        self.version, self.buckets, self.folders = self.version + 1, buckets, folders

    def bucket(self, buckets: int | None = None) -> Column:
        types = {f.name: f.dataType for f in self.schema}
        return F.pmod(F.xxhash64(*(F.col(k).cast(types[k]) for k in self.keys)), F.lit(buckets or self.buckets)).cast("int")

    def read(self, only: list[int] | None = None) -> DataFrame:
        """The rows, of the given buckets or all."""
        paths = [p for b, p in sorted(self.folders.items()) if only is None or b in set(only)]
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{p}" for p in paths)) if paths else self.spark.createDataFrame([], self.schema)

    def _touched(self, rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select(self.bucket().alias(_BUCKET)).distinct().collect())  # at most as many as buckets

    def _written(self, rows: DataFrame, buckets: int) -> dict[int, str]:
        folder = f"data/{uuid.uuid4().hex}"
        placed = rows.select(*self.schema.names).withColumn(_BUCKET, self.bucket(buckets))
        placed.repartition(_BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        made = self._fs.listStatus(self._path(f"{self.path}/{folder}"))
        return {int(n.split("=")[1]): f"{folder}/{n}" for n in (x.getPath().getName() for x in made) if n.startswith(f"{_BUCKET}=")}

    def update(self, new: DataFrame, merge) -> list[int]:
        """Put ``merge(stored, new)`` in the place of the buckets that ``new`` has keys of; returns these.

        ``stored`` holds these buckets' rows alone, so what merge keeps or drops of other keys in them is its matter.
        """
        touched = self._touched(new)
        if touched:
            merged = merge(self.read(touched), new)
            made = self._written(merged, self.buckets)
            self._commit({b: p for b, p in self.folders.items() if b not in set(touched)} | made, self.buckets)
        return touched

    def replace(self, new: DataFrame) -> list[int]:
        """Upsert: rows of ``new``, whose keys must be distinct, take the place of those with their keys."""
        def merge(stored: DataFrame, rows: DataFrame) -> DataFrame:
            s, n = stored.alias("s"), rows.select(*self.keys).distinct().alias("n")
            on = [F.col(f"s.{k}").eqNullSafe(F.col(f"n.{k}")) for k in self.keys]
            return s.join(n, on, "left_anti").unionByName(rows.select(*self.schema.names))

        return self.update(new, merge)

    def lookup(self, *key) -> DataFrame:
        """The rows of one key, from its bucket alone."""
        one = self.spark.createDataFrame([key], StructType([self.schema[k] for k in self.keys]))
        (bucket,) = self._touched(one)
        rows = self.read([bucket])
        for name, value in zip(self.keys, key, strict=True):
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value).cast(self.schema[name].dataType)))
        return rows

    def lookups(self, keys: DataFrame) -> DataFrame:
        """The rows of many keys, from their buckets alone."""
        wanted = keys.select(*self.keys).distinct().alias("w")
        rows = self.read(self._touched(keys)).alias("s")
        return rows.join(wanted, [F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}")) for k in self.keys], "left_semi")

    def rebucket(self, buckets: int) -> None:
        """Write all rows anew in another number of buckets."""
        self._commit(self._written(self.read(), buckets), buckets)

    def vacuum(self) -> None:
        """Delete the folders and manifests of earlier versions; nobody may read them any more."""
        kept = {p.split("/")[1] for p in self.folders.values()}
        where = self._path(f"{self.path}/data")
        if self._fs.exists(where):
            for x in self._fs.listStatus(where):
                if x.getPath().getName() not in kept:
                    self._fs.delete(x.getPath(), True)
        for version in range(1, self.version):
            self._fs.delete(self._path(self._manifest(version)), False)
