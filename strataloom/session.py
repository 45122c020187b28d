"""Session and staging helpers shared by every layer."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that hold for any deployment; sizes and masters are the caller's.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strataloom")
    settings = DEFAULTS | {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for staged tables, as a URI.

    It is the session's checkpoint directory.  A cluster names it in
    ``spark.checkpoint.dir``; only where that is unset (tests, a laptop) is a
    temporary folder used.
    """
    sc = spark.sparkContext
    where = sc.getCheckpointDir()
    if where is None:
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="strataloom-"))
        where = sc.getCheckpointDir()
    return where


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/strataloom/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    Cuts the lineage durably: a lost executor costs the unfinished tasks of
    later stages only.  The reread table also has file statistics.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


#: Tasks that each core gets of rows whose work isn't in proportion to their bytes.
TASKS_A_CORE = 4


def tasks_for(spark: SparkSession) -> int:
    return TASKS_A_CORE * max(2, spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` dealt out by the hash of ``by`` to several tasks a core.

    For rows that are small and cost much each: by their bytes alone, files and shuffles would give them to a few tasks.
    """
    return df.repartition(tasks_for(df.sparkSession), *by)


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more; other frames are left alone."""
    for df in frames:
        path = getattr(df, "_staged_at", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def complete(spark: SparkSession, path: str) -> list[str]:
    """The names of the folders in ``path`` that a finished write has left, ascending; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [x.getPath().getName() for x in files.listStatus(folder) if x.isDirectory()]
    return sorted(n for n in names if files.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))
