"""Reading tables and cutting lineage, alike on a laptop and on a cluster."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_OWN: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it in spark.checkpoint.dir.

    Only a session on one machine without that setting (a test, a notebook) gets a temporary folder of its own; on a cluster
    that would be a folder no other executor sees, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="blattwerk-"))
        folder = _OWN[0]
    return folder.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_place(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet; it is deleted when the application ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    fs, where = _file_system(spark, path)
    fs.deleteOnExit(where)
    return path


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its files have fewer splits than there are cores, so only ever a small input; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def written(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    What follows starts from files that outlive any executor, and nothing above is computed twice.
    """
    path = path or new_place(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at a path."""
    fs, where = _file_system(spark, path)
    return bool(fs.exists(where))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path below the shared folder."""
    fs, where = _file_system(spark, path)
    fs.delete(where, True)


def local_session(name: str = "blattwerk", cores: int | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; further settings with _ for the dots."""
    cores = cores or min(8, os.cpu_count() or 1)
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return (
        builder.config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
