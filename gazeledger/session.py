"""Session settings the jobs rely on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import broadcast

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    # EUC-KR / CP949 logs are decoded in the JVM; a malformed byte gives U+FFFD
    "spark.sql.legacy.javaCharsets": "true",
    "spark.sql.legacy.codingErrorAction": "true",
    # "n-th row" filters stay on the map side up to this rank
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: the cluster's checkpoint folder, a temporary one only in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="gazeledger-"))
    return spark.sparkContext.getCheckpointDir()


_FOLDERS: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    _FOLDERS.append(f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")
    return _FOLDERS[-1]


def clear_folders(spark: SparkSession) -> None:
    """Delete all intermediate tables that this driver wrote; they may hold values in clear text. Tables read from them
    can not be used afterwards."""
    while _FOLDERS:
        path = spark._jvm.org.apache.hadoop.fs.Path(_FOLDERS.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table that several branches read, and read it back: lost executors do not recompute it, and
    every branch scans only the columns it needs."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def checked_broadcast(df: DataFrame, name: str, rows: int = 100_000) -> DataFrame:
    """Write a table that is expected to be small and broadcast it only if it is: one row per file, for instance."""
    table = materialise(df, name)
    return broadcast(table) if table.count() <= rows else table


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session; cluster settings such as partition counts stay as they are."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gazeledger")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
    )
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())
