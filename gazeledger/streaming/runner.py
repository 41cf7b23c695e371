"""Run a stream over what is there now and read its result as a table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gazeledger.session import new_folder


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Process all available input into a parquet table in the shared folder."""
    spark: SparkSession = stream.sparkSession
    folder = new_folder(spark, "stream")
    query = (
        stream.writeStream.outputMode(mode).format("parquet")
        .option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/table")


def run_latest(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Process all available input in update mode and keep the latest row of every key.

    Each micro-batch overwrites a folder of its own, so that one that is repeated after a failure counts once; reading takes
    the row of the highest batch of a key.
    """
    spark: SparkSession = stream.sparkSession
    folder = new_folder(spark, "stream")

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/table/batch={batch}")

    spark.createDataFrame([], stream.schema).write.parquet(f"{folder}/table/batch=-1")  # the table of a stream without input
    query = (
        stream.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    values = [c for c in stream.columns if c not in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema) + ", batch bigint"
    stored = spark.read.schema(schema).parquet(f"{folder}/table")
    latest = stored.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_row"))
    return latest.select(*keys, "_row.*").select(*stream.columns)


def run_by_day(stream: DataFrame, evaluate: Callable[[DataFrame], DataFrame], late_days: int = 2) -> DataFrame:
    """Keep the result of a batch plan over the days of a stream up to date, and read it as a table.

    The state is a table of the stream's rows, partitioned by their day (of ``ts``). A micro-batch adds its rows, then
    ``evaluate`` runs over the days it touched, the day behind each (rows of the last hour still count there) and the rows of
    the day before. Rows with the ``ts`` of any other day may come with its result; each day keeps its own. A day is as a
    batch over all of its rows would give it, in whatever order they came, and a user of very many rows is spread as in a
    batch. Rows more than ``late_days`` behind the newest day of earlier micro-batches are late and dropped, and so is the
    state of such days. Folders carry the number of their micro-batch: one that is repeated after a failure counts once.
    """
    spark: SparkSession = stream.sparkSession
    folder = new_folder(spark, "stream")
    found_schema = evaluate(spark.createDataFrame([], stream.schema)).schema

    def ddl(schema) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)

    rows_schema, days_schema = f"{ddl(stream.schema)}, batch bigint, day date", "day date, batch bigint"
    spark.createDataFrame([], "day date").write.parquet(f"{folder}/days/batch=-1")
    spark.createDataFrame([], found_schema).write.parquet(f"{folder}/found/batch=-1")

    def take(rows: DataFrame, batch: int) -> None:
        own = rows.sparkSession
        days = own.read.schema(days_schema).parquet(f"{folder}/days")
        newest = days.where(F.col("batch") < batch).agg(F.max("day")).first()[0]
        dated = rows.withColumn("day", F.to_date("ts")).where("day is not null")
        if newest is not None:
            dated = dated.where(F.col("day") >= F.lit(newest - timedelta(late_days)))
        dated.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/rows/batch={batch}")
        arrived = own.read.schema(f"{ddl(stream.schema)}, day date").parquet(f"{folder}/rows/batch={batch}")
        came = {r["day"] for r in arrived.select("day").distinct().collect()}  # days, few
        touched = came | {d + timedelta(1) for d in came}
        needed = touched | {d - timedelta(1) for d in came}
        stored = own.read.schema(rows_schema).parquet(f"{folder}/rows").where(
            (F.col("batch") <= batch) & F.col("day").isin(sorted(needed)))
        found = evaluate(stored.select(*stream.columns)).where(F.to_date("ts").isin(sorted(touched)))
        found.write.mode("overwrite").parquet(f"{folder}/found/batch={batch}")
        own.createDataFrame([(d,) for d in sorted(came)], "day date").union(
            stored.where(F.col("day").isin(sorted(touched - came))).select("day").distinct()
        ).coalesce(1).write.mode("overwrite").parquet(f"{folder}/days/batch={batch}")
        _drop_days(own, f"{folder}/rows", max([*came, newest] if newest else came, default=None), late_days + 1)

    query = (
        stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    latest = spark.read.schema(days_schema).parquet(f"{folder}/days").groupBy("day").agg(F.max("batch").alias("batch"))
    found = spark.read.schema(f"{ddl(found_schema)}, batch bigint").parquet(f"{folder}/found")
    return found.withColumn("day", F.to_date("ts")).join(latest, ["day", "batch"]).select(*found_schema.names)


def _drop_days(spark: SparkSession, path: str, newest, keep: int) -> None:
    """Delete the partitions of days more than ``keep`` behind ``newest``."""
    if newest is None:
        return
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch=*/day=*")
    files = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(pattern) or []:
        if status.getPath().getName() < f"day={newest - timedelta(keep)}":
            files.delete(status.getPath(), True)
