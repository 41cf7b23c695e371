"""No task's share of a derived log grows with the table."""

from pyspark.sql import functions as F

from gazeledger.plans import views


def test_derived_lines_come_in_tasks_of_bounded_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(views, "TASK_ROWS", 20, raising=False)
    # one row group, which the splits of a file do not cut
    spark.range(2000).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts")).coalesce(1).write.parquet(
        f"{tmp_path}/events.parquet")
    dealt = views.texts(spark, str(tmp_path), "events")
    sizes = dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
    assert sizes.agg(F.max("n")).first()[0] <= 60
    assert dealt.distinct().count() == 2000


def test_written_logs_have_files_of_bounded_lines(spark, tmp_path, monkeypatch):
    import glob

    from gazeledger.plans import queries_sources as sources

    monkeypatch.setattr(sources, "FILE_ROWS", 100, raising=False)
    spark.sql("""select id as event_id, timestamp_ntz'2024-01-02 03:04:05' as ts, id as user_id, 'view' as event_type,
     1.0d as value, 'k1' as props from range(1, 1001)""").write.parquet(f"{tmp_path}/events.parquet")
    found = sources.gzip_scan(spark, str(tmp_path)).first()
    assert tuple(found) == (1000, 1000, 0, 0)
    assert len(glob.glob(sources._written(spark, str(tmp_path), "web_log", "gzip").replace("file:", "") + "/*.gz")) == 10
    # a gap, a number that comes twice and a swap are seen
    lines = spark.createDataFrame(
        [("f", 1, "x 1"), ("f", 2, "x 3"), ("f", 2, "x 3"), ("f", 5, "x 2")], "source_file string, line_no bigint, raw_line string")
    assert tuple(sources._numbered(lines).first()) == (4, 3, 2, 1)


def test_splits_without_row_groups_do_not_count_as_tasks(spark, tmp_path, monkeypatch):
    """One row group in many splits: all rows lie in one of them."""
    monkeypatch.setattr(views, "TASK_ROWS", 100, raising=False)
    spark.range(2000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text")).coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        assert views.table(spark, str(tmp_path), "documents").rdd.getNumPartitions() >= 20
        dealt = views.texts(spark, str(tmp_path), "documents")
        sizes = dealt.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"))
        assert sizes.agg(F.max("n")).first()[0] <= 200
        assert dealt.distinct().count() == 2000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
