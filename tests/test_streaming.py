from pyspark.sql import functions as F

from wareloom.streaming import events as S


def test_windows_and_first_arrivals(spark, tmp_path):
    rows = spark.range(100).select(
        F.col("id").alias("event_id"), (F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)).alias("ts"), F.lit(1).cast("long").alias("user_id"),
        F.lit("click").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"),
    )
    source = str(tmp_path / "in")
    rows.union(rows.limit(10)).coalesce(1).write.parquet(source)
    S.run_once(S.first_arrivals(S.event_stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 100
    S.run_once(S.windowed_counts(S.event_stream(spark, source)), str(tmp_path / "win"), str(tmp_path / "cp2"))
    closed = spark.read.parquet(str(tmp_path / "win")).agg(F.sum("events")).head()[0]
    assert closed is None or closed <= 110
