"""Streams against the same computation over the whole table."""

from pyspark.sql import functions as F

from tracklens.streaming import feedback as S

COLUMNS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def rows(spark):
    return spark.sql(
        "SELECT id AS event_id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, cast(id * 5 AS int)) AS ts, id % 4 AS user_id, "
        "CASE WHEN id % 3 = 0 THEN 'click' ELSE 'view' END AS event_type, 1.0D AS value, concat('{\"k\": ', id % 5, '}') AS props FROM range(60)"
    )


def test_first_seen(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark).write.parquet(source)
    rows(spark).write.mode("append").parquet(source)
    S.run_once(S.first_seen(S.event_stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "state"))
    S.run_once(S.first_seen(S.event_stream(spark, source)), str(tmp_path / "out"), str(tmp_path / "state"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 60


def test_sliding_counts(spark, tmp_path):
    source = str(tmp_path / "in")
    rows(spark).write.parquet(source)
    S.run_once(S.sliding_counts(S.event_stream(spark, source), "2 days", "1 day"), str(tmp_path / "out"), str(tmp_path / "state"))
    got = {(r.start, r.act): r.events for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    whole = spark.read.schema(COLUMNS).parquet(source).select(F.col("ts").cast("timestamp").alias("ts"), S.action(F.col("event_type")).alias("act"))
    wanted = {(r.start, r.act): r.n for r in whole.groupBy(F.window("ts", "2 days", "1 day"), "act").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "act", "n").collect()}
    assert got and all(wanted[k] == n for k, n in got.items())
