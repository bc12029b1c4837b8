from pyspark.sql import functions as F

from lexmill.streaming import events as stream


def test_upserts_keep_the_latest_row(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream.upsert_latest(stream.event_stream(spark, str(tmp_path / "in"), source.schema), str(tmp_path / "out"), str(tmp_path / "cp"), "user_id", ["ts", "event_id"]).awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    want = source.groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    got = spark.read.parquet(str(last)).select("user_id", "event_id")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_windowed_counts(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    source.coalesce(1).write.parquet(str(tmp_path / "in"))
    rows = stream.windowed_counts(stream.event_stream(spark, str(tmp_path / "in"), source.schema), late="100 days")
    q = rows.writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == source.count()
