"""The streaming form of the bars gives the batch result."""

from pyspark.sql import functions as F

from tickerloom.sources import market
from tickerloom.streaming.bars import window_bars


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    events = market.table(spark, sf_dir, "events").select(F.col("event_type").alias("ticker"), "ts", "value", "event_id")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    query = window_bars(stream).writeStream.format("memory").queryName("bars").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(spark.table("bars").collect()) == sorted(window_bars(events).collect())
