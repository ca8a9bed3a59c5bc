"""A stream gives what the batch gives."""

from rollbook.streaming.counts import sliding_counts


def test_sliding_counts(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = sliding_counts(stream, "ts", "event_type", "7 days").writeStream.outputMode("complete").format("memory").queryName("sliding").trigger(availableNow=True).start()
    query.awaitTermination()
    want = sorted(map(tuple, sliding_counts(events, "ts", "event_type", "7 days").collect()))
    assert want and sorted(map(tuple, spark.table("sliding").collect())) == want
