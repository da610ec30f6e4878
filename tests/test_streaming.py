import pytest

from tracklore.operators import captions
from tracklore.streaming import stages


def run(df, name, mode):
    # what there is now, then an end: a query with timeouts would go on for ever
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(60)
    finally:
        q.stop()


def test_rolling_stream_is_the_batch(spark, tmp_path):
    words = [f"w{i}" for i in range(40)]
    rows = [(t, k, k * 2.0, k * 2.0 + 2.0, " ".join(words[4 * k : 4 * k + 8])) for t in (1, 2) for k in range(9)]
    schema = "track_id long, seq long, start_s double, end_s double, text string"
    batch = spark.createDataFrame(rows, schema)
    for part, cond in enumerate(("seq < 4", "seq >= 4")):
        batch.where(cond).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        assert part < 2
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run(stages.dedupe_rolling_stream(stream), "rolled", "append")
    got = {(r.track_id, r.seq, r.text) for r in spark.sql("select * from rolled").collect()}
    assert got == {(r.track_id, r.seq, r.text) for r in captions.dedupe_rolling(batch).collect()}


def test_ema_stream(spark, tmp_path):
    spark.createDataFrame([("s", 0, 3.0), ("s", 1, 5.0)], "stage string, ord int, value double").write.parquet(str(tmp_path / "e"))
    run(stages.ema_stream(spark.readStream.schema("stage string, ord int, value double").parquet(str(tmp_path / "e"))), "rates", "update")
    assert spark.sql("select rate from rates").first()[0] == pytest.approx(3.0 * 0.6 + 5.0 * 0.4)


def test_hours(spark, tmp_path):
    spark.sql("select timestamp '2024-01-01 00:10:00' as ts, 'a' as event_type, 1.0D as value union all select timestamp '2024-01-01 03:00:00', 'a', 2.0D").write.parquet(str(tmp_path / "h"))
    run(stages.purchases_by_hour(spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "h"))), "hours", "complete")
    assert spark.sql("select sum(n) from hours").first()[0] == 2
