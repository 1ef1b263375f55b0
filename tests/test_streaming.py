from pyspark.sql import functions as F

from sonoframe.streaming import levels


def drain(df, name):
    q = df.writeStream.outputMode("append").format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return q


def test_event_levels_equal_batch_where_the_watermark_passed(spark, sf_dir, tmp_path):
    batch = spark.read.parquet(f"{sf_dir}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.orderBy("ts").coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    drain(levels.event_levels(stream), "levels_out")
    out = {(r.key, r.start): r.rms for r in spark.table("levels_out").collect()}
    whole = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 hour").start.alias("start"), F.col("user_id").alias("key")).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
    for r in whole.collect():
        if (r.key, r.start) in out:
            assert abs(out[(r.key, r.start)] - r.rms) < 1e-9


def test_block_levels(spark, tmp_path):
    blocks = spark.createDataFrame([("a", 0, 0, 0, [0.0, 0.5, -1.0]), ("a", 0, 1, 3, [0.0])], "clip_id string, channel int, block_idx int, start long, samples array<float>")
    blocks.write.parquet(str(tmp_path / "b"))
    drain(levels.block_levels(spark.readStream.schema(blocks.schema).parquet(str(tmp_path / "b"))), "blocks_out")
    assert sorted((r.block_idx, r.peak) for r in spark.table("blocks_out").collect()) == [(0, 1.0), (1, 0.0)]
