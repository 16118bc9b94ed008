from tessera.plans import QUERIES

SF = "/root/testdata/sf0.001"


def test_stream_form_equals_batch(spark):
    stream, batch = (sorted(map(tuple, QUERIES[q](spark, SF).collect())) for q in ("stream_fifo", "batch_fifo"))
    assert stream == batch and stream


def test_state_carries_over_batches(spark, tmp_path):
    """Many files, one a batch: the lots of earlier batches are sold in later ones."""
    from tessera.operators.trading import fifo
    from tessera.streaming.jobs import fifo_stream

    rows = [(1, i, f"2024-01-{i + 1:02d} 00:00:00", "Buy" if i < 10 else "Sell", 3.0 + i % 2, float(i)) for i in range(20)]
    trades = spark.createDataFrame(rows, "key long, id long, at string, side string, quantity double, price double").selectExpr("key", "id", "to_timestamp(at) as at", "side", "quantity", "price")
    for part in range(4):
        trades.filter(f"id div 5 = {part}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(trades.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    task = fifo_stream(stream).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, e: b.write.mode("append").parquet(out)).trigger(availableNow=True).start()
    task.awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, fifo(trades).collect()))


def test_run_once_keeps_all_batches(spark, tmp_path):
    """More files than one trigger takes: the registered path returns the sells of every batch."""
    import os

    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = spark.read.parquet(f"{SF}/events.parquet").schema
    events = pq.read_table(f"{SF}/events.parquet").select(schema.names).sort_by([("ts", "ascending"), ("event_id", "ascending")])
    (tmp_path / "events.parquet").mkdir()
    n, files = len(events), 150
    for k in range(files):
        part = tmp_path / "events.parquet" / f"{k:03d}.parquet"
        pq.write_table(pa.Table.from_batches(events.slice(k * n // files, (k + 1) * n // files - k * n // files).to_batches(), events.schema), part)
        os.utime(part, (1_700_000_000 + k, 1_700_000_000 + k))
    stream, batch = (sorted(map(tuple, QUERIES[q](spark, str(tmp_path)).collect())) for q in ("stream_fifo", "batch_fifo"))
    assert stream == batch and stream
    totals, want = (sorted(map(tuple, QUERIES["stream_ledger"](spark, d).collect())) for d in (str(tmp_path), SF))
    assert totals == want and totals


def test_a_batch_that_dies_is_repeated(spark, tmp_path):
    """A batch fails after its counts are written, before its late rows are; the restarted query gives the rows of one that never failed."""
    import pytest
    from pyspark.sql import functions as F

    from tessera.streaming.jobs import Windows, arriving

    rows = spark.createDataFrame([(i, "ab"[i % 2], f"2024-01-{1 + i % 20:02d} 10:00:00") for i in range(200)], "event_id long, event_type string, at string").select("event_id", "event_type", F.to_timestamp("at").alias("ts"))
    batch = F.when(F.col("event_id") % 5 == 0, 1).otherwise(0)
    calm = arriving(spark, rows, batch, 2)
    shaken = Windows(spark, str(tmp_path / "shaken"))
    source = str(tmp_path / "in")

    def dies(df, epoch):
        if epoch == 1 and not (tmp_path / "died").exists():
            (tmp_path / "died").touch()
            df.groupBy(F.window("ts", "1 day").start.alias("start"), "event_type").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{shaken.root}/counts/epoch=1")
            raise RuntimeError("lost")
        shaken.batch(df, epoch)

    for k in range(2):
        rows.filter(batch == k).write.mode("append").parquet(source)
        stream = lambda: spark.readStream.schema(rows.schema).parquet(source)
        if k:
            with pytest.raises(Exception, match="lost"):
                shaken.drain(stream(), dies)
        shaken.drain(stream(), dies)
    for rows_of in (Windows.counts, Windows.late_rows):
        a, b = (sorted(map(tuple, rows_of(w).collect())) for w in (calm, shaken))
        assert a == b and a
