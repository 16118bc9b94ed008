"""Structured Streaming forms of the counters and the ledger, and a runner that drains a table as a stream of files."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def counted_by_type(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


class Windows:
    """Tumbling counts by event type with a watermark, and the rows later than it in a sink of their own.

    The watermark of a batch is the latest time of all batches before it less `late`; a row whose window ended by then is late, any other
    adds to its window. Each batch writes its counts, its late rows and its latest time under its own number, the time last, and reads
    only the times of smaller numbers: a batch that is repeated after a failure finds the same watermark and
    replaces what it wrote.
    """

    def __init__(self, spark: SparkSession, root: str, width: str = "1 day", late: str = "1 hour"):
        self.spark, self.root, self.width, self.late = spark, root, width, late

    def batch(self, rows: DataFrame, epoch: int) -> None:
        put = lambda df, name: df.write.mode("overwrite").parquet(f"{self.root}/{name}/epoch={epoch}")
        seen = self._read("times", "at timestamp").filter(F.col("epoch") < epoch).agg(F.max("at").alias("at")).first().at if epoch else None
        mark = F.lit(seen).cast("timestamp") - F.expr(f"interval {self.late}")
        dealt = rows.withColumn("w", F.window(F.col("ts").cast("timestamp"), self.width))
        on_time = mark.isNull() | (F.col("w.end") > mark)
        put(dealt.filter(on_time).groupBy(F.col("w.start").alias("start"), "event_type").agg(F.count("*").alias("n")), "counts")
        put(dealt.filter(~on_time).select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"), mark.alias("watermark")), "late")
        put(rows.agg(F.max(F.col("ts").cast("timestamp")).alias("at")), "times")

    def _read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(f"{schema}, epoch int").option("basePath", f"{self.root}/{name}").parquet(f"{self.root}/{name}")

    def counts(self) -> DataFrame:
        """(start, event_type, n) of all batches together."""
        return self._read("counts", "start timestamp, event_type string, n long").groupBy("start", "event_type").agg(F.sum("n").alias("n"))

    def late_rows(self) -> DataFrame:
        return self._read("late", "event_id long, event_type string, ts timestamp, watermark timestamp")

    def drain(self, stream: DataFrame, batch: Callable[[DataFrame, int], None] | None = None) -> None:
        """Take what has arrived on `stream` as one batch; what was taken before is known by the checkpoint under the same root."""
        task = stream.writeStream.option("checkpointLocation", f"{self.root}/state").foreachBatch(batch or self.batch).trigger(availableNow=True).start()
        task.awaitTermination()


def arriving(spark: SparkSession, rows: DataFrame, batch: Column, batches: int) -> Windows:
    """Rows that arrive in batches by number, each drained by a query that starts anew from the checkpoint."""
    root = f"{checkpoint_root(spark)}/windows-{uuid.uuid4().hex}"
    windows = Windows(spark, root)
    for k in range(batches):
        rows.filter(batch == k).write.mode("append").parquet(f"{root}/in")
        windows.drain(spark.readStream.schema(rows.schema).parquet(f"{root}/in"))
    return windows


def ledger_balances(events: DataFrame) -> DataFrame:
    """Signed sums by user and currency of the two legs of each event."""
    legs = F.array(F.struct(F.col("event_type").alias("ccy"), F.col("value").alias("amount")), F.struct(F.lit("cash").alias("ccy"), (-F.col("value")).alias("amount")))
    return events.select("user_id", F.inline(legs)).groupBy("user_id", "ccy").agg(F.sum("amount").alias("balance"))


def fifo_stream(trades: DataFrame) -> DataFrame:
    """The stream form of FIFO lots over (key, id, at, side, quantity, price): open lots are a key's state.

    Trades of a key are taken in order of time and id within a batch; a sell that the lots do not
    cover takes all of them and is short by the rest.
    """

    def step(key, batches, state):
        import pandas as pd

        at, quantity, price = (list(x) for x in state.get) if state.exists else ([], [], [])
        rows = pd.concat(list(batches)).sort_values(["at", "id"])
        out = []
        for r in rows.itertuples():
            if r.side == "Buy":
                at.append(r.at)
                quantity.append(r.quantity)
                price.append(r.price)
                continue
            left, realised, old = r.quantity, 0.0, 0.0
            while left > 0 and quantity:
                part = min(left, quantity[0])
                realised += (r.price - price[0]) * part
                old += part if (r.at - at[0]).days >= 365 else 0.0
                left -= part
                quantity[0] -= part
                if quantity[0] <= 0:
                    del at[0], quantity[0], price[0]
            out.append((r.key, r.id, realised, old, left))
        state.update((at, quantity, price))
        yield pd.DataFrame(out, columns=["key", "id", "realised", "long_term", "short"])

    return trades.groupBy("key").applyInPandasWithState(
        step, "key long, id long, realised double, long_term double, short double", "at array<timestamp>, quantity array<double>, price array<double>", "append", "NoTimeout"
    )


def event_trades(events: DataFrame) -> DataFrame:
    """Events as trades: purchases and clicks buy, others sell, at a price that follows the id."""
    side = F.when(F.col("event_type").isin("purchase", "click"), "Buy").otherwise("Sell")
    return events.filter("value is not null and ts is not null").select(F.col("user_id").alias("key"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"), side.alias("side"), F.col("value").cast("double").alias("quantity"), (1 + F.col("event_id") % 17).cast("double").alias("price"))


def checkpoint_root(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tessera-stream-")


def run_once(spark: SparkSession, sf_dir: str, name: str, job: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """Drain a table through a job with state and a checkpoint, and read what the sink holds at the end.

    In complete mode the last batch holds all; in append mode every batch has a folder of its own, which a retry overwrites.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"output mode {mode!r}: append or complete")
    root = f"{checkpoint_root(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 64).option("pathGlobFilter", "*.parquet").parquet(*_stream_path(spark, sf_dir, name))
    out = f"{root}/out"
    task = (
        job(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state")
        .foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{out}/{epoch if mode == 'append' else 'all'}")).trigger(availableNow=True).start()
    )
    task.awaitTermination()
    return spark.read.parquet(f"{out}/*")


def _stream_path(spark: SparkSession, sf_dir: str, name: str) -> list[str]:
    """A folder of files as it is; a single file as a pattern that matches it alone, since streams read folders or patterns."""
    path = f"{sf_dir}/{name}.parquet"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return [path] if fs.getFileStatus(jpath).isDirectory() else [f"{sf_dir}/{name}.parque[t]"]
