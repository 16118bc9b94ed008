from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as m
from ..operators.trading import fifo
from ..sources.tables import exposition, table, upsert
from ..streaming.jobs import arriving, counted_by_type, event_trades, fifo_stream, ledger_balances, run_once
from .registry import query

_B = ", ".join(f"({float(b)})" for b in m.BOUNDS)


@query(f"SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative, round(sum(value), 4) AS total, count(value) AS n FROM events, (VALUES {_B}) b(le) GROUP BY event_type, le")
def latency_histogram(spark, sf_dir):
    return m.histogram(table(spark, sf_dir, "events"), "value", "event_type").withColumn("total", F.round("total", 4))


@query("SELECT event_type, ts::DATE AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def labelled_counters(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT user_id, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id")
def last_gauge(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("""
SELECT event_id AS id FROM events WHERE event_type <> 'purchase' AND (event_id % 3 = 0 OR (event_id % 3 = 1 AND ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 30 SECONDS)) ORDER BY ts, event_id LIMIT 1""")
def lease_queue_next(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("event_type <> 'purchase'")
    tasks = e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 3 == 0, "queued").when(F.col("event_id") % 3 == 1, "claimed").otherwise("done").alias("status"), F.col("ts").alias("claimed_at"))
    return m.next_leased(tasks, "2024-01-15 00:00:00").select("id")


@query("SELECT user_id, ccy, round(sum(amount), 4) AS balance FROM (SELECT user_id, event_type AS ccy, value AS amount FROM events UNION ALL SELECT user_id, 'cash', -value FROM events) GROUP BY ALL")
def ledger_balance(spark, sf_dir):
    """Two legs for each event: a credit in its kind, a debit of cash; a leg is a row made in place, not a second scan."""
    return ledger_balances(table(spark, sf_dir, "events")).withColumn("balance", F.round("balance", 4))


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def upsert_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.struct("ts", "event_id").alias("version"))
    return upsert(e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1"), "user_id", "version").select("user_id", "event_id", "event_type")


@query("""SELECT 'events_total{label="' || event_type || '"} ' || count(*) AS value FROM events GROUP BY event_type""")
def metrics_exposition(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("label")).agg(F.count("*").alias("value")).withColumn("name", F.lit("events_total"))
    return exposition(e)


@query("SELECT event_type, count(*) AS good, 'valid' AS side FROM events WHERE value BETWEEN 1 AND 200 GROUP BY 1 UNION ALL SELECT event_type, count(*), 'quarantine' FROM events WHERE NOT coalesce(value BETWEEN 1 AND 200, false) GROUP BY 1")
def validated_events(spark, sf_dir):
    ok = F.coalesce(F.col("value").between(1, 200), F.lit(False))
    return table(spark, sf_dir, "events").groupBy("event_type", F.when(ok, "valid").otherwise("quarantine").alias("side")).agg(F.count("*").alias("good"))


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def stream_counters(spark, sf_dir):
    """The stream form of the counters, run to its end over the table as a source of files."""
    return run_once(spark, sf_dir, "events", counted_by_type, "complete").withColumn("total", F.round("total", 4))


@query("SELECT user_id, ccy, round(sum(amount), 4) AS balance FROM (SELECT user_id, event_type AS ccy, value AS amount FROM events UNION ALL SELECT user_id, 'cash', -value FROM events) GROUP BY ALL")
def stream_ledger(spark, sf_dir):
    return run_once(spark, sf_dir, "events", ledger_balances, "complete").withColumn("balance", F.round("balance", 4))


@query()
def stream_fifo(spark, sf_dir):
    """FIFO lots with keyed state in a stream of events."""
    return run_once(spark, sf_dir, "events", lambda e: fifo_stream(event_trades(e)), "append")


@query()
def batch_fifo(spark, sf_dir):
    """The batch form on the same trades."""
    return fifo(event_trades(table(spark, sf_dir, "events")))


#: Events arrive in three batches by the day of the month, every seventh a batch late.
_ARRIVES = """
b AS (SELECT event_id, event_type, ts::TIMESTAMP AS ts, least(2, (day(ts) - 1) // 10 + (event_id % 7 = 0)::INT) AS b FROM events WHERE ts IS NOT NULL),
m AS (SELECT x.b, max(y.ts) - INTERVAL 1 HOUR AS watermark FROM (SELECT DISTINCT b FROM b) x LEFT JOIN b y ON y.b < x.b GROUP BY x.b),
d AS (SELECT b.*, watermark, watermark IS NOT NULL AND date_trunc('day', ts) + INTERVAL 1 DAY <= watermark AS late FROM b JOIN m USING (b))"""


def _arrived(spark, sf_dir):
    e = table(spark, sf_dir, "events").filter("ts is not null").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    batch = F.least(F.lit(2), F.floor((F.dayofmonth("ts") - 1) / 10) + (F.col("event_id") % 7 == 0).cast("int"))
    return arriving(spark, e, batch, 3)


@query(f"WITH {_ARRIVES} SELECT date_trunc('day', ts)::DATE AS day, event_type, count(*) AS n FROM d WHERE NOT late GROUP BY ALL")
def windowed_on_time(spark, sf_dir):
    """Daily counts of a stream in three batches: what came before the watermark had passed its day."""
    return _arrived(spark, sf_dir).counts().select(F.to_date("start").alias("day"), "event_type", "n")


@query(f"WITH {_ARRIVES} SELECT event_id, event_type, b::INT AS batch, date_diff('second', ts, watermark) AS behind FROM d WHERE late")
def windowed_late(spark, sf_dir):
    """The rows that came too late, with how far they were behind the watermark of their batch."""
    late = _arrived(spark, sf_dir).late_rows()
    return late.select("event_id", "event_type", F.col("epoch").alias("batch"), (F.unix_seconds("watermark") - F.unix_seconds("ts")).alias("behind"))
