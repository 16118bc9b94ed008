"""Chat formatting after collapse of cumulative snapshots, by DataFrame functions only.

A logged conversation that is a prefix of a longer one is a snapshot of it. Every turn gets a
128-bit hash of its place, role and text; the running XOR of these is a hash of each turn prefix.
A conversation goes if its whole hash is a proper prefix hash of another (an anti-join), or if a
conversation with the same turns has a smaller id. Those kept are rendered.

The running values are made in two levels, within stretches of turn numbers and then over the
stretches' totals, so that one huge conversation is dealt over many tasks; only the rendered text,
which is the result, brings a conversation together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

STRETCH = 1024
TEMPLATE = ("<|im_start|>", "\n", "<|im_end|>\n")


def _turns(turns: DataFrame) -> DataFrame:
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    return turns.filter("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"),
        F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are kept."""
    at = _turns(turns).select("conv_id", F.floor(F.coalesce("turn", F.lit(-1)) / STRETCH).alias("part"), "turn", "role", "t1", "t2")
    parts = at.groupBy("conv_id", "part").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("conv_id", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"), F.sum("rows").over(Window.partitionBy("conv_id")).alias("n_turns"))
    order = Window.partitionBy("conv_id", "part").orderBy(F.asc_nulls_first("turn"), "role", "t1", "t2")
    ranked = at.withColumn("k", F.row_number().over(order)).join(parts, ["conv_id", "part"]).withColumn("k", F.col("k") + F.col("earlier"))
    ranked = ranked.select("conv_id", "part", "k", "n_turns", F.xxhash64("k", "t1").alias("x1"), F.xxhash64("t2", "k").alias("x2"))
    totals = ranked.groupBy("conv_id", "part").agg(F.bit_xor("x1").alias("p1"), F.bit_xor("x2").alias("p2"))
    totals = totals.select("conv_id", "part", *(F.coalesce(F.bit_xor(p).over(before), F.lit(0)).alias(p) for p in ("p1", "p2")))
    running = Window.partitionBy("conv_id", "part").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    prefixes = (
        ranked.withColumns({"x1": F.bit_xor("x1").over(running), "x2": F.bit_xor("x2").over(running)})
        .join(totals, ["conv_id", "part"])
        .select("conv_id", "k", "n_turns", F.col("x1").bitwiseXOR(F.col("p1")).alias("h1"), F.col("x2").bitwiseXOR(F.col("p2")).alias("h2"))
    )
    whole = prefixes.filter("k = n_turns").groupBy("k", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.filter("k < n_turns").select("k", "h1", "h2").distinct()
    return whole.join(inner, ["k", "h1", "h2"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"))


def render(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, rendered): all turns in order, each as opening, role, separator, text, closing."""
    opening, separator, closing = template
    listed = F.array_sort(F.collect_list(F.struct("turn", "role", "t1", "t2", "text")))
    shown = F.transform(listed, lambda t: F.concat(F.lit(opening), t["role"], F.lit(separator), t["text"], F.lit(closing)))
    return _turns(turns).withColumn("turn", F.coalesce("turn", F.lit(-(1 << 63)))).groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(shown, "").alias("rendered"))


def format_chats(turns: DataFrame, template: tuple[str, str, str] = TEMPLATE) -> DataFrame:
    """(conv_id, n_turns, rendered) of each maximal conversation of (conv_id, turn, role, text).

    Turns are ordered by number (null first), then role and text hashes, so ties have one order;
    repeated rows are repeated turns. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation and are ignored; other columns are ignored. Very long texts are rendered whole. No rows give no rows.
    """
    kept = maximal_conversations(turns).select("conv_id")
    return render(turns.join(kept.hint("merge"), "conv_id", "left_semi"), template)  # ids grow with the input: never broadcast


ORACLE = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), p AS (
  SELECT conv_id, turn, role, text,
         row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS h
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), whole AS (
  SELECT min(conv_id) AS conv_id, n, h FROM p WHERE k = n GROUP BY n, h
), kept AS (
  SELECT conv_id FROM whole w WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.k < p.n AND p.k = w.n AND p.h = w.h)
)
SELECT p.conv_id, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY k) AS rendered
FROM p JOIN kept USING (conv_id) GROUP BY p.conv_id
"""
