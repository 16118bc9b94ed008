"""Sharding by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

A bucket is a prefix of a row's 60-bit hash. The bucket of the empty prefix holds all rows; one that
holds more bytes than the limit splits on the next bit, until every shard fits. The directory is
built from byte sums of fine prefixes (combined before the shuffle), never from single rows, and
prefixes that are still too large go on at a greater depth on their own.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

HASH_BITS = 60
#: Bits below the expected depth of the directory, and bits added for prefixes that are still too large.
SPARE_BITS, MORE_BITS = 4, 8


def _directory(cells: DataFrame, top: int, depth: int, limit: int) -> DataFrame:
    """(cell, shard_depth, shard_bytes) of cells (cell, n_bytes) of `depth` bits: the shallowest prefix of at least `top` bits that fits; null where none does."""
    levels = cells.select("cell", "n_bytes", F.explode(F.sequence(F.lit(top), F.lit(depth))).alias("level"))
    levels = levels.withColumn("prefix", F.expr(f"shiftright(cell, {depth} - level)"))
    fits = levels.groupBy("level", "prefix").agg(F.sum("n_bytes").alias("shard_bytes")).filter(F.col("shard_bytes") <= limit)
    found = levels.join(fits, ["level", "prefix"]).groupBy("cell").agg(F.min(F.struct("level", "shard_bytes")).alias("best"))
    return cells.join(found, "cell", "left").select("cell", F.col("best.level").alias("shard_depth"), F.col("best.shard_bytes").alias("shard_bytes"))


def assign_shards(docs: DataFrame, limit_bytes: int, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, n_bytes, shard, shard_depth, shard_bytes, oversize) for each row of `docs`.

    `shard` is the bucket's prefix in bits ("" for the only shard of a table that fits), n_bytes the
    text's UTF-8 bytes (null: 0). Rows with equal keys (null keys too) share a shard; where such rows alone exceed
    the limit, the shard at full depth holds just their hash and `oversize` is true. An empty table
    has no shards. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "shards")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))), 1, HASH_BITS // 4), 16, 10).cast("long")
    rows = scratch.table(docs.select(F.col(key).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), hashed.alias("h")), "rows")
    total = rows.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]
    depth = min(HASH_BITS, max(1, math.ceil(math.log2(max(2, total / limit_bytes))) + SPARE_BITS))
    top, left, parts = 0, rows, []
    while True:
        celled = left.withColumn("cell", F.expr(f"shiftright(h, {HASH_BITS - depth})"))
        directory = scratch.table(_directory(celled.groupBy("cell").agg(F.sum("n_bytes").alias("n_bytes")), top, depth, limit_bytes), "directory")
        placed = celled.join(directory, "cell")
        parts.append(placed.filter("shard_depth is not null").withColumn("oversize", F.lit(False)))
        if directory.filter("shard_depth is null").isEmpty():
            break
        left = placed.filter("shard_depth is null").select("key", "n_bytes", "h")
        if depth == HASH_BITS:
            sums = left.groupBy("h").agg(F.sum("n_bytes").alias("shard_bytes"))
            parts.append(left.join(sums, "h").withColumns({"shard_depth": F.lit(HASH_BITS), "oversize": F.lit(True)}))
            break
        left, top, depth = scratch.table(left, "left"), depth + 1, min(HASH_BITS, depth + MORE_BITS)
    columns = ["key", "n_bytes", "h", "shard_depth", "shard_bytes", "oversize"]
    out = parts[0].select(columns)
    for part in parts[1:]:
        out = out.union(part.select(columns))
    bits = F.lpad(F.conv(F.col("h").cast("string"), 10, 2), HASH_BITS, "0")
    return out.select(F.col("key").alias(key), "n_bytes", F.expr("shard_depth").cast("int").alias("shard_depth"), bits.alias("bits"), "shard_bytes", "oversize").select(
        key, "n_bytes", F.expr("substring(bits, 1, shard_depth)").alias("shard"), "shard_depth", "shard_bytes", "oversize"
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, key: str = "doc_id") -> None:
    """Write the rows of `docs` under `path`, a folder `shard=<bits>` for each shard. A key is expected once in `docs`."""
    dealt = docs.join(shards.select(key, F.concat(F.lit("b"), F.col("shard")).alias("shard")), key).repartition("shard")
    dealt.write.partitionBy("shard").parquet(path)


def oracle(limit_bytes: int) -> str:
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, {HASH_BITS // 4}))::BIGINT AS h FROM documents
), levels AS (
  SELECT level::INT AS level, (h >> ({HASH_BITS} - level)::INT) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes
  FROM d, range(0, {HASH_BITS + 1}) r(level) GROUP BY ALL
), fit AS (SELECT * FROM levels WHERE shard_bytes <= {limit_bytes} OR level = {HASH_BITS}
), best AS (
  SELECT d.r, d.doc_id, d.n_bytes, d.h, min(f.level) AS shard_depth
  FROM d JOIN fit f ON f.prefix = (d.h >> ({HASH_BITS} - f.level)) GROUP BY ALL
)
SELECT b.doc_id, b.n_bytes, substr(lpad(bin(b.h), {HASH_BITS}, '0'), 1, b.shard_depth) AS shard, b.shard_depth,
       f.shard_bytes, f.shard_bytes > {limit_bytes} AS oversize
FROM best b JOIN fit f ON f.level = b.shard_depth AND f.prefix = (b.h >> ({HASH_BITS} - b.shard_depth))
"""
