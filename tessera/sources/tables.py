"""Readers with declared schemas, and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "benchmark": "item_id bigint, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a scan dealt over all cores where it has fewer partitions than there are, as a file of one row group has.

    For work that is heavy for each row. A table of many files has partitions enough and is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Rows that are broadcast at most.
SMALL_ROWS = 100_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has at most `rows` rows, which is counted; else as it is, for the optimizer to join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def merged(df: DataFrame) -> DataFrame:
    """`df` marked to be sorted and merged with what it joins, never broadcast.

    The optimizer takes the size of a table in files for that of its rows, which are many times larger where they repeat; such a side of a join would pass the driver whole.
    """
    return df.hint("merge")


def hash_id(text: Column) -> Column:
    """The first 16 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def scan_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, name, role, sha256, lines, text) of files under a root; build output folders are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    files = files.filter(~F.col("path").rlike(r"/(obj|bin)/")).withColumn("text", F.decode("content", "UTF-8"))
    role = (
        F.when(F.col("path").rlike(r"(?i)/tests?/"), "test").when(F.col("path").rlike(r"(?i)/docs?/|\.md$"), "documentation")
        .when(F.col("path").rlike(r"(?i)/config(uration)?/"), "configuration").otherwise("source")
    )
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), role.alias("role"), hash_id(F.col("text")).alias("sha256"), F.size(F.split("text", "\n")).alias("lines"), "text")


def front_matter(text: Column, key: str) -> Column:
    """The value of `key:` in the first 20 lines, null where there is none."""
    lines = F.slice(F.split(text, "\r?\n"), 1, 20)
    found = F.filter(lines, lambda line: F.lower(F.trim(line)).startswith(f"{key.lower()}:"))
    return F.trim(F.regexp_replace(F.get(found, 0), r"^[^:]*:", ""))


def read_vectors(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Comma-separated test vectors: header skipped, blank and # lines dropped, cells trimmed."""
    return spark.read.schema(schema).option("header", True).option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def upsert(existing: DataFrame, updates: DataFrame, key: str, version: str) -> DataFrame:
    """The latest row of each key by version; between equal versions the update wins."""
    both = existing.withColumn("_side", F.lit(0)).unionByName(updates.withColumn("_side", F.lit(1)))
    newest = Window.partitionBy(key).orderBy(F.desc(version), F.desc("_side"))
    return both.withColumn("_rank", F.row_number().over(newest)).filter("_rank = 1").drop("_rank", "_side")


def write_files(files: DataFrame, path: str) -> None:
    """Rows (path, text) as text files, one folder for each path, written whole or not at all by Spark's committer."""
    files.select(F.col("text").alias("value"), F.col("path").alias("file")).write.partitionBy("file").mode("overwrite").text(path)


def exposition(metrics: DataFrame) -> DataFrame:
    """Metrics text lines of (name, label, value)."""
    named = F.when(F.col("label").isNull() | (F.col("label") == ""), F.col("name")).otherwise(F.concat("name", F.lit('{label="'), "label", F.lit('"}')))
    return metrics.select(F.concat_ws(" ", named, F.col("value").cast("string")).alias("value"))
