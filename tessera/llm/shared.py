"""Tables in the folder that all executors share, which cut lineage and survive a lost executor.

The folder is `spark.checkpoint.dir` of the session. Only where that is unset (local tests) one of
this machine's own is set, once for a session.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt over all cores where it has fewer partitions than there are, as a table of one row group has; others are not moved."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan.rdd.getNumPartitions() >= cores else scan.repartition(cores)


#: Spark's setting that a finished write removes its shuffle files.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def clean_shuffles(spark: SparkSession) -> Iterator[None]:
    """What runs within it removes its shuffle files at its end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


class Scratch:
    """Parquet tables of one run, under one new folder of the shared folder."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}", 0

    def path(self, name: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """`df` written and read again. The write's own shuffle files go once it is done, as the table stands for them."""
        path = self.path(name)
        with clean_shuffles(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._tessera_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that nothing reads any more."""
        jvm = self.spark._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._tessera_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Edges that one task joins in memory (16 bytes each); more are joined in rounds over all tasks.
EDGES_AT_ONCE = 1_000_000


def union_find(edges: pa.Table) -> pa.Table:
    """Each node of the edges (a, b) with the smallest node of its component."""
    nodes, ends = np.unique(np.concatenate([edges.column("a").to_numpy(), edges.column("b").to_numpy()]), return_inverse=True)
    above = list(range(len(nodes)))

    def top(x: int) -> int:
        while above[x] != x:
            above[x] = above[above[x]]
            x = above[x]
        return x

    for a, b in ends.reshape(2, -1).T.tolist():
        a, b = top(a), top(b)
        above[max(a, b)] = min(a, b)
    return pa.table({"id": pa.array(nodes, pa.int64()), "label": pa.array(nodes[[top(i) for i in range(len(nodes))]], pa.int64())})


def components(edges: DataFrame, scratch: Scratch, at_once: int = EDGES_AT_ONCE) -> DataFrame:
    """Connected components of edges (a, b): rows (id, label), label being the smallest id reachable.

    Up to `at_once` distinct edges are joined by one task, whose size that bounds. More take rounds
    of the least label among neighbours and then the label's own label; every round is a table in
    the shared folder. Labels only ever leave as tables. Edges with a null end are ignored; a loop makes
    its node a component.
    """
    edges = edges.filter("a is not null and b is not null").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = scratch.table(edges.distinct(), "edges")
    if edges.limit(at_once + 1).count() <= at_once:
        return scratch.table(edges.groupBy(F.lit(0).alias("all")).applyInArrow(union_find, "id long, label long"), "labels")
    both = scratch.table(edges.union(edges.select("b", "a")).distinct(), "neighbours")
    labels = scratch.table(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    changed = not labels.filter("label <> id").isEmpty()
    while changed:
        near = both.join(labels.hint("merge"), both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near.hint("merge"), labels.id == near.a).select("id", F.col("label").alias("old"), F.least("label", "near").alias("met"))
        up = labels.select(F.col("id").alias("up"), F.col("label").alias("top"))
        jumped = met.join(up.hint("merge"), F.col("met") == F.col("up")).select("id", F.least("met", "top").alias("label"), "old")
        table = scratch.table(jumped, "labels")
        changed = not table.filter("label <> old").isEmpty()
        scratch.drop(labels)
        labels = table.select("id", "label")
        labels._tessera_path = table._tessera_path
    return labels
