"""The folder that all executors share, and tables in it that are written once for each state of their inputs."""

from __future__ import annotations

import hashlib
import inspect
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir` of the session; where that is unset (local tests) a folder of this machine, set for the session."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fingerprint(df: DataFrame) -> str:
    """A hash of the files that `df` reads: paths, lengths and times of change; a change of any gives another."""
    spark = df.sparkSession
    conf, hadoop = spark._jsc.hadoopConfiguration(), spark._jvm.org.apache.hadoop.fs
    said = []
    for name in sorted(df.inputFiles()):
        path = hadoop.Path(spark._jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        said.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(said).encode()).hexdigest()[:24]


def version(*modules) -> str:
    """A hash of the modules' source: tables that their code makes are made anew when it changes."""
    return hashlib.sha256("".join(inspect.getsource(m) for m in modules).encode()).hexdigest()[:12]


def written_once(spark: SparkSession, name: str, build: Callable[[str], None]) -> str:
    """The folder of `name` in the shared folder, built by `build(path)` if it is not there whole.

    It is built under another name and renamed when done, so a run that dies leaves nothing that a later one would read; of two
    that build at once one is kept.
    """
    path, half = f"{shared_dir(spark)}/{name}", f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    done, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, half))
    files = done.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(done):
        build(half)
        if files.exists(done) or not files.rename(new, done):
            files.delete(new, True)
    return path


#: Rows of the input for each partition of a shuffle, about, and bytes of a shuffle that partitions may be joined up to.
PARTITION_ROWS, PARTITION_BYTES = 200_000, "4m"


def sized(spark: SparkSession, rows: int) -> SparkSession:
    """A session like `spark` whose shuffles have partitions in proportion to `rows` of input, and no fewer than its own: what a task sorts does not grow with the input."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.shuffle.partitions", max(rows // PARTITION_ROWS + 1, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    own.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", PARTITION_BYTES)
    # lists and sets of many small groups: hashing holds 128 groups, then sorts what is left, before a shuffle and after it
    own.conf.set("spark.sql.execution.useObjectHashAggregateExec", False)
    return own


def stored(df: DataFrame, name: str = "rows") -> DataFrame:
    """`df` written to the shared folder as Parquet and read again: computed once, its lineage cut. The table stays until the folder is cleaned."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
