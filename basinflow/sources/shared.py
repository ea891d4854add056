"""Intermediate storage that every executor can reach.

Iterative operators cut lineage by writing tables under the folder the cluster names in
``spark.checkpoint.dir``.  Only where that setting is absent (local runs, tests) a folder of
our own is chosen, and it is chosen once per session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder; where the session names none, a local one, and an error on a cluster,
    whose executors would each write to a disk of their own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = found.get() if found.isDefined() else None
    if not base:
        if not spark.sparkContext._jsc.sc().isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="basinflow-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/basinflow/{name}-{uuid.uuid4().hex}"


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_arrow_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound the bytes of text that a Python task holds at once, unless the session has a bound of its own.

    Spark's default of 64 MB is held several times over, on both sides of the pipe and for every core.
    """
    if spark.conf.get(ARROW_BYTES, None) is None:
        spark.conf.set(ARROW_BYTES, size)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that ``df`` reads, as Spark estimates them; an upper bound of what a scan,
    filter or aggregation of them writes."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))


def scan_bytes(spark: SparkSession) -> int:
    """Bytes of a table that one task reads (``spark.sql.files.maxPartitionBytes``)."""
    return int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())


def few_files(df: DataFrame) -> DataFrame:
    """``df`` in fewer partitions, without a shuffle: two for each scan split of the tables it reads, but
    an eighth of the session's shuffle partitions and two per core of the cluster at least.

    Writing many partitions of a few rows each costs more in file creation than in work; the bound by
    bytes keeps tasks as small as the splits of a scan at any size of the input.
    """
    spark = df.sparkSession
    splits = min(2 * input_bytes(df) // scan_bytes(spark), 1 << 20)
    return df.coalesce(max(splits, 2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back.

    The result has no lineage: a lost executor costs a re-read, never a recomputation.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    few_files(df).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`materialise` through Spark's own file system."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


#: Names of URI schemes that Hadoop and Arrow call differently.
ARROW_SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss"}


def arrow_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The Arrow file system of a Hadoop URI, and the path in it."""
    scheme, mark, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{ARROW_SCHEMES.get(scheme, scheme)}{mark}{rest}")


def discard(df: DataFrame) -> None:
    """Drop the files behind a materialised table once later steps have used it."""
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        remove(df.sparkSession, path)
