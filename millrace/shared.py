"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    path = os.path.join(tempfile.mkdtemp(prefix="millrace-"), "millrace.zip")
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def spread(df: DataFrame) -> DataFrame:
    """df in at least four tasks a core, before work that is dear for each row.

    A small file is one or a few tasks, however dear its rows are; and Spark would join small parts of
    a shuffle again, but for those of a number that is given. Rows are dealt in turn, so no key is hot.
    """
    spark = df.sparkSession
    return df.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))


#: Bytes of a table's files, and of a shuffle's rows as they are written, to a task.
PART = 4 << 20


def fit(spark: SparkSession, path: str) -> None:
    """Let shuffles have as many parts as a table's files ask for, of PART bytes each at most.

    What a task holds then doesn't grow with the table. Spark joins parts of 64 MB again, which are
    gigabytes in memory where rows are narrow and compress well, so it is told to join fewer, and
    to read files in parts of an eighth of that number. Small tables change nothing.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    size = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    first = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    now = int(spark.conf.get(first, None) or spark.conf.get("spark.sql.shuffle.partitions"))
    if -(-size // PART) > now:
        spark.conf.set(first, str(-(-size // PART)))
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PART))
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(8 * PART))


#: Paths of tables that this process has written and not dropped.
_written: list[str] = []


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that driver and executors share.

    The cluster names that folder in spark.checkpoint.dir. Only on one machine, as in tests, does a
    temporary folder stand in where it is unset, and is set for the session's later calls; elsewhere
    that is an error, as executors couldn't see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is unset: it must name a folder that the driver and all executors share")
        base = Path(tempfile.mkdtemp(prefix="millrace-shared-")).as_uri()
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def saved(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """Write df to the shared folder (in folders by some columns) and read it back: its lineage ends there, and no executor alone holds it."""
    path = shared_dir(df.sparkSession, tag)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    if path in _written:
        _written.remove(path)


def drop(table: DataFrame) -> None:
    """Delete a table that saved() gave, once nothing is read from it any more."""
    _delete(table.sparkSession, table._saved_at)


def clean(spark: SparkSession) -> int:
    """Delete all tables and folders that this process has made in the shared folder and not dropped; how many.

    To be called when the results that were told from them have been written: a query's DataFrame
    reads them when it runs.
    """
    paths = list(_written)
    for path in paths:
        _delete(spark, path)
    return len(paths)
