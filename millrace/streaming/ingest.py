"""Resumable ingestion: files of JSON lines into a keyed table, each key once."""

from __future__ import annotations

import uuid
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import exists
from . import states


def append_new(batch: DataFrame, path: str, key: list[str], batch_id: int | str | None = None) -> None:
    """Append the rows whose key the table at path doesn't hold yet, one of each key (the least row).

    For single appends: the table's keys are read and joined away. A batch with an id replaces what an
    earlier try of it has left. ingest() keeps keys as state instead.
    """
    spark = batch.sparkSession
    rows = batch.groupBy(*key).agg(F.min(F.struct(*[c for c in batch.columns if c not in key])).alias("r")).select(*key, "r.*")
    own = f"new-{uuid.uuid4().hex}" if batch_id is None else f"{batch_id:012d}" if isinstance(batch_id, int) else batch_id
    if exists(spark, path):
        # as text: ids of batches and names of single appends side by side
        done = spark.read.option("basePath", path).schema(rows.withColumn("batch", F.lit("")).schema).parquet(path).where(F.col("batch") != own)
        rows = rows.join(done.select(*key), key, "left_anti")
    rows.write.mode("overwrite").parquet(f"{path}/batch={own}")


def read_ingested(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that append_new() and ingest() write, without the column of its layout."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def ingest(spark: SparkSession, source: str, schema: str, path: str, key: list[str], checkpoint: str, ttl_ms: int | None = None) -> StreamingQuery:
    """Read the files that have come to `source` since the checkpoint and append their new keys.

    Keys are state in the checkpoint, so a batch looks its own keys up, however many there are. A
    checkpoint that begins beside a table that is there already takes that table's keys once as its first
    state. A batch that ran but wasn't recorded runs again and replaces its own rows; so each key is
    once in the table (with ttl_ms, once in that time). Ends when all files there are have been read.
    """
    known = read_ingested(spark, path) if exists(spark, path) and not exists(spark, f"{checkpoint}/commits") else None
    rows = states.once(spark.readStream.schema(schema).json(source), key, known, ttl_ms)
    name = sha256(checkpoint.encode()).hexdigest()[:12]

    def append(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={name}-{n:012d}")

    return rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(append).start()


def windowed_counts(stream: DataFrame, at: str, by: list[str], late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts of a stream's rows by event-time window; rows later than `late` are left out."""
    return stream.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n"))
