"""Readers and writers of the tables: JSON lines with fixed schemas, source trees, manifests."""

from __future__ import annotations

import ctypes
import json
import re
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.text import is_implementation
from ..shared import drop, saved, ship
from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever file system Spark reads it from."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: str, bad: str = "PERMISSIVE") -> DataFrame:
    """JSON lines; a missing path is an empty table. Lines that don't parse give nulls, or are dropped
    with bad="DROPMALFORMED"; blank lines are no rows. Keys that a line lacks are null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", bad).json(path)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return read_jsonl(spark, path, schemas.TABLES[name])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line) of text files, seq from 0 in each file's order.

    Files are read in blocks: lines are numbered within their block, and a block begins at the sum of
    the lines of those before it; so no task sees more of a large file than a block.
    """
    meta = lambda c: F.col(f"_metadata.{c}")
    rows = spark.read.text(path).select(meta("file_path").alias("path"), meta("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    within = F.row_number().over(Window.partitionBy("path", "block").orderBy("at")) - 1
    sizes = rows.groupBy("path", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("within", within).join(sizes.select("path", "block", before.alias("before")), ["path", "block"]).select("path", (F.col("before") + F.col("within")).cast("int").alias("seq"), "line")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Logs of JSON lines whose order counts: rows with the file's path and seq from 0; blank lines are no rows but count."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"path string, seq int, {schema}")
    lines = numbered_lines(spark, path).where(F.trim("line") != "")
    return lines.select("path", "seq", F.from_json("line", schema).alias("r")).select("path", "seq", "r.*")


def read_sources(spark: SparkSession, root: str, pattern: str = "*.java") -> DataFrame:
    """All files below root that match, as (path, content); kept as they are, in no order."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"))


def doubled(content: Column) -> Column:
    """A source as lines joined with their own ends kept: every line end twice, but for the last line's."""
    return F.regexp_replace(content, r"\n(?!\z)", "\n\n")


def in_path_order(files: DataFrame) -> DataFrame:
    """files with `place` from 0 in path order. Paths alone are ranked."""
    return files.join(with_places(files.select("path"), "path"), "path")


def with_places(rows: DataFrame, by: str, out: str = "place") -> DataFrame:
    """rows with their places from 0 in the order of a column, equal ones in any order: by partial sums over ranges, no task orders them all."""
    # written, as ranges found anew could be others
    dealt = saved(rows.repartitionByRange(by).withColumn("part_", F.spark_partition_id()), "ranges")
    ranked = dealt.withColumn("place_", F.row_number().over(Window.partitionBy("part_").orderBy(by)))
    counts = dealt.groupBy("part_").agg(F.count("*").alias("n_"))  # a row for each range
    before = counts.withColumn("before_", F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n_")
    return ranked.join(F.broadcast(before), "part_").withColumn(out, (F.col("before_") + F.col("place_") - 1).cast("int")).drop("part_", "place_", "before_")


def read_implementation(spark: SparkSession, root: str) -> DataFrame:
    """Implementation sources below root: paths with a folder src and none of tests, (path, content)."""
    return read_sources(spark, root).where(is_implementation(F.col("path")))


def write_index(rows: DataFrame, path: str, source_hash: str, project: str) -> None:
    """A class index as JSON lines under path/records and its header under path/header, which tells what it was built from."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").json(f"{path}/records")
    spark.createDataFrame([(project, source_hash)], "project string, source_hash string").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def read_index(spark: SparkSession, path: str, schema: str, source_hash: str | None = None) -> DataFrame | None:
    """An index as write_index() wrote it; None if there is none or, where a hash is given, it was built from something else."""
    if not exists(spark, f"{path}/header"):
        return None
    header = spark.read.schema("project string, source_hash string").json(f"{path}/header").first()
    if header is None or source_hash is not None and header["source_hash"] != source_hash:
        return None
    return spark.read.schema(schema).json(f"{path}/records")


#: The header's fields in the first line of an index of one file.
HEADER = "_header boolean, project string, classes_hash string, records long"


def write_index_file(rows: DataFrame, path: str, source_hash: str, project: str) -> None:
    """A class index as one file of JSON lines, in order of class: a header first, which tells what it was built from.

    One file is one task's work, so this is for the index of a project; write_index() is for larger ones.
    The file takes the old one's place when it is whole.
    """
    spark = rows.sparkSession
    own = rows.select("class", F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))
    n = own.count()
    head = spark.createDataFrame([(None, json.dumps({"_header": True, "project": project, "classes_hash": source_hash, "records": n}))], "class string, value string")
    part = f"{path}.writing"
    own.unionByName(head).coalesce(1).sortWithinPartitions(F.asc_nulls_first("class")).select("value").write.mode("overwrite").text(part)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    whole = [f.getPath() for f in fs.listStatus(hadoop(part)) if f.getPath().getName().startswith("part-")]
    fs.delete(hadoop(path), True)
    fs.rename(whole[0], hadoop(path))
    fs.delete(hadoop(part), True)


def index_header(spark: SparkSession, path: str) -> dict | None:
    """The header of an index of one file; None if there is no file, or none in its first line."""
    if not exists(spark, path):
        return None
    first = spark.read.text(path).where(F.col("_metadata.file_block_start") == 0).head()
    row = spark.createDataFrame([(first["value"],)], "v string").select(F.from_json("v", HEADER).alias("h")).first()["h"] if first else None
    return row.asDict() if row and row["_header"] else None


def read_index_file(spark: SparkSession, path: str, schema: str, source_hash: str | None = None) -> DataFrame | None:
    """The records of an index of one file, read in as many ranges of bytes as Spark cuts it to; None if there is no index or,
    where a hash is given, it was built from something else, which the header tells before a record is read. A file with
    fewer or more records than its header says is an error."""
    header = index_header(spark, path)
    if header is None or source_hash is not None and header["classes_hash"] != source_hash:
        return None
    rows = spark.read.schema(f"_header boolean, {schema}").json(path).where("_header IS NULL").drop("_header")
    n = rows.agg(F.count("*").alias("n")).first()["n"]
    if n != header["records"]:
        raise ValueError(f"{path} holds {n} records, its header tells of {header['records']}")
    return rows


def write_checkpoint(row: DataFrame, path: str) -> None:
    """The checkpoint's one row, in place of the last one."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A summary of one row as one JSON file."""
    row.limit(1).coalesce(1).write.mode("overwrite").json(path)


def clear_reports(spark: SparkSession, paths: list[str]) -> int:
    """Delete reports of earlier runs, which would count into the next one's figures; how many were there."""
    gone = 0
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return gone


#: Bytes of a tree's files that one task of fingerprint() reads, but for one larger file.
DIGEST_BYTES = 256 << 20


def _openssl():
    """The interpreter's own OpenSSL, whose SHA-256 can be stopped and gone on with elsewhere; null if it isn't reachable."""
    try:
        import _hashlib

        lib = ctypes.CDLL(_hashlib.__file__)
        return lib if all(hasattr(lib, f"SHA256_{x}") for x in ("Init", "Update", "Final")) else None
    except (ImportError, OSError):
        return None


class Sha256:
    """SHA-256 with a state of a few bytes that another task takes over."""

    #: Longer than OpenSSL's SHA256_CTX (112 bytes).
    SIZE = 256

    def __init__(self, state: bytes | None = None):
        if (lib := _openssl()) is None:
            raise RuntimeError("this Python's hashlib isn't built on an OpenSSL with SHA256_Init, SHA256_Update and SHA256_Final")
        self.lib, self.state = lib, ctypes.create_string_buffer(state or b"", self.SIZE)
        if state is None:
            self.lib.SHA256_Init(self.state)

    def update(self, data: bytes) -> None:
        self.lib.SHA256_Update(self.state, ctypes.c_char_p(data), ctypes.c_size_t(len(data)))

    def hexdigest(self) -> str:
        out, end = ctypes.create_string_buffer(32), ctypes.create_string_buffer(self.state.raw, self.SIZE)
        self.lib.SHA256_Final(out, end)
        return out.raw.hex()


def fingerprint(files: DataFrame, root: str = "") -> DataFrame:
    """One digest of a tree of files (path, content): sha256 over each path below root and its content, in path order; 16 hex digits.

    Such a digest is told byte by byte in one order. The rows are written in ranges of paths of about
    DIGEST_BYTES each; one task for each range, one after the other, goes on from the state of SHA-256 that the
    one before has left (256 bytes, by way of the driver). An empty tree has the digest of nothing.
    """
    spark = files.sparkSession
    rows = files.select(F.regexp_replace("path", F.lit("^" + re.escape(root) + "/?" if root else "^$"), F.lit("")).alias("path"), F.col("content").cast("binary").alias("content"))
    size = rows.agg(F.coalesce(F.sum(F.octet_length("path") + F.coalesce(F.octet_length("content"), F.lit(0))), F.lit(0)).cast("long")).first()[0]
    parts = max(1, -(-size // DIGEST_BYTES))
    ship(spark)

    def digest(state: bytes | None):
        def run(batches):
            total = Sha256(state)
            for batch in batches:
                for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    total.update(p.encode())
                    total.update(c or b"")
            yield pa.RecordBatch.from_pydict({"state": [total.state.raw]})

        return run

    ranged = rows.repartitionByRange(parts, "path") if parts > 1 else rows.repartition(1)
    table = saved(ranged.withColumn("part", F.spark_partition_id()), "tree", "part")
    state = None
    for part in sorted(r["part"] for r in table.select("part").distinct().collect()):  # one for each range
        one = table.where(F.col("part") == part).select("path", "content")
        state = one.repartition(1).sortWithinPartitions("path").mapInArrow(digest(state), "state binary").collect()[0]["state"]
    drop(table)
    return spark.createDataFrame([(Sha256(None if state is None else bytes(state)).hexdigest()[:16],)], "fingerprint string")


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def write_once(df: DataFrame, path: str) -> None:
    df.write.mode("ignore").json(path)


def read_prompts(spark: SparkSession, path: str, with_excluded: bool = False) -> DataFrame:
    rows = read_table(spark, path, "prompts")
    return rows if with_excluded else rows.where(~F.coalesce(F.col("excluded"), F.lit(False)))


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """The checkpoint's row, or its start: class 0, nothing spent."""
    rows = read_table(spark, path, "checkpoint")
    start = spark.createDataFrame([(0, None, 0, 0, 0.0, 0)], schemas.CHECKPOINT)
    return rows.union(start).limit(1) if rows.isEmpty() else rows


def write_dataset(rows: DataFrame, path: str, name: str) -> None:
    """Training pairs as JSON lines under path/name, and the manifest dataset_info.json beside them."""
    pairs = rows.select("instruction", F.lit("").alias("input"), "output")
    pairs.write.mode("overwrite").json(f"{path}/{name}")
    manifest = json.dumps({name: {"file_name": name, "columns": {"prompt": "instruction", "query": "input", "response": "output"}}})
    spark = rows.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/dataset_info.json")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    out.write(bytearray(manifest.encode()))
    out.close()


def newest(files: DataFrame, by: str = "modificationTime") -> DataFrame:
    """The files of the latest modification time only."""
    latest = files.agg(F.max(by).alias("m"))
    return files.join(F.broadcast(latest), F.col(by) == F.col("m")).drop("m")  # one row
