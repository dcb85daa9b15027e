"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space between words; everything else belongs to a word.
SPACE = r"[ \t\n\x0B\f\r]"
#: Used only where no shared folder is set and driver and executors are one process.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/quire"
#: Bytes of Arrow data that are handled at a time in a Python worker; a longer row is handled alone.
SLICE_BYTES = 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or the checkpoint folder of the context.

    Where neither is set, a local master gets a local folder, and any other master is an error: its executors would
    write to their own disks.
    """
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (own := context._jsc.sc().getCheckpointDir()).isDefined():
        found = own.get()
    if not found and not re.match(r"local(\[[^,]*\])?$", context.master):
        raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
    return found or LOCAL_CHECKPOINTS


def table(df: DataFrame) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back. The files go when the session ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of a small frame: checkpoint() in the shared folder."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def drop_table(df: DataFrame) -> None:
    """Remove the files of a frame that table() made, once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        if "/quire-" in f:
            where = jvm.org.apache.hadoop.fs.Path(f)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores after it if there is such a column already (in any case of letters)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name += "_"
    return name


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns of df as one struct, so that helper columns beside it cannot meet a column of the same name."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def small(rows: DataFrame, bound: int) -> DataFrame:
    """A table to be broadcast if it has at most so many rows (counted); a longer one is joined by shuffle."""
    return F.broadcast(rows) if rows.count() <= bound else rows


def slices(batch: pa.RecordBatch, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in parts of about so many bytes of Arrow data, cut by its average row; long rows stay whole."""
    rows = max(1, batch.num_rows * size // max(size, batch.nbytes))
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def spread(df: DataFrame) -> DataFrame:
    """df itself, or, where a scan has fewer partitions than there are cores, its rows dealt over the cores.

    That is so for tables of some megabytes only, one row group of which one task would have to work through; a table
    of more partitions than cores is not moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def words(text: Column) -> Column:
    """Array of the words of a text; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def hash2(text: Column) -> Column:
    """A second 64-bit hash, independent of xxhash64(text): its seed is another hash."""
    return F.xxhash64(F.lit("second"), text)


def numbered(df: DataFrame, keys: list[str], order: list[Column], parts: Column, out: str, lead: list[Column] = ()) -> DataFrame:
    """Number the rows of each key from 0 without gaps, in `parts` independent sorts per key.

    lead: columns that come first in the order (coarse, few values a key). A row's part is a hash of the
    order columns, so a hot key is sorted by many tasks; offsets come from the counts of the parts.
    """
    lead_names = [f"__lead{i}" for i in range(len(lead))]
    for n, c in zip(lead_names, lead):
        df = df.withColumn(n, c)
    df = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.greatest(parts, F.lit(1))))
    by = [*keys, *lead_names, "__part"]
    counts = df.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(*lead_names, "__part")
    offsets = counts.select(*by, (F.sum("__n").over(w) - F.col("__n")).alias("__off"))
    joined = df.join(offsets, by)
    at = Window.partitionBy(*by).orderBy(*order)
    return joined.withColumn(out, F.col("__off") + F.row_number().over(at) - 1).drop(*lead_names, "__part", "__off")
