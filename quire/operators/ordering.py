"""A total order over tables of any size: places of rows from 1 without gaps, and prefix sums, with no task that sees all rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Used only where no shared folder is set and driver and executors are one process.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/quire"


def settled(df: DataFrame) -> DataFrame:
    """df with its partitions as they are, kept in the shared checkpoint folder, so that a lost executor cannot change them."""
    spark = df.sparkSession
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that driver and executors share.")
        spark.sparkContext.setCheckpointDir(found or LOCAL_CHECKPOINTS)
    return df.checkpoint()


def ranged(df: DataFrame, *order: Column | str, parts: int | None = None) -> DataFrame:
    """df in ranges of the order, sorted: reading its partitions one after another is reading it in order.

    Ranges are cut by samples of the whole order, so a first column that is the same in many rows is cut as well; rows
    that are equal in all of it meet in one range, where they keep no order of their own.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settled(df.repartitionByRange(n, *order).sortWithinPartitions(*order))


def numbered(df: DataFrame, *order: Column | str, out: str = "n", total: Column | None = None, total_out: str = "total", parts: int | None = None) -> DataFrame:
    """df with each row's place in the order, from 1; and, if total is given, the sum of that column up to and with the row.

    The rows are dealt by ranges once. What the driver sees is a count (and a sum) for each range; it comes back as a
    constant of the plan. An empty table gives none; nulls come first, as Spark sorts them.
    """
    rows = ranged(df if total is None else df.withColumn("__part_of_total", total), *order, parts=parts)
    part = F.spark_partition_id()
    sums = [F.count(F.lit(1)).alias("n")] + ([] if total is None else [F.sum(F.coalesce("__part_of_total", F.lit(0))).cast("bigint").alias("t")])
    found = {r["p"]: r for r in rows.groupBy(part.alias("p")).agg(*sums).collect()}
    before, run, at, sum_ = [], [], 0, 0
    for p in range(max(found, default=-1) + 1):
        before.append(at)
        run.append(sum_)
        at, sum_ = at + (found[p]["n"] if p in found else 0), sum_ + ((found[p]["t"] or 0) if p in found and total is not None else 0)
    constant = lambda values: F.element_at(F.array(*[F.lit(v).cast("bigint") for v in values or [0]]), part + 1)
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = rows.withColumn(out, constant(before) + within + 1)
    if total is None:
        return placed
    from pyspark.sql import Window

    # a range is sorted by its own task, and the sum of the ranges before is a constant
    inside = Window.partitionBy("__range").orderBy(out).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = placed.withColumns({"__range": part, "__before": constant(run)})
    return placed.withColumn(total_out, F.col("__before") + F.sum(F.coalesce("__part_of_total", F.lit(0))).over(inside)).drop("__range", "__before", "__part_of_total")
