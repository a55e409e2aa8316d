"""Dense numbers over a whole table without a single-task window."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that executors share (spark.checkpoint.dir); a local one only where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphlens-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in the folder that executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def with_dense_index(df: DataFrame, *by: str, name: str = "idx") -> DataFrame:
    """Number all rows from 0 in the order of `by`.

    Rows are range-partitioned and sorted once; each partition's offset is the sum of the row counts
    before it (one count per partition goes to the driver).
    """
    ordered = checkpointed(df.orderBy(*by).withColumn("_part", F.spark_partition_id()).withColumn("_local", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    counts = sorted((r["_part"], r["n"]) for r in ordered.groupBy("_part").agg(F.count("*").alias("n")).collect())
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_part int, _offset long")
    out = ordered.join(F.broadcast(table), "_part")  # one row per partition
    return out.withColumn(name, F.col("_offset") + F.col("_local")).drop("_part", "_local", "_offset")


def with_dense_offsets(df: DataFrame, order: Column, *counts: str, name: str = "before") -> DataFrame:
    """Add the sum of each count over the rows before, in an order without ties: `before`, or before_<count> for several.

    Rows are range-partitioned and summed within a partition; one row a partition goes to the driver.
    """
    names = [name] if len(counts) == 1 else [f"{name}_{c}" for c in counts]
    ordered = checkpointed(df.repartitionByRange(df.sparkSession.sparkContext.defaultParallelism, order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()))
    sums = sorted((r["_part"], *(r[c] for c in counts)) for r in ordered.groupBy("_part").agg(*[F.sum(c).alias(c) for c in counts]).collect())
    rows, total = [], [0] * len(counts)
    for part, *mine in sums:
        rows.append((part, *total))
        total = [a + b for a, b in zip(total, mine, strict=True)]
    table = df.sparkSession.createDataFrame(rows or [(0, *total)], "_part int, " + ", ".join(f"_o{i} long" for i in range(len(counts))))
    before = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = ordered.join(F.broadcast(table), "_part")  # one row per partition
    out = out.withColumns({n: F.col(f"_o{i}") + F.coalesce(F.sum(c).over(before), F.lit(0)) for i, (n, c) in enumerate(zip(names, counts, strict=True))})
    return out.drop("_part", *[f"_o{i}" for i in range(len(counts))])
