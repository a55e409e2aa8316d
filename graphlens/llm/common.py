"""Helpers shared by the corpus operators: reading tables, cutting lineage, text normalisation."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Byte table that lower-cases A-Z and nothing else.
LOWER_BYTES = bytes.maketrans(UPPER.encode(), LOWER.encode())


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); a local one only where none is set."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="graphlens-"))
    return sc.getCheckpointDir()


def fresh(df: DataFrame, name: str) -> str:
    """The name, or one made from it, that no column of df has."""
    there = {c.lower() for c in df.columns}
    while name.lower() in there:
        name = "_" + name
    return name


#: Most bytes of text that Spark hands to a Python worker at once.
ARROW_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = ARROW_BYTES) -> None:
    """Lower the session's limit on the bytes of an Arrow batch: a batch of long texts is held several times over, by the JVM and by Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = str(spark.conf.get(key, None))
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again, so that later steps survive lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._graphlens_path = path
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that materialize() wrote; the frame can't be read after."""
    path = getattr(df, "_graphlens_path", None)
    if path:
        spark = df.sparkSession
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def lower_ascii(c: Column) -> Column:
    """A-Z in lower case, other characters as they are. Pure ASCII texts take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def fraction(*parts: Column) -> Column:
    """A number in [0, 1) drawn from the md5 of the parts: the same on every run, machine and engine."""
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def doc_part(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def extended(df: DataFrame, more: str) -> T.StructType:
    """The schema of df with more columns, given as DDL."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])
