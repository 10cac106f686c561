"""Cutting lineage with written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only in local mode, where it is unset, a local folder (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='weir-tables-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A path for a new table in a folder of its own in the shared folder, deleted when the application ends."""
    folder = f"{shared_dir(spark)}/weir-{name}-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    store.mkdirs(place)
    store.deleteOnExit(place)
    return f"{folder}/table"


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read again: rows are fixed, lineage is short, lost executors cost nothing."""
    path = fresh_dir(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


SIEVE_BITS, SIEVE_BITS_EACH = 1 << 24, 16


def sifted(rows: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """rows less most of those whose key isn't in wanted (distinct keys): few are left to shuffle for an exact join.

    By a bitmap of hashed keys with some SIEVE_BITS_EACH bits for each, of SIEVE_BITS at most: what is broadcast has SIEVE_BITS / 64 rows,
    however many keys there are; where it is full, more rows pass. Rows with a null key go.
    """
    bits = min(SIEVE_BITS, 1 << max(12, (SIEVE_BITS_EACH * wanted.count()).bit_length()))
    place = F.pmod(F.xxhash64(key, F.lit("sieve")), F.lit(bits))
    bitmap = wanted.select(place.alias("_p")).groupBy(F.expr("_p div 64").alias("_word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(_p % 64 AS int))")).alias("_bits"))
    near = rows.withColumn("_p", place).withColumn("_word", F.expr("_p div 64")).join(F.broadcast(bitmap), "_word")
    # the key passes through the test, so that a later join by it isn't moved before it
    passed = F.when(F.expr("(_bits & shiftleft(1L, cast(_p % 64 AS int))) <> 0"), F.col(key))
    return near.withColumn(key, passed).filter(F.col(key).isNotNull()).drop("_p", "_word", "_bits")
