"""Snapshots that are compared by digests: only ranges of keys that differ are read again.

A snapshot is a table cut into ranges of a hash of its key, one folder each, and a small table of digests: for every range, the number of
rows and two sums of 64-bit hashes of whole rows. A later table is digested in one pass over it (a range sends one row a task), and
ranges whose digests agree are taken for equal: that they aren't has a chance of about 2^-128. Equal tables cost a join of
as many rows as there are ranges; one changed row costs its range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .sets import dealt

RANGE, SUMS = "_range", ("_rows", "_one", "_two")
MOST_RANGES = 100_000


def _range_of(key: Sequence[str], ranges: int) -> Column:
    return F.pmod(F.xxhash64(*_marked(key)), F.lit(ranges)).cast("int")


def _marked(columns: Sequence[str]) -> list[Column]:
    """The columns and whether each is null, as a hash passes nulls over."""
    return [c for name in columns for c in (F.col(f"`{name}`"), F.col(f"`{name}`").isNull())]


def digests(df: DataFrame, key: Sequence[str], ranges: int) -> DataFrame:
    """(_range, _rows, _one, _two): a row for each range that has rows; columns are hashed in the order of their names."""
    columns = sorted(df.columns)
    wide = lambda seed: F.sum(F.xxhash64(F.lit(seed), *_marked(columns)).cast("decimal(38,0)"))
    return df.groupBy(_range_of(key, ranges).alias(RANGE)).agg(F.count("*").alias("_rows"), wide("one").alias("_one"), wide("two").alias("_two"))


def write_snapshot(df: DataFrame, path: str, key: Sequence[str], ranges: int = 256) -> None:
    """Writes df, cut into ranges of its key, with its digests. Columns can't be named like those of a digest."""
    if not 0 < ranges <= MOST_RANGES:
        raise ValueError(f"a snapshot has 1 to {MOST_RANGES} ranges")
    if clash := {RANGE, *SUMS}.intersection(df.columns):
        raise ValueError(f"names of columns are taken: {sorted(clash)}")
    dealt(df.withColumn(RANGE, _range_of(key, ranges)), [RANGE]).write.partitionBy(RANGE).parquet(f"{path}/rows")
    held = df.sparkSession.read.schema(df.schema).option("basePath", f"{path}/rows").parquet(f"{path}/rows")
    digests(held.select(df.columns), key, ranges).withColumn("_ranges", F.lit(ranges)).write.parquet(f"{path}/digests")


def changed_ranges(current: DataFrame, path: str, key: Sequence[str]) -> list[int]:
    """The ranges of a snapshot in which current differs, in order; at most as many as it has."""
    then = current.sparkSession.read.parquet(f"{path}/digests")
    first = then.first()
    if first is None:  # an empty table has no ranges
        return [] if current.isEmpty() else [-1]
    now = digests(current, key, first["_ranges"]).withColumnsRenamed({c: f"{c}_now" for c in SUMS})
    same = F.lit(True)
    for c in SUMS:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_now"))
    return sorted(r[0] for r in then.join(now, RANGE, "full").filter(~same).select(RANGE).collect())


def diff_snapshot(current: DataFrame, path: str, key: Sequence[str]) -> DataFrame:
    """(key, change): added, removed or changed since the snapshot, by the key (rows of one key are compared as a multiset).

    Only ranges that differ are read from the snapshot and joined; columns of both have to be the same. Null keys are keys.
    """
    spark = current.sparkSession
    differ = changed_ranges(current, path, key)
    columns = sorted(current.columns)
    now = current
    if differ == [-1]:
        then = current.limit(0)
    else:
        ranges = (spark.read.parquet(f"{path}/digests").first() or {"_ranges": 1})["_ranges"]
        now = current.withColumn(RANGE, _range_of(key, ranges)).filter(F.col(RANGE).isin(differ)).drop(RANGE) if differ else current.limit(0)
        held = spark.read.parquet(f"{path}/rows") if differ else None
        then = held.filter(F.col(RANGE).isin(differ)).drop(RANGE) if differ else current.limit(0)
    sign = F.when(F.col("_side") == 1, F.lit(1)).otherwise(F.lit(-1)).cast("decimal(1,0)")
    wide = lambda seed: F.sum((sign * F.xxhash64(F.lit(seed), *_marked(columns)).cast("decimal(20,0)")).cast("decimal(38,0)"))
    both = now.withColumn("_side", F.lit(1)).unionByName(then.select(*current.columns).withColumn("_side", F.lit(2)))
    seen = dealt(both, key).groupBy(*key).agg(F.count_if(F.col("_side") == 1).alias("_now"), F.count_if(F.col("_side") == 2).alias("_then"), wide("one").alias("_one"), wide("two").alias("_two"))
    same = (F.col("_now") == F.col("_then")) & (F.col("_one") == 0) & (F.col("_two") == 0)
    change = F.when(F.col("_then") == 0, "added").when(F.col("_now") == 0, "removed").when(~same, "changed")
    return seen.select(*key, change.alias("change")).filter("change IS NOT NULL")
