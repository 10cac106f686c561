"""Set operations: diffs, versions, parity, unions that keep order, equality of multisets, vocabularies of fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


ROWS_A_TASK = 500_000  # that a task groups


def dealt(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df dealt by the columns over as many tasks as its rows need: a task groups some ROWS_A_TASK rows, whatever the table's size."""
    return df.repartition(max(1, -(-df.count() // ROWS_A_TASK)), *columns)


def fact_diff(current: DataFrame, base: DataFrame, signature: Sequence[str]) -> DataFrame:
    """(signature, change): added or removed, by the signature columns; nulls equal nulls. One shuffle; see dealt."""
    tagged = current.select(*signature).withColumn("_in", F.lit(1)).unionByName(base.select(*signature).withColumn("_in", F.lit(2)))
    return dealt(tagged, signature).groupBy(*signature).agg(F.bit_or("_in").alias("_in")).filter("_in < 3").withColumn("change", F.when(F.col("_in") == 1, "added").otherwise("removed")).drop("_in")


def version_diff(old: DataFrame, new: DataFrame, key: str, content: str) -> DataFrame:
    """(key, change): new, removed or changed (another content hash); equal ones are left out."""
    digest = F.sha2(F.coalesce(F.col(content).cast("string"), F.lit("")), 256)
    a, b = old.select(key, digest.alias("a")), new.select(key, digest.alias("b"))
    change = F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return a.join(b, key, "full").select(key, change.alias("change")).filter("change IS NOT NULL")


def parity(declared: DataFrame, observed: DataFrame, key: str, direction: str = "both", exempt: DataFrame | None = None, optional: DataFrame | None = None) -> DataFrame:
    """(key, issue): missing (declared, not observed) and undeclared. exempt silences undeclared keys, optional missing ones."""
    if direction not in ("both", "missing-only", "undeclared-only"):
        raise ValueError(f"no such direction: {direction}")
    d, o = declared.select(key).distinct(), observed.select(key).distinct()
    parts = []
    if direction != "undeclared-only":
        gone = d.join(o, key, "left_anti")
        parts.append((gone if optional is None else gone.join(optional.select(key), key, "left_anti")).withColumn("issue", F.lit("missing")))
    if direction != "missing-only":
        extra = o.join(d, key, "left_anti")
        parts.append((extra if exempt is None else extra.join(exempt.select(key), key, "left_anti")).withColumn("issue", F.lit("undeclared")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def ordered_union(*arrays: Column) -> Column:
    """The arrays one after the other, each value where it stands first."""
    return F.array_distinct(F.concat(*(F.coalesce(a, F.array().cast("array<string>")) for a in arrays)))


def interlock(prose: DataFrame, registry: DataFrame, prefix: str = "prefix") -> DataFrame:
    """(prefix, issue): said in prose but not registered, or registered but nowhere said."""
    a, b = prose.select(prefix).distinct(), registry.select(prefix).distinct()
    return a.join(b, prefix, "left_anti").withColumn("issue", F.lit("unregistered")).unionByName(b.join(a, prefix, "left_anti").withColumn("issue", F.lit("unmentioned")))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows the same number of times."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        return False
    tagged = a.select(*columns).withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    return tagged.groupBy(*columns).agg(F.sum("_n").alias("_n")).filter("_n <> 0").isEmpty()


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows with how many more a has of them than b (below zero: fewer); equal counts are left out."""
    columns = sorted(a.columns)
    tagged = a.select(*columns).withColumn("_n", F.lit(1)).unionByName(b.select(*columns).withColumn("_n", F.lit(-1)))
    return tagged.groupBy(*columns).agg(F.sum("_n").alias("surplus")).filter("surplus <> 0")


def key_drift(df: DataFrame, baseline: DataFrame, json: str = "props", key: str = "key") -> DataFrame:
    """(key, change, level): keys of JSON objects against a baseline; added is a note, removed a violation."""
    now = df.select(F.explode(F.json_object_keys(json)).alias(key)).distinct()
    base = baseline.select(key).distinct()
    return now.join(base, key, "left_anti").select(key, F.lit("added").alias("change"), F.lit("I").alias("level")).unionByName(base.join(now, key, "left_anti").select(key, F.lit("removed").alias("change"), F.lit("E").alias("level")))
