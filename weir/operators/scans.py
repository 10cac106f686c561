"""Running values within groups of any size: a group is cut into ranges of its order, and only edges of ranges are carried.

Rows are dealt by ranges of (group, order) and written once; a range is what one task handles, however large the group
that it belongs to. Within a range, values run by a window; what lies before or after it in the same group comes from the totals of the
other ranges. Only a range's first and last group reach beyond it, so that what is carried has two rows a range at most, and is
broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import cut

RANGE = "_range"


def ranged(df: DataFrame, part: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """df, written once, with the number of its range; rows that are equal in part and order share one. Null groups are a group."""
    keys = [*part, *order]
    dealt = df.repartitionByRange(*keys) if ranges is None else df.repartitionByRange(ranges, *keys)
    return cut(dealt.withColumn(RANGE, F.spark_partition_id()))


def run_over(
    rows: DataFrame, part: Sequence[str], order: Sequence[str], running: Mapping[str, Column] | None = None, before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None
) -> DataFrame:
    """rows (see ranged) with new columns, each a value over the rows of the same group, in order:

    running: the sum up to and with this row; before: the greatest value of the rows before this one; after: the least value of the
    rows after it. Nulls are passed over; null where there is none (a running sum: 0). Rows that are equal in part and order come
    one after the other in some order.
    """
    kinds = {**{c: ("running", v) for c, v in (running or {}).items()}, **{c: ("before", v) for c, v in (before or {}).items()}, **{c: ("after", v) for c, v in (after or {}).items()}}
    step = {"running": F.sum, "before": F.max, "after": F.min}
    joined = {"running": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "before": F.greatest, "after": F.least}
    end = {"running": (Window.unboundedPreceding, 0), "before": (Window.unboundedPreceding, -1), "after": (1, Window.unboundedFollowing)}

    rows = rows.withColumns({f"_v_{c}": v for c, (_, v) in kinds.items()})
    totals = rows.groupBy(RANGE, *part).agg(*(step[kind](f"_v_{c}").alias(f"_t_{c}") for c, (kind, _) in kinds.items()))
    edges = Window.partitionBy(*part).orderBy(RANGE)
    beyond = {"running": (Window.unboundedPreceding, -1), "before": (Window.unboundedPreceding, -1), "after": (1, Window.unboundedFollowing)}
    carried = totals.withColumns({f"_c_{c}": step[kind](f"_t_{c}").over(edges.rowsBetween(*beyond[kind])) for c, (kind, _) in kinds.items()} | {"_ranges": F.count("*").over(Window.partitionBy(*part))})
    carried = carried.filter("_ranges > 1").select(F.col(RANGE).alias("_r"), *(F.col(p).alias(f"_p_{p}") for p in part), *(f"_c_{c}" for c in kinds))
    same = reduce(lambda a, b: a & b, (F.col(p).eqNullSafe(F.col(f"_p_{p}")) for p in part), F.col(RANGE) == F.col("_r"))

    local = Window.partitionBy(RANGE, *part).orderBy(*order)
    near = rows.withColumns({f"_l_{c}": step[kind](f"_v_{c}").over(local.rowsBetween(*end[kind])) for c, (kind, _) in kinds.items()})
    out = near.join(F.broadcast(carried), same, "left").withColumns({c: joined[kind](F.col(f"_l_{c}"), F.col(f"_c_{c}")) for c, (kind, _) in kinds.items()})
    return out.drop("_r", *(f"_p_{p}" for p in part), *(f"_{x}_{c}" for x in "vlc" for c in kinds))


def in_parts(df: DataFrame, part: Sequence[str], order: Sequence[str], most: int, ranges: int | None = None) -> DataFrame:
    """df with part_no and place (both from 0): each group in its order, cut into parts of `most` rows."""
    placed = run_over(ranged(df, part, order, ranges), part, order, running={"_place": F.lit(1)}).withColumn("place", (F.col("_place") - 1).cast("long"))
    return placed.withColumn("part_no", F.expr(f"place div {int(most)}")).drop("_place", RANGE)
