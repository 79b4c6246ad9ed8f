"""As-of join: each left row with the last right row of its key up to its time.

Both sides are dealt by key and stretch of time, not by key alone, so that a key with a third of all rows is as many
groups as it has stretches.  What a stretch doesn't know, the last right row before it, comes from one row for each key and stretch
in which right rows are.

Defined results: a null key or time matches nothing and its left rows stay; rows of the right side without a key or time are left out; of
right rows at one time the one with the largest ``tie`` counts, and of those the one with the largest values; with ``strict`` a right row at the left row's very time doesn't count; beyond the
tolerance there is no match; every left row is in the result once, whether repeated or not; either side may be empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _micros(time: Column, kind: str) -> Column:
    """Times as whole numbers: microseconds for dates and timestamps."""
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.unix_micros(time.cast("timestamp"))
    return time.cast("long")


def asof(left: DataFrame, right: DataFrame, by: str, on: str, values: Sequence[str], stretch: int, tolerance: int | None = None, strict: bool = False, tie: str | None = None) -> DataFrame:
    """``left`` with ``values`` and ``matched_<on>`` of the right row in force.

    ``stretch`` and ``tolerance`` count in the time's unit: microseconds for dates and timestamps, else its own.
    """
    kind = dict(left.dtypes)[on]
    row, held = F.struct("*"), F.struct(F.col(on).alias("on"), *values)
    time = _micros(F.col(on), kind)
    ranked = F.struct((F.col(tie) if tie else F.lit(0)).alias("tie"), held.alias("held"))
    one = right.where(F.col(by).isNotNull() & F.col(on).isNotNull()).groupBy(F.col(by).alias("_by"), time.alias("_at")).agg(F.max(ranked)["held"].alias("_held"))
    bucket = F.floor(F.col("_at") / stretch)
    rights = one.select("_by", "_at", bucket.alias("_bucket"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(left.select(row.alias("r")).schema["r"].dataType).alias("_row"), "_held")
    keyed = left.select(F.col(by).alias("_by"), time.alias("_at"), row.alias("_row"))
    able = F.col("_by").isNotNull() & F.col("_at").isNotNull()
    lefts = keyed.where(able).select("_by", "_at", bucket.alias("_bucket"), F.lit(0 if strict else 1).alias("_side"), "_row", F.lit(None).cast(rights.schema["_held"].dataType).alias("_held"))
    inside = Window.partitionBy("_by", "_bucket").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_held", ignorenulls=True)
    met = rights.unionByName(lefts).withColumn("_inside", last.over(inside)).where(F.col("_row").isNotNull())
    # one row for each key and stretch with right rows: its last one is what later stretches begin with
    ends = rights.groupBy("_by", "_bucket").agg(F.max_by("_held", "_at").alias("_end"))
    needed = lefts.select("_by", "_bucket").distinct().join(ends, ["_by", "_bucket"], "full")
    carried = needed.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy("_by").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).select("_by", "_bucket", "_before")
    found = met.join(carried, ["_by", "_bucket"], "left").withColumn("_found", F.coalesce("_inside", "_before"))
    near = F.lit(True) if tolerance is None else F.col("_at") - _micros(F.col("_found.on"), kind) <= tolerance
    done = found.select("_row", F.when(near, F.col("_found")).alias("_found"))
    bare = keyed.where(~able).select("_row", F.lit(None).cast(rights.schema["_held"].dataType).alias("_found"))
    return done.unionByName(bare).select("_row.*", F.col("_found.on").alias(f"matched_{on}"), *[F.col("_found")[v].alias(v) for v in values])
