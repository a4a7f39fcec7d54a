"""Ranges of a global order: bounds, buckets and running totals, without a task that holds the whole order.

Nothing here depends on the size of the input: what reaches the driver is one
row per range bucket, and the number of buckets is a parameter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def fresh(columns: Sequence[str], name: str) -> str:
    """``name``, or the first of name_1, name_2, ... that no column has (case-insensitively)."""
    taken, n, out = {c.lower() for c in columns}, 0, name
    while out.lower() in taken:
        n += 1
        out = f"{name}_{n}"
    return out


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, cols: Sequence[str], n: int) -> list[tuple]:
    """At most ``n`` - 1 ascending tuples that cut ``df`` into about equal ranges of ``cols`` (not null).

    Collects one row per range. The tuples only steer the work; no result depends on them.
    """
    firsts = (
        df.select(*cols)
        .repartitionByRange(n, *cols)
        .groupBy(F.spark_partition_id().alias("p"))
        .agg(F.min(F.struct(*cols)).alias("first"))
        .collect()
    )
    return sorted(tuple(r["first"]) for r in firsts)[1:n]


#: Bounds up to which a range is found by nested CASE; more are searched for in an array.
_MOST_CASES = 512


def range_bucket(cols: Sequence[Column], bounds: list[tuple]) -> Column:
    """The number of ``bounds`` that are not above ``cols``, by binary search."""
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(cols)])
    bound = [F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(b)]) for b in bounds]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bound[mid], search(low, mid)).otherwise(search(mid + 1, high))

    if len(bounds) <= _MOST_CASES:
        return search(0, len(bounds))
    sorted_bounds = F.array(*bound)  # one constant

    def halve(state: Column, _: Column) -> Column:
        mid = F.floor((state["low"] + state["high"]) / 2).cast("int")
        above = key < F.get(sorted_bounds, mid)
        done = state["low"] >= state["high"]
        return F.struct(
            F.when(done | above, state["low"]).otherwise(mid + 1).alias("low"),
            F.when(~done & above, mid).otherwise(state["high"]).alias("high"),
        )

    start = F.struct(F.lit(0).alias("low"), F.lit(len(bounds)).alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve)["low"]


def global_prefix(df: DataFrame, order: Sequence[str], value: str, out: str, n: int) -> DataFrame:
    """``df`` with the running total of ``value`` over the whole table in ascending ``order`` (not null).

    Range buckets are summed first, their ``n`` totals are accumulated, and each
    bucket runs its own window, so no task ever holds more than one bucket.
    ``order`` must be unique per row for a result that reruns reproduce. The
    table is read twice and should be materialised.
    """
    bucket, offset = fresh(df.columns, "bucket"), fresh(df.columns, "offset")
    bounds = range_bounds(df, order, n)
    cut = df.withColumn(bucket, range_bucket([F.col(c) for c in order], bounds))
    totals = cut.groupBy(bucket).agg(F.sum(value).alias(offset))
    below = Window.orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)  # n rows at most
    totals = totals.select(bucket, F.coalesce(F.sum(offset).over(below), F.lit(0)).alias(offset))
    within = Window.partitionBy(bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        cut.join(F.broadcast(totals), bucket)  # n rows at most
        .withColumn(out, F.sum(value).over(within) + F.col(offset))
        .drop(bucket, offset)
    )
