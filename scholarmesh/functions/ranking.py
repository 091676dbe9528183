"""Joins and rankings that hold when one key owns a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000
SALT_BUCKETS = 32


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    """True iff the DataFrame has at most max_rows rows; reads no more than that."""
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_join(big: DataFrame, small: DataFrame, on: list[str], spread: list[str],
                 how: str = "inner", small_enough: bool | None = None) -> DataFrame:
    """Equi-join that broadcasts `small` when its row count is checked to be small, else salts both sides.

    `spread` are columns of `big` that vary within a hot key; each hot key is spread over SALT_BUCKETS tasks.
    `small_enough` passes on a check already made on a table that bounds `small`.
    """
    if is_small(small) if small_enough is None else small_enough:
        return big.join(F.broadcast(small), on, how)
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALT_BUCKETS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT_BUCKETS - 1))))
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key, ranked from 1.

    The filter on row_number lets Catalyst limit every group before the shuffle (WindowGroupLimit),
    so a hot key sends at most k rows per input task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def running_total(df: DataFrame, keys: list[str], order: list[Column], bucket: Column,
                  value: Column | None = None, name: str = "running", totals_from: DataFrame | None = None) -> DataFrame:
    """Running sum (default: running count, i.e. row number) per key in `order`, without one task per key.

    `bucket` must be monotone in `order`. Each (key, bucket) is summed first; the prefix over the few bucket
    totals gives every bucket its offset, and rows are only ordered inside their bucket. `totals_from` may name a
    simpler DataFrame with the same rows to take the totals from.
    """
    value = F.lit(1) if value is None else value
    rows = df.withColumn("_bucket", bucket).withColumn("_value", value)
    base = rows if totals_from is None else totals_from.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = base.groupBy(*keys, "_bucket").agg(F.sum("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.join(offsets, [*keys, "_bucket"])
            .withColumn(name, F.col("_offset") + F.sum("_value").over(inside))
            .drop("_bucket", "_value", "_offset"))
