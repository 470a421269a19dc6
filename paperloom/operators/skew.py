"""Joins and windows that stay even when one key holds a large share of the rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A key with this many rows is looked up by broadcast. At most (all rows / HOT_ROWS) keys can be that hot,
# which is the size bound of the broadcast side.
HOT_ROWS = 1_000_000
SPREAD = 100_000


def lookup(rows: DataFrame, values: DataFrame, keys: list[str], copies: str, row_id: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join ``rows`` with ``values`` (one row per key, ``copies`` = rows that share the key).

    Hot keys come from a broadcast of bounded size; their rows are then spread by row id through the
    shuffle join, where they match nothing, so that no task receives a whole hot key.
    """
    columns = [c for c in values.columns if c not in keys and c != copies]
    found = F.struct(*columns)
    hot = values.filter(F.col(copies) >= hot_rows).select(*keys, found.alias("_hot"))
    cold = values.filter(F.col(copies) < hot_rows).select(*keys, found.alias("_cold"), F.lit(0).cast("long").alias("_spread"))
    joined = rows.join(F.broadcast(hot), keys, "left").withColumn(
        "_spread",
        F.when(F.col("_hot").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(row_id), F.lit(SPREAD))),
    )
    joined = joined.join(cold, [*keys, "_spread"], "left")
    picked = F.coalesce("_hot", "_cold")
    return joined.select(*rows.columns, *[picked[c].alias(c) for c in columns])


def time_bucket(ts: Column, seconds: int) -> Column:
    return F.floor(F.unix_micros(ts) / F.lit(seconds * 1_000_000)).cast("long")


def carry(
    rows: DataFrame, key: str, ts: str, row_id: str, value: Column, out: str, bucket_seconds: int, include_current: bool
) -> DataFrame:
    """The latest non-NULL ``value`` of the key before a row (or up to it), in time order.

    Two levels: inside (key, time bucket) by a window, across buckets by one summary row per bucket. A key
    with very many rows is split over its buckets instead of being sorted in one task.
    """
    bucketed = rows.withColumns({"_bucket": time_bucket(F.col(ts), bucket_seconds), "_value": value})
    inside = Window.partitionBy(key, "_bucket").orderBy(ts, row_id).rowsBetween(
        Window.unboundedPreceding, Window.currentRow if include_current else -1
    )
    order = F.struct(F.col(ts), F.col(row_id))
    summary = bucketed.groupBy(key, "_bucket").agg(
        F.max_by(F.col("_value"), F.when(F.col("_value").isNotNull(), order)).alias("_last")
    )
    across = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    summary = summary.select(key, "_bucket", F.last("_last", ignorenulls=True).over(across).alias("_carried"))
    joined = bucketed.withColumn("_inside", F.last("_value", ignorenulls=True).over(inside)).join(
        summary, [key, "_bucket"], "left"
    )
    return joined.withColumn(out, F.coalesce("_inside", "_carried")).drop("_bucket", "_value", "_inside", "_carried")


def previous(rows: DataFrame, key: str, ts: str, row_id: str, columns: list[str], out: str, bucket_seconds: int) -> DataFrame:
    """The key's row just before each row, as a struct of ``columns``."""
    return carry(rows, key, ts, row_id, F.struct(*columns), out, bucket_seconds, include_current=False)
