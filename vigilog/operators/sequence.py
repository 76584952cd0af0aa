"""Order-dependent values per key without one task per key.

A key may hold a large part of all rows, so no window runs over a whole key. Rows are
range-partitioned by key and time, windows run inside (piece, key), and what crosses
the border of a piece is carried by a summary of one row per (key, piece).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilog.session import cut_lineage

BUCKET_SECONDS = 3600


def in_order(
    df: DataFrame,
    key: list[str],
    time: str,
    tie: str,
    first_position: str | None = None,
) -> DataFrame:
    """Add ``prev_time``, the 0-based ``position`` within the key and its last position.

    Rows are ordered by time, then ``tie``. ``first_position`` names a column whose
    least value in a key is where its positions start. The rows are written once, so
    what they are made of is computed once and every use sees the same pieces.
    """
    ranged = df.repartitionByRange(*key, time, tie).withColumn("_piece", F.spark_partition_id())
    pieces = cut_lineage(df.sparkSession, ranged, "in-order")
    start = F.lit(None).cast("bigint") if first_position is None else F.col(first_position)
    before = Window.partitionBy(*key).orderBy("_piece")
    earlier = before.rowsBetween(Window.unboundedPreceding, -1)
    summary = pieces.groupBy(*key, "_piece").agg(
        F.max(time).alias("_last"), F.count("*").alias("_n"), F.min(start).alias("_start")
    )
    whole = Window.partitionBy(*key)
    base = F.coalesce(F.min("_start").over(whole), F.lit(0))
    carried = summary.select(
        *key,
        "_piece",
        F.lag("_last").over(before).alias("_before"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) + base).alias("_offset"),
        (F.sum("_n").over(whole) + base - 1).alias("last_position"),
    )
    inside = Window.partitionBy("_piece", *key).orderBy(time, tie)
    local = pieces.withColumn("_lag", F.lag(time).over(inside)).withColumn(
        "_row", F.row_number().over(inside)
    )
    joined = local.join(carried, ["_piece", *key])
    return joined.select(
        *df.columns,
        F.coalesce("_lag", "_before").alias("prev_time"),
        (F.col("_offset") + F.col("_row") - 1).alias("position"),
        "last_position",
    )


def inter_arrival(
    events: DataFrame, key: str, time: str, tie: str
) -> DataFrame:
    """Add ``delta``, the seconds since the key's previous event; 0 for the first."""
    ordered = in_order(events, [key], time, tie)
    micros = F.unix_micros(time) - F.unix_micros("prev_time")
    delta = F.coalesce(micros / F.lit(1000000.0), F.lit(0.0))
    return ordered.select(
        *events.columns, delta.alias("delta"), F.col("prev_time").isNull().alias("is_first")
    )


def trailing_counts(
    events: DataFrame,
    key: str,
    time: str,
    seconds: int,
    bucket_seconds: int = BUCKET_SECONDS,
) -> DataFrame:
    """Events of each key in the trailing ``seconds``, for each second that has one.

    Times are compared in whole seconds, the precision of log times. Events are
    first counted per (key, second); a bucket then holds at most its own seconds
    plus the tail of the bucket before, which is copied into it as history.
    """
    width = max(bucket_seconds, seconds)
    per_second = events.groupBy(key, F.unix_seconds(time).alias("second")).agg(
        F.count("*").alias("_n")
    )
    home = F.floor(F.col("second") / F.lit(width))
    reaches_next = (home + 1) * width - F.col("second") <= seconds
    buckets = F.when(reaches_next, F.array(home, home + 1)).otherwise(F.array(home))
    copies = per_second.withColumn("_home", home).withColumn("_bucket", F.explode(buckets))
    trailing = (
        Window.partitionBy(key, "_bucket").orderBy("second").rangeBetween(-seconds, 0)
    )
    counted = copies.withColumn("recent", F.sum("_n").over(trailing))
    return counted.where(F.col("_bucket") == F.col("_home")).select(key, "second", "recent")
