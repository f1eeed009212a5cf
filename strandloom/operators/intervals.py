"""Interval operators: union of segments, islands, range joins, nearest regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def union(segments: DataFrame, *keys: str) -> DataFrame:
    """Touching or overlapping [left, right) of a key as one: (keys, left, right, n)."""
    order = Window.partitionBy(*keys).orderBy("left", "right")
    reach = segments.withColumn("__reach", F.max("right").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    island = reach.withColumn("__new", F.when(F.col("__reach") >= F.col("left"), 0).otherwise(1))
    numbered = island.withColumn("__id", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "__id").agg(F.min("left").alias("left"), F.max("right").alias("right"), F.count("*").alias("n")).drop("__id")


def islands(rows: DataFrame, key: str, order: str, inside: Column, max_gap: int = 0) -> DataFrame:
    """Runs of rows that satisfy ``inside``; runs less than ``max_gap`` positions apart are one: (key, first, last, n)."""
    by = Window.partitionBy(key).orderBy(order)
    hit = rows.filter(inside).select(key, F.col(order).alias("__at"))
    by = Window.partitionBy(key).orderBy("__at")
    new = hit.withColumn("__new", F.when(F.col("__at") - F.lag("__at").over(by) - 1 <= max_gap, 0).otherwise(1))
    numbered = new.withColumn("__id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "__id").agg(F.min("__at").alias("first"), F.max("__at").alias("last"), F.count("*").alias("n")).drop("__id")


def embed(points: DataFrame, segments: DataFrame, key: str, width: int) -> DataFrame:
    """Points (key, pos, ...) with the segments (key, left, right, ...) that hold them.

    Both sides are dealt to buckets of ``width`` positions, so a key with many points
    is spread and each point meets only the segments near it.
    """
    buckets = F.sequence(F.floor(F.col("left") / width), F.floor((F.col("right") - 1) / width))
    cut = segments.filter(F.col("left") < F.col("right")).withColumn("__bucket", F.explode(buckets))
    dealt = points.withColumn("__bucket", F.floor(F.col("pos") / width))
    return dealt.join(cut, [key, "__bucket"]).filter((F.col("left") <= F.col("pos")) & (F.col("pos") < F.col("right"))).drop("__bucket")


def next_region(points: DataFrame, regions: DataFrame, key: str) -> DataFrame:
    """Points with the first region of their key that starts at or after them: adds next_left (null if none).

    One window over both tables instead of a join of all pairs.
    """
    both = points.select(key, "pos", F.lit(None).cast("long").alias("left"), F.lit(1).alias("__kind")).unionByName(regions.select(key, F.col("left").cast("long").alias("pos"), F.col("left").cast("long").alias("left"), F.lit(2).alias("__kind")))
    ahead = Window.partitionBy(key).orderBy("pos", "__kind").rowsBetween(0, Window.unboundedFollowing)
    return both.withColumn("next_left", F.first("left", ignorenulls=True).over(ahead)).filter("__kind = 1").select(key, "pos", "next_left")
