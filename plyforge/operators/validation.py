"""Completeness of groups against what they should hold, and run statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalars import percent


def difference(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Distinct rows of the left that the right lacks."""
    return left.select(*on).distinct().join(right.select(*on).distinct(), on, "left_anti")


def completeness(data: DataFrame, expected: DataFrame, key: str, item: str) -> DataFrame:
    """key, n_missing, n_extra and is_complete over the keys of both."""
    on = [key, item]
    both = data.select(*on).distinct().withColumn("d", F.lit(1)).join(expected.select(*on).distinct().withColumn("e", F.lit(1)), on, "full")
    out = both.groupBy(key).agg(F.count_if(F.col("d").isNull()).alias("n_missing"), F.count_if(F.col("e").isNull()).alias("n_extra"))
    return out.withColumn("is_complete", (F.col("n_missing") == 0) & (F.col("n_extra") == 0))


def bucket_statistics(groups: DataFrame, bucket: str, file: str, items: str, flags: list[str]) -> DataFrame:
    """For each bucket: files, keys, items, and how many keys have each flag. groups: a row for each key, flags as columns."""
    return groups.groupBy(bucket).agg(F.countDistinct(file).alias("files"), F.count("*").alias("n_keys"), F.sum(items).alias("n_items"), *(F.count_if(F.col(f)).alias(f"n_{f}") for f in flags))


def bucket_totals(buckets: DataFrame, flags: list[str]) -> DataFrame:
    """One row over bucket_statistics: buckets that hold keys, sums, and percentages of the keys."""
    one = buckets.agg(F.count_if(F.col("n_keys") > 0).alias("buckets"), F.sum("files").alias("files"), F.sum("n_keys").alias("n_keys"), F.sum("n_items").alias("n_items"), *(F.sum(f"n_{f}").alias(f"n_{f}") for f in flags))
    return one.select("*", *(percent(F.col(f"n_{f}"), F.col("n_keys")).alias(f"percent_{f}") for f in flags))


def totals(groups: DataFrame, flags: list[str]) -> DataFrame:
    """One row: groups, and for each flag how many have it and which percentage."""
    one = groups.agg(F.count("*").alias("groups"), *(F.count_if(f).alias(f"n_{f}") for f in flags))
    return one.select("*", *(percent(F.col(f"n_{f}"), F.col("groups")).alias(f"percent_{f}") for f in flags))
