"""Grouped records: duplicates, ranks, top items and per-key summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def best_per_item(rows: DataFrame, key: str, item: str, score: str) -> DataFrame:
    """One row for each key and item, with its largest score; combined before the shuffle."""
    return rows.groupBy(key, item).agg(F.max(score).alias(score))


def ranked(rows: DataFrame, key: str, item: str, score: str, at_most: int | None = None) -> DataFrame:
    """Ranks within a key by falling score, ties by item. A limit is applied group by group before the sort's output."""
    order = W.partitionBy(key).orderBy(F.desc(score), item)
    out = rows.withColumn("rank", F.row_number().over(order))
    return out if at_most is None else out.where(F.col("rank") <= at_most)


def summary(rows: DataFrame, key: str, item: str, score: str, k: int = 5) -> DataFrame:
    """key, n_items, best and top (array of item and score), of which only k items a key are ever collected."""
    # duplicates go before the shuffle by key, which then serves ranks, counts and lists
    best = best_per_item(rows, key, item, score)
    placed = best.withColumns({"rank": F.row_number().over(W.partitionBy(key).orderBy(F.desc(score), item)), "n_items": F.count("*").over(W.partitionBy(key))})
    listed = placed.where(F.col("rank") <= k).groupBy(key).agg(F.first("n_items").alias("n_items"), F.sort_array(F.collect_list(F.struct("rank", item, score))).alias("top"))
    return listed.select(key, "n_items", F.get("top", F.lit(0))[item].alias("best"), "top")


def rank_of(top: Column, item: Column, field: str) -> Column:
    """1-based place of an item in a ranked list, null if it isn't there."""
    return F.nullif(F.array_position(F.transform(top, lambda m: m[field]), item), F.lit(0).cast("bigint"))


def value_flags(top: Column, score: str, k: int, high: float, low: float) -> tuple[Column, Column]:
    """Whether a key has k top scores that all lie above ``high`` (no real order among them), or below ``low``."""
    full = F.size(top) >= k
    return full & F.forall(top, lambda m: m[score] > high), full & F.forall(top, lambda m: m[score] < low)
