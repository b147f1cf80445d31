"""Token sequences with labels and masks, and their padding to rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

IGNORED = -100


def joined_sequence(prompt: Column, answer: Column, most: int) -> tuple[Column, Column, Column]:
    """input_ids, attention_mask and labels; prompt tokens are ignored, all cut to ``most``."""
    ids = F.slice(F.concat(prompt, answer), 1, most)
    labels = F.slice(F.concat(F.array_repeat(F.lit(IGNORED).cast("bigint"), F.size(prompt)), answer), 1, most)
    return ids, F.transform(ids, lambda _: F.lit(1).cast("bigint")), labels


def range_mask(ids: Column, start: int, end: int) -> Column:
    return F.transform(ids, lambda x: (x >= start) & (x < end))


def padded(rows: DataFrame, batch: str, fills: dict[str, Column]) -> DataFrame:
    """Array columns filled on the right to the longest first column of the batch."""
    longest = F.max(F.size(next(iter(fills)))).over(W.partitionBy(batch))
    out = rows.withColumn("__most", longest)
    return out.withColumns({c: F.concat(c, F.array_repeat(v, F.col("__most") - F.size(c))) for c, v in fills.items()}).drop("__most")


def length_stats(rows: DataFrame, ids: str) -> DataFrame:
    n = F.size(ids)
    return rows.agg(F.min(n).alias("shortest"), F.max(n).alias("longest"), F.round(F.avg(n), 1).alias("mean_length"))


def next_token(rows: DataFrame, sequence: str, position: str, label: str) -> DataFrame:
    """Adds the label of the next position, and leaves out the last."""
    order = W.partitionBy(sequence).orderBy(position)
    return rows.withColumn("target", F.lead(label).over(order)).where("target is not null")
