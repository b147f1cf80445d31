"""Minimax contiguous partition of documents into shards, with copies kept together.

Rows with equal texts are one group and never split. Groups are put in the order of their texts' MD5
and gathered into at most 2**block_bits consecutive atoms, whose sizes one partial aggregation gives.
The driver holds these at most 65,536 numbers, binary-searches the smallest capacity for which a greedy
pass needs no more than the given number of shards, and cuts there (a cut is moved back towards an even
share only where the rest still fits the capacity). Shards then are a few comparisons on the atom's
number. Positions within a shard come from per-atom counts and ranks, so no task holds a whole shard;
atoms with many rows, such as a large group of copies, are dealt by id over ``salts`` ranks.

DataFrame operations only. A null text has no bytes and goes with empty ones; repeated rows are copies.
Empty input gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from .shared import Scratch


def greedy_cuts(cumulative: np.ndarray, capacity: int, shards: int) -> list[int] | None:
    """End positions of the shards that a greedy pass fills up to a capacity, or None if there are too few."""
    cuts, base, n = [], 0, len(cumulative)
    for _ in range(shards):
        end = int(np.searchsorted(cumulative, base + capacity, "right"))
        cuts.append(end)
        if end == n:
            return cuts
        if end == (cuts[-2] if len(cuts) > 1 else 0):
            return None
        base = int(cumulative[end - 1])
    return None


def smallest_capacity(sizes: np.ndarray, shards: int) -> int:
    """The smallest capacity at which contiguous shards of whole atoms suffice."""
    if not len(sizes):
        return 0
    cumulative = np.cumsum(sizes)
    low, high = max(int(sizes.max()), -(-int(cumulative[-1]) // shards)), int(cumulative[-1])
    while low < high:
        middle = (low + high) // 2
        if greedy_cuts(cumulative, middle, shards) is None:
            low = middle + 1
        else:
            high = middle
    return low


def minimax_cuts(sizes: np.ndarray, shards: int) -> tuple[int, list[int]]:
    """The smallest capacity, and each shard's end position; shards are as even as that capacity allows."""
    capacity, n = smallest_capacity(sizes, shards), len(sizes)
    cumulative = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    cuts, at = [], 0
    for left in range(shards, 0, -1):
        base = cumulative[at]
        most = int(np.searchsorted(cumulative, base + capacity, "right")) - 1
        if left == 1:
            end = n
        else:
            even = base + (cumulative[n] - base) / left
            end = int(np.searchsorted(cumulative, even))
            if end > at and end <= n and even - cumulative[end - 1] < cumulative[min(end, n)] - even:
                end -= 1
            end = min(max(end, at), most, n)
            while end < most and greedy_cuts(cumulative[end + 1 :] - cumulative[end], capacity, left - 1) is None and end < n:
                end += 1
        cuts.append(end)
        at = end
    return capacity, cuts


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", block_bits: int = 16, salts: int = 64) -> DataFrame:
    """id, size, text_crc32, shard, slot and block of every row; ``size`` is the text's UTF-8 bytes plus 8."""
    spark, text = docs.sparkSession, F.coalesce(F.col(text_col), F.lit(""))
    scratch = Scratch(spark, "shard")
    digest = F.md5(text.cast("binary"))
    block = F.shiftright(F.conv(F.substring(digest, 1, 4), 16, 10).cast("int"), 16 - block_bits)
    rows = scratch.save(docs.select(F.col(id_col), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), block.alias("block"), F.substring(digest, 5, 12).alias("within")), "rows")
    table = rows.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n")).orderBy("block").collect()  # 2**block_bits rows at most
    _, cuts = minimax_cuts(np.array([r["size"] for r in table], np.int64), shards)
    ends = [table[c]["block"] if c < len(table) else 1 << block_bits for c in cuts[:-1]]
    number = sum(((F.col("block") >= e).cast("int") for e in ends), F.lit(0))
    usual = sum(r["n"] for r in table) / max(1, len(table))
    hot = [r["block"] for r in table if r["n"] > max(4 * usual, 1024)]  # a quarter of the atoms at most
    salt = F.when(F.col("block").isin(hot), F.pmod(F.xxhash64(id_col), F.lit(salts))).otherwise(F.lit(0).cast("long")) if hot else F.lit(0).cast("long")
    placed = rows.select("*", number.alias("shard"), salt.alias("salt"))
    unit = ["shard", "block", "salt"]
    before = W.partitionBy("shard").orderBy("block", "salt").rowsBetween(W.unboundedPreceding, -1)
    bases = placed.groupBy(*unit).agg(F.count("*").alias("n")).select(*unit, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = placed.withColumn("rank", F.row_number().over(W.partitionBy(*unit).orderBy("within", F.col(id_col), "text_crc32")))
    return ranked.join(bases, unit).select(id_col, "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"), "block")
