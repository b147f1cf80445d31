"""Training examples: choices of list lengths, texts, token rows with masks, shuffled batches and their statistics.

Choices and orders follow from MD5 of id and seed, so they are the same on any cluster and whenever a lost task runs again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.rendering import answer, prompt
from ..functions.scalars import percent
from .sampling import ranked_in_group, shuffled_rank
from .sequences import IGNORED, joined_sequence, range_mask


def digest(*parts: Column | int | str) -> Column:
    """MD5 of the parts, joined by colons."""
    return F.md5(F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts)).cast("binary"))


def chosen(row: Column, choices: list[int], seed: int = 0) -> Column:
    """One of the choices for each row, independently and with even odds."""
    number = F.conv(F.substring(digest(row, seed), 1, 8), 16, 10).cast("bigint")
    return F.element_at(F.array(*map(F.lit, choices)), (number % len(choices) + 1).cast("int"))


def shuffled_moves(moves: Column, top_n: Column, row: Column, seed: int = 0) -> Column:
    """The first top_n of ranked array<struct<move,...>>, in a seeded order of their own for each row."""
    keyed = F.transform(F.slice(moves, 1, top_n), lambda m: F.struct(digest(row, m["move"], seed).alias("d"), m.alias("m")))
    return F.transform(F.array_sort(keyed), lambda e: e["m"])


def texts(rows: DataFrame, row: str, fen: str, moves: str, top_n: str, next_fen: str, seed: int | None = 0, with_next: bool = True) -> DataFrame:
    """Adds prompt and answer of a position. The best move is the first as stored; rows without moves are left out, as they have none."""
    listed = F.slice(moves, 1, F.col(top_n)) if seed is None else shuffled_moves(F.col(moves), F.col(top_n), F.col(row), seed)
    out = rows.where(F.size(moves) > 0)
    return out.withColumns({"prompt": prompt(F.col(fen), F.col(top_n), with_next), "answer": answer(F.col(moves), F.col(top_n), F.col(next_fen) if with_next else F.lit(None).cast("string"), listed=listed)})


def token_rows(rows: DataFrame, prompt_ids: str, answer_ids: str, most: int, value_start: int, value_end: int) -> DataFrame:
    """Adds input_ids, attention_mask, labels and value_token_mask, all of one length."""
    ids, mask, labels = joined_sequence(F.col(prompt_ids), F.col(answer_ids), most)
    return rows.withColumns({"input_ids": ids, "attention_mask": mask, "labels": labels}).withColumn("value_token_mask", range_mask(F.col("input_ids"), value_start, value_end))


def batch_statistics(rows: DataFrame, batch: str) -> DataFrame:
    """batch, masked, trained and their percentages over padded cells, and value_tokens; combined before the shuffle.

    rows: labels and value_token_mask before padding. Each row is padded to its batch's longest, with ignored labels.
    """
    n = F.size("labels")
    some = rows.groupBy(batch).agg(F.count("*").alias("n"), F.max(n).alias("longest"), F.sum(F.size(F.filter("labels", lambda x: x != IGNORED))).alias("trained"), F.sum(F.size(F.filter("value_token_mask", lambda x: x))).alias("value_tokens"))
    cells = F.col("n") * F.col("longest")
    masked = cells - F.col("trained")
    return some.select(batch, masked.alias("masked"), "trained", percent(masked, cells).alias("percent_masked"), percent(F.col("trained"), cells).alias("percent_trained"), "value_tokens")


def shuffled_batches(rows: DataFrame, group: str, id_col: str, size: int, seed: int = 0, epoch: int = 0, drop_last: bool = False) -> DataFrame:
    """id, group, batch (0-based place of the row's batch among all) and place in it: rows shuffled within groups, then all batches; other orders in each epoch."""
    tag = f"{seed}.{epoch}"
    dealt = ranked_in_group(rows.select(id_col, group), group, id_col, digest(F.col(id_col), tag))
    dealt = dealt.select(id_col, group, F.floor(F.col("place") / size).alias("__batch"), (F.col("place") % size).alias("place"))
    batches = dealt.groupBy(group, "__batch").agg(F.count("*").alias("__n"))
    if drop_last:
        batches = batches.where(F.col("__n") == size)
    named = batches.select(group, "__batch", F.concat_ws(":", F.col(group).cast("string"), F.col("__batch").cast("string"), F.lit(tag)).alias("__name"))
    order = shuffled_rank(named, "__name", seed).select(F.col(group).alias("__g"), F.col("__batch").alias("__c"), F.col("place").alias("batch"))
    return dealt.join(order, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__batch") == F.col("__c"))).select(id_col, group, "batch", "place")


def first_groups(rows: DataFrame, key: str, k: int) -> DataFrame:
    """The rows of the k smallest keys; of the keys only k come out of each task."""
    keys = rows.select(F.col(key).alias("__k")).where("__k is not null").distinct().orderBy("__k").limit(k)
    return rows.join(keys, F.col(key) == F.col("__k"), "left_semi")


def planned_steps(samples: Column, batch: int, accumulation: int, epochs: int) -> Column:
    """Optimiser steps of a run over that many samples."""
    return F.floor(samples / (batch * accumulation)).cast("bigint") * epochs


def pad_id(given: Column | None) -> Column:
    """The padding id, 0 where there is none."""
    return F.lit(0).cast("bigint") if given is None else F.coalesce(given.cast("bigint"), F.lit(0).cast("bigint"))
