"""Position records: ranked moves against the legal ones, the chosen move and the position after it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.moves import legal_moves, play
from .ranking import best_per_item

#: Called once in each task; gives a function from a position to a move (or None), and one that ends the engine.
Engine = Callable[[], tuple[Callable[[str], str | None], Callable[[], None]]]


def with_engine(rows: DataFrame, fen: str, engine: Engine | None, name: str = "engine_move") -> DataFrame:
    """Adds an engine's move, null where it fails or there is no engine. One engine a task; tasks are the pool."""
    if engine is None:
        return rows.withColumn(name, F.lit(None).cast("string"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        choose, end = engine()

        def chosen(position: str) -> str | None:
            try:
                return choose(position)
            except Exception:  # whatever an engine raises, the ranked move stands in
                return None

        try:
            for batch in batches:
                yield batch.assign(**{name: batch[fen].map(chosen, na_action="ignore").astype(object)})
        finally:
            end()

    return rows.mapInPandas(run, StructType([*rows.schema.fields, StructField(name, StringType())]))


def records(rows: DataFrame, fen: str = "fen", move: str = "move", score: str = "win_prob", engine: Engine | None = None, high: float = 0.99, low: float = 0.01, digits: int = 4) -> DataFrame:
    """A record for each position of (position, move, score) rows.

    fen, is_complete, num_moves, moves (by falling score, ties by name), top5, best_action (the engine's, else the
    first), next_fen, needs_tiebreak, is_losing, engine_agrees and engine_rank (null without an engine's move), missing and extra
    (sorted, null where empty). A position has at most a few hundred moves, so its list is bounded. Rows with a
    null position or move are left out; a malformed position has no legal moves, so all its moves are extra, and next_fen is empty.
    """
    best = best_per_item(rows.where(F.col(fen).isNotNull() & F.col(move).isNotNull()), fen, move, score)
    # negated, so that one ascending sort ranks by score and then by name; scores that are null come last
    entry = F.struct((-F.coalesce(F.col(score), F.lit(float("-inf")))).alias("down"), F.col(move).alias("move"), F.col(score).alias("exact"))
    grouped = best.groupBy(F.col(fen).alias("fen")).agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    grouped = with_engine(grouped.withColumn("legal", F.coalesce(legal_moves("fen"), F.array().cast("array<string>"))), "fen", engine)
    names, top = F.transform("entries", lambda m: m["move"]), F.slice("entries", 1, 5)
    facts = grouped.select(
        "fen",
        F.transform("entries", lambda m: F.struct(m["move"].alias("move"), F.round(m["exact"], digits).alias("win_prob"))).alias("moves"),
        F.coalesce("engine_move", F.get(names, F.lit(0))).alias("best_action"),
        ((F.size(top) >= 5) & F.forall(top, lambda m: m["exact"] > high)).alias("needs_tiebreak"),
        ((F.size(top) >= 5) & F.forall(top, lambda m: m["exact"] < low)).alias("is_losing"),
        (F.coalesce(F.col("engine_move") == F.get(names, F.lit(0)), F.lit(False))).alias("engine_agrees"),
        F.nullif(F.array_position(names, F.col("engine_move")), F.lit(0).cast("bigint")).cast("int").alias("engine_rank"),
        F.sort_array(F.array_except("legal", names)).alias("missing"),
        F.sort_array(F.array_except(names, "legal")).alias("extra"),
    )
    complete = (F.size("missing") == 0) & (F.size("extra") == 0)
    return facts.select(
        "fen", complete.alias("is_complete"), F.size("moves").alias("num_moves"), "moves", F.slice("moves", 1, 5).alias("top5"), "best_action",
        F.coalesce(play("fen", "best_action"), F.lit("")).alias("next_fen"), "needs_tiebreak", "is_losing", "engine_agrees", "engine_rank",
        F.when(F.size("missing") > 0, F.col("missing")).alias("missing"), F.when(F.size("extra") > 0, F.col("extra")).alias("extra"),
    )
