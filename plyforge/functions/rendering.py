"""Prompt and answer texts of a position."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalars import fixed_fen, value_bucket, value_token


# The marks and labels of the texts below, which other tools read.


def prompt(fen: Column, top_n: Column, with_next: bool = True) -> Column:
    """What is asked for; the position after the move only with_next."""
    asked = " %best_action %FEN" if with_next else " %best_action"
    return F.concat(F.lit("<|chess|> %prev_FEN %top_"), top_n.cast("string"), F.lit(f"{asked}\n[%prev_FEN "), fixed_fen(fen), F.lit("]"))


def answer(moves: Column, top_n: Column, next_fen: Column, seed: int | None = None, listed: Column | None = None) -> Column:
    """moves: ranked array<struct<move,win_prob>>. The listed moves are shuffled where a seed is given, or given as they are to stand."""
    first = F.slice(moves, 1, top_n)
    if listed is None:
        listed = first if seed is None else F.shuffle(first, seed)
    pairs = F.array_join(F.transform(listed, lambda m: F.concat(m["move"], F.lit(":"), value_token(value_bucket(m["win_prob"])))), " ")
    head = F.concat(F.lit("\n[%top_"), top_n.cast("string"), F.lit(" "), pairs, F.lit("]\n[%best_action "), F.get(moves, F.lit(0))["move"], F.lit("]"))
    return F.concat(head, F.when(F.length(next_fen) > 0, F.concat(F.lit("\n[%FEN "), fixed_fen(next_fen), F.lit("]"))).otherwise(""))


def jsonl(columns: list[str]) -> Column:
    """A JSON object that keeps keys with null values."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def text_block(fen: Column, n_moves: Column, top: Column, all_moves: Column, best: Column, next_fen: Column, complete: Column, missing: Column, extra: Column) -> Column:
    """Labelled lines that end with a rule; missing and extra only where there are any."""
    def listed(moves: Column) -> Column:
        return F.array_join(F.transform(moves, lambda m: F.format_string("%s:%.3f", m["move"], m["win_prob"])), " ")

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value)

    return F.concat_ws(
        "\n", line("FEN", fen), line("LEGAL_MOVES", n_moves.cast("string")), line("TOP5", listed(top)), line("ALL_MOVES", listed(all_moves)), line("BEST", F.coalesce(best, F.lit(""))), line("NEXT_FEN", F.coalesce(next_fen, F.lit(""))), line("COMPLETE", complete.cast("string")),
        F.when(F.size(missing) > 0, line("MISSING", F.array_join(missing, " "))), F.when(F.size(extra) > 0, line("EXTRA", F.array_join(extra, " "))), F.lit("---"),
    )
