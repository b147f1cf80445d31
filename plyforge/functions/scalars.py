"""Scalar column functions on positions, moves and values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf


def hash_bucket(key: Column, buckets: int) -> Column:
    """The first eight hex digits of the key's MD5, modulo the number of buckets."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets).cast("int")


def value_bucket(p: Column, buckets: int = 64) -> Column:
    """A probability clamped to [0, 1] in evenly spaced buckets, rounded half up; NaN is the last, null stays null."""
    inside = F.greatest(F.lit(0.0), F.least(F.lit(1.0), p.cast("double")))
    return F.when(p.isNotNull(), F.least(F.floor(inside * (buckets - 1) + 0.5), F.lit(buckets - 1)).cast("int"))


def value_token(bucket: Column) -> Column:
    return F.concat(F.lit("<val_"), bucket.cast("string"), F.lit(">"))


def _left_filled(text: Column, width: int) -> Column:
    # lpad alone would cut longer texts
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), ".")


def fixed_fen(fen: Column) -> Column:
    """A position of six fields as 81 characters or more: squares written out, fields filled with dots."""
    part = F.split(F.trim(fen), r"\s+")
    board = F.translate(part[0], "/", "")
    for n in range(1, 9):
        board = F.replace(board, F.lit(str(n)), F.lit("." * n))
    castling = F.rpad(F.when(part[2] == "-", "").otherwise(part[2]), 4, ".")
    passing = F.when(part[3] == "-", "-.").otherwise(part[3])
    return F.concat_ws(" ", board, part[1], castling, passing, _left_filled(part[4], 2), _left_filled(part[5], 3))


def rounded(p: Column, digits: int) -> Column:
    """Rounded on the exact binary value (half to even only at true ties), which Spark's round, on decimal text, isn't. NaN gives null."""

    @pandas_udf("double")
    def exact(values: pd.Series) -> pd.Series:
        return values.map(lambda v: round(v, digits) if v - v == 0 else v, na_action="ignore")

    return exact(p)


def shown(text: Column, n: int) -> Column:
    """The first n characters."""
    return F.substring(text, 1, n)


def null_if_empty(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def percent(part: Column, total: Column) -> Column:
    """100 * part / total, 0 where the total is 0."""
    return F.coalesce(F.try_divide(part * 100.0, total), F.lit(0.0))


def file_number(n: Column) -> Column:
    """At least five digits."""
    return F.format_string("%05d", n)


def unwrapped_move(best: Column) -> Column:
    """A move given as text, or as the text of a list whose first item is the move."""
    return F.when(best.startswith("["), F.coalesce(F.get_json_object(best, "$[0]"), best)).otherwise(best)
