"""Vocabulary tables, texts as token ids, and vectors for new tokens."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Markers of a formatted example, and list lengths that can be asked for.
MARKERS = ("<|chess|>", "%prev_FEN", "%FEN", "%best_action")
LENGTHS = (3, 5, 10, 20, 30)


def extended(spark: SparkSession, moves: DataFrame, first_id: int, buckets: int = 64) -> DataFrame:
    """token, kind and id: markers, lengths, value buckets and the (idx, move) rows' moves, numbered from first_id without gaps where idx has none."""
    fixed = [(t, "marker") for t in MARKERS] + [(f"%top_{n}", "marker") for n in LENGTHS] + [(f"<val_{b}>", "value") for b in range(buckets)]
    head = spark.createDataFrame([(t, kind, first_id + i) for i, (t, kind) in enumerate(fixed)], "token string, kind string, id long")
    tail = moves.select(F.col("move").alias("token"), F.lit("move").alias("kind"), (F.col("idx") + F.lit(first_id + len(fixed))).cast("long").alias("id"))
    return head.unionByName(tail)


def token_ids(rows: DataFrame, id_col: str, text_col: str, vocabulary: DataFrame, unknown: int = -1) -> DataFrame:
    """id and ids: the (token, id) vocabulary's ids of a text's words, in order. Null and empty texts have none; rows must have distinct ids."""
    words = F.filter(F.split(F.coalesce(text_col, F.lit("")), r"\s+"), lambda w: w != "")
    placed = rows.select(F.col(id_col), F.posexplode_outer(words).alias("place", "token"))
    found = placed.join(vocabulary.select("token", F.col("id").alias("__id")), "token", "left")
    entry = F.when(F.col("place").isNotNull(), F.struct("place", F.coalesce("__id", F.lit(unknown)).cast("long").alias("id")))
    return found.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["id"]).alias("ids"))


def move_names(spark: SparkSession) -> DataFrame:
    """from_square, to_square, kind and promotion of every move that some piece can make on an empty board, by the geometry of the board."""
    s, t = F.shiftright("id", 6), F.col("id").bitwiseAND(63)
    squares = spark.range(4096).select(s.alias("s"), t.alias("t"), F.abs(s % 8 - t % 8).alias("dx"), F.abs(F.floor(s / 8) - F.floor(t / 8)).alias("dy"), F.floor(s / 8).alias("from_rank"), F.floor(t / 8).alias("to_rank"))
    line = (F.col("s") != F.col("t")) & ((F.col("dx") == 0) | (F.col("dy") == 0) | (F.col("dx") == F.col("dy")))
    kind = F.when(line, "line").when(F.col("dx") * F.col("dy") == 2, "leap")
    plain = squares.select("s", "t", kind.alias("kind"), F.lit("").alias("promotion")).where("kind is not null")
    last = ((F.col("from_rank") == 6) & (F.col("to_rank") == 7)) | ((F.col("from_rank") == 1) & (F.col("to_rank") == 0))
    raised = squares.where(last & (F.col("dx") <= 1)).select("s", "t", F.lit("promotion").alias("kind"), F.explode(F.array(*map(F.lit, "qrbn"))).alias("promotion"))

    def named(c: str) -> Column:
        return F.concat(F.substring(F.lit("abcdefgh"), (F.col(c) % 8 + 1).cast("int"), F.lit(1)), (F.floor(F.col(c) / 8) + 1).cast("string"))

    return plain.unionByName(raised).select(F.concat(named("s"), named("t"), "promotion").alias("move"), "kind")


def new_vectors(tokens: DataFrame, id_col: str, stats: DataFrame, seed: int = 0) -> DataFrame:
    """id and vector: normal values about each dimension's mean with its deviation, from (dim, mean, std) rows.

    They follow from id, dimension and seed alone, so a lost task gives the same ones again. A null deviation counts as 0.
    """
    shape = stats.agg(F.sort_array(F.collect_list(F.struct("dim", "mean", F.coalesce("std", F.lit(0.0)).alias("std")))).alias("__shape"))  # one row for each dimension

    def uniform(d: Column, part: int) -> Column:
        return (F.shiftrightunsigned(F.xxhash64(F.col(id_col), d, F.lit(seed), F.lit(part)), 11) + 0.5) * 2.0**-53

    def value(e: Column) -> Column:
        normal = F.sqrt(-2.0 * F.log(uniform(e["dim"], 0))) * F.cos(2 * math.pi * uniform(e["dim"], 1))
        return e["mean"] + e["std"] * normal

    one = tokens.select(id_col).withColumn("__one", F.lit(1)).join(F.broadcast(shape.withColumn("__one", F.lit(1))), "__one")  # one row is broadcast
    return one.select(id_col, F.transform("__shape", value).alias("vector"))
