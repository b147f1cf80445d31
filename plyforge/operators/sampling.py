"""Reproducible orders, splits, assignments and batches.

Order is by MD5 of id and seed, so it is the same on any cluster. A rank over all rows is counted in two
steps, by a hash prefix and within it, so no single task sorts the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def shuffled_rank(rows: DataFrame, id_col: str, seed: int = 0, prefix: int = 2) -> DataFrame:
    """Adds ``place``, the row's 0-based place in the seeded order."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed))).cast("binary"))
    keyed = rows.withColumn("__d", digest).withColumn("__p", F.substring("__d", 1, prefix))
    counts = keyed.groupBy("__p").agg(F.count("*").alias("__n"))  # 16**prefix rows at most
    before = counts.select("__p", F.coalesce(F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    inner = keyed.withColumn("__r", F.row_number().over(W.partitionBy("__p").orderBy("__d", id_col)))
    return inner.join(F.broadcast(before), "__p").withColumn("place", (F.col("__b") + F.col("__r") - 1).cast("long")).drop("__d", "__p", "__r", "__b")


def ranked_in_group(rows: DataFrame, group: str, id_col: str, digest: Column, prefix: int = 2) -> DataFrame:
    """Adds ``place``, the row's 0-based place in its group by digest, counted by a digest's prefix and within it, so that a large group is no single task's."""
    keyed = rows.withColumn("__d", digest).withColumn("__p", F.substring("__d", 1, prefix))
    counts = keyed.groupBy(group, "__p").agg(F.count("*").alias("__n"))
    before = W.partitionBy(group).orderBy("__p").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__b"))
    inner = keyed.withColumn("__r", F.row_number().over(W.partitionBy(group, "__p").orderBy("__d", id_col)))
    out = inner.join(bases, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return out.withColumn("place", (F.col("__b") + F.col("__r") - 1).cast("long")).drop("__d", "__p", "__r", "__b", "__g", "__q")


def exact_split(rows: DataFrame, id_col: str, share: float, seed: int = 0) -> DataFrame:
    """Adds ``is_eval``, true for exactly int(rows * share) rows."""
    n = int(rows.count() * share)
    return shuffled_rank(rows, id_col, seed).withColumn("is_eval", F.col("place") < n).drop("place")


def balanced_choice(rows: DataFrame, id_col: str, choices: list[int], seed: int = 0, name: str = "top_n") -> DataFrame:
    """Adds one of the choices, each on as many rows as the others or one more."""
    pick = F.element_at(F.array(*map(F.lit, choices)), (F.col("place") % len(choices) + 1).cast("int"))
    return shuffled_rank(rows, id_col, seed).withColumn(name, pick).drop("place")


def batches(rows: DataFrame, group: str, id_col: str, size: int, drop_last: bool = False) -> DataFrame:
    """Adds ``batch`` and ``place`` within each group."""
    out = ranked_in_group(rows, group, id_col, F.md5(F.col(id_col).cast("string").cast("binary"))).withColumnRenamed("place", "__r")
    out = out.withColumn("batch", F.floor(F.col("__r") / size)).withColumn("place", F.col("__r") % size).drop("__r")
    return out.withColumn("__n", F.count("*").over(W.partitionBy(group, "batch"))).where(F.col("__n") == size).drop("__n") if drop_last else out


def batch_counts(rows: DataFrame, group: str, size: int) -> DataFrame:
    """group, rows, batches, full_batches."""
    return rows.groupBy(group).agg(F.count("*").alias("n_rows")).select(group, "n_rows", F.ceil(F.col("n_rows") / size).alias("batches"), F.floor(F.col("n_rows") / size).alias("full_batches"))


def first_per_group(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    return rows.withColumn("__r", F.row_number().over(W.partitionBy(group).orderBy(order))).where(F.col("__r") <= k).drop("__r")


def file_index(rows: DataFrame, file_col: str) -> DataFrame:
    """file, n_rows and start_row (rows of earlier files); a row for each file."""
    counts = rows.groupBy(file_col).agg(F.count("*").alias("n_rows"))
    before = W.orderBy(file_col).rowsBetween(W.unboundedPreceding, -1)
    return counts.withColumn("start_row", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))


def first_rows(rows: DataFrame, file_col: str, order: str, n: int) -> DataFrame:
    """The first n rows of all, by file and then by order within it; files that begin beyond n are not sorted, and of the others only what can be among the n."""
    needed = file_index(rows, file_col).where(F.col("start_row") < n).select(F.col(file_col).alias("__f"), (n - F.col("start_row")).alias("__most"))
    some = rows.join(needed, F.col(file_col).eqNullSafe(F.col("__f")))
    ranked = some.withColumn("__r", F.row_number().over(W.partitionBy(file_col).orderBy(order))).where(F.col("__r") <= n)
    return ranked.where(F.col("__r") <= F.col("__most")).drop("__r", "__f", "__most")


def located(rows: DataFrame, file_col: str, order: str) -> DataFrame:
    """Adds ``local``, a row's 0-based place in its file, and ``place``, that in all files."""
    inner = rows.withColumn("local", (F.row_number().over(W.partitionBy(file_col).orderBy(order)) - 1).cast("long"))
    return inner.join(file_index(rows, file_col).select(file_col, "start_row"), file_col).withColumn("place", F.col("start_row") + F.col("local")).drop("start_row")


def file_of_place(places: DataFrame, index: DataFrame, place: str, file_col: str, block: int = 1 << 16) -> DataFrame:
    """Adds the file and ``local`` place of each global place, from ``file_index`` rows; places beyond the last row go.

    Files are cut into blocks of places, so the range is found by an equal key and nothing is broadcast by hint.
    """
    last = F.col("start_row") + F.col("n_rows") - 1
    blocks = index.where("n_rows > 0").select(file_col, "start_row", last.alias("__last"), F.explode(F.sequence(F.floor(F.col("start_row") / block), F.floor(last / block))).alias("__block"))
    found = places.withColumn("__block", F.floor(F.col(place) / block)).join(blocks, "__block").where(F.col(place).between(F.col("start_row"), F.col("__last")))
    return found.withColumn("local", F.col(place) - F.col("start_row")).drop("__block", "__last", "start_row")


def stride(rows: DataFrame, id_col: str, workers: int, seed: int = 0) -> DataFrame:
    """Adds ``worker``: rows dealt in turn in the seeded order, so that counts differ by one at most."""
    return shuffled_rank(rows, id_col, seed).withColumn("worker", (F.col("place") % workers).cast("int")).drop("place")
