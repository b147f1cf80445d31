"""Nearest neighbours by collision counting over single-projection sorted arrays.

Each block of vectors (rows dealt by id, so of about ``block_rows``) holds one sorted array for each of
``m`` Gaussian projections. Around a query's projections, windows grow by virtual rehashing: their half
width is proportional to a radius that rises geometrically, and each step reads only what the windows
newly cover. A vector found in enough windows is verified by its exact distance. A block is done for a
query once the k-th verified distance is within the radius, or all its vectors are verified; there is no
cap on candidates, so copies in any number are all verified and ties go to the smaller id. The blocks'
best k are merged by a partial top-k. Radii grow in small steps, as windows that overshoot the k-th distance verify most of a block.

Every row is indexed. Queries are sent in chunks of at most ``chunk`` vectors, whose size is thus
bounded; more queries make more chunks. Recall is below 1 only where a true neighbour collides in fewer
windows than expected (see the README for the measured figure).

Vectors that are null, zero, hold null or non-finite components, or differ in length from the most
common length take no part, nor do rows without id. Every row is told apart, so a row that repeats another's id or
vector is a candidate for it, and a query of its own; equal distances are ranked by id. No queries or no rows give no
result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .arrays import ragged
from .shared import Scratch

RESULT = "query_key long, query_id long, vec_id long, score double"


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, v) rows that take part, and their length (0: none)."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(
        F.col("id").isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return (rows.where(F.size("v") == usual["d"]), usual["d"]) if usual else (rows, 0)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, d)


class Block:
    """Sorted projections of some vectors."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, x: np.ndarray, m: int, seed: int) -> None:
        self.keys, self.ids, self.x, self.m, self.verified = keys, ids, x, m, 0
        self.a = np.random.default_rng(seed).standard_normal((x.shape[1], m))
        p = x @ self.a
        self.order = np.argsort(p, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(p, axis=0).T.copy()

    def radii(self, growth: float) -> np.ndarray:
        """From well below usual distances to one whose windows cover everything."""
        spread = float(np.median(self.sorted[:, -1] - self.sorted[:, 0])) or 1.0
        return spread * growth ** np.arange(np.floor(np.log(0.018) / np.log(growth)), np.ceil(np.log(3) / np.log(growth)) + 1)

    def search(self, query_keys: np.ndarray, queries: np.ndarray, k: int, width: float, share: float, growth: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, need = len(self.ids), int(np.ceil(share * self.m))
        steps, p = self.radii(growth), queries @ self.a
        half = steps * width / 2
        flat, base = self.order.ravel(), np.arange(self.m) * n
        low = np.empty((len(steps), self.m, len(p)), np.int64)
        high = np.empty_like(low)
        for j in range(self.m):
            low[:, j] = np.searchsorted(self.sorted[j], p[:, j] - half[:, None])
            high[:, j] = np.searchsorted(self.sorted[j], p[:, j] + half[:, None], "right")
        # windows that hold fewer entries than a collision needs are passed over
        start = np.minimum(((high - low).sum(1) >= need).argmax(0), len(steps) - 1)
        for i in range(len(p)):
            counts, distance = np.zeros(n, np.int32), np.full(n, np.nan)
            a = b = None
            for s in range(int(start[i]), len(steps)):
                new_a, new_b = low[s, :, i], high[s, :, i]
                if s == len(steps) - 1:
                    new_a, new_b = np.zeros(self.m, np.int64), np.full(self.m, n)
                if a is None:
                    at = ragged(base + new_a, new_b - new_a)
                else:
                    at = np.concatenate((ragged(base + new_a, a - new_a), ragged(base + b, new_b - b)))
                a, b = new_a, new_b
                if len(at):
                    counts += np.bincount(flat[at], minlength=n).astype(np.int32)
                    fresh = np.flatnonzero((counts >= need) & np.isnan(distance))
                    d = self.x[fresh] - queries[i]
                    self.verified += len(fresh)
                    distance[fresh] = np.where(self.keys[fresh] == query_keys[i], np.inf, np.sqrt(np.einsum("ij,ij->i", d, d)))
                known = np.flatnonzero(distance < np.inf)
                if len(known) >= k and np.partition(distance[known], k - 1)[k - 1] <= steps[s]:
                    break
            known = np.flatnonzero(distance < np.inf)
            best = known[np.lexsort((self.ids[known], distance[known]))][:k]
            yield self.ids[best], distance[best]


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, m: int = 96, width: float = 2.55, share: float = 0.75, growth: float = 1.06, block_rows: int = 16384, chunk: int = 16384, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found; is_query: a condition on the id column, named ``id``."""
    rows, d = usable(vectors, id_col, vector_col)
    if not d:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # written once, so that the keys stay what they are
    rows = Scratch(vectors.sparkSession, "ann").save(rows.select("id", "v", F.monotonically_increasing_id().alias("key")), "rows")
    n_rows, n_queries = rows.agg(F.count("*"), F.count_if(is_query)).first()
    blocks = rows.repartition(max(1, -(-n_rows // block_rows)), F.xxhash64("key"))
    chunks = max(1, -(-2 * n_queries // chunk)) if n_queries > chunk else 1
    found = None
    for c in range(chunks):
        some = rows.where(is_query & (F.pmod(F.xxhash64(F.col("key"), F.lit(1)), F.lit(chunks)) == c)).toArrow()
        shared = vectors.sparkSession.sparkContext.broadcast((some["key"].to_numpy(), some["id"].to_numpy(), _matrix(some["v"].combine_chunks(), d) if len(some) else np.empty((0, d))))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            got = [(b.column(0).to_numpy(zero_copy_only=False), _matrix(b.column(1), d), b.column(2).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
            keys, ids, queries = shared.value
            if not got or not len(keys):
                return
            ids_here, x, keys_here = (np.concatenate(g) for g in zip(*got, strict=True))
            block = Block(keys_here, ids_here, x, m, seed)
            for at in range(0, len(keys), 128):
                some = slice(at, at + 128)
                out = list(block.search(keys[some], queries[some], k, width, share, growth))
                sizes = [len(x) for x, _ in out]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys[some], sizes)), pa.array(np.repeat(ids[some], sizes)), pa.array(np.concatenate([x for x, _ in out])), pa.array(np.concatenate([x for _, x in out]))], ["query_key", "query_id", "vec_id", "score"])

        part = blocks.mapInArrow(run, RESULT)
        found = part if found is None else found.unionByName(part)
    best = W.partitionBy("query_key").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
