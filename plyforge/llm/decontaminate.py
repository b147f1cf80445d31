"""Benchmark passages in documents by winnowing.

Words are hashed, every k consecutive words are a k-gram, and in each window of w consecutive k-grams
the leftmost smallest is kept as a fingerprint. Any span of k + w - 1 = ``span`` words that a document
and an item share holds a whole window, whose fingerprint depends on these words alone, so both keep
it: no shared span is missed. Fingerprints of documents are joined with those of items, and each hit is
extended word by word to both sides; only runs of ``span`` words count. An item with fewer words is one
passage as a whole and is looked up by the gram of its own length.

The benchmark's index is broadcast where its text, which is measured first, has at most ``part_bytes``. A
larger benchmark is joined by shuffle: a document's fingerprints that a bitmap of fixed size lets through are
extended to the windows they stand for, and these are joined with the windows of the items; a bitmap that is
full lets more through and changes no result. Hot windows are spread over salts.

Words are compared by 64-bit hashes. Null and empty texts have no words and no hits; an item
without words has no passage; repeated rows each get their result; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import ALNUM, U64, grams, text_blocks, whole, word_hashes, words
from .shared import Scratch, distinct_names, map_texts

MAP_BITS = 27  # the bitmap of a joined benchmark has 2**MAP_BITS bits
SALTS = 16


def minima(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first word of each window within a row, and place and value of its leftmost smallest k-gram."""
    values = grams(hashes, k)
    if len(values) < w:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, U64)
    windows = len(values) - w + 1
    inside = np.zeros(windows + 1, np.int64)
    first, end = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - (k + w - 2))
    np.add.at(inside, np.minimum(first, windows), 1)
    np.add.at(inside, np.minimum(end, windows), -1)
    start = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    at = start + sliding_window_view(values, w)[start].argmin(1) if len(start) else start
    return start, at, values[at]


def fingerprints(hashes: np.ndarray, bounds: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and values of the k-grams that are the leftmost smallest of some window within a row."""
    _, at, values = minima(hashes, bounds, k, w)
    at, first = np.unique(at, return_index=True)
    return at, values[first]


@dataclass
class ItemIndex:
    """Fingerprints and word hashes of one part of the benchmark."""

    k: int
    w: int
    ids: list[str] = field(default_factory=list)
    hashes: list[np.ndarray] = field(default_factory=list)
    marks: dict[int, list[tuple[int, int]]] = field(default_factory=lambda: defaultdict(list))
    short: dict[int, dict[int, list[int]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))

    def add(self, item: str, text: str) -> None:
        data = np.frombuffer(text.encode(), np.uint8)
        starts, ends, bounds = words(data, np.array([0, len(data)]), ALNUM)
        h, n = word_hashes(data, starts, ends), len(self.ids)
        self.ids.append(item)
        self.hashes.append(h)
        if len(h) >= self.k + self.w - 1:
            for at, value in zip(*fingerprints(h, bounds, self.k, self.w), strict=True):
                self.marks[int(value)].append((n, int(at)))
        elif len(h):
            self.short[len(h)][whole(h)].append(n)

    def sealed(self) -> ItemIndex:
        self.marks, self.short = dict(self.marks), {n: dict(x) for n, x in self.short.items()}
        self.known = np.array(sorted(self.marks), np.uint64)
        self.known_short = {n: np.array(sorted(x), np.uint64) for n, x in self.short.items()}
        return self


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Positions of the values that are in a sorted array."""
    if not len(known) or not len(values):
        return np.empty(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values)


def extended(h: np.ndarray, low: int, high: int, at: int, item: np.ndarray, q: int, k: int) -> tuple[int, int]:
    """The longest run around a k-gram hit, as positions in h."""
    back = min(at - low, q)
    miss = np.flatnonzero(h[at - back : at] != item[q - back : q])
    start = at - back + (int(miss[-1]) + 1 if len(miss) else 0)
    ahead = min(high - at, len(item) - q)
    miss = np.flatnonzero(h[at : at + ahead] != item[q : q + ahead])
    return start, at + (int(miss[0]) if len(miss) else ahead)


def block_hits(h: np.ndarray, bounds: np.ndarray, index: ItemIndex) -> dict[int, list[tuple[int, int, int]]]:
    """For each row of a block with hits: (first word, end word, item), words counted in the row."""
    found: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    span = index.k + index.w - 1
    at, values = fingerprints(h, bounds, index.k, index.w)
    hits = member(values, index.known)
    done: dict[tuple[int, int], int] = {}
    for p, value, row in zip(at[hits].tolist(), values[hits].tolist(), (np.searchsorted(bounds, at[hits], "right") - 1).tolist(), strict=True):
        low, high = int(bounds[row]), int(bounds[row + 1])
        for item, q in index.marks[value]:
            if done.get((item, p - q), -1) > p:  # within a run that is known
                continue
            a, b = extended(h, low, high, p, index.hashes[item], q, index.k)
            done[item, p - q] = max(b, p + 1)
            if b - a >= span:
                found[row].append((a - low, b - low, item))
    for n, items in index.short.items():
        values = grams(h, n)
        for p in member(values, index.known_short[n]).tolist():
            row = int(np.searchsorted(bounds, p, "right")) - 1
            if p + n <= bounds[row + 1]:
                low = int(bounds[row])
                found[row] += [(p - low, p - low + n, item) for item in items[int(values[p])]]
    return found


HITS = "array<struct<start:long,end:long>>"
_HITS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def find_passages(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = 10, k: int = 5, part_bytes: int = 32 << 20, passed: tuple[str, ...] = ()) -> DataFrame:
    """Each row's id and passed columns, n_words, hits array<struct<start,end>> (disjoint word runs in order) and items array<string>.

    Items without an id are looked for like the others, but are not named in items.
    """
    keep = [id_col, *passed]
    distinct_names(tuple(keep), "n_words", "hits", "items")
    items = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).alias("text")).where("text is not null")
    rows = docs.select(*keep, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__bytes"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return (searched if size <= part_bytes else joined)(rows, items, keep, span, k)


def searched(rows: DataFrame, items: DataFrame, keep: list[str], span: int, k: int) -> DataFrame:
    """The result with the whole index on each worker."""
    index = ItemIndex(k, span - k + 1)
    for row in items.toLocalIterator():
        index.add(row["item"], row["text"])
    shared = rows.sparkSession.sparkContext.broadcast(index.sealed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        for batch in batches:
            n_words, hits, named = [], [], []
            for low, high, data, offsets in text_blocks(batch, "__bytes"):
                starts, ends, bounds = words(data, offsets, ALNUM)
                n_words += np.diff(bounds).tolist()
                found = block_hits(word_hashes(data, starts, ends), bounds, one)
                for row in range(high - low):
                    hits.append([{"start": a, "end": b} for a, b in merged([x[:2] for x in found.get(row, [])])])
                    named.append(sorted({one.ids[x[2]] for x in found.get(row, [])} - {None}))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(named, pa.list_(pa.string()))], [*keep, "n_words", "hits", "items"])

    return map_texts(rows, run, f"{_typed(rows, keep)}, n_words long, hits {HITS}, items array<string>")


def joined(rows: DataFrame, items: DataFrame, keep: list[str], span: int, k: int) -> DataFrame:
    """The result where windows of documents and items meet in a shuffle."""
    spark = rows.sparkSession
    scratch, w = Scratch(spark, "decontaminate"), span - k + 1
    marks = scratch.save(item_marks(items, span, k).distinct(), "marks")
    slots = marks.select(F.expr(f"shiftrightunsigned(key, {64 - MAP_BITS})").alias("slot"))
    bits = slots.groupBy(F.expr("slot >> 6").alias("place")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot & 63 AS INT)))").alias("bits")).toArrow()
    bitmap = np.zeros(1 << (MAP_BITS - 6), U64)
    bitmap[bits["place"].to_numpy()] = bits["bits"].to_numpy().view(U64)
    marks = marks.where("n >= 0")  # fingerprints are in the bitmap
    lengths = sorted(r["n"] for r in marks.where("n > 0").select("n").distinct().collect())  # fewer than span
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def known(values: np.ndarray) -> np.ndarray:
            slot = values >> U64(64 - MAP_BITS)
            return (shared.value[(slot >> U64(6)).astype(np.int64)] >> (slot & U64(63))) & U64(1) == 1

        for batch in batches:
            for low, _, data, offsets in text_blocks(batch, "__bytes"):
                starts, ends, bounds = words(data, offsets, ALNUM)
                h = word_hashes(data, starts, ends)
                at, _, values = minima(h, bounds, k, w)
                at = at[known(values)]
                for n in (0, *lengths):
                    values = grams(h, n or span)
                    if n:
                        at = np.arange(len(values))
                        at = at[at + n <= bounds[np.searchsorted(bounds, at, "right")]]
                    at = at[known(values[at])]
                    row = np.searchsorted(bounds, at, "right") - 1
                    digests = batch.column(0).take(pa.array(low + row))
                    yield pa.RecordBatch.from_arrays([digests, pa.array(np.full(len(at), n, np.int32)), pa.array(values[at].view(np.int64)), pa.array(at - bounds[row])], ["d", "n", "key", "at"])

    def salted(table: DataFrame) -> DataFrame:
        return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def salt(*columns: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.lit(SALTS)).cast("int")

    digest = F.unhex(F.sha2("__bytes", 256)).alias("d")  # copies have one
    found = scratch.save(map_texts(rows.select(digest, "__bytes"), run, "d binary, n int, key long, at long").distinct(), "windows").withColumn("salt", salt("d"))
    on = ["n", "key", "salt"]
    end = F.col("at") + F.when(F.col("n") == 0, span).otherwise(F.col("n"))
    hits = found.join(salted(marks.select("n", "key").distinct()), on, "left_semi").groupBy("d").agg(F.collect_set(F.struct(F.col("at").alias("start"), end.alias("end"))).alias("hits"))
    named = found.select("d", *on).distinct().join(salted(marks.where("item is not null")), on).groupBy("d").agg(F.sort_array(F.collect_set("item")).alias("items"))
    results = scratch.save(map_texts(hits.join(named, "d", "left"), _merged_hits, f"d binary, hits {HITS}, items array<string>"), "results")
    # passed columns may have any name, so they have numbers until the end
    numbers = [f"c{i}" for i in range(len(keep))]
    numbered = rows.toDF(*numbers, "__bytes")
    counted = map_texts(numbered.select(*numbers, digest, "__bytes"), _counted, f"{_typed(numbered, numbers)}, d binary, n_words long")
    both = counted.withColumn("salt", salt("c0")).join(salted(results), ["d", "salt"], "left")
    return both.select(*(F.col(n).alias(c) for n, c in zip(numbers, keep, strict=True)), "n_words", F.coalesce("hits", F.array().cast(HITS)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def item_marks(items: DataFrame, span: int, k: int) -> DataFrame:
    """(item, n, key): windows (n = 0) and their fingerprints (n = -1); an item of fewer words, n, is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, data, offsets in text_blocks(batch, "bytes"):
                starts, ends, bounds = words(data, offsets, ALNUM)
                h = word_hashes(data, starts, ends)
                start, _, values = minima(h, bounds, k, span - k + 1)
                row = np.searchsorted(bounds, start, "right") - 1
                sizes = np.diff(bounds)
                short = np.flatnonzero((sizes > 0) & (sizes < span))
                keys = np.array([whole(h[bounds[r] : bounds[r + 1]]) for r in short.tolist()], U64)
                n = np.concatenate((np.full(len(start), -1), np.zeros(len(start), np.int64), sizes[short]))
                key = np.concatenate((values, grams(h, span)[start], keys)).view(np.int64)
                item = batch.column(0).take(pa.array(low + np.concatenate((row, row, short))))
                yield pa.RecordBatch.from_arrays([item, pa.array(n.astype(np.int32)), pa.array(key)], ["item", "n", "key"])

    return map_texts(items.select("item", F.col("text").cast("binary").alias("bytes")), run, "item string, n int, key long")


def _merged_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hits = [[{"start": a, "end": b} for a, b in merged([(x["start"], x["end"]) for x in row])] for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hits, _HITS), batch.column(2)], ["d", "hits", "items"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last one, the bytes, and the number of words."""
    for batch in batches:
        n_words = [n for _, _, data, offsets in text_blocks(batch, "__bytes") for n in np.diff(words(data, offsets, ALNUM)[2]).tolist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_words, pa.int64())], [*batch.schema.names[:-1], "n_words"])


def _typed(rows: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(runs):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out
