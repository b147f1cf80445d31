"""Documents packed into fixed windows by non-negative least squares over shallow length combinations.

A document is its token ids and an end id. It is cut into whole windows and one rest, so few documents
are cut. Lengths are counted in bins of ``window / bins`` tokens. All combinations of up to three bins that
exactly fill a window are the strategies; how often each is used comes from non-negative least squares
against the histogram (by coordinate descent), rounded and held to what there is. What is left is packed
greedily, the longest first with the largest bins that still fit. Histogram, strategies and plan are of
fixed size whatever the corpus.

Each piece then finds its sequence by its rank among the pieces of its bin: a rank within its task plus
the counts of earlier tasks. Offsets are running sums within a sequence. No text or id leaves its task.

Null and empty texts are one end id. Texts are taken whole. Repeated rows are packed each on their own.
No rows give no pieces. Other columns are not read.
"""

from __future__ import annotations

import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .byte_pairs import BytePairs
from .shared import Scratch, map_texts

#: Bytes of text whose distinct words are encoded together.
TOGETHER = 1 << 23


class Encoder:
    """Token ids as little-endian 32-bit bytes.

    The byte-level pre-tokenizer starts a token at a single space after a character that is no white space,
    so such a text is the concatenation of its words' ids, each taken with its space; the distinct words of the texts are
    encoded together, see byte_pairs. Other texts, and those that hold an added token of the tokenizer, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pairs = BytePairs.of(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]  # found before words are split

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array, space: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, each after space, and how many ids each has."""
        joined = b""
        if len(words):
            joined = space.encode() + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(space, words.type))[0].as_buffer().to_pybytes()
        sizes = pc.binary_length(words).to_numpy().astype(np.int64) + len(space)
        ids, bounds, left = self.pairs.encode(joined, np.concatenate(([0], np.cumsum(sizes))))
        if not left.any():
            return ids, np.diff(bounds)
        parts, at, odd = [], 0, np.flatnonzero(left)
        for i, own in zip(odd.tolist(), self._encode([space + words[i].as_py() for i in odd.tolist()]), strict=True):
            parts += [ids[at : bounds[i]], own]
            at = bounds[i + 1]
        counts = np.diff(bounds)
        counts[odd] = [len(own) for own in parts[1::2]]
        return np.concatenate([*parts, ids[at:]]), counts

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        texts = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        if self.pairs is None:
            return [ids.tobytes() for ids in self._encode(texts.to_pylist())]
        split = pc.split_pattern(texts, " ")
        bounds = split.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        heads = bounds[:-1]
        coded = split.flatten().dictionary_encode()
        words, codes = coded.dictionary, coded.indices.to_numpy()
        # words whose ids depend on what is beside them: white space at the end, and nothing but for a text's first word
        odd = pc.utf8_is_space(pc.utf8_slice_codeunits(words, -1)).to_numpy(zero_copy_only=False)
        alone = odd | (pc.binary_length(words).to_numpy() == 0)
        at = alone[codes]
        at[heads] = odd[codes[heads]]
        whole = np.zeros(len(texts), bool)
        whole[np.searchsorted(bounds, np.flatnonzero(at), side="right") - 1] = True
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        first, of_head = np.unique(codes[heads], return_inverse=True)
        ids, n = self._words(words, " ")
        more, n_more = self._words(words.take(pa.array(first)), "")
        codes = codes.astype(np.int64)
        codes[heads] = len(words) + of_head
        ids, n = np.concatenate((ids, more)), np.concatenate((n, n_more))
        begins, sizes = np.cumsum(n) - n, n[codes]
        ends = np.cumsum(sizes)
        out = ids[np.repeat(begins[codes] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        cuts = 4 * np.concatenate(([0], ends))[bounds]
        got = [out[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        some = np.flatnonzero(whole).tolist()
        for i, own in zip(some, self._encode([texts[i].as_py() for i in some]), strict=True):
            got[i] = own.tobytes()
        return got


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(path: str) -> Encoder:
    """One encoder for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def strategies(bins: int) -> list[tuple[int, ...]]:
    """Combinations of up to three bins, largest first, that fill a window."""
    found: list[tuple[int, ...]] = [(bins,)]
    for a in range(bins - 1, 0, -1):
        b = bins - a
        if b <= a:
            found.append((a, b))
        found += [(a, m, b - m) for m in range(min(a, b - 1), (b - 1) // 2, -1) if 0 < b - m <= m]
    return found


def nnls(columns: list[tuple[int, ...]], target: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Repeats x >= 0 of the columns (multisets of bins) minimising |sum - target|^2, by coordinate descent."""
    left = target.astype(float).tolist()
    made = [[(b, c.count(b)) for b in sorted(set(c))] for c in columns]
    x = [0.0] * len(columns)
    usable = [j for j, c in enumerate(columns) if all(target[b] > 0 for b in c)]
    for _ in range(sweeps):
        moved = 0.0
        for j in usable:
            gain = sum(m * left[b] for b, m in made[j]) / sum(m * m for _, m in made[j])
            new = max(0.0, x[j] + gain)
            step = new - x[j]
            if step:
                x[j] = new
                for b, m in made[j]:
                    left[b] -= m * step
                moved = max(moved, abs(step))
        if moved < 0.25:
            break
    return np.array(x)


def plan(counts: np.ndarray, bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(bins of a sequence, how many such sequences) that use up a histogram; counts[b] pieces of bin b."""
    left, made = counts.astype(np.int64).copy(), []
    columns = strategies(bins)
    x = nnls(columns, counts)
    for j in np.argsort(-x, kind="stable"):
        if x[j] < 0.5:
            break
        c = columns[j]
        n = min(round(x[j]), *(int(left[b]) // c.count(b) for b in c))
        if n > 0:
            made.append((c, n))
            for b in c:
                left[b] -= n
    while left.any():
        room, c, free = bins, [], left.copy()
        while room > 0 and (some := np.flatnonzero(free[1 : room + 1])).size:
            b = int(some[-1]) + 1
            c.append(b)
            free[b] -= 1
            room -= b
        n = min(int(left[b]) // c.count(b) for b in c)
        made.append((tuple(c), n))
        for b in c:
            left[b] -= n
    return made


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """(bin, first rank, end rank, first sequence, place in the sequence) of the plan."""
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for c, n in made:
        for place, b in enumerate(c):
            out.append((b, used[b], used[b] + n, sequence, place))
            used[b] += n
        sequence += n
    return out


def pack(docs: DataFrame, tokenizer_path: str, window: int = 2048, bins: int = 256, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, binary) of every piece."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    end = np.array([end_id], "<u4").tobytes()
    step = -(-window // bins)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seen = encoder_of(tokenizer_path), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            at, ids, texts = 0, batch.column(0), batch.column(1)
            sizes = np.cumsum(pc.binary_length(texts).to_numpy().astype(np.int64))
            while at < batch.num_rows:
                low, rows = at, []
                at = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + TOGETHER, side="right")))
                for i, got in enumerate(encoder.encode(texts.slice(low, at - low))):
                    got += end
                    n = len(got) // 4
                    for start in range(0, n, window):
                        piece = got[4 * start : 4 * (start + window)]
                        length = len(piece) // 4
                        b = -(-length // step)
                        rows.append((low + i, start, length, zlib.crc32(piece), n, part, b, seen[b], piece if with_ids else None))
                        seen[b] += 1
                columns = list(zip(*rows, strict=True))
                kinds = [pa.int64()] * 4 + [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0], pa.int64())), *(pa.array(c, k) for c, k in zip(columns[1:], kinds, strict=True))], ["id", "start", "length", "ids_crc32", "doc_tokens", "part", "bin", "nth", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = scratch.save(map_texts(texts, pieces, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, part int, bin int, nth long, ids binary"), "pieces")
    per_task = rows.groupBy("part", "bin").agg(F.count("*").alias("n"))
    counts = np.zeros(bins + 1, np.int64)
    for r in per_task.groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row for each bin
        counts[r["bin"]] = r["n"]
    table = slots(plan(counts, bins)) or [(0, 0, 0, 0, 0)]
    where = spark.createDataFrame(table, "bin int, first long, end long, sequence long, place int")
    earlier = W.partitionBy("bin").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = per_task.select("part", "bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = rows.join(bases, ["part", "bin"]).withColumn("rank", F.col("base") + F.col("nth"))
    placed = ranked.join(F.broadcast(where), (ranked["bin"] == where["bin"]) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.col("rank") - F.col("first"))
    before = W.partitionBy("sequence_id").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"), *(["ids"] if with_ids else []))
