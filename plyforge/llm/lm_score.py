"""N-gram language model in an Elias-Fano trie, trained on and scoring whole texts.

Tokens are lower-cased words and one end for each text. The first level is an Elias-Fano list of the
64-bit hashes of all distinct tokens, with their counts at the exact width. Level k holds the n-grams of
k tokens with ``least_count`` occurrences or more, as children of the (k-1)-gram nodes: node ids are
positions within the level. Monotone pointers (Elias-Fano) lead from each context to its first child and
the next context's first; the children are one non-decreasing list (context * vocabulary + token, the
context counted from the shard's first) in Elias-Fano code. Each n-gram has its discounted probability
(c - d) / C quantised to 8 bits on a log scale, each context what is left to the shorter context likewise:
P = found + left * P(shorter), where C counts all occurrences after the context, also of n-grams that are
not kept. A lookup takes the context's range of children from the pointers and searches the successor of
the token within that range.

A block's lookups are sorted and made once for each distinct n-gram, so they go through the levels in order.
Levels are built in shards, each from a range of contexts with an even share of occurrences, and as many
as the occurrences ask for: tasks count n-grams in sorted runs, one shuffle brings a shard's runs together,
and its task writes one file to the shared folder. Scoring tasks memory-map these files, so they hold only
pages they touch; on file systems that can't be mapped a shard is read when first needed. Only the shards'
descriptions come to the driver. Keys that would not fit 63 bits raise an error.

Null and empty texts are one end; an empty table has no rows. Without training texts every token has the uniform unknown probability 1.
Repeated rows count and are scored each; n-grams of equal counts don't depend on any order. Other columns
are not read, but for those passed, whose names must differ from those of the result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import SPACED, U64, block_hashes, planes, ragged, text_blocks, unplanes, words
from .elias_fano import EliasFano, Packed
from .shared import Scratch, distinct_names, map_texts, shuffle_partitions

END = 0x5EEDE2D0000000E1
RUN = 1 << 21
#: Occurrences that a shard is made of, about; its task holds them.
SHARD = 6 << 20
BLOCK = 2 << 20
QUANTUM = 32  # steps for a power of ten


def quantised(p: np.ndarray) -> np.ndarray:
    """8-bit codes, rounded to lower probabilities so that no context exceeds 1."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-9)) * QUANTUM - 1e-9), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-np.arange(256) / QUANTUM)

_OPENED: dict[str, list[np.ndarray]] = {}


def _system(folder: str) -> tuple[pafs.FileSystem, str]:
    """Hadoop names S3 by other schemes."""
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


def write_arrays(folder: str, arrays: list[np.ndarray]) -> tuple[str, str]:
    """A new file with the arrays, and its layout; a task that runs again writes another file."""
    system, path = _system(folder)
    path = f"{path}/{uuid.uuid4().hex}.level"
    if isinstance(system, pafs.LocalFileSystem):
        system.create_dir(path.rpartition("/")[0], recursive=True)
    layout = []
    with system.open_output_stream(path) as out:
        at = 0
        for a in arrays:
            data = np.ascontiguousarray(a).tobytes()
            pad = -len(data) % 8
            layout.append(f"{a.dtype.str}:{at}:{len(a)}")
            out.write(data + b"\0" * pad)
            at += len(data) + pad
    return path, ",".join(layout)


def read_arrays(folder: str, path: str, layout: str) -> list[np.ndarray]:
    if path not in _OPENED:
        if len(_OPENED) > 4096:
            _OPENED.clear()
        system, _ = _system(folder)
        if isinstance(system, pafs.LocalFileSystem):
            data = np.memmap(path, np.uint8, "r").view(np.ndarray)
        else:
            with system.open_input_file(path) as f:
                data = np.frombuffer(f.read(), np.uint8)
        parts = [x.split(":") for x in layout.split(",")]
        _OPENED[path] = [data[int(at) : int(at) + int(n) * np.dtype(kind).itemsize].view(kind) for kind, at, n in parts]
    return _OPENED[path]


@dataclass
class Shard:
    path: str
    layout: str
    n: int
    first: int  # smallest hash (level 1) or context
    base: int = 0  # id of the first node
    mass: list[int] = field(default_factory=list)  # occurrences up to evenly spaced nodes
    numbers: tuple[int, ...] = ()


@dataclass
class Trie:
    """The shards of all levels; small, so it goes to tasks as it is."""

    folder: str
    levels: list[list[Shard]]
    tokens: int
    vocabulary: int

    def ids(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids (-1: unknown) and counts."""
        distinct, where = np.unique(hashes, return_inverse=True)
        ids, counts = np.full(len(distinct), -1, np.int64), np.zeros(len(distinct), np.int64)
        for shard, a, b in _shards(self.levels[0], distinct, U64):
            keys, count = _tokens(self.folder, shard)
            x = distinct[a:b] - U64(shard.first)
            inside = np.flatnonzero(x <= U64(shard.numbers[0]))
            at, ok = keys.successor(x[inside], np.zeros(len(inside), np.int64), np.full(len(inside), shard.n))
            rows = a + inside[ok]
            ids[rows] = shard.base + at[ok]
            counts[rows] = count[at[ok]].astype(np.int64)
        return ids[where], counts[where]

    def find(self, level: int, context: np.ndarray, token: np.ndarray, values: bool = True) -> tuple[np.ndarray, ...]:
        """Of a level's (context, token): node ids (-1: none) and, with values, found probability and what the context leaves. Negative contexts or tokens are unknown."""
        context, token, where = _distinct(context, token, self.vocabulary)
        new = np.flatnonzero(np.diff(context, prepend=-2))  # pointers are read once for each context
        distinct, sizes = context[new], np.diff(np.append(new, len(context)))
        node, found, left = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(distinct))
        for shard, a, b in _shards(self.levels[level - 1], distinct, np.int64):
            pointers, children, probability, rest = _opened(self.folder, shard)
            b = a + int(np.searchsorted(distinct[a:b], shard.first + shard.numbers[0]))
            code = rest[distinct[a:b] - shard.first]
            left[a:b] = _VALUE[code]
            some = a + np.flatnonzero(code)  # contexts without children leave all
            relative = distinct[some] - shard.first
            start, end = (x.astype(np.int64) for x in pointers.pair(relative))
            rows = ragged(new[some], sizes[some])
            relative, start, end = (np.repeat(x, sizes[some]) for x in (relative * self.vocabulary, start, end))
            if len(rows) and (unknown := token[rows] < 0).any():
                rows, relative, start, end = (x[~unknown] for x in (rows, relative, start, end))
            at, ok = children.successor(relative + token[rows], start, end)
            rows, at = rows[ok], at[ok]
            node[rows] = shard.base + at
            if values:
                found[rows] = _VALUE[probability[at]]
        return (node[where], found[where], np.repeat(left, sizes)[where]) if values else (node[where],)

    def log10(self, ids: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Base and model log10 probability of each token; firsts: where texts start."""
        p = (counts + 0.5) / (self.tokens + 0.5 * (self.vocabulary + 1))
        base = np.log10(p)
        age = _ages(len(ids), firsts)
        context = ids.copy()
        for level in range(2, len(self.levels) + 1):
            previous = np.concatenate(([-1], context[:-1]))
            previous[age < level - 1] = -1
            context, found, left = self.find(level, previous, ids)
            p = found + left * p
        return base, np.log10(p)


def _ages(n: int, firsts: np.ndarray) -> np.ndarray:
    """How many tokens of the same text stand before each."""
    return np.arange(n) - np.repeat(firsts, np.diff(np.append(firsts, n)))


def _distinct(context: np.ndarray, token: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and where each pair stands among them. Both are -1 or more."""
    if not len(context):
        return context, token, np.empty(0, np.int64)
    if int(context.max()) < (1 << 62) // (vocabulary + 1):
        key, where = np.unique(context * (vocabulary + 1) + token + 1, return_inverse=True)
        context = key // (vocabulary + 1)
        return context, key - context * (vocabulary + 1) - 1, where
    order = np.lexsort((token, context))
    c, t = context[order], token[order]
    new = np.append(True, (c[1:] != c[:-1]) | (t[1:] != t[:-1]))
    where = np.empty(len(c), np.int64)
    where[order] = np.cumsum(new) - 1
    return c[new], t[new], where


def _shards(shards: list[Shard], ordered: np.ndarray, kind: type) -> Iterator[tuple[Shard, int, int]]:
    """The shards that sorted numbers may be in, and the numbers' range in each."""
    cut = np.searchsorted(ordered, np.array([s.first for s in shards], kind))
    for shard, a, b in zip(shards, cut.tolist(), [*cut[1:].tolist(), len(ordered)], strict=True):
        if a < b and shard.n:
            yield shard, a, b


def _tokens(folder: str, shard: Shard) -> tuple[EliasFano, Packed]:
    a = read_arrays(folder, shard.path, shard.layout)
    _, bits, width = shard.numbers
    return EliasFano(a[:-1], shard.n, bits), Packed(a[-1], width)


def _opened(folder: str, shard: Shard) -> tuple[EliasFano, EliasFano, np.ndarray, np.ndarray]:
    """Pointers, children, the children's probabilities and what each context leaves."""
    a = read_arrays(folder, shard.path, shard.layout)
    width, pointer_bits, child_bits = shard.numbers
    return EliasFano(a[:3], width + 1, pointer_bits), EliasFano(a[3:-2], shard.n, child_bits), a[-2], a[-1]


def children(trie: Trie, level: int, context: int) -> np.ndarray:
    """Token ids that the level has after a context, by its pointers."""
    for shard in trie.levels[level - 1]:
        relative = context - shard.first
        if shard.n and 0 <= relative < shard.numbers[0]:
            pointers, values, _, _ = _opened(trie.folder, shard)
            start, end = pointers.pair(np.array([relative]))
            return values.at(np.arange(int(start[0]), int(end[0]))).astype(np.int64) - relative * trie.vocabulary
    return np.empty(0, np.int64)


def token_blocks(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, token hashes with an end for each row, where rows start)."""
    for low, high, data, offsets in text_blocks(batch, column, BLOCK):
        starts, ends, bounds = words(data, offsets, SPACED)
        h = np.insert(block_hashes(data, starts, ends), bounds[1:], U64(END))
        yield low, high, h, bounds[:-1] + np.arange(high - low)


def _vocabulary(texts: DataFrame, folder: str, parts: int) -> list[Shard]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array((h ^ U64(1 << 63)).view(np.int64)), pa.array(n.astype(np.int64))], ["h", "n"])

        for batch in batches:
            for _, _, h, _ in token_blocks(batch, "text"):
                held.append(h)
                size += len(h)
                if size >= 2 * RUN:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b.column(0).to_numpy().view(U64) ^ U64(1 << 63), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not got:
            return
        keys, n = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        span = int(keys[-1] - keys[0])
        listed = EliasFano.build(keys - keys[0], span + 1)
        width = int(n.max()).bit_length()
        path, layout = write_arrays(folder, [*listed.arrays(), Packed.build(n, width).words])
        mass = np.concatenate(([0], np.cumsum(n)))
        marks = [int(mass[len(n) * i // 64]) for i in range(65)]
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([layout]), pa.array([len(keys)]), pa.array([str(int(keys[0]))]), pa.array([marks]), pa.array([[str(span), str(listed.bits), str(width)]])], ["path", "layout", "n", "first", "mass", "numbers"])

    table = map_texts(texts, count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    # ranges of even width: hashes are uniform, and no sample of a large table is needed
    width = -(-(1 << 64) // parts)
    shard = F.floor((F.col("h").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")) / F.lit(str(width)).cast("decimal(20,0)")).cast("int")
    sorted_ = table.withColumn("shard", shard).repartition(parts, "shard").sortWithinPartitions("shard", "h")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task may have several ranges
        held: dict[int, list[pa.RecordBatch]] = {}
        for b in batches:
            s = b.column(2).to_numpy()
            for x in np.unique(s):
                at = np.flatnonzero(s == x)
                held.setdefault(int(x), []).append(b.slice(int(at[0]), len(at)).select(["h", "n"]))
        for x in list(held):
            yield from write(iter(held.pop(x)))

    return _described(sorted_.select("h", "n", "shard").mapInArrow(each, _SHARD).collect())


def _described(rows: list) -> list[Shard]:
    out = sorted((Shard(r["path"], r["layout"], r["n"], int(r["first"]), 0, r["mass"], tuple(int(x) for x in r["numbers"])) for r in rows), key=lambda s: s.first)
    base = 0
    for s in out:
        s.base = base
        base += s.n
    return out


_SHARD = "path string, layout string, n long, first string, mass array<long>, numbers array<string>"


def _context_cuts(shards: list[Shard], parts: int) -> np.ndarray:
    """First nodes of ranges with about even mass."""
    nodes, mass, total = [], [], 0
    for s in shards:
        nodes += [s.base + s.n * i // 64 for i in range(65)]
        mass += [total + m for m in s.mass]
        total += s.mass[-1]
    want = np.arange(1, parts) * (total / parts)
    return np.unique(np.interp(want, mass, nodes).astype(np.int64)) if nodes else np.empty(0, np.int64)


def _counted(context: np.ndarray, token: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct pairs in order, and how often each is there."""
    if not len(context) or int(context.max()) < (1 << 62) // vocabulary:
        key, n = np.unique(context * vocabulary + token, return_counts=True)
        return key // vocabulary, key % vocabulary, n
    context, token, where = _distinct(context, token, vocabulary)
    return context, token, np.bincount(where)


def _level(texts: DataFrame, trie: Trie, parts: int, least_count: int, discount: float) -> list[Shard]:
    level, v = len(trie.levels) + 1, trie.vocabulary
    cuts = _context_cuts(trie.levels[-1], parts)
    lows = np.concatenate(([0], cuts))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> pa.RecordBatch:
            context, token, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)), v)
            edge = np.searchsorted(context, cuts)
            rows = []
            for p, (a, b) in enumerate(zip([0, *edge], [*edge, len(context)], strict=True)):
                if a < b:
                    if int(context[b - 1] - lows[p] + 1) * v >= 1 << 63:
                        raise OverflowError(f"a range of contexts times {v} tokens exceeds 63 bits; use more shuffle partitions")
                    key = (context[a:b] - lows[p]) * v + token[a:b]
                    rows.append((p, planes(np.diff(key, prepend=0).astype(U64)), planes(n[a:b].astype(np.uint32))))
            return pa.RecordBatch.from_arrays([pa.array([p for p, _, _ in rows], pa.int32()), pa.array([x for _, x, _ in rows], pa.binary()), pa.array([x for _, _, x in rows], pa.binary())], ["part", "steps", "n"])

        for batch in batches:
            for _, _, h, firsts in token_blocks(batch, "text"):
                ids, _ = trie.ids(h)
                age, context = _ages(len(ids), firsts), ids
                for k in range(2, level):
                    previous = np.concatenate(([-1], context[:-1]))
                    previous[age < k - 1] = -1
                    (context,) = trie.find(k, previous, ids, values=False)
                ok = np.flatnonzero((age[1:] >= level - 1) & (context[:-1] >= 0))
                held.append((context[ok], ids[ok + 1]))
                size += len(ok)
                if size >= RUN:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by part, so one part is held at a time
        now, held, size = None, [], 0
        for batch in batches:
            for part, steps, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != now:
                    if held:
                        yield from finished(now, held)
                    now, held, size = part, [], 0
                held.append((np.cumsum(unplanes(steps.as_buffer(), U64), dtype=U64), unplanes(n.as_buffer(), np.uint32)))
                size += len(held[-1][0])
                if len(held) > 1 and size >= max(RUN, 2 * len(held[0][0])):
                    held = [_added(held)]
                    size = len(held[0][0])
        if held:
            yield from finished(now, held)

    def finished(part: int, held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        key, n = _added(held)
        held.clear()
        context, token = (key // U64(v)).astype(np.int64), (key % U64(v)).astype(np.int64)
        begins = np.flatnonzero(np.diff(context, prepend=-1))
        total = np.repeat(np.add.reduceat(n, begins), np.diff(np.append(begins, len(n))))
        keep = n >= least_count
        context, token, kept, total = context[keep], token[keep], n[keep], total[keep]
        if not len(kept):
            return
        first = int(context[0])
        context -= first
        width = int(context[-1]) + 1
        begins = np.flatnonzero(np.diff(context, prepend=-1))
        share = (kept - discount) / total
        rest = np.zeros(width, np.uint8)  # 0 where a context has no children
        rest[context[begins]] = np.maximum(quantised(np.maximum(1 - np.add.reduceat(share, begins), 1e-8)), 1)
        pointers = EliasFano.build(np.searchsorted(context, np.arange(width + 1)), len(kept) + 1, searched=False)
        values = EliasFano.build(context * v + token, width * v)
        path, layout = write_arrays(trie.folder, [*pointers.arrays(), *values.arrays(), quantised(share), rest])
        mass = np.concatenate(([0], np.cumsum(kept)))
        marks = [int(mass[len(kept) * i // 64]) for i in range(65)]
        numbers = [str(x) for x in (width, pointers.bits, values.bits)]
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([layout]), pa.array([len(kept)]), pa.array([str(first + int(lows[part]))]), pa.array([marks]), pa.array([numbers])], ["path", "layout", "n", "first", "mass", "numbers"])

    blocks = map_texts(texts, count, "part int, steps binary, n binary")
    return _described(blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(write, _SHARD).collect())


def _added(some: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    key = np.concatenate([k for k, _ in some])
    order = np.argsort(key, kind="stable")
    key, n = key[order], np.concatenate([m for _, m in some]).astype(np.int64)[order]
    begins = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[begins], np.add.reduceat(n, begins)


def fit(docs: DataFrame, learn: Column | None = None, text_col: str = "text", order: int = 3, least_count: int = 1, discount: float = 0.6) -> Trie:
    """Learns from the rows for which ``learn`` holds."""
    spark = docs.sparkSession
    texts = (docs if learn is None else docs.where(learn)).select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    folder = Scratch(spark, "lm").root
    folder = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"
    parts = shuffle_partitions(spark)
    shards = _vocabulary(texts, folder, parts)
    trie = Trie(folder, [shards], sum(s.mass[-1] for s in shards), sum(s.n for s in shards))
    for _ in range(2, order + 1):
        if trie.vocabulary:
            trie.levels.append(_level(texts, trie, max(parts, -(-trie.tokens // SHARD)), least_count, discount))
    return trie


def score(docs: DataFrame, trie: Trie, text_col: str = "text", passed: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The passed columns, n_tokens, n_known, train_tokens, base_score and score of each row."""
    distinct_names(passed, "n_tokens", "n_known", "train_tokens", "base_score", "score")
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, known, base, model = [], [], [], []
            for low, high, h, firsts in token_blocks(batch, "__bytes"):
                ids, counts = trie.ids(h) if trie.vocabulary else (np.full(len(h), -1), np.zeros(len(h)))
                b, m = trie.log10(ids, counts, firsts)
                tokens.append(np.diff(np.append(firsts, len(h))))
                known.append(np.add.reduceat((counts > 0).astype(np.int64), firsts))
                base.append(np.add.reduceat(b, firsts))
                model.append(np.add.reduceat(m, firsts))
            n = batch.num_rows
            columns = [np.concatenate(x) if x else np.empty(0) for x in (tokens, known, base, model)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(columns[0].astype(np.int64)), pa.array(columns[1].astype(np.int64)), pa.array(np.full(n, trie.tokens, np.int64)), pa.array(columns[2].astype(np.float64)), pa.array(columns[3].astype(np.float64))], [*passed, "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    rows = docs.select(*passed, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__bytes"))
    return map_texts(rows, run, f"{kept}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
