"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are grams of five bytes of the lower-cased text in which every other byte than letters, digits and
those beyond ASCII is taken as a space, so they hold word beginnings and parts of words of any language. A bounded sample of labelled rows, ``per_class`` of each label by hash of the id (the
documented bound), is the set of examples; the terms that tell its labels apart best by chi-square, and
significantly (at 0.001), are the vocabulary, ``vocabulary`` of them at most, and vectors are normalised within it. Votes are weighted by how many labelled rows an
example stands for, 1 on average, so that the prior weighs the same for every size of the labels.

Examples are laid out in blocks that share a label and their strongest term. For every term the inverted
index has postings by block and each block's largest weight. A query adds up these maxima to bounds,
scores blocks from the highest bound down and stops where no bound beats its k-th best score, so its k
neighbours are exact; examples that tie with the k-th share the places left, so no order decides. Their squared cosines vote; a prior of ``prior_weight`` votes at the base rate
makes the score a calibrated share, and is all there is for a text without any term of the vocabulary.

Null and empty texts get the base rate. Texts are scored whole. Without labelled examples all scores are 0.
Labels that are null are not learned; of repeated labels the larger counts, of rows that repeat an id the smallest
text; repeated rows each get a score, and an empty table gives none. Other columns are not read, but for those passed, whose
names must differ from those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .arrays import ALNUM, text_blocks
from .shared import Scratch, distinct_names, map_texts

GRAM = 5
_LOWER = np.where(ALNUM, np.arange(256), 32).astype(np.uint8)
_LOWER[65:91] = np.arange(97, 123)
_TABLE_BITS = 22
TIE = 1e-12


def gram_codes(data: np.ndarray) -> np.ndarray:
    """The five bytes from each position as one number; a text block needs four bytes more at its end."""
    low = _LOWER[data].astype(np.uint64)
    n = len(low) - GRAM + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = low[:n].copy()
    for j in range(1, GRAM):
        code <<= np.uint64(8)
        code |= low[j : j + n]
    return code


def padded(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a block with a space before and after each, so that grams of two rows are told apart by place."""
    n = len(offsets) - 1
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    sizes = np.diff(offsets)
    at = offsets[:-1] + 2 * np.arange(n)
    place = np.arange(len(data)) + np.repeat(2 * np.arange(n) + 1, sizes)
    out[place] = data
    return out, np.append(at, len(out))


def inside(n: int, bounds: np.ndarray) -> np.ndarray:
    """Which gram positions lie within one row."""
    ok = np.ones(max(0, n), bool)
    for j in range(1, GRAM):
        cut = bounds[1:-1] - j
        ok[cut[(cut >= 0) & (cut < n)]] = False
    return ok


def _slot(codes: np.ndarray) -> np.ndarray:
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


@dataclass
class BlockMaxIndex:
    """Examples as inverted lists by block, with the largest weight of each term in each block."""

    terms: np.ndarray  # sorted codes
    idf: np.ndarray
    positive: np.ndarray  # label of each example
    ids: np.ndarray  # id of each example, as text
    votes: np.ndarray  # labelled rows that each example stands for, over their mean
    base: float
    block: int = 64
    k: int = 15
    prior_weight: float = 0.5

    def build(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> BlockMaxIndex:
        """rows: term numbers and unit weights of each example; ordered so that blocks are alike."""
        lead = np.array([t[np.argmax(w)] if len(t) else -1 for t, w in rows], np.int64)
        order = np.lexsort((lead, self.positive))
        order = order[lead[order] >= 0]
        self.positive, self.votes, self.ids = self.positive[order], self.votes[order], self.ids[order]
        rows = [rows[i] for i in order]
        n, nt = len(rows), len(self.terms)
        self.n_blocks = -(-n // self.block) if n else 0
        doc = np.repeat(np.arange(n), [len(t) for t, _ in rows])
        term = np.concatenate([t for t, _ in rows]) if n else np.empty(0, np.int64)
        weight = np.concatenate([w for _, w in rows]) if n else np.empty(0)
        cell = term * max(1, self.n_blocks) + doc // self.block
        by = np.argsort(cell, kind="stable")
        self.docs, self.weights = doc[by], weight[by]
        self.starts = np.searchsorted(cell[by], np.arange(nt * max(1, self.n_blocks) + 1))
        self.most = np.zeros(nt * max(1, self.n_blocks))
        np.maximum.at(self.most, cell, weight)
        self.most = self.most.reshape(nt, max(1, self.n_blocks))
        self.flags = np.zeros(1 << _TABLE_BITS, bool)
        self.flags[_slot(self.terms)] = True
        return self

    def lookup(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the codes that are terms, and the terms' numbers."""
        if not len(self.terms) or not len(codes):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.flatnonzero(self.flags[_slot(codes)])
        term = np.minimum(np.searchsorted(self.terms, codes[at]), len(self.terms) - 1)
        ok = self.terms[term] == codes[at]
        return at[ok], term[ok]

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k nearest examples and their cosines, exactly, with all that tie with the last."""
        if not self.n_blocks:
            return np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        best_docs, best = np.empty(0, np.int64), np.empty(0)
        at, step = 0, 2
        while at < len(order):
            if len(best) >= self.k and bound[order[at]] < best[self.k - 1] - TIE:
                break
            some = order[at : at + step]
            cells = (terms[:, None] * self.n_blocks + some).ravel()
            a, sizes = self.starts[cells], self.starts[cells + 1] - self.starts[cells]
            end = np.cumsum(sizes)
            pick = np.arange(int(end[-1])) + np.repeat(a - end + sizes, sizes)
            docs, where = np.unique(self.docs[pick], return_inverse=True)
            got = np.bincount(where, np.repeat(np.repeat(weights, len(some)), sizes) * self.weights[pick], len(docs))
            best_docs, best = np.concatenate((best_docs, docs)), np.concatenate((best, got))
            keep = np.lexsort((best_docs, -best))
            best_docs, best = best_docs[keep], best[keep]
            if len(best) > self.k:
                keep = best >= best[self.k - 1] - TIE
                best_docs, best = best_docs[keep], best[keep]
            at, step = at + step, step * 2
        return best_docs, best

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def score(self, terms: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The calibrated share of toxic votes, and the neighbours with their cosines as evidence."""
        docs, cosine = self.nearest(terms, self.unit(terms, counts)) if len(terms) else (np.empty(0, np.int64), np.empty(0))
        vote = cosine * cosine * self.votes[docs]
        if len(docs) > self.k:  # those that tie with the last share the places that are left
            tied = cosine <= cosine[self.k - 1] + TIE
            vote[tied] *= (self.k - (~tied).sum()) / tied.sum()
        total = vote.sum() + self.prior_weight
        return float(min(1.0, max(0.0, (vote[self.positive[docs]].sum() + self.prior_weight * self.base) / total))), docs, cosine


def row_terms(index: BlockMaxIndex, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Terms of the vocabulary and their counts for each row of a block."""
    text, bounds = padded(data, offsets)
    at, term = index.lookup(gram_codes(text))
    ok = inside(len(text) - GRAM + 1, bounds)[at]
    at, term = at[ok], term[ok]
    row = np.searchsorted(bounds, at, "right") - 1
    pair, n = np.unique(row * len(index.terms) + term, return_counts=True) if len(at) else (at, at)
    cut = np.searchsorted(pair, np.arange(len(offsets)) * max(1, len(index.terms)))
    for r in range(len(offsets) - 1):
        some = slice(cut[r], cut[r + 1])
        yield pair[some] % max(1, len(index.terms)), n[some]


def sample(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str, per_class: int, scratch: Scratch) -> tuple[DataFrame, dict[int, float]]:
    """At most per_class texts of each label, and how many labelled rows one of them stands for."""
    marked = labels.where(learn & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    marked = scratch.save(marked, "labels")
    totals = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    order = F.xxhash64("id", F.lit(17))
    picked = [marked.where(F.col("y") == y).orderBy(order, "id").limit(per_class) for y in (0, 1)]
    both = picked[0].unionByName(picked[1])  # 2 * per_class rows at most
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(both), "id")
    # of rows that repeat an id one text is learned
    rows = scratch.save(texts.groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
    got = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    return rows, {y: totals[y] / got[y] for y in got}


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4096, vocabulary: int = 1024, least_df: int = 5, least_chi: float = 10.83, **kw) -> BlockMaxIndex:
    """Learns from labelled rows for which ``learn`` (a condition on labels) holds."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "toxicity")
    rows, stands = sample(docs, labels, F.lit(True) if learn is None else learn, id_col, text_col, label_col, per_class, scratch)
    texts = rows.select("y", F.col("text").cast("binary").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ys = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.uint64)
            for low, high, data, offsets in text_blocks(batch, "text"):
                text, bounds = padded(data, offsets)
                codes = gram_codes(text)
                ok = inside(len(codes), bounds)
                # a document counts once for a term; five bytes leave room for the label
                marks = [(np.unique(codes[a:b][ok[a:b]]) << np.uint64(1)) | y for a, b, y in zip(bounds[:-1], bounds[1:], ys[low:high], strict=True)]
                term, n = np.unique(np.concatenate(marks), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array((term >> np.uint64(1)).astype(np.int64)), pa.array((term & np.uint64(1)).astype(np.int32)), pa.array(n.astype(np.int64))], ["term", "y", "n"])

    n_of = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = float(n_of.get(0, 0)), float(n_of.get(1, 0))
    base = n1 * stands.get(1, 0) / max(1e-9, n0 * stands.get(0, 0) + n1 * stands.get(1, 0))
    none = BlockMaxIndex(np.empty(0, np.uint64), np.empty(0), np.empty(0, bool), np.empty(0, object), np.empty(0), base, **kw).build([])
    if not n0 or not n1:
        return none
    table = map_texts(texts, count, "term long, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("b"))
    # how far the label rates with and without the term lie apart, as a chi-square
    miss = (F.lit(n0) - F.col("a")) * F.col("b") - F.col("a") * (F.lit(n1) - F.col("b"))
    df = F.col("a") + F.col("b")
    chi = miss * miss * ((n0 + n1) / (n0 * n1)) / (df * (F.lit(n0 + n1) - df + 1e-9))
    top = table.where(df >= least_df).select("term", df.alias("df"), chi.alias("chi")).where(F.col("chi") >= least_chi).orderBy(F.desc("chi"), "term").limit(vocabulary).toArrow()
    codes = top["term"].to_numpy().astype(np.uint64)
    order = np.argsort(codes)
    idf = np.log((1 + n0 + n1) / (1 + top["df"].to_numpy()[order])) + 1
    none.terms, none.idf = codes[order], idf
    index = none.build([])
    shared = spark.sparkContext.broadcast(index)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(t.tolist(), n.tolist()) for _, _, data, offsets in text_blocks(batch, "text") for t, n in row_terms(shared.value, data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.list_(pa.int64()))], ["id", "y", "terms", "n"])

    texts = rows.select(F.col("id").cast("string").alias("id"), F.col("y").cast("int").alias("y"), F.col("text").cast("binary").alias("text"))
    examples = sorted(map_texts(texts, vectors, "id string, y int, terms array<long>, n array<long>").toArrow().to_pylist(), key=lambda r: r["id"])  # 2 * per_class rows at most
    index.positive, index.ids = np.array([r["y"] == 1 for r in examples]), np.array([r["id"] for r in examples], object)
    mean = (n0 * stands[0] + n1 * stands[1]) / (n0 + n1)
    index.votes = np.array([stands[r["y"]] / mean for r in examples])
    built = []
    for r in examples:
        t = np.array(r["terms"], np.int64)
        built.append((t, index.unit(t, np.array(r["n"], np.float64)) if len(t) else np.empty(0)))
    return index.build(built)


def score(docs: DataFrame, index: BlockMaxIndex, text_col: str = "text", passed: tuple[str, ...] = ("doc_id",), evidence: int = 3) -> DataFrame:
    """The passed columns, score, and as evidence the nearest examples: array<struct<id,toxic,cosine>>, nearest first."""
    distinct_names(passed, "score", "evidence")
    kind = pa.list_(pa.struct([("id", pa.string()), ("toxic", pa.bool_()), ("cosine", pa.float64())]))
    shared = docs.sparkSession.sparkContext.broadcast(index)
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            scores, shown = [], []
            for _, _, data, offsets in text_blocks(batch, "__bytes"):
                for terms, n in row_terms(model, data, offsets):
                    s, near, cosine = model.score(terms, n)
                    scores.append(s)
                    shown.append([{"id": model.ids[d], "toxic": bool(model.positive[d]), "cosine": float(c)} for d, c in zip(near[:evidence], cosine, strict=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(shown, kind)], [*passed, "score", "evidence"])

    rows = docs.select(*passed, F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("__bytes"))
    return map_texts(rows, run, f"{kept}, score double, evidence array<struct<id:string,toxic:boolean,cosine:double>>")
