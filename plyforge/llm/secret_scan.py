"""Secrets in texts: pattern spans, and spans that a character Markov model finds more likely random than ordinary.

Two first-order chains over a 65-symbol alphabet (letters, digits, ``+/_``, and an end) are trained from
labelled samples. Samples may be given (run, label); else the corpus labels itself: what the patterns find is
a random string, every other candidate run an ordinary identifier, and in a second round only those that
the first round's model does not find random, so that lone secrets teach the ordinary chain little.
Transitions are counted in each task and summed by Spark, so the model is a table of fixed size whatever
the corpus. A run is a secret where its log-likelihood ratio is high.

Null and empty texts have no spans. A text is scanned whole, whatever its length. Rows are kept one for
one, repeated rows too, and tied spans (of one start) stand in the order of KINDS; an empty table gives no rows and
a corpus without samples of either label a model that finds nothing. Other columns of the input are not read,
but for those passed, whose names must differ from those of the result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .shared import distinct_names, map_texts

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: What the models can call a secret: a run of this alphabet.
LEAST_RUN = 16
RUN = re.compile(rf"[A-Za-z0-9+/_]{{{LEAST_RUN},}}")
KINDS = ("assign", "access", "hex", "random")

_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_"
N_SYMBOLS = len(_SYMBOLS)
EDGE = N_SYMBOLS  # before the first and after the last symbol
CODE = np.full(256, EDGE, np.uint8)
CODE[np.frombuffer(_SYMBOLS.encode(), np.uint8)] = np.arange(N_SYMBOLS)
WIDTH = N_SYMBOLS + 1

Span = tuple[int, int, int]


def pattern_spans(text: str) -> list[Span]:
    """(start, end, kind) of the three patterns, leftmost and non-overlapping for each."""
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def other_runs(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Candidate runs that no pattern span touches."""
    runs = [m.span() for m in RUN.finditer(text)]
    return [r for r in runs if not any(s[0] < r[1] and r[0] < s[1] for s in spans)] if spans else runs


def left_runs(text: str, spans: list[Span]) -> list[tuple[int, int]]:
    """Candidate runs, with the pattern spans cut out of those they touch."""
    if not spans:
        return other_runs(text, spans)
    runs = []
    for m in RUN.finditer(text):
        at, end = m.span()
        for a, b, _ in spans:  # in order of their starts
            if a < end and at < b:
                runs.append((at, a))
                at = b
        runs.append((at, end))
    return [(a, b) for a, b in runs if b - a >= LEAST_RUN]


def transitions(samples: list[str]) -> np.ndarray:
    """How often a symbol follows another, over all samples."""
    joined = CODE[np.frombuffer("\n".join(["", *samples, ""]).encode("ascii", "replace"), np.uint8)].astype(np.int64)
    return np.bincount(joined[:-1] * WIDTH + joined[1:], minlength=WIDTH * WIDTH)


@dataclass(frozen=True)
class RatioModel:
    """Log-likelihood ratios of each transition, random against ordinary, in nats."""

    ratio: np.ndarray
    least: float = 20.0
    #: Also needed on average for each character, so that length alone doesn't decide.
    least_mean: float = 0.4

    @classmethod
    def fit(cls, random: np.ndarray, ordinary: np.ndarray, smooth: float = 0.5, prior: float = 200.0, **kw) -> RatioModel:
        """Chains whose transitions are shrunk to the label's symbol frequencies; without samples of either label all ratios are 0 and nothing is found."""
        if not random.sum() or not ordinary.sum():
            return cls(np.zeros((WIDTH, WIDTH)), **kw)

        def chain(counts: np.ndarray) -> np.ndarray:
            c = counts.reshape(WIDTH, WIDTH)
            symbol = (c.sum(0) + smooth) / (c.sum() + smooth * WIDTH)
            return np.log((c + prior * symbol) / (c.sum(1, keepdims=True) + prior))

        return cls(chain(random) - chain(ordinary), **kw)

    def score(self, run: str) -> float:
        c = CODE[np.frombuffer(run.encode("ascii"), np.uint8)]
        at = np.concatenate(([EDGE], c, [EDGE])).astype(np.int64)
        return float(self.ratio[at[:-1], at[1:]].sum())

    def is_secret(self, run: str) -> bool:
        score = self.score(run)
        return score >= self.least and score >= self.least_mean * len(run)


def train(docs: DataFrame, text_col: str = "text", samples: DataFrame | None = None, rounds: int = 2, **kw) -> RatioModel:
    """Fits the chains on given (run, is_secret) samples, or else on every text; what comes to the driver are two tables of fixed size."""
    if samples is not None:
        return _fitted(samples.select(F.col("run"), F.col("is_secret").cast("boolean")).where("run is not null and is_secret is not null"), _count_samples, kw)
    model, texts = None, docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for _ in range(rounds):
        model = _fitted(texts, _count_texts(model), kw)
    return model


def _fitted(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], kw: dict) -> RatioModel:
    table = map_texts(rows, count, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).toArrow()
    totals = np.zeros((2, WIDTH * WIDTH), np.int64)
    totals[table["label"].to_numpy(), table["pair"].to_numpy()] = table["n"].to_numpy()
    return RatioModel.fit(totals[1], totals[0], **kw)


def _totals(totals: np.ndarray) -> pa.RecordBatch:
    label, pair = np.nonzero(totals)
    return pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(totals[label, pair])], ["label", "pair", "n"])


def _count_samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals = np.zeros((2, WIDTH * WIDTH), np.int64)
    for batch in batches:
        for run, is_secret in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            totals[int(is_secret)] += transitions([run])
    yield _totals(totals)


def _count_texts(model: RatioModel | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts the corpus's own samples; ordinary ones only as far as the model, if there is one, doesn't find them random."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = np.zeros((2, WIDTH * WIDTH), np.int64)
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                spans = pattern_spans(text)
                # a value after its key word; short ones such as pass phrases are no sample of randomness
                values = [v for s in spans for v in RUN.findall(text[s[0] : s[1]])]
                if values:
                    totals[1] += transitions(values)
                runs = other_runs(text, spans)
                runs = [r for r in (text[a:b] for a, b in runs) if not model or not model.is_secret(r)]
                if runs:
                    totals[0] += transitions(runs)
        yield _totals(totals)

    return count


def find(text: str, model: RatioModel) -> tuple[list[Span], list[Span]]:
    """The pattern spans, and all spans with those of the model, in order."""
    base = pattern_spans(text)
    more = [(a, b, 3) for a, b in left_runs(text, base) if model.is_secret(text[a:b])]
    return base, sorted(base + more, key=lambda s: (s[0], s[2])) if more else base


def scan(docs: DataFrame, model: RatioModel | None = None, id_col: str = "doc_id", text_col: str = "text", passed: tuple[str, ...] = ()) -> DataFrame:
    """id, spans array<struct<kind,start,end,base>> and redacted text of every row; passed: columns to keep beside them."""
    distinct_names((id_col, *passed), "spans", "redacted")
    model = model or train(docs, text_col)
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))
    columns = [id_col, *passed]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = [], []
            for text in batch.column(len(columns)):
                text = text.as_py()
                _, found = find(text, model) if text else ([], [])
                spans.append([{"kind": KINDS[k], "start": a, "end": b, "base": k < 3} for a, b, k in found])
                texts.append(redacted(text, found) if found else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, spans_type), pa.array(texts, pa.string())], [*columns, "spans", "redacted"])

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return map_texts(docs.select(*columns, F.col(text_col).alias("__text")), run, f"{kept}, spans array<struct<kind:string,start:long,end:long,base:boolean>>, redacted string")


def redacted(text: str, spans: list[Span], mark: str = "[SECRET]") -> str:
    """The text with each run of overlapping spans replaced by a mark."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def digest(spans: list[tuple[str, int, int]]) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
