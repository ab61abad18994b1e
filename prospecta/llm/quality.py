"""Operator 8: quality classifier by positive-unlabelled learning.

Trusted positives (label 1, outside the held-out fold) and unlabelled web text are
described by statistics of the whole text, each cut into bins at its quantiles. A linear
model over the bins minimises the non-negative unbiased risk

    prior * E_pos[loss(f, +1)] + max(0, E_unl[loss(f, -1)] - prior * E_pos[loss(f, -1)])

with the sigmoid loss; whenever the bracket turns negative, its gradient is taken back.
The class prior is estimated from the two samples alone: the least ratio, over thresholds
of a first positive-against-unlabelled fit, of the unlabelled share above the threshold to
the positives' share above it, both with a confidence margin.

Learning uses at most ``POSITIVES`` and ``UNLABELLED`` rows, chosen by a hash of the id.
Scores cover every row and the whole of each text.

Cases: null and empty text get the score of a text with all statistics at 0; without
positives or unlabelled rows every score is the prior 0.5; repeated rows and ties are
scored row by row; only ``doc_id`` and ``text`` are inputs of a score, so further columns
of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import crc_rest, small, store

POSITIVES = 10_000  #: most trusted positives that are learned from
UNLABELLED = 20_000  #: most unlabelled rows that are learned from
BINS = 12
THRESHOLD = 0.5

FEATURES = (
    "log_words", "log_word_length", "distinct_words", "repeated_neighbours", "longest_run", "common_word", "upper", "digits",
    "signs", "doubled_signs", "stops", "non_ascii", "lines", "repeated_lines", "words_with_signs", "bars", "short_words", "distinct_pairs",
)

_CLASS = np.zeros(256, np.int64)  # 0 other, 1 upper, 2 lower, 3 digit, 4 sign, 5 stop mark, 6 space, 7 non-ASCII
_CLASS[0x41:0x5B], _CLASS[0x61:0x7B], _CLASS[0x30:0x3A], _CLASS[0x80:] = 1, 2, 3, 7
for _c in range(0x21, 0x7F):
    if not chr(_c).isalnum():
        _CLASS[_c] = 5 if chr(_c) in ".,;:?'" else 4
_CLASS[[0x20, *range(0x09, 0x0E)]] = 6
_SIGN = bytes(c if _CLASS[c] == 4 else 0x20 for c in range(256))


def statistics(text: str | None) -> list[float]:
    """The statistics of ``FEATURES`` over the whole text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return [0.0] * len(FEATURES)
    n = len(words)
    raw = np.frombuffer(data, np.uint8)
    kinds = np.bincount(_CLASS[raw], minlength=8)
    letters = max(1, kinds[1] + kinds[2])
    visible = max(1, len(data) - kinds[6])
    signs = data.translate(_SIGN).split()
    same = np.fromiter((a == b for a, b in zip(words, words[1:])), np.bool_, n - 1)
    edges = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        math.log1p(n),
        math.log1p(visible / n),
        len(counts) / n,
        float(same.mean()) if n > 1 else 0.0,
        math.log1p(int(np.diff(edges).max()) - 1),
        max(counts.values()) / n if n > 4 else 0.0,
        kinds[1] / letters,
        kinds[3] / visible,
        kinds[4] / visible,
        sum(len(s) > 1 for s in signs) / n,
        kinds[5] / n,
        kinds[7] / visible,
        len(lines) / n,
        1.0 - len(set(lines)) / max(1, len(lines)),
        len(signs) / n,
        data.count(b" | ") / n,
        sum(c for w, c in counts.items() if len(w) < 3) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
    ]


class Model:
    """Bin edges per statistic, one weight per bin, a bias."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, bias: float, prior: float):
        self.edges, self.weights, self.bias, self.prior = edges, weights, bias, prior

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(self.edges):
            return np.full(len(x), 0.5)
        return 1 / (1 + np.exp(-np.clip(self.weights[bins(x, self.edges)].sum(1) + self.bias, -30, 30)))


def bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Number of the bin each statistic falls into; the statistics' bins follow each other."""
    first = np.cumsum([0, *(len(e) + 1 for e in edges)])
    return np.stack([first[k] + np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)], axis=1)


def quantile_edges(x: np.ndarray) -> list[np.ndarray]:
    """Distinct inner quantiles, closer together in both tails, of each statistic."""
    q = np.unique(np.concatenate([np.linspace(0, 1, BINS + 1)[1:-1], [0.005, 0.02, 0.04, 0.96, 0.98, 0.995]]))
    return [np.unique(np.quantile(x[:, k], q, method="lower")) for k in range(x.shape[1])]


class Additive:
    """Weights of the bins and a bias (the last entry), trained by Adam."""

    def __init__(self, size: int, rate: float, ridge: float):
        self.w, self.m, self.v, self.t = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1), 0
        self.rate, self.ridge = rate, ridge

    def __call__(self, rows: np.ndarray) -> np.ndarray:
        return self.w[rows].sum(1) + self.w[-1]

    def gradient(self, rows: np.ndarray, g: np.ndarray) -> np.ndarray:
        out = np.bincount(rows.ravel(), weights=np.repeat(g, rows.shape[1]), minlength=len(self.w))
        out[-1] = g.sum()
        return out

    def step(self, g: np.ndarray) -> None:
        self.t += 1
        g = g + self.ridge * self.w
        self.m, self.v = 0.9 * self.m + 0.1 * g, 0.999 * self.v + 0.001 * g * g
        self.w -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def first_fit(p: np.ndarray, u: np.ndarray, size: int, steps: int = 200) -> Additive:
    """Positive against unlabelled, logistic loss with equal class weights."""
    f = Additive(size, 0.05, 2e-4)
    for _ in range(steps):
        zp, zu = np.clip(f(p), -30, 30), np.clip(f(u), -30, 30)
        f.step(f.gradient(p, -1 / (1 + np.exp(zp)) / len(p)) + f.gradient(u, 1 / (1 + np.exp(-zu)) / len(u)))
    return f


def estimate_prior(sp: np.ndarray, su: np.ndarray) -> float:
    """Share of positives among the unlabelled from the scores of both samples."""
    cuts = np.quantile(sp, np.linspace(0.0, 0.9, 91))
    up = np.array([(su >= c).mean() for c in cuts])
    pos = np.array([(sp >= c).mean() for c in cuts])
    margin = math.sqrt(math.log(200.0) / 2) * (1 / math.sqrt(len(su)) + 1 / math.sqrt(len(sp)))
    ratio = (up + margin / 4) / np.maximum(pos, 1e-9)
    return float(np.clip(ratio.min(), 0.05, 0.98))


def fit(xp: np.ndarray, xu: np.ndarray, steps: int = 500, seed: int = 7) -> Model:
    """Non-negative risk minimisation in mini-batches."""
    edges = quantile_edges(np.vstack([xp, xu]))
    size = sum(len(e) + 1 for e in edges)
    p, u = bins(xp, edges), bins(xu, edges)
    half = len(p) // 2 if len(p) > 100 else 0
    first = first_fit(p[half:], u, size)
    seen = p[:half] if half else p  # positives the first fit hasn't seen
    prior = estimate_prior(first(seen), first(u))
    f, rng = Additive(size, 0.04, 1e-4), np.random.default_rng(seed)

    def loss(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sigmoid loss against the label -1 (the loss against +1 is the rest to 1) and its slope."""
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return s, s * (1 - s) / len(z)

    for _ in range(steps):
        bp, bu = p[rng.integers(0, len(p), min(len(p), 2048))], u[rng.integers(0, len(u), min(len(u), 4096))]
        (sp, gp), (su, gu) = loss(f(bp)), loss(f(bu))
        bracket = f.gradient(bu, gu) - f.gradient(bp, prior * gp)
        if su.mean() - prior * sp.mean() >= 0:
            f.step(bracket - f.gradient(bp, prior * gp))
        else:
            f.step(-bracket)
    return Model(edges, f.w[:-1], float(f.w[-1]), prior)


def held_out(col: Column) -> Column:
    return crc_rest(col, 3) == 1


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from at most ``POSITIVES`` labelled and ``UNLABELLED`` unlabelled rows for
    whose ids ``usable`` holds. Labels other than 1 aren't read."""
    order = (F.xxhash64("doc_id"), "doc_id")
    some = docs.where(F.col("doc_id").isNotNull() & usable).select("doc_id")
    chosen = labels.where(usable & (F.col("quality") == 1)).select("doc_id").orderBy(*order).limit(POSITIVES).select("doc_id", F.lit(1).alias("trusted"))
    chosen = chosen.unionByName(some.orderBy(*order).limit(UNLABELLED).select("doc_id", F.lit(0).alias("trusted")))
    chosen = chosen.distinct()  # POSITIVES + UNLABELLED rows at most: a bounded broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("trusted"), b.column("doc_id"), pa.array(list(x), pa.list_(pa.float64()))], names=["trusted", "doc_id", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("trusted", "doc_id", "text")
    found = store(found.mapInArrow(run, "trusted int, doc_id long, x array<double>"), "quality-sample")
    rows = found.dropDuplicates(["trusted", "doc_id"]).orderBy("trusted", *order).limit(POSITIVES + UNLABELLED).collect()
    xp, xu = (np.array([r["x"] for r in rows if r["trusted"] == k]).reshape(-1, len(FEATURES)) for k in (1, 0))
    if not len(xp) or not len(xu):
        return Model([], np.zeros(0), 0.0, 0.5)
    return fit(xp, xu)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 512):
            x = np.array([statistics(t) for t in b.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            s = model.scores(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    model = learn(docs, labels.select("doc_id", "quality"), ~held_out(F.col("doc_id")))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
