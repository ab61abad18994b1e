"""Operator 2: toxicity by a weighted lexicon.

Texts are folded (compatibility forms, look-alike letters of other scripts, digits and
signs that stand for letters, invisible characters), then all lexicon entries are found
in one Aho-Corasick pass. Entries are whole words or word beginnings, each with a weight;
exception phrases cancel the entries they cover. The weighted sum, taken as it is and per
100 words, goes through a logistic curve.

Learning reads labels only of rows outside the held-out fold, at most ``LABELLED`` of
them (chosen by a hash of the id, so reruns agree): words and word beginnings that occur
in toxic texts far more often than in clean ones join the lexicon with their log odds,
and clean words that start like a toxic entry become exceptions. Everything after that
covers every row and the whole of each text.

Cases: null and empty text have no matches and get the score of a text without any;
without usable labels a fixed starting lexicon and curve are used; duplicate labels of an
id count once each; repeated rows are scored row by row; only ``doc_id`` and ``text`` are
inputs of a score, so further columns of any name don't matter; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import crc_rest, mix, small, store

LABELLED = 20_000  #: most labelled rows that are learned from
THRESHOLD = 0.3

# Letters of other scripts that look like Latin ones, and signs used as letters.
LOOK_ALIKE = (
    ("аɑα@4", "a"), ("вЬ8", "b"), ("сϲ", "c"), ("ԁ", "d"), ("еєɛε3", "e"), ("ɡ9", "g"), ("һн", "h"), ("іιı1!|", "i"),
    ("ј", "j"), ("кκ", "k"), ("ⅼӏ", "l"), ("мϻ", "m"), ("пո", "n"), ("оοσ0ө", "o"), ("рρ", "p"), ("ԛ", "q"), ("г", "r"),
    ("ѕ5$", "s"), ("тτ7", "t"), ("υս", "u"), ("νѵ", "v"), ("ѡω", "w"), ("хχ", "x"), ("уγ", "y"), ("ᴢ", "z"),
)
INVISIBLE = "­​‌‍⁠﻿"
#: Entries and weights to start from; learned weights replace them.
START = dict.fromkeys("idiot idiots moron morons stupid loser losers scum trash clown worthless pathetic disgusting".split(), 4.0)
#: Phrases in which an entry is harmless.
EXCEPTIONS = ("trash can", "trash cans", "trash bin", "trash bag", "clown fish", "clownfish", "clown car", "pond scum", "stupid simple")

_FOLD = {ord(c): to for chars, to in LOOK_ALIKE for c in chars} | dict.fromkeys(map(ord, INVISIBLE))
WORDS = re.compile(r"[^\W_]+")
#: Signs that are also punctuation stand for a letter only inside a word.
_EDGE = re.compile(r"(?<!\w)[!|@$]+|[!|@$]+(?!\w)")


def fold(text: str | None) -> str:
    """The folded text: lower case, look-alikes and letter signs as the letters they mean."""
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower()
    if any(c in text for c in "!|@$"):
        text = _EDGE.sub(" ", text)
    return text.translate(_FOLD)


class Lexicon:
    """Aho-Corasick automaton over entries (whole words and word beginnings) and exceptions."""

    def __init__(self, words: dict[str, float], starts: dict[str, float], exceptions: Iterable[str]):
        self.auto = ahocorasick.Automaton()
        found: dict[str, list] = {}
        for w, x in words.items():
            found.setdefault(w, []).append((len(w), x, True))
        for w, x in starts.items():
            found.setdefault(w, []).append((len(w), x, False))
        for w in exceptions:
            found.setdefault(w, []).append((len(w), None, True))
        for w, kinds in found.items():
            self.auto.add_word(w, tuple(kinds))
        if found:
            self.auto.make_automaton()
        self.empty = not found

    def matches(self, folded: str) -> list[tuple[int, int, float]]:
        """(start, end, weight) of entries at word boundaries that no exception covers;
        one per place, the longest entry winning."""
        if self.empty or not folded:
            return []
        best: dict[int, tuple[int, float]] = {}
        spared: list[tuple[int, int]] = []
        n = len(folded)
        for last, kinds in self.auto.iter(folded):
            for size, weight, whole in kinds:
                a, b = last - size + 1, last + 1
                if (a and folded[a - 1].isalnum()) or (whole and b < n and folded[b].isalnum()):
                    continue
                if weight is None:
                    spared.append((a, b))
                elif a not in best or size > best[a][0]:
                    best[a] = (size, weight)
        out, k, covered = [], 0, 0  # spans by their starts: how far those that start before an entry reach
        spared.sort()
        for a, (s, w) in sorted(best.items()):
            while k < len(spared) and spared[k][0] <= a:
                covered = max(covered, spared[k][1])
                k += 1
            if a >= covered:
                out.append((a, a + s, w))
        return out

    def features(self, text: str | None) -> tuple[float, float]:
        """Weighted sum of the matches, as it is and per 100 words (both on a log scale)."""
        folded = fold(text)
        found = self.matches(folded)
        if not found:
            return 0.0, 0.0
        total = sum(w for _, _, w in found)
        words = folded.count(" ") + folded.count("\n") + 1
        return math.log1p(total), math.log1p(100.0 * total / words)


class Model:
    def __init__(self, words, starts, exceptions, curve):
        self.parts, self.curve = (words, starts, exceptions, curve), curve
        self.lexicon = Lexicon(words, starts, exceptions)

    def score(self, text: str | None) -> float:
        a, b = self.lexicon.features(text)
        z = self.curve[0] + self.curve[1] * a + self.curve[2] * b
        return 1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, z))))


def learn_lexicon(sample: DataFrame) -> tuple[dict, dict, list]:
    """Entries from (text, toxic) rows: the words are counted per class by Spark, the few
    that pass the support and odds are collected."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in small(batches, 1024):
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                seen.update((w, toxic) for w in set(WORDS.findall(fold(text))))
            if len(seen) > 200_000:
                yield rows(seen)
                seen.clear()
        yield rows(seen)

    def rows(seen: Counter) -> pa.RecordBatch:
        keys = list(seen)
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int32()), pa.array([seen[k] for k in keys], pa.int64())], names=["word", "toxic", "n"])

    sums = (F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("good"))
    total = sample.agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")).first()
    if not total["bad"] or not total["good"]:
        return dict(START), {}, list(EXCEPTIONS)
    words = sample.select("text", "toxic").mapInArrow(count, "word string, toxic int, n long").groupBy("word").agg(*sums)
    words = store(words, "toxic-words")
    nb, ng = float(total["bad"]), float(total["good"])
    odds = F.log((F.col("bad") + 0.5) / (nb + 1)) - F.log((F.col("good") + 0.5) / (ng + 1))
    base = nb / (nb + ng)
    n, share = F.col("bad") + F.col("good"), F.col("bad") / (F.col("bad") + F.col("good"))
    # Evidence against a term being as toxic as any other, beyond what chance finds among all terms.
    evidence = n * (share * F.log(share / base) + F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - base))).otherwise(0.0))

    def best(df: DataFrame, least: float) -> list:
        enough = math.log(max(1, df.count())) + 2.0
        return df.withColumn("odds", odds).where((F.col("bad") >= 2) & (F.col("odds") >= least) & (evidence >= enough)).orderBy(F.desc(F.col("bad") * F.col("odds")), "term").collect()

    whole = best(words.withColumnRenamed("word", "term"), math.log(20.0))
    size = F.explode(F.sequence(F.lit(4), F.least(F.length("word"), F.lit(10)))).alias("size")
    begun = words.where((F.length("word") >= 4) & ~F.col("word").isin([r["term"] for r in whole])).select("word", "bad", "good", size).groupBy(F.substring("word", 1, F.col("size")).alias("term"))
    begun = best(begun.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("forms")).where("forms >= 3"), math.log(40.0))
    starts: dict[str, float] = {}
    for r in sorted(begun, key=lambda r: (len(r["term"]), r["term"])):  # the shortest beginning stands for the longer ones
        if not any(r["term"][:k] in starts for k in range(4, len(r["term"]))):
            starts[r["term"]] = float(r["odds"])
    entries = dict(START) | {r["term"]: float(r["odds"]) for r in whole}
    clean: list[str] = []
    if starts:  # words of clean texts that begin like an entry
        begin = F.lit(False)
        for k in sorted({len(x) for x in starts}):
            begin = begin | F.substring("word", 1, k).isin([x for x in starts if len(x) == k])
        clean = [r["word"] for r in words.where(begin & (F.col("good") > F.col("bad"))).orderBy(F.desc("good"), "word").collect()]
    return entries, starts, [*EXCEPTIONS, *clean]


def fit_curve(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression by Newton steps with a small ridge, each row counting ``n``
    times; slopes aren't negative."""
    a = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = a.T @ (a * (n * (p * (1 - p) + 1e-6))[:, None]) + np.eye(3) * 0.05
        w -= np.linalg.solve(h, a.T @ (n * (p - y)) + 0.05 * w)
    return float(w[0]), max(0.0, float(w[1])), max(0.0, float(w[2]))


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds two minimal hashes of the five-word shingles: near copies mostly share one."""
    for b in small(batches, 1024):
        g: tuple[list, list] = ([], [])
        for text in b.column("text").to_pylist():
            words = (text or "").lower().split()
            crcs = np.array([zlib.crc32(" ".join(words[i : i + 5]).encode()) for i in range(max(1, len(words) - 4))], np.uint64)
            for out, k in zip(g, (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)):
                out.append(int((mix(crcs ^ np.uint64(k)) >> np.uint64(1)).min()))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), b.column("toxic"), *(pa.array(x, pa.int64()) for x in g)], names=["doc_id", "text", "toxic", "g1", "g2"])


def learn(docs: DataFrame, labels: DataFrame, usable: Column) -> Model:
    """A model from at most ``LABELLED`` labelled rows for which ``usable`` holds."""
    chosen = labels.where(usable & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(LABELLED)  # so at most that many rows are broadcast
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    sample = sample.mapInArrow(signatures, "doc_id long, text string, toxic int, g1 long, g2 long")
    columns = ["doc_id", "toxic", "text", "g1", "g2"]
    for g in ("g1", "g2"):  # near copies would pass their rare words off as a class's words: the least row of each stays
        sample = sample.groupBy(F.col(g).alias("_g")).agg(F.min(F.struct(*columns)).alias("r")).select("r.*")
    sample = store(sample, "toxic-texts")
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))
    words, starts, exceptions = learn_lexicon(sample.where(part > 0))
    sample = sample.where(part == 0)
    curve = (-3.5, 1.0, 1.0)
    lexicon_parts = (words, starts, exceptions)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*lexicon_parts)
        for b in small(batches, 1024):
            x = [lex.features(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in x], pa.float64()), pa.array([p[1] for p in x], pa.float64()), b.column("toxic"), b.column("doc_id"), b.column("g1")], names=["a", "b", "toxic", "doc_id", "g1"])

    # Rows with one id may repeat without bound: one of each counts, so at most LABELLED are collected.
    got = sample.select("text", "toxic", "doc_id", "g1").mapInArrow(features, "a double, b double, toxic int, doc_id long, g1 long")
    got = got.groupBy("doc_id", "toxic").agg(F.min_by(F.struct("a", "b"), "g1").alias("x")).groupBy("x.a", "x.b", "toxic").count().orderBy("a", "b", "toxic").collect()
    if {r["toxic"] for r in got} == {0, 1}:
        curve = fit_curve(np.array([[r["a"], r["b"]] for r in got]), *(np.array([float(r[k]) for r in got]) for k in ("toxic", "count")))
    return Model(words, starts, exceptions, curve)


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, toxic_score, toxic_predicted) of every row."""
    parts = model.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts)
        for b in small(batches, 1024):
            s = [m.score(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.float64()), pa.array([int(x >= threshold) for x in s], pa.int32())], names=["doc_id", "toxic_score", "toxic_predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, toxic_score double, toxic_predicted int")


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that aren't predicted toxic."""
    parts = model.parts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*parts)
        for b in small(batches, 1024):
            yield b.filter(pa.array([m.score(t) < threshold for t in b.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out(col: Column) -> Column:
    return crc_rest(col, 4) == 2


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    model = learn(docs, labels, ~held_out(F.col("doc_id")))
    return score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
