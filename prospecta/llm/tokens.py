"""Operator 9: token counts by the whole-token shortcut.

Before the job, every string of the vocabulary is put through the library's own
splitter and merges; those that come back as exactly one piece and one id are proven
*whole tokens*. A text is then cut into pre-tokens, whole tokens count 1 each without
any merging, and only the remaining pre-tokens are merged by the library (each distinct
one once per task, remembered in a bounded table).

Cases: null and empty text have 0 bytes and 0 tokens; special strings inside a text are
one token each, as is the library's default; repeated rows are counted row by row; an
empty table gives an empty result; only ``doc_id`` and ``text`` are read, so further
columns of any name don't matter. Very long texts are cut lazily, piece by piece.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospecta.llm.common import small

#: Fixed value: the splitting pattern of byte-level BPE vocabularies of this family.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Remembered pre-tokens per task; beyond it the table starts anew (results don't change).
REMEMBER = 300_000


def byte_letters() -> dict[str, int]:
    """Printable stand-in of each byte, as byte-level vocabularies write them: printable
    Latin-1 stands for itself, the other bytes follow from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def whole_tokens(spec: str) -> frozenset[str]:
    """Vocabulary strings proven to encode alone as one token."""
    tok = Tokenizer.from_str(spec)
    letters, cut = byte_letters(), regex.compile(SPLIT)
    texts = []
    for piece in tok.get_vocab(with_added_tokens=False):
        try:
            texts.append(bytes(letters[c] for c in piece).decode())
        except (KeyError, UnicodeDecodeError):  # part of a character: never a pre-token
            continue
    texts = [t for t in texts if (m := cut.match(t)) and m.end() == len(t)]
    return frozenset(t for t, e in zip(texts, tok.encode_batch(texts, add_special_tokens=False)) if len(e.ids) == 1)


class Counter(dict):
    """Pre-token -> number of tokens. Whole tokens are there from the start."""

    def __init__(self, spec: str, whole: frozenset[str]):
        super().__init__(dict.fromkeys(whole, 1))
        self.tok, self.whole = Tokenizer.from_str(spec), whole

    def __missing__(self, piece: str) -> int:
        if len(self) > len(self.whole) + REMEMBER:
            self.clear()
            self.update(dict.fromkeys(self.whole, 1))
        n = self[piece] = len(self.tok.model.tokenize(to_letters(piece)))
        return n


_LETTER = {b: c for c, b in byte_letters().items()}


def to_letters(piece: str) -> str:
    return "".join(map(_LETTER.__getitem__, piece.encode()))


def special_strings(spec: str) -> list[str]:
    return [t["content"] for t in json.loads(spec)["added_tokens"]]


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 1024) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row; ``vocabulary`` is the path of
    the tokenizer file. The file is read once by the driver and sent to the tasks (its
    size is fixed by the vocabulary, not by the data)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast((spec, whole_tokens(spec)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, whole = sent.value
        counts, cut = Counter(spec, whole), regex.compile(SPLIT)
        special = special_strings(spec)
        parts = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        get = counts.__getitem__

        def one(text: str | None) -> int:
            if not text:
                return 0
            n, pieces = 0, [text]
            if parts is not None and any(s in text for s in special):
                pieces = parts.split(text)
                n = len(pieces) - 1
            for p in pieces:
                if len(p) <= 1 << 20:
                    n += sum(map(get, cut.findall(p)))
                else:
                    n += sum(get(m.group()) for m in cut.finditer(p))
            return n

        for b in small(batches, 1024):
            text = b.column("text")
            n = [one(t) for t in text.to_pylist()]
            size = [0 if t is None else len(t) for t in text.cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
