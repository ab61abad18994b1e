"""Operator 13: BPE encoding and decoding without a merge loop.

A word is cut by walking the longest vocabulary strings that an Aho-Corasick automaton
finds at every place. A token may follow another only if the *pair* is compatible: if
BPE, run on the two tokens' letters, gives back those two tokens. Where none fits, the
walk takes the token's longest prefix that is a token, or steps back and marks the place
as dead; each place is marked at most once, so the walk is linear in the word. All
neighbouring pairs compatible means that the whole cut is the one that the merges give.

Compatibility is decided by undoing merges: the touching pieces of both sides are split,
latest merge first, and a merge across the border that would have come before a piece
was merged away into its own token makes the pair incompatible. Answers are kept in a
table (bounded; it starts anew when full).

Decoding joins the tokens' strings, taken from one block of bytes by an offset table.

Cases: null and empty text have no tokens and decode to the empty text; the added tokens'
strings inside a text are one token each, before normalisation, as is the library's
default; repeated rows are encoded row by row; an empty table gives an empty result; only
``doc_id`` and ``text`` are read, so further columns of any name don't matter. A very long
text is one row: its tokens are held as packed numbers, four bytes each, and decoded in
slices; words without an end are cut in linear time.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prospecta.llm.common import small
from prospecta.llm.tokens import byte_letters

#: Fixed values of vocabularies with word ends: the mark and the splitting pattern.
END = "</w>"
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: One character for ``END`` inside this module; no byte letter is this character.
MARK = "\ue000"
#: Remembered words and pairs per task; beyond it a table starts anew (results don't change).
REMEMBER = 400_000
#: Bytes of decoded text that are put together at once.
SLICE = 1 << 20
PACK = [struct.Struct(f"<{n}I").pack for n in range(33)]


class Encoder:
    """Token tables of one vocabulary. ``rank`` is the time a token is made by its merge
    (0 for letters), ``parts`` the two tokens that it is made of."""

    def __init__(self, spec: str):
        made = json.loads(spec)
        model = made["model"]
        self.ids: dict[str, int] = {s.replace(END, MARK): i for s, i in model["vocab"].items()}
        size = max(self.ids.values()) + 1
        self.text = [""] * size
        for s, i in self.ids.items():
            self.text[i] = s
        self.length = [len(s) for s in self.text]
        self.rank, self.parts = [0] * size, [(-1, -1)] * size
        self.merge: dict[tuple[int, int], int] = {}
        for r, m in enumerate(model["merges"], 1):
            a, b = (self.ids[x.replace(END, MARK)] for x in (m.split(" ") if isinstance(m, str) else m))
            t = self.ids[self.text[a] + self.text[b]]
            if (a, b) not in self.merge:
                self.merge[a, b] = t
                if not self.rank[t]:
                    self.rank[t], self.parts[t] = r, (a, b)
        if any(self.parts[t] != p for p, t in self.merge.items()):
            raise ValueError("two merges make the same token: a pair table can't tell them apart")
        # pairs are keyed by one number: tables without tuples cost the garbage collector nothing
        self.rank_of = {a * size + b: self.rank[t] for (a, b), t in self.merge.items()}
        self.left, self.right = [a for a, _ in self.parts], [b for _, b in self.parts]
        self.known: dict[int, bool] = {}
        self.tokens = size
        # tokens that the merges give for their own letters; no other can be in a result
        self.whole = [bool(s) for s in self.text]
        for t in sorted(range(size), key=self.rank.__getitem__):
            a, b = self.parts[t]
            if a >= 0:
                self.whole[t] = self.whole[a] and self.whole[b] and self.touch(a, b, self.rank[t])
        self.find = ahocorasick.Automaton()
        for s, i in self.ids.items():
            if self.whole[i]:
                self.find.add_word(s, i)
        self.find.make_automaton()
        self.shorter = [self._prefix(s) for s in self.text]
        self.special = {t["content"]: t["id"] for t in made["added_tokens"]}

    def _prefix(self, s: str) -> int:
        for n in range(len(s) - 1, 0, -1):
            i = self.ids.get(s[:n], -1)
            if i >= 0 and self.whole[i]:
                return i
        return -1

    def touch(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Do tokens ``a`` and ``b`` stay apart until time ``before``? Looks at the pieces
        that touch, from the last ones back to single letters. ``before`` is when one of
        the two is merged into its own token; a merge on the right at the same time comes
        after one across the border (leftmost first), so it allows for half a step more."""
        rank, rank_of, size = self.rank, self.rank_of, self.tokens
        while True:
            r = rank_of.get(a * size + b)
            if r is not None and r < before:
                return False
            ra, rb = rank[a], rank[b]
            if not ra and not rb:
                return True
            if ra > rb:
                before, a = ra, self.right[a]
            else:
                before, b = rb + 0.5, self.left[b]

    def pair(self, a: int, b: int) -> bool:
        ok = self.known.get(a * self.tokens + b)
        if ok is None:
            if len(self.known) >= REMEMBER:
                self.known.clear()
            ok = self.known[a * self.tokens + b] = self.touch(a, b)
        return ok

    def encode(self, word: str) -> list[int]:
        """Tokens of one word in byte letters, its end marked by ``MARK``."""
        n = len(word)
        longest = [-1] * (n + 1)
        length, shorter, known, pair, size = self.length, self.shorter, self.known, self.pair, self.tokens
        for end, t in self.find.iter(word):
            longest[end + 1 - length[t]] = t  # ends grow, so the last one is the longest
        dead = bytearray(n + 1)
        out: list[int] = []
        at, t = 0, longest[0]
        while at < n:
            while t >= 0:
                if not dead[at + length[t]]:
                    if not out:
                        break
                    ok = known.get(out[-1] * size + t)
                    if ok or ok is None and pair(out[-1], t):
                        break
                t = shorter[t]
            if t >= 0:
                out.append(t)
                at += length[t]
                t = longest[at]
            elif out:
                dead[at] = 1
                t = out.pop()
                at -= length[t]
            else:
                raise ValueError(f"the vocabulary has no letters for {word!r}")
        return out


class Words(dict):
    """Word -> its ids as little-endian 32-bit numbers (bounded, it starts anew when full)."""

    def __init__(self, encoder: Encoder):
        super().__init__()
        self.encoder = encoder
        self.letters = {b: c for c, b in byte_letters().items()}

    @staticmethod
    def pack(*ids: int) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBER:
            self.clear()
        letters = word.encode().decode("latin-1").translate(self.letters)
        ids = self.encoder.encode(letters + MARK)
        packed = self.pack(*ids) if len(ids) > 32 else PACK[len(ids)](*ids)
        if len(word) < 256:
            self[word] = packed
        return packed


class Table:
    """Bytes of every token by id: one block and the offsets into it, each string with the
    space that the library's decoder-less join puts between tokens."""

    def __init__(self, encoder: Encoder):
        text = {i: s.replace(MARK, END) for i, s in enumerate(encoder.text) if s}
        text |= {i: s for s, i in encoder.special.items()}
        strings = [(text[i] + " ").encode() if i in text else b"" for i in range(max(text) + 1)]
        self.block = np.frombuffer(b"".join(strings), np.uint8)
        self.size = np.array([len(s) for s in strings], np.int64)
        self.offset = np.cumsum(self.size) - self.size

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """The tokens' strings with a space after each, some tokens at a time."""
        size = self.size[ids]
        cut = np.searchsorted(np.cumsum(size), np.arange(SLICE, int(size.sum()) + SLICE, SLICE)) + 1
        for i, j in zip(np.concatenate(([0], cut)), cut):
            n, start = size[i:j], self.offset[ids[i:j]]
            if len(n):
                first = np.cumsum(n) - n
                yield self.block[np.arange(n.sum()) + np.repeat(start - first, n)].tobytes()


@functools.lru_cache(maxsize=2)
def encoder_of(spec: str) -> Encoder:
    return Encoder(spec)


class Splitter:
    """Normalised words of a text: NFC, lower case character by character (no rule of final
    letters), white space dropped. Texts with code points that this Python's Unicode tables
    don't know are normalised and split by the library, whose tables may be newer; for all
    others the rules here equal the library's."""

    def __init__(self, spec: str):
        self.cut = regex.compile(SPLIT)
        self.assigned: set[str] = set()
        self.library = Tokenizer.from_str(spec)
        letters = byte_letters()
        self.bytes = {ord(c): b for c, b in letters.items()}

    def ordinary(self, text: str) -> bool:
        new = set(text) - self.assigned
        self.assigned.update(c for c in new if unicodedata.category(c) != "Cn")
        return new <= self.assigned

    def words(self, text: str) -> Iterator[str]:
        if text.isascii():
            text = text.lower()
        elif self.ordinary(text):
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        else:
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return (bytes(self.bytes[ord(c)] for c in p).decode() for p, _ in pieces)
        if len(text) <= 1 << 20:
            return iter(self.cut.findall(text))
        return (m.group() for m in self.cut.finditer(text))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_tokens, ids, ids_sha256, decoded_sha256, n_decoded) of every row; ``ids``
    holds the token numbers, little-endian and 32 bits wide. ``vocabulary`` is the path of the
    tokenizer file; it is read by the driver and sent to the tasks (its size doesn't grow
    with the data)."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    sent = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder_of(sent.value)
        words, split, table = Words(coder), Splitter(sent.value), Table(coder)
        get = words.__getitem__
        special = {s: np.array([i], "<u4").tobytes() for s, i in coder.special.items()}
        parts = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

        def one(text: str | None) -> bytes:
            if not text:
                return b""
            if not any(s in text for s in special):
                return b"".join(map(get, split.words(text)))
            return b"".join(special[p] if p in special else b"".join(map(get, split.words(p))) for p in parts.split(text))

        def decoded(ids: np.ndarray) -> tuple[str, int]:
            h, n, held = hashlib.sha256(), 0, b""
            for piece in table.decode(ids):
                h.update(held)
                held = piece
                n += len(piece)
            h.update(held[:-1])  # no space after the last token
            return h.hexdigest(), max(n - 1, 0)

        for b in small(batches, 256):
            packed = [one(t) for t in b.column("text").to_pylist()]
            texts = [decoded(np.frombuffer(p, "<u4")) for p in packed]
            columns = [
                b.column("doc_id"),
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array(packed, pa.binary()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([h for h, _ in texts], pa.string()),
                pa.array([n for _, n in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256", "n_decoded"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_tokens long, ids binary, ids_sha256 string, decoded_sha256 string, n_decoded long")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``text`` of rows with ``doc_id`` and ``ids`` as ``encode`` gives them (null ids: null)."""
    with open(vocabulary, encoding="utf-8") as f:
        sent = encoded.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(encoder_of(sent.value))
        for b in small(batches, 256):
            texts = [None if p is None else b"".join(table.decode(np.frombuffer(p, "<u4")))[:-1].decode() for p in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    src = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids"))
    return src.mapInArrow(run, "doc_id long, text string")
