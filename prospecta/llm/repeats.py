"""Operator 4: removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else (in any
document, the same one included) is removed; matches never cross documents and are judged
on the input.

1. Segments. For each string of LENGTH bytes take the least hash of its ``GRAM``-byte
   parts. Equal strings have equal least hashes, so cutting a text where that value
   changes gives segments such that equal strings always lie in segments of equal value.
   A segment is known by its value and a hash of its whole text.
2. Copies. Segments with the same value and text are repeats as they are. Only values with
   several different texts (or one that recurs inside its segment) need more.
3. Shards. One text of each such segment goes to a shard by its value. Each shard builds
   suffix arrays over blocks of at most ``BLOCK`` bytes by Larsson-Sadakane refinement in
   numpy (ranks of h bytes give ranks of 2h; suffixes that are alone aren't sorted again),
   takes common prefixes by Kasai's rule along the diagonals, and marks the strings whose
   neighbour shares LENGTH bytes.
4. Merging. A value with more than ``BLOCK`` bytes of different segments is spread over
   several shards. Each hands out its strings' hashes as sorted runs cut into ranges of the hash;
   for every range the runs of all shards are merged by binary search and those found in
   two shards go back. No shard or range grows with the group.

Documents are known by a digest of their text, so copies share their spans. Cases: null
and empty text and texts shorter than LENGTH lose nothing; repeated rows are copies of each
other and lose all bytes if they are long enough; only ``text`` (and ``doc_id`` for the
report) is read, so further columns of any name don't matter; an empty table gives an
empty result. Long documents are handled whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import free_name, mix, powers, small, store, text_bytes

LENGTH = 400
GRAM = 32
PIECE = 16_384  #: strings of one segment; longer runs are cut into pieces
BLOCK = 2 << 20  #: bytes of one suffix array


# -- segments ---------------------------------------------------------------------------


def prefix_hash(data: np.ndarray) -> np.ndarray:
    pw, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=out[1:])
    return out


def span_hash(pre: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, end), the same wherever the span stands."""
    _, inv = powers(len(pre))
    return mix((pre[end] - pre[start]) * inv[start] + (end - start).astype(np.uint64))


def gram_hashes(pre: np.ndarray, gram: int) -> np.ndarray:
    """``span_hash`` of every string of ``gram`` bytes."""
    _, inv = powers(len(pre))
    return mix((pre[gram:] - pre[:-gram]) * inv[: len(pre) - gram] + np.uint64(gram))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours (block-wise running minima from both sides)."""
    n = len(x) - width + 1
    pad = -len(x) % width
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, width)
    right = np.minimum.accumulate(full, axis=1).ravel()
    left = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(left[:n], right[width - 1 : width - 1 + n])


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(value, text hash, start, end, recurs) of the segments of one text. Segment
    [start, end) holds the strings that begin in [start, end - length]; ``recurs``: its
    value occurs at several places, so that a string may repeat inside."""
    n = len(data)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z.astype(np.uint64), z, z, z.astype(bool)
    raw = np.frombuffer(data, np.uint8)
    pre = prefix_hash(raw)
    grams = gram_hashes(pre, gram)
    least = sliding_min(grams, length - gram + 1)
    cut = np.flatnonzero(least[1:] != least[:-1]) + 1
    start = np.concatenate(([0], cut))
    size = np.diff(np.append(start, len(least)))
    if size.max() > PIECE:
        start = np.concatenate([np.arange(a, a + k, PIECE) for a, k in zip(start, size)])
    last = np.append(start[1:], len(least)) - 1
    value, end = least[start], last + length
    recurs = np.zeros(len(start), bool)
    for i in np.flatnonzero(last - start >= 1):
        recurs[i] = np.count_nonzero(grams[start[i] : end[i] - gram + 1] == value[i]) > 1
    return value, span_hash(pre, start, end), start, end, recurs


SEGMENT = "key binary, value long, text_hash long, start long, end long, recurs boolean"


def digest(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def find_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 512):
        keys, parts = [], []
        for data in text_bytes(b.column("text")):
            if len(data) >= LENGTH:
                parts.append(segments(data))
                keys += [digest(data)] * len(parts[-1][0])
        if parts:
            v, h, s, e, r = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(v.view(np.int64)), pa.array(h.view(np.int64)), pa.array(s), pa.array(e), pa.array(r)], names=["key", "value", "text_hash", "start", "end", "recurs"])


# -- suffix arrays ----------------------------------------------------------------------


def eight_bytes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as numbers in the bytes' order."""
    k = np.concatenate([data, np.zeros(7, np.uint8)]).astype(np.uint64)
    for width, shift in ((1, 8), (2, 16), (4, 32)):
        k = (k[:-width] << np.uint64(shift)) | k[width:]
    return k


def first_of_run(differs: np.ndarray) -> np.ndarray:
    """Index of the first member of each member's run; ``differs`` is set at first members."""
    return np.maximum.accumulate(np.where(differs, np.arange(len(differs)), 0))


def changes(x: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], x[1:] != x[:-1]))[: len(x)]


def suffix_order(key: np.ndarray, room: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with at least ``length`` bytes left (``room``), in the order of their first
    ``length`` bytes, and whether each agrees with the one before it over the last power
    of two below ``length``. Larsson-Sadakane: ranks over h bytes, taken h bytes further
    on, order the members of each group over 2h bytes; single members are left alone."""
    order = np.flatnonzero(room >= 8)
    order = order[np.argsort(key[order])]
    rank = np.zeros(len(room), np.int64)
    first = changes(key[order])
    rank[order] = first_of_run(first)
    h = 8
    while h < length:
        step = min(h, length - h)
        order = order[room[order] >= h + step]
        first = changes(rank[order])
        tied = ~(first & np.append(first[1:], True))
        slots = np.flatnonzero(tied)
        active = order[slots]
        pair = rank[active] * np.int64(len(room) + 1) + rank[active + step]
        by = np.argsort(pair)
        order[slots], pair = active[by], pair[by]
        before = first.copy()  # groups over h bytes
        first[slots] = changes(pair)
        rank[order] = first_of_run(first)
        h += step
    return order, ~before if length > 8 else ~first


def common_prefixes(key: np.ndarray, room: np.ndarray, order: np.ndarray, close: np.ndarray, length: int) -> np.ndarray:
    """Length of the common prefix of each place in ``order`` with the one before it, where
    ``close`` says it is worth counting (else 0). Kasai's rule: a place and its neighbour
    one byte on share one byte less, so only the first pair of a diagonal is compared."""
    out = np.zeros(len(order), np.int64)
    slots = np.flatnonzero(close)
    if not len(slots):
        return out
    by = np.argsort(order[slots])
    slots = slots[by]
    i, j = order[slots], order[slots - 1]
    head = np.concatenate(([True], (i[1:] != i[:-1] + 1) | (j[1:] != j[:-1] + 1)))
    a, b = i[head], j[head]
    chain = np.diff(np.append(np.flatnonzero(head), len(i)))
    most = np.minimum(np.minimum(room[a], room[b]), length + chain)  # more isn't asked of the diagonal
    shared = np.zeros(len(a), np.int64)
    live = np.arange(len(a))
    while len(live):
        x = key[a[live] + shared[live]] ^ key[b[live] + shared[live]]
        same = x == 0
        part = live[~same]
        if len(part):  # equal leading bytes of the first eight that differ
            y, n = x[~same], np.zeros(len(part), np.int64)
            for k in range(1, 8):
                n += (y >> np.uint64(64 - 8 * k)) == 0
            shared[part] += n
        live = live[same]
        shared[live] += 8
        live = live[shared[live] < most[live]]
    shared = np.minimum(shared, most)
    out[slots] = np.repeat(shared, chain) - (np.arange(len(i)) - np.repeat(np.flatnonzero(head), chain))
    return out


def repeated_places(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text, the places whose string of ``length`` bytes occurs elsewhere in the
    block (the same text included)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum(sizes)
    room = np.repeat(ends, sizes) - np.arange(len(data))
    # the pad lets a comparison start at the very end of the data
    key = np.concatenate([eight_bytes(data), np.zeros(8, np.uint64)])
    order, close = suffix_order(key, room, length)
    long = common_prefixes(key, room, order, close, length) >= length
    mark = np.zeros(len(data), bool)
    mark[order[long]] = True
    mark[order[np.flatnonzero(long) - 1]] = True
    return [np.flatnonzero(mark[e - n : e]) for e, n in zip(ends, sizes)]


def covered(places: np.ndarray, length: int) -> list[int]:
    """Union of [p, p + length) over sorted places: start, end, start, end ..."""
    if not len(places):
        return []
    gap = np.flatnonzero(places[1:] > places[:-1] + length)
    starts, ends = places[np.append(0, gap + 1)], places[np.append(gap, len(places) - 1)] + length
    return np.column_stack([starts, ends]).ravel().tolist()


# -- shards -----------------------------------------------------------------------------

SPANS = "key binary, spans array<long>, value long, shard long, range long, hashes binary"


def span_rows(keys: list, spans: list) -> pa.RecordBatch:
    none = [None] * len(keys)
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(spans, pa.list_(pa.int64())), *(pa.array(none, pa.int64()) for _ in range(3)), pa.array(none, pa.binary())], names=["key", "spans", "value", "shard", "range", "hashes"])


def run_rows(rows: list) -> pa.RecordBatch:
    value, shard, part, hashes = (list(x) for x in zip(*rows))
    none = [None] * len(rows)
    return pa.RecordBatch.from_arrays([pa.array(none, pa.binary()), pa.array(none, pa.list_(pa.int64())), *(pa.array(x, pa.int64()) for x in (value, shard, part)), pa.array(hashes, pa.binary())], names=["key", "spans", "value", "shard", "range", "hashes"])


def groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple[tuple, list[dict]]]:
    """Rows of equal values of ``names``, which follow each other."""
    now, held = None, []
    for b in small(batches, 256):
        for row in b.to_pylist():
            key = tuple(row[n] for n in names)
            if key != now and held:
                yield now, held
                held = []
            now = key
            held.append(row)
    if held:
        yield now, held


def string_hashes(data: bytes, length: int = LENGTH) -> np.ndarray:
    return gram_hashes(prefix_hash(np.frombuffer(data, np.uint8)), length)


def search_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Suffix arrays over the values of a shard, several values to a block; hands out the
    spans of segments that occur once, and sorted runs of hashes of the split values."""

    def block(rows: list[dict]) -> pa.RecordBatch | None:
        keys, spans = [], []
        for r, p in zip(rows, repeated_places([r["data"] for r in rows])):
            if len(p) and r["copies"] == 1:
                keys.append(r["key"])
                spans.append([x + r["start"] for x in covered(p, LENGTH)])
        return span_rows(keys, spans)

    rows: list[dict] = []
    size = 0
    for (value, shard), held in groups(batches, "value", "shard"):
        n = sum(len(r["data"]) for r in held)
        if rows and size + n > BLOCK:
            yield block(rows)
            rows, size = [], 0
        rows += held
        size += n
        if held[0]["shards"] > 1:
            h = np.unique(np.concatenate([string_hashes(r["data"]) for r in held]))
            parts = held[0]["shards"]
            cut = np.searchsorted(h, [np.uint64((k << 64) // parts) for k in range(1, parts)])
            yield run_rows([(value, shard, k, x.tobytes()) for k, x in enumerate(np.split(h, cut)) if len(x)])
    if rows:
        yield block(rows)


def merge_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the runs of one value and range, the hashes that two shards have, for each shard."""
    for (value, part), held in groups(batches, "value", "range"):
        runs = [np.frombuffer(r["hashes"], np.uint64) for r in held]
        out = []
        whole = np.sort(np.concatenate(runs))
        twice = np.unique(whole[1:][whole[1:] == whole[:-1]])
        for r, run in zip(held, runs):
            at = np.searchsorted(run, twice)
            found = twice[run[np.minimum(at, len(run) - 1)] == twice] if len(twice) else twice
            if len(found):
                out.append((value, r["shard"], part, found.tobytes()))
        if out:
            yield run_rows(out)


def mark_split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of a split value's segments from the hashes that other shards have, too."""
    for _, held in groups(batches, "value", "shard"):
        found = [np.frombuffer(r["hashes"], np.uint64) for r in held if r["hashes"] is not None]
        if not found:
            continue
        known = np.sort(np.concatenate(found))
        keys, spans = [], []
        for r in held:
            if r["data"] is not None and r["copies"] == 1:
                h = string_hashes(r["data"])
                p = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h)
                if len(p):
                    keys.append(r["key"])
                    spans.append([x + r["start"] for x in covered(p, LENGTH)])
        if keys:
            yield span_rows(keys, spans)


# -- the whole --------------------------------------------------------------------------


def text_key(text):
    return F.unhex(F.substring(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256), 1, 32))


def cut_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The texts of the wanted segments of each document."""
    for b in small(batches, 256):
        rows = []
        for data, key, wanted in zip(text_bytes(b.column("text")), b.column("key").to_pylist(), b.column("wanted").to_pylist()):
            rows += [(w["value"], w["text_hash"], w["copies"], w["shards"], w["shard"], key, w["start"], data[w["start"] : w["end"]]) for w in wanted]
        for i in range(0, len(rows), 2048):
            cols = list(zip(*rows[i : i + 2048]))
            kinds = [pa.int64()] * 5 + [pa.binary(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["value", "text_hash", "copies", "shards", "shard", "key", "start", "data"])


CUT = "value long, text_hash long, copies long, shards long, shard long, key binary, start long, data binary"


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(key, spans) of the texts that lose bytes: spans as start, end, ... of the covered
    ranges (they may overlap each other); key as ``text_key`` makes it."""
    src = docs.select(F.col("text").cast("string").alias("text"))
    segs = store(src.mapInArrow(find_segments, SEGMENT), "repeat-segments")
    known = segs.groupBy("value", "text_hash").agg(F.count("*").alias("copies"), F.min(F.struct("key", "start", "end")).alias("one"), F.max("recurs").alias("recurs"))
    known = store(known, "repeat-known")
    values = known.groupBy("value").agg(F.count("*").alias("texts"), F.sum(F.col("one.end") - F.col("one.start")).alias("bytes"), F.max("recurs").alias("recurs"), F.min("copies").alias("least"))
    # A value needs its texts compared if it has several, or one that may repeat inside.
    values = values.where((F.col("texts") > 1) & (F.col("least") == 1) | F.col("recurs") & (F.col("least") == 1))
    values = values.select("value", F.ceil(F.col("bytes") / BLOCK).cast("long").alias("shards"))
    wanted = known.join(values, "value").withColumn("shard", F.pmod(F.col("text_hash"), F.col("shards")))
    part = F.struct("value", "text_hash", "copies", "shards", "shard", F.col("one.start").alias("start"), F.col("one.end").alias("end"))
    wanted = wanted.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(part).alias("wanted"))  # of one text
    cut = docs.select(text_key(F.col("text")).alias("key"), F.col("text").cast("string").alias("text")).where(F.length("text") > 0).join(wanted, "key")
    cut = cut.select("text", "key", "wanted").mapInArrow(cut_segments, CUT)
    # the copies of a document bring the same segments again
    cut = store(cut.groupBy("value", "text_hash").agg(*[F.first(c).alias(c) for c in ("copies", "shards", "shard", "key", "start", "data")]), "repeat-texts")
    dealt = cut.repartition("value", "shard").sortWithinPartitions("value", "shard", "text_hash")
    found = store(dealt.mapInArrow(search_shards, SPANS), "repeat-shards")
    spans = found.where("key IS NOT NULL").select("key", "spans")
    runs = found.where("key IS NULL")
    if not runs.isEmpty():
        back = runs.repartition("value", "range").sortWithinPartitions("value", "range").mapInArrow(merge_runs, SPANS).select("value", "shard", "hashes")
        both = cut.where("shards > 1").unionByName(back, allowMissingColumns=True)
        both = both.repartition("value", "shard").sortWithinPartitions("value", "shard").mapInArrow(mark_split, SPANS)
        spans = spans.unionByName(both.select("key", "spans"))
    copied = segs.join(known.where("copies > 1").select("value", "text_hash"), ["value", "text_hash"])
    copied = copied.select("key", F.array("start", "end").alias("spans"))
    return spans.unionByName(copied).groupBy("key").agg(F.flatten(F.collect_set("spans")).alias("spans"))


def union(spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal ranges covered by ``spans``."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])) if spans else ():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def keep(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    at, parts = 0, []
    for a, b in ranges:
        parts.append(data[at:a])
        at = b
    return b"".join([*parts, data[at:]])


def with_spans(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with its columns as they are plus a column of spans, and that column's name."""
    spans, own, key = (free_name(docs.columns, n) for n in ("repeat_spans", "repeat_own", "repeat_key"))
    found = repeated_spans(docs).select(F.col("key").alias(key), F.col("spans").alias(spans))
    return docs.withColumn(own, text_key(F.col("text"))).join(found, F.col(own) == F.col(key), "left").drop(own, key), spans


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated bytes taken out of ``text`` (``n_chars`` follows where it
    is there). A character that is cut in two is dropped; null texts stay null."""
    columns = docs.columns
    df, name = with_spans(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            names, cols = b.schema.names, list(b.columns)
            text, at = b.column("text").to_pylist(), names.index("text")
            for i, spans in enumerate(cols[names.index(name)].to_pylist()):
                if spans:
                    data = text[i].encode()
                    text[i] = keep(data, union(spans)).decode("utf-8", "ignore")
            cols[at] = pa.array(text, pa.string())
            yield pa.RecordBatch.from_arrays([cols[names.index(c)] for c in columns], names=columns)

    out = df.mapInArrow(run, docs.schema)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.coalesce(F.length("text").cast(kind), F.col("n_chars")))
    return out


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            size, removed, count, sha = [], [], [], []
            for data, spans in zip(text_bytes(b.column("text")), b.column(name).to_pylist()):
                ranges = union(spans)
                size.append(len(data))
                removed.append(sum(y - x for x, y in ranges))
                count.append(len(ranges))
                sha.append(hashlib.sha256(keep(data, ranges)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, count)), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    df, name = with_spans(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    return df.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
