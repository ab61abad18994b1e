"""Operator 5: benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of every benchmark item (an item
of fewer words is one window of its own length). Per pattern length, a shift table tells
for each block of two words how far the search may jump: blocks in no pattern allow the
largest jump, so most positions are never looked at. Where the shift is 0, the block's
suffix bucket gives the few patterns that end there, and a direct comparison of all their
words confirms an occurrence.

The benchmark is a stated query set. It is split by a hash of the item into blocks of
about ``BLOCK_WORDS`` words; one block at a time is collected and sent to the tasks, and
the rows of ``documents`` pass through one search per block in the same stage, without a
shuffle. Nothing is cut off: more items only mean more blocks.

Cases: null and empty texts have no words and no hits; an item without words has no
window; a null item_id counts and its id is left out of ``items``; equal items and
repeated rows are all counted; only ``doc_id`` and ``text`` (``item_id`` and ``text``) are
read, so further columns of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import ALNUM_WORD, alnum_table, free_name, small

WINDOW = 10
BLOCK_WORDS = 500_000  #: benchmark words searched for in one pass


class WuManber:
    """Windows of a list of items, searched for in lists of words (bytes)."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], window: int = WINDOW):
        by_size: dict[int, dict[tuple[bytes, ...], set]] = {}
        for n, (_, words) in enumerate(items):
            size = min(window, len(words))
            for i in range(len(words) - size + 1 if size else 0):
                by_size.setdefault(size, {}).setdefault(tuple(words[i : i + size]), set()).add(n)
        self.tables = [(size, *self.table(size, pats)) for size, pats in sorted(by_size.items())]

    @staticmethod
    def table(size: int, patterns: dict) -> tuple[int, dict, dict]:
        """Block length, shift of each block, patterns by their last block."""
        width = min(2, size)
        shift: dict = {}
        bucket: dict = {}
        for p in patterns:
            for j in range(width - 1, size):
                block = p[j] if width == 1 else (p[j - 1], p[j])
                shift[block] = min(shift.get(block, size), size - 1 - j)
            bucket.setdefault(p[-1] if width == 1 else p[-2:], []).append(p)
        return width, shift, {b: [(p, patterns[p]) for p in ps] for b, ps in bucket.items()}

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Places (start, end) of occurrences, and the numbers of the items that have one."""
        places, found, n = [], set(), len(words)
        for size, width, shift, bucket in self.tables:
            jump, i = size - width + 1, size - 1
            get = shift.get
            while i < n:
                block = words[i] if width == 1 else (words[i - 1], words[i])
                s = get(block, jump)
                if s:
                    i += s
                    continue
                here = tuple(words[i - size + 1 : i + 1])
                for p, owners in bucket[block]:
                    if p == here:
                        places.append((i - size + 1, i + 1))
                        found |= owners
                i += 1
        return places, found


_TABLE = alnum_table()


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def merged(places: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(places):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def blocks(benchmark: DataFrame) -> Iterator[list]:
    """The items, one bounded block at a time."""
    b = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    words = b.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    parts = max(1, -(-words // (5 * BLOCK_WORDS)))
    for k in range(parts):
        yield [(r["item_id"], r["text"]) for r in b.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k).collect()]


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, list[str]]:
    """``docs`` with its columns as they are plus three, and these columns' names: the
    number of words, the maximal hit word ranges (start, end, start, end ...) and the ids
    of the items with an occurrence."""
    extra = [free_name(docs.columns, n) for n in ("bench_words", "bench_spans", "bench_items")]
    empty = F.array().cast("array<long>")
    df = docs.withColumns(dict(zip(extra, (F.lit(None).cast("long"), empty, empty))))
    for block in blocks(benchmark):
        df = df.mapInArrow(search_block(docs.sparkSession.sparkContext.broadcast(block), window, extra), df.schema)
    return df, extra


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, that hold no benchmark window."""
    found, (_, spans, _) = find(docs, benchmark)
    return found.where(F.size(spans) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def search_block(sent, window: int, extra: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = [i for i, _ in sent.value]
        engine = WuManber([(i, words_of(t)) for i, t in sent.value], window)
        for b in small(batches, 1024):
            at = {n: b.schema.names.index(n) for n in ("text", *extra)}
            _, at_spans, at_items = (at[n] for n in extra)
            n_words, spans, items = [], [], []
            old = zip(b.column(at_spans).to_pylist(), b.column(at_items).to_pylist())
            for text, (s, i) in zip(b.column(at["text"]).to_pylist(), old):
                words = words_of(text)
                places, found = engine.search(words)
                n_words.append(len(words))
                if places:
                    s = [x for p in merged([*zip(s[::2], s[1::2]), *places]) for x in p]
                    i = sorted({*i, *(ids[k] for k in found if ids[k] is not None)})
                spans.append(s)
                items.append(i)
            cols = list(b.columns)
            for name, values, kind in zip(extra, (n_words, spans, items), (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))):
                cols[at[name]] = pa.array(values, kind)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return run


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's columns of every row."""
    found, _ = find(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), benchmark)
    span = F.transform(F.sequence(F.lit(0), (F.size("bench_spans") / 2).cast("int") - 1), lambda i: F.get("bench_spans", 2 * i + 1) - F.get("bench_spans", 2 * i))
    hit = F.when(F.size("bench_spans") > 0, F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x)).otherwise(F.lit(0).cast("long"))
    ids = F.array_join(F.array_sort(F.transform("bench_items", lambda i: i.cast("string"))), ",")
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB twin: all windows of documents and items, joined as strings."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({lower}, '{ALNUM_WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lower}, '{ALNUM_WORD}') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT item_id, w, least({window}, len(w)) AS k, unnest(range(1, len(w) - least({window}, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM p),
v AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT r, i, v.k, item_id FROM v JOIN p ON v.s = p.s AND v.k = p.k),
hw AS (SELECT r, count(DISTINCT x) AS n FROM (SELECT r, unnest(range(i, i + k)) AS x FROM h) GROUP BY r),
hi AS (SELECT r, count(*) AS n, string_agg(t, ',' ORDER BY t) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS t FROM h) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hw.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(hi.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(hi.ids, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN hi USING (r)"""
