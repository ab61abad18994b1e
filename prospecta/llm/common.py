"""Small helpers shared by the operators: table reads, label splits, byte tables,
Arrow batch plumbing and intermediate tables in the cluster's shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.session import scratch_path

#: ASCII white space, as the contracts spell it: [\x20\x09-\x0D]. ``bytes.split()`` uses the same set.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: Words of ASCII letters, digits and every non-ASCII character.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def crc_rest(col: Column, mod: int) -> Column:
    """crc32 of the id written as text, modulo ``mod``; a null id counts as empty text."""
    return F.pmod(F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")), F.lit(mod))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table to the shared folder and read it back: it cuts the
    lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, f"llm/{name}")
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def free_name(columns: list[str], name: str) -> str:
    """``name``, with underscores added until no column is called that."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def alnum_table() -> bytes:
    """Byte map that lower-cases A-Z and turns every separator of ``ALNUM_WORD`` into a
    space; UTF-8 bytes from 0x80 on are word bytes. After it, ``split()`` gives the words."""
    t = bytearray(b" " * 256)
    for b in range(256):
        if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80:
            t[b] = b
        elif 0x41 <= b <= 0x5A:
            t[b] = b + 32
    return bytes(t)


def lower_table() -> bytes:
    """Byte map that lower-cases A-Z only."""
    return bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def text_bytes(col: pa.Array) -> list[bytes]:
    """UTF-8 bytes of every text of a batch; null is the empty text."""
    return [b"" if x is None else x for x in col.cast(pa.large_binary()).to_pylist()]


def small(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and, unless a single row is larger,
    ``size`` bytes: bounds the memory of a step whatever the texts' lengths."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            parts = [b.slice(i, rows)]
            while parts:
                part = parts.pop()
                if part.num_rows > 1 and part.nbytes > size:
                    half = part.num_rows // 2
                    parts += [part.slice(half), part.slice(0, half)]
                else:
                    yield part


def word_hashes(data: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the maximal runs of word bytes in ``data`` (uint8), with the
    start and end of each run. Polynomial prefix sums modulo 2**64 with an odd base,
    made position independent by the base's inverse powers, then mixed with the length."""
    edge = np.diff(np.concatenate(([0], is_word.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start, end
    pw, inv = powers(len(data) + 1)
    pre = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * pw[: len(data)], out=pre[1:])
    h = (pre[end] - pre[start]) * inv[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56))), start, end


BASE = 0x9E3779B97F4A7C15
_POW: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64 (kept between calls)."""
    if "p" not in _POW or len(_POW["p"]) < n:
        n = max(n, 1 << 16)
        for key, b in (("p", BASE), ("i", pow(BASE, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _POW[key] = np.multiply.accumulate(p)
    return _POW["p"], _POW["i"]


def mix(h: np.ndarray) -> np.ndarray:
    """A full avalanche of 64-bit values (splitmix64 finaliser)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))
