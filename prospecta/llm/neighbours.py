"""Operator 10: nearest neighbours by randomly rotated one-bit codes.

Index: every vector is centred, rotated by a fixed random orthogonal matrix and kept as
the packed signs of its coordinates, with two scalars: the length of the centred vector
and the inner product of its direction with its code. Search: the inner product with a
query is estimated from the packed bits and the scalars; the estimate's error bound gives
a smallest and a largest possible distance. A vector whose smallest possible distance is
above the k-th best distance known so far is skipped; all others are reranked by their
exact distance on the original vectors, in double precision.

Every row is indexed. Queries are taken in blocks of ``BLOCK`` rows; a block is the only
thing that is collected and sent out, and each task returns at most k rows per query.

Cases: vectors that are null, empty, zero or hold null or non-finite components take no
part, nor do rows without an id and vectors of another length than the most common one
(ties: the shorter). Rows that share the query's id are the query's own. Equal vectors
tie and the smaller id comes first. Fewer candidates than k give fewer rows; an empty
table gives an empty result. Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import small, store

BLOCK = 4096  #: queries searched for in one pass
ROWS = 2048  #: vectors estimated at a time
PAIRS = 50_000  #: pairs reranked at a time
EPSILON = 4.0  #: width of the error bound, in its standard units
SEED = 20240


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix, the same wherever it is made."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def usable(df: DataFrame) -> DataFrame:
    """(vec_id, v) of the rows that take part, whatever their length."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    df = df.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull())
    return df.where(fine & F.exists("v", lambda x: x != 0))


def matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def encode(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed signs, lengths and code products of vectors."""
    r = x - centre
    length = np.sqrt((r * r).sum(1))
    u = (r / np.where(length > 0, length, 1.0)[:, None]) @ turn
    product = np.abs(u).sum(1) / np.sqrt(x.shape[1])
    return np.packbits(u > 0, axis=1), length, np.where(product > 0, product, 1.0)


def build(vectors: DataFrame) -> tuple[DataFrame, int, np.ndarray]:
    """The index (vec_id, v, code, length, product), the dimension and the centre."""
    dims = vectors.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return vectors, 0, np.zeros(0)
    dim = dims[0]["dim"]
    vectors = vectors.where(F.size("v") == dim)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(dim), 0
        for b in batches:
            total, n = total + matrix(b.column("v")).sum(0), n + b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total), pa.array(np.full(dim, n))], names=["i", "s", "n"])

    parts = vectors.select("v").mapInArrow(sums, "i long, s double, n long").groupBy("i").agg((F.sum("s") / F.sum("n")).alias("mean")).orderBy("i").collect()
    centre, turn = np.array([r["mean"] for r in parts]), rotation(dim)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, ROWS):
            bits, length, product = encode(matrix(b.column("v")), centre, turn)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in bits], pa.binary()), pa.array(length), pa.array(product)], names=["vec_id", "v", "code", "length", "product"])

    return store(vectors.mapInArrow(code, "vec_id long, v array<double>, code binary, length double, product double"), "vector-index"), dim, centre


class Best:
    """The k best (distance, id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.q = k, queries
        self.d, self.id = np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, q: np.ndarray, d: np.ndarray, ids: np.ndarray) -> None:
        hit = np.unique(q)
        q = np.concatenate([q, np.repeat(hit, self.k)])
        d = np.concatenate([d, self.d[hit].ravel()])
        ids = np.concatenate([ids, self.id[hit].ravel()])
        order = np.lexsort((ids, d, q))
        q, d, ids = q[order], d[order], ids[order]
        first = np.searchsorted(q, hit)
        rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
        keep = rank < self.k
        self.d[q[keep], rank[keep]], self.id[q[keep], rank[keep]] = d[keep], ids[keep]


def search_block(sent, centre: np.ndarray, dim: int, k: int, epsilon: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        turn = rotation(dim)
        r = q - centre
        away = np.sqrt((r * r).sum(1))
        v = ((r / np.where(away > 0, away, 1.0)[:, None]) @ turn).astype(np.float32)
        total, best = v.sum(1), Best(len(q), k)
        for b in small(batches, ROWS):
            x, own = matrix(b.column("v")), np.asarray(b.column("vec_id"))
            code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(len(own), -1)
            length, product = np.asarray(b.column("length")), np.asarray(b.column("product"))
            for at in range(0, len(q), 512):
                part = slice(at, at + 512)
                bits = np.unpackbits(code, axis=1, count=dim).astype(np.float32)
                inner = (2 * (bits @ v[part].T) - total[part]) / np.sqrt(dim) / product[:, None]
                error = (epsilon / np.sqrt(max(1, dim - 1))) * np.sqrt(np.maximum(0.0, 1 - product**2)) / product
                scale = 2 * length[:, None] * away[None, part]
                square = length[:, None] ** 2 + away[None, part] ** 2
                low = square - scale * np.minimum(1.0, inner + error[:, None])
                high = square - scale * np.maximum(-1.0, inner - error[:, None])
                high[own[:, None] == ids[None, part]] = np.inf
                known = best.d[part, -1] ** 2
                if len(own) > k:
                    known = np.minimum(known, np.partition(high, k - 1, axis=0)[k - 1])
                i, j = np.nonzero((low <= known * (1 + 1e-5) + 1e-12) & (own[:, None] != ids[None, part]))
                for s in range(0, len(i), PAIRS):
                    ii, jj = i[s : s + PAIRS], j[s : s + PAIRS] + at
                    best.add(jj, np.sqrt(((x[ii] - q[jj]) ** 2).sum(1)), own[ii])
        n, rank = np.nonzero(np.isfinite(best.d))
        yield pa.RecordBatch.from_arrays([pa.array(n), pa.array(ids[n]), pa.array(best.id[n, rank]), pa.array(best.d[n, rank])], names=["q", "query_id", "vec_id", "score"])

    return run


def search(table: DataFrame, is_query: Column, k: int = 10, epsilon: float = EPSILON) -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows for which ``is_query`` (over vec_id)
    holds, against all rows."""
    index, dim, centre = build(usable(table))
    spark = table.sparkSession
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    queries = index.where(is_query).select("vec_id", "v")
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for n in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == n).orderBy("vec_id", "v").collect()
        sent = spark.sparkContext.broadcast((np.array([r["vec_id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.float64).reshape(-1, dim)))
        part = index.mapInArrow(search_block(sent, centre, dim, k, epsilon), "q long, query_id long, vec_id long, score double")
        rank = F.row_number().over(Window.partitionBy("q", "query_id").orderBy("score", "vec_id"))
        part = part.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        found = part if found is None else found.unionByName(part)
    return found


def recall(found: DataFrame, table: DataFrame, is_query: Column, k: int = 10) -> float:
    """Share of the true k nearest (by brute force over all rows) that ``found`` holds."""
    v = usable(table)
    q = v.where(is_query).select(F.col("vec_id").alias("query_id"), F.col("v").alias("w")).collect()
    parts = []
    for r in q:
        w = F.array(*[F.lit(float(x)) for x in r["w"]])
        d = F.sqrt(F.aggregate(F.zip_with("v", w, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
        parts.append((r["query_id"], {x["vec_id"] for x in v.where(F.col("vec_id") != r["query_id"]).orderBy(d, "vec_id").limit(k).collect()}))
    got: dict[int, set] = {}
    for r in found.collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    return sum(len(t & got.get(i, set())) for i, t in parts) / max(1, sum(len(t) for _, t in parts))


ORACLE = """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT * FROM v WHERE len(v) = (SELECT len(v) FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_distance(q.v, c.v) AS score FROM u q JOIN u c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM p) WHERE rank <= 10"""
