"""Operator 11: vector code compression with anchors-hierarchy metric trees.

Vectors become integers, floor(scale * x), and are cut into equal consecutive parts; each
part has a codebook that rounds of nearest-entry assignment and means refine. The vectors
are dealt into blocks (some thousand rows of one task). For every part of a block a metric
tree is built once, middle-out: about sqrt(n) *anchors* are placed, each new one at the
point that is farthest from its anchor, stealing from the others only points that the
triangle inequality allows; anchors are merged upwards, always the pair with the smallest
ball, and each anchor's own points are divided downwards in the same way. A ball holds its
centre, radius, and the sum and count of its points, repeated points counted.

A round sends the codebooks through the trees. A ball inherits the list of entries that can
be nearest to some of its points and drops those that lie, for the whole ball, on the far
side of the plane between them and the entry nearest to the centre. A list of one entry
means that the ball is wholly owned: its cached sum and count are added and its points are
not looked at. What is left at a leaf is compared exactly, ties to the lower index, so
the result is that of comparing everything. Trees are stored in the shared folder; sums and
counts are added up per task before they are shuffled, and the driver sees only the
codebooks (entries times dimensions, a fixed size).

Cases: vectors that are null, empty or hold a null or non-finite component are dropped. The first
kept vector in the order of ids sets the dimension, which must be divisible by the number
of parts; vectors of another length cannot be cut alike and are dropped, too. Null ids sort
last; rows that share an id go by their vector and are all coded. With fewer kept vectors
than entries, the codebooks have as many entries as there are vectors. An empty table
gives an empty result. Null labels form one group. Integers too large for exact 64-bit sums
of squares raise an error. Only ``vec_id``, ``embedding`` and ``label`` are read, so further
columns of any name don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import store
from prospecta.operators.keys import split_key

#: Rows of a block, and points of a leaf.
BLOCK, LEAF = 8192, 64
#: Integers below this are exact in doubles, sums and products included.
EXACT = 1 << 52
#: Columns of a stored tree, each the bytes of one array, and their types.
TREE = {
    "points": "i4", "weight": "i8", "place": "i4",  # distinct points in tree order; a row's point
    "low": "i4", "high": "i4", "left": "i4", "right": "i4",  # a ball's points and children (-1: leaf)
    "centre": "f8", "radius": "f8", "total": "i8", "count": "i8",
}


def lengths(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.einsum("ij,ij->i", x, x))


# -- trees


def anchors(x: np.ndarray) -> np.ndarray:
    """Anchor of each point, for about sqrt(n) anchors (fewer if no points are apart)."""
    owner, dist = np.zeros(len(x), np.int64), lengths(x - x[0])
    pivots = [0]
    for a in range(1, math.isqrt(len(x) - 1) + 1):
        far = int(dist.argmax())
        if dist[far] == 0:
            break
        gap = lengths(x[pivots] - x[far])
        may = np.flatnonzero(2 * dist > gap[owner])  # a nearer point can't prefer the new anchor
        d = lengths(x[may] - x[far])
        take = d < dist[may]
        dist[may[take]], owner[may[take]] = d[take], a
        pivots.append(far)
    return owner


class Builder:
    """Grows the tree of one part of a block; balls are numbered as they are made."""

    def __init__(self, points: np.ndarray, weight: np.ndarray):
        self.x, self.points, self.weight = points.astype(np.float64), points, weight
        self.balls: list[tuple[int, int, np.ndarray, float, np.ndarray, int]] = []
        self.members: list[np.ndarray] = []

    def ball(self, index: np.ndarray, left: int = -1, right: int = -1) -> int:
        total, count = (self.points[index] * self.weight[index, None]).sum(0), int(self.weight[index].sum())
        centre = total / count
        self.balls.append((left, right, centre, float(lengths(self.x[index] - centre).max()), total, count))
        self.members.append(index)
        return len(self.balls) - 1

    def grow(self, index: np.ndarray) -> int:
        if len(index) <= LEAF:
            return self.ball(index)
        owner = anchors(self.x[index])
        order = np.argsort(owner, kind="stable")
        groups = np.split(index[order], np.flatnonzero(np.diff(owner[order])) + 1)
        if len(groups) == 1:
            return self.ball(index)
        return self.merge([self.grow(g) for g in groups])

    def merge(self, nodes: list[int]) -> int:
        """Joins balls in pairs, the pair with the smallest common ball first."""
        nodes = list(nodes)
        centre = np.array([self.balls[i][2] for i in nodes])
        radius = np.array([self.balls[i][3] for i in nodes])
        count = np.array([self.balls[i][5] for i in nodes], np.float64)
        cost = np.full((len(nodes),) * 2, np.inf)

        def spans(i: int, others: np.ndarray) -> np.ndarray:
            gap, both = lengths(centre[others] - centre[i]), count[others] + count[i]
            return np.maximum(gap * count[others] / both + radius[i], gap * count[i] / both + radius[others])

        for i in range(1, len(nodes)):
            cost[i, :i] = spans(i, np.arange(i))
        for _ in range(len(nodes) - 1):
            i, j = np.unravel_index(int(cost.argmin()), cost.shape)
            made = self.ball(np.concatenate([self.members[nodes[j]], self.members[nodes[i]]]), nodes[j], nodes[i])
            nodes[j] = made
            centre[j], radius[j], count[j] = self.balls[made][2], self.balls[made][3], self.balls[made][5]
            cost[i], cost[:, i], radius[i] = np.inf, np.inf, np.inf
            live = np.flatnonzero(np.isfinite(radius))
            below, above = live[live < j], live[live > j]
            cost[j, below], cost[above, j] = spans(j, below), spans(j, above)
        return nodes[int(np.isfinite(radius).argmax())]

    def arrays(self) -> dict[str, np.ndarray]:
        """The tree with its root first and its points in the order of the leaves."""
        root = self.grow(np.arange(len(self.points)))
        number, low, high, order, todo = [], {}, {}, [], [(root, False)]
        at = 0
        while todo:
            i, done = todo.pop()
            left, right = self.balls[i][:2]
            if done:
                high[i] = at
                continue
            number.append(i)
            low[i] = at
            if left < 0:
                order.append(self.members[i])
                at += len(self.members[i])
                high[i] = at
            else:
                todo += [(i, True), (right, False), (left, False)]
        new = {i: k for k, i in enumerate(number)} | {-1: -1}
        balls = [self.balls[i] for i in number]
        at_point = np.concatenate(order)
        return {
            "points": self.points[at_point], "weight": self.weight[at_point], "order": at_point,
            "low": np.array([low[i] for i in number]), "high": np.array([high[i] for i in number]),
            "left": np.array([new[b[0]] for b in balls]), "right": np.array([new[b[1]] for b in balls]),
            "centre": np.array([b[2] for b in balls]), "radius": np.array([b[3] for b in balls]),
            "total": np.array([b[4] for b in balls]), "count": np.array([b[5] for b in balls]),
        }


def tree(x: np.ndarray) -> dict[str, np.ndarray]:
    """The tree over the rows of ``x``; equal rows are one point with a weight."""
    points, inverse, weight = np.unique(x, axis=0, return_inverse=True, return_counts=True)
    t = Builder(points, weight).arrays()
    position = np.empty(len(points), np.int64)
    position[t.pop("order")] = np.arange(len(points))
    return t | {"place": position[inverse.reshape(-1)]}


# -- rounds


def first_of_runs(group: np.ndarray) -> np.ndarray:
    return np.concatenate(([True], group[1:] != group[:-1]))


def nearest(points: np.ndarray, entries: np.ndarray, listed: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, owner: np.ndarray) -> None:
    """Compares leaves' points with the entries on their lists (``listed``, ``size`` each)
    and notes the nearest, the first of equals, in ``owner``. Squared lengths are compared
    without that of the point; doubles hold them exactly up to ``EXACT``, beyond it 64-bit
    integers do."""
    width = points.shape[1]
    most = max(int(np.abs(points).max()), int(np.abs(entries).max()))
    kind = np.float64 if 4 * width * most * most < EXACT else np.int64
    x, y = points.astype(kind), entries.astype(kind)
    square = np.einsum("ij,ij->i", y, y)
    for begin, n, i, j in zip((np.cumsum(size) - size).tolist(), size.tolist(), low.tolist(), high.tolist()):
        c = listed[begin : begin + n]
        owner[i:j] = c[(square[c] - 2 * (x[i:j] @ y[c].T)).argmin(1)]


def gaps(entries: np.ndarray) -> np.ndarray:
    """Distances between entries (by differences: near entries may be far from the origin)."""
    place = entries.astype(np.float64)
    return np.array([lengths(place - e) for e in place]).reshape(len(place), len(place))


def assign(t: dict[str, np.ndarray], entries: np.ndarray, apart: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest entry of every point of a tree, and sums and counts of the entries' points."""
    apart = gaps(entries) if apart is None else apart
    points, owner = t["points"].astype(np.int64), np.full(len(t["points"]), -1)
    sums, counts = np.zeros(entries.shape, np.int64), np.zeros(len(entries), np.int64)
    _, distinct = np.unique(entries, axis=0, return_index=True)  # of equal entries the first can win
    listed = np.sort(distinct)
    place = entries.astype(np.float64)
    square, middle = np.einsum("ij,ij->i", place, place), np.einsum("ij,ij->i", t["centre"], t["centre"])
    far = middle[:, None] + square - 2 * (t["centre"] @ place.T)  # centres to entries, squared
    node, size = np.zeros(1, np.int64), np.array([len(listed)])
    while len(node):
        at = np.repeat(np.arange(len(node)), size)
        head = np.cumsum(size) - size
        d = far[node[at], listed]
        least = np.minimum.reduceat(d, head)
        hit = np.flatnonzero(d == least[at])
        best = listed[hit[first_of_runs(at[hit])]]
        # entry c can't be nearest in the ball if d(c) - d(best) > 2 r |c - best|; the slack covers rounding
        scale = middle[node][at] + square[listed] + square[best][at] + 1
        keep = d - least[at] <= 2 * t["radius"][node][at] * apart[best[at], listed] + 1e-9 * scale
        keep |= listed == best[at]
        size = np.add.reduceat(keep.astype(np.int64), head)
        listed, at = listed[keep], at[keep]
        own = size == 1
        for i, b in zip(node[own], best[own]):
            owner[t["low"][i] : t["high"][i]] = b
        np.add.at(sums, best[own], t["total"][node[own]])
        np.add.at(counts, best[own], t["count"][node[own]])
        leaf = ~own & (t["left"][node] < 0)
        if leaf.any():
            i = node[leaf]
            nearest(points, entries, listed[leaf[at]], size[leaf], t["low"][i], t["high"][i], owner)
            seen = np.concatenate([np.arange(a, b) for a, b in zip(t["low"][i], t["high"][i])])
            np.add.at(sums, owner[seen], points[seen] * t["weight"][seen, None])
            np.add.at(counts, owner[seen], t["weight"][seen])
        inner = ~own & ~leaf
        lists = listed[inner[at]]
        node = np.concatenate([t["left"][node[inner]], t["right"][node[inner]]])
        listed = np.concatenate([lists, lists])
        size = np.concatenate([size[inner], size[inner]])
    return owner, sums, counts


# -- jobs


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label (as text) and the vector, of vectors with finite components only."""
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where((F.size("v") > 0) & F.coalesce(finite, F.lit(False)))


def whole_numbers(rows: list | np.ndarray, scale: int) -> np.ndarray:
    x = np.floor(np.asarray(rows, np.float64) * scale)
    if len(x) and np.abs(x).max() >= min(2.0**30, math.sqrt(2.0**61 / x.shape[1]) / 2):
        raise ValueError("components are too large for exact squared distances in 64 bits")
    return x.astype(np.int64)


def grow_trees(vectors: DataFrame, dim: int, parts: int, scale: int) -> DataFrame:
    """One row per block: its ids and labels, and the arrays of a tree for each part."""
    names = [f"{c}{p}" for p in range(parts) for c in TREE]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def block() -> pa.RecordBatch:
            rows = pa.Table.from_batches(held).combine_chunks()
            x = whole_numbers(rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            out = [pa.array([rows["vec_id"].to_pylist()], pa.list_(pa.int64())), pa.array([rows["label"].to_pylist()], pa.list_(pa.string()))]
            for p in np.split(x, parts, axis=1):
                t = tree(p)
                out += [pa.array([t[c].astype(k).tobytes()], pa.binary()) for c, k in TREE.items()]
            return pa.RecordBatch.from_arrays(out, names=["ids", "labels", *names])

        for b in batches:
            while b.num_rows:
                take = b.slice(0, BLOCK - n)
                held.append(take)
                n += take.num_rows
                b = b.slice(take.num_rows)
                if n == BLOCK:
                    yield block()
                    held.clear()
                    n = 0
        if n:
            yield block()

    schema = "ids array<long>, labels array<string>, " + ", ".join(f"{c} binary" for c in names)
    return vectors.select("vec_id", "label", "v").mapInArrow(run, schema)


def read_tree(row: dict, p: int, width: int, leave: tuple[str, ...] = ()) -> dict[str, np.ndarray]:
    t = {c: np.frombuffer(row[f"{c}{p}"], k).astype(k.replace("i4", "i8")) for c, k in TREE.items() if c not in leave}
    return t | {c: t[c].reshape(-1, width) for c in ("points", "centre", "total")}


def one_round(trees: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """New codebooks: componentwise floor of the mean of each entry's parts; unused stay."""
    parts, _, width = codebooks.shape
    columns = [f"s{k}" for k in range(width)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, np.int64), np.zeros(codebooks.shape[:2], np.int64)
        apart = [gaps(e) for e in codebooks]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                for p in range(parts):
                    _, s, c = assign(read_tree(row, p, width, ("place",)), codebooks[p], apart[p])
                    sums[p] += s
                    counts[p] += c
        part, entry = np.nonzero(counts)
        values = [pa.array(x, pa.int64()) for x in (part, entry, counts[part, entry], *sums[part, entry].T)]
        yield pa.RecordBatch.from_arrays(values, names=["part", "entry", "n", *columns])

    read = [f"{c}{p}" for p in range(parts) for c in TREE if c != "place"]
    found = trees.select(*read).mapInArrow(run, "part long, entry long, n long, " + ", ".join(f"{c} long" for c in columns))
    new = codebooks.copy()
    for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in columns]).collect():
        new[r["part"], r["entry"]] = [r[c] // r["n"] for c in columns]
    return new


def final_codes(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """vec_id, label, codes (an entry of each part) and error of every vector."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = [gaps(e) for e in codebooks]
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in b.schema.names}
                error, codes = 0, []
                for p in range(parts):
                    t = read_tree(row, p, width)
                    owner = assign(t, codebooks[p], apart[p])[0]
                    d = t["points"] - codebooks[p][owner]
                    error = error + np.einsum("ij,ij->i", d, d)[t["place"]]
                    codes.append(owner[t["place"]])
                values = pa.array(np.stack(codes, 1).reshape(-1), pa.int32())
                listed = pa.ListArray.from_arrays(pa.array(np.arange(len(error) + 1) * parts, pa.int32()), values)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(row["labels"], pa.string()), listed, pa.array(error, pa.int64())],
                    names=["vec_id", "label", "codes", "error"],
                )

    return trees.mapInArrow(run, "vec_id long, label string, codes array<int>, error long")


def compress(vectors: DataFrame, *, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> tuple[np.ndarray, DataFrame]:
    """The codebooks (part, entry, component) and the coded vectors, a stored table of
    vec_id, label (as text), codes and error."""
    kept = usable(vectors)
    order = [F.col("vec_id").asc_nulls_last(), F.col("v").asc()]
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64), kept.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")).where(F.lit(False))
    dim = len(first[0]["v"])
    if dim % parts:
        raise ValueError(f"vectors of {dim} components can't be cut into {parts} equal parts")
    alike = kept.where(F.size("v") == dim)
    start = whole_numbers([r["v"] for r in alike.orderBy(*order).limit(entries).collect()], scale)
    codebooks = np.stack(np.split(start, parts, axis=1))
    trees = store(grow_trees(alike, dim, parts, scale), "vector-trees")
    for _ in range(rounds):
        codebooks = one_round(trees, codebooks)
    return codebooks, store(final_codes(trees, codebooks), "vector-codes")


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.reshape(-1).tolist())).encode()).hexdigest()


def report(vectors: DataFrame) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of every kept vector."""
    codebooks, coded = compress(vectors)
    label = F.coalesce(F.concat(F.lit("l"), F.col("label")), F.lit("n"))
    coded = coded.select("vec_id", "error", label.alias("of"), F.concat(*[F.lpad(F.lower(F.hex(F.col("codes")[p])), 2, "0") for p in range(4)]).alias("code"))
    # a label may hold a third of the rows: summed before the shuffle, joined on a key that can be split
    per = coded.groupBy("of").agg(F.sum("error").alias("label_error")).select(split_key(F.col("of")).alias("k"), "label_error")
    joined = coded.join(per, split_key(F.col("of")) == F.col("k"))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def oracle_sql(parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by comparing every part with every entry of its codebook."""
    ok = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"
    sql = [
        f"""kept AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) - 1 AS rid, vec_id, label,
          list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings WHERE {ok})""",
        f"""cut AS (SELECT rid, part, list_slice(v, part * (len(v) // {parts}) + 1, (part + 1) * (len(v) // {parts})) AS v
          FROM kept, range({parts}) AS t(part))""",
        f"book0 AS (SELECT part, rid AS idx, v FROM cut WHERE rid < {entries})",
    ]
    for k in range(rounds + 1):
        sql.append(
            f"""near{k} AS (SELECT c.rid, c.part, min(CAST(list_dot_product(c.v, c.v) - 2 * list_dot_product(c.v, b.v) + list_dot_product(b.v, b.v) AS HUGEINT) * {entries} + b.idx) AS m
          FROM cut c JOIN book{k} b ON b.part = c.part GROUP BY c.rid, c.part)"""
        )
        if k < rounds:
            sql.append(
                f"""mean{k} AS (SELECT part, idx, list(floor((s - ((s % n) + n) % n) / n) ORDER BY pos) AS v FROM (
            SELECT part, idx, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (
              SELECT part, idx, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM (
                SELECT c.part, n.m % {entries} AS idx, c.v FROM near{k} n JOIN cut c ON c.rid = n.rid AND c.part = n.part))
            GROUP BY part, idx, pos) GROUP BY part, idx)"""
            )
            sql.append(f"book{k + 1} AS (SELECT b.part, b.idx, coalesce(m.v, b.v) AS v FROM book{k} b LEFT JOIN mean{k} m ON m.part = b.part AND m.idx = b.idx)")
    return f"""WITH {", ".join(sql)},
      coded AS (SELECT k.vec_id, k.label, string_agg(printf('%02x', CAST(n.m % {entries} AS BIGINT)), '' ORDER BY n.part) AS code, CAST(sum(n.m // {entries}) AS BIGINT) AS error
        FROM near{rounds} n JOIN kept k ON k.rid = n.rid GROUP BY k.rid, k.vec_id, k.label),
      books AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY part, idx, pos)) AS h FROM (
        SELECT part, idx, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM book{rounds}))
      SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, books"""
