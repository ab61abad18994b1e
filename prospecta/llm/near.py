"""Operator 6: near duplicates by a chosen-path set similarity join.

A document's set holds its distinct five-word shingles. Documents of equal sets form a
class (known by a 128-bit hash of the set), represented by its smallest id; classes are
linked where 100 * |intersection| >= 75 * |union| of the full sets.

* Trees. A class walks down ``TREES`` independent random trees. At every node the node's
  own hash chooses a coordinate of the class's minwise sketch, and with probability
  1/threshold - 1 a second one; the chosen minwise token leads to the child. Two classes
  with similarity s stay together with probability s per choice, s / threshold children on
  average, so that links survive and unrelated pairs part within ``DEPTH`` levels.
* Nodes. Every member is first compared with the nodes' smallest members (the best of
  them by sketch): this ties groups of copies together with one pair per member. Then only
  nodes that still hold several components matter. Small ones are compared exhaustively:
  members with a partner across components by sketch are brought together with their full
  sets, a node of many bytes in pairs of blocks, and a node gives at most a spanning set of
  links, fewer than its members. Members of larger nodes go on down the tree, a level at a
  time, until no large node with several components is left. No node is cut off.
* Recall. A tree loses a pair with the depth that it is followed to, so the number of trees
  follows from the depth: ``trees_for`` gives the fewest for which a pair at the threshold
  is lost by all of them with a probability of at most ``LOSS``. ``TREES`` do at ``DEPTH``;
  where large nodes led deeper, the members of large nodes walk fresh trees until there are
  as many as their depth asks for.
* Every pair that passes the sketch (wide margin) is confirmed on the full sets before it
  counts as a link. Components come from alternating large and small stars.

Pairs, links and components stay in tables; the driver sees counts only. Hot nodes, hot
copies and hubs go through partial aggregation and joins that split large partitions.

Cases: null and empty text and texts without words have the empty set, link with nothing
and are their own component; with fewer than five words the whole sequence is the only
shingle; repeated rows share id and component; rows with a null id take no part in links
and have a null component (``kept`` is true); only ``doc_id`` and ``text`` are read, so
further columns of any name don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prospecta.llm.common import free_name, lower_table, mix, small, store, text_bytes, word_hashes

SHINGLE = 5
THRESHOLD = (75, 100)
COORDINATES = 128  #: minwise tokens of a sketch
TREES = 14
DEPTH = 4  #: levels walked before nodes are first looked at
SMALL = 4096  #: members of a node that is compared exhaustively
HELD = 32 << 20  #: bytes of full sets in a block of a node
LOSS = 1e-3  #: greatest probability that all trees part a pair at the threshold
LEAST_AGREEING = 75  #: of 128 sketch tokens; a linked pair agrees on 96 +- 5 or more

_LOWER = lower_table()
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STEP = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
_TURN = mix(np.arange(101, 101 + COORDINATES, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    data = np.frombuffer(b"\n".join(t.translate(_LOWER) for t in texts) + b"\n", np.uint8)
    words, start, _ = word_hashes(data, ~_SPACE[data])
    bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    out = []
    if len(words) >= SHINGLE:
        rolled = sum(words[k : len(words) - SHINGLE + 1 + k] * _STEP[k] for k in range(SHINGLE))
        rolled = mix(rolled)
    for a, b in zip(bounds, bounds[1:]):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(rolled[a : b - SHINGLE + 1]))
        elif n:
            out.append(mix(mix((words[a:b] * _STEP[:n]).sum(keepdims=True)) + np.uint64(n)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(s: np.ndarray) -> bytes:
    """16 bits of the minwise token of every coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(s), 2048):  # bounds the memory of very long texts
        np.minimum(least, (s[i : i + 2048, None] * _TURN).min(axis=0), out=least)
    return (mix(least) >> np.uint64(48)).astype(np.uint16).tobytes()


def set_hashes(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a set, independent of order."""
    if not len(s):
        return 0, 0
    total = mix(s ^ np.uint64(0xA5A5A5A5)).sum(dtype=np.uint64)
    return int(total.view(np.int64)), int(np.bitwise_xor.reduce(mix(s + np.uint64(0x5BD1E995))).view(np.int64))


SIGNATURE = "doc_id long, n long, h1 long, h2 long, sketch binary"


def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in small(batches, 128):
        n, h1, h2, sk = [], [], [], []
        for s in shingle_sets(text_bytes(b.column("text"))):
            a, b_ = set_hashes(s)
            n.append(len(s))
            h1.append(a)
            h2.append(b_)
            sk.append(sketch(s) if len(s) else None)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.array(sk, pa.binary())], names=["doc_id", "n", "h1", "h2", "sketch"])


# -- trees ------------------------------------------------------------------------------


def children(path: np.ndarray, row: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The child nodes of (path, row of ``tokens``): one always, a second by the node's hash."""
    second = mix(path ^ np.uint64(0x2545F491)) < np.uint64(int((THRESHOLD[1] / THRESHOLD[0] - 1) * 2**64))
    out = []
    for k, on in ((1, slice(None)), (2, second)):
        p, r = path[on], row[on]
        at = mix(p + np.uint64(k)) % np.uint64(COORDINATES)
        token = tokens[r, at.astype(np.int64)].astype(np.uint64)
        out.append((mix(mix(p + np.uint64(k)) ^ (token + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), r))
    return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def token_table(col: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(len(col), COORDINATES)


def lists(path: np.ndarray, row: np.ndarray, n: int) -> pa.Array:
    """Paths of each row as a list."""
    order = np.argsort(row, kind="stable")
    offsets = np.searchsorted(row[order], np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(path[order].view(np.int64)))


def loss(depth: int, trees: int) -> float:
    """Probability that a pair at the threshold is in no common node of ``trees`` trees at a
    depth: over the tokens that its sketches share, the extinction of its descent (one
    child, or two with the nodes' probability, each kept if the token is shared)."""
    s0, second = THRESHOLD[0] / THRESHOLD[1], THRESHOLD[1] / THRESHOLD[0] - 1
    total = 0.0
    for shared in range(COORDINATES + 1):
        s, gone = shared / COORDINATES, 0.0
        for _ in range(depth):
            x = 1 - s + s * gone
            gone = x * (1 - second + second * x)
        total += math.comb(COORDINATES, shared) * s0**shared * (1 - s0) ** (COORDINATES - shared) * gone**trees
    return total


def trees_for(depth: int) -> int:
    """The fewest trees, ``TREES`` at least, whose loss at a depth is small enough."""
    high = TREES
    while loss(depth, high) > LOSS:
        high *= 2
    low = max(TREES, high // 2)
    while low < high:
        middle = (low + high) // 2
        low, high = (low, middle) if loss(depth, middle) <= LOSS else (middle + 1, high)
    return low


def walk(first: int, last: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(id, sketch) -> (id, paths): the nodes reached after DEPTH levels of the trees
    ``first`` to ``last``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = mix(np.arange(first, last + 1, dtype=np.uint64))
        for b in small(batches, 4096):
            tokens, n = token_table(b.column("sketch")), b.num_rows
            path, row = np.tile(seeds, n), np.repeat(np.arange(n), len(seeds))
            for _ in range(DEPTH):
                path, row = children(path, row, tokens)
            yield pa.RecordBatch.from_arrays([b.column("id"), lists(path, row, n)], names=["id", "paths"])

    return run


def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, id, sketch) -> (id, paths) one level down."""
    for b in small(batches, 4096):
        path, row = children(np.asarray(b.column("path")).view(np.uint64), np.arange(b.num_rows), token_table(b.column("sketch")))
        yield pa.RecordBatch.from_arrays([b.column("id"), lists(path, row, b.num_rows)], names=["id", "paths"])


# -- pairs ------------------------------------------------------------------------------


def similar(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agreeing) of the pairs whose sketches agree enough for a link."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("sketch").alias(f"{c}s"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 4096):
            agreeing = (token_table(b.column("as")) == token_table(b.column("bs"))).sum(1)
            on = np.flatnonzero(agreeing >= LEAST_AGREEING)
            if len(on):
                yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(on)), b.column("b").take(pa.array(on)), pa.array(agreeing[on].astype(np.int64))], names=["a", "b", "agreeing"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "as", "bs").mapInArrow(run, "a long, b long, agreeing long")


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are linked by their full sets."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("members").alias(f"{c}m"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 256):
            on = [k for k, (x, y) in enumerate(zip(b.column("am").to_pylist(), b.column("bm").to_pylist())) if linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))]
            if on:
                yield pa.RecordBatch.from_arrays([b.column(c).take(pa.array(on)) for c in ("a", "b")], names=["a", "b"])

    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "am", "bm").mapInArrow(run, "a long, b long")


def groups_of(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int) -> Iterator[pa.Table]:
    """Runs of equal keys of sorted batches, one table each."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in small(batches, rows):
        key = np.stack([np.asarray(b.column(c)) for c in keys], 1)
        cut = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
        for i, j in zip(cut, cut[1:]):
            if held and tuple(key[i]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(key[i])
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def agreeing_pairs(tokens: np.ndarray, comp: np.ndarray, at: Iterator[int] | range) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of different components whose sketches agree enough for a link, and
    how much they agree; some rows at a time."""
    for i in at:
        x, y = np.nonzero(comp[i : i + 32, None] != comp[None, i:])
        on = y > x
        x, y = x[on] + i, y[on] + i
        for k in range(0, len(x), 8192):
            p, q = x[k : k + 8192], y[k : k + 8192]
            agreeing = (tokens[p] == tokens[q]).sum(1)
            on = agreeing >= LEAST_AGREEING
            if on.any():
                yield p[on], q[on], agreeing[on]


def with_partner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, id) of the members of each (small) node that have a partner across components
    by sketch; rows (path, id, comp, sketch) come by path."""
    for t in groups_of(batches, ["path"], 2048):
        comp = t["comp"].to_numpy()
        tokens = token_table(t["sketch"].combine_chunks())
        has = np.zeros(len(comp), bool)
        for p, q, _ in agreeing_pairs(tokens, comp, range(0, len(comp), 32)):
            has[p] = has[q] = True
        if has.any():
            on = pa.array(np.flatnonzero(has))
            yield pa.RecordBatch.from_arrays([t[c].combine_chunks().take(on) for c in ("path", "id")], names=["path", "id"])


def links_within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a node, enough to span what its full sets link; rows (path, low,
    high, block, id, comp, paths, sketch, members) come by (path, low, high), a pair of the
    node's blocks. The most agreeing pairs come first, pairs that are joined by then are
    left out, and a pair is compared in the least node (``paths``) that holds both."""
    for t in groups_of(batches, ["path", "low", "high"], 64):
        ids, comp, block = (t[c].to_numpy() for c in ("id", "comp", "block"))
        tokens, sets = token_table(t["sketch"].combine_chunks()), t["members"].to_pylist()
        paths = [frozenset(x) for x in t["paths"].to_pylist()]
        path, across = t["path"][0].as_py(), t["low"][0].as_py() != t["high"][0].as_py()
        found = list(agreeing_pairs(tokens, comp, range(0, len(ids), 32)))
        if not found:
            continue
        p, q, agreeing = (np.concatenate(x) for x in zip(*found))
        if across:
            on = block[p] != block[q]
            p, q, agreeing = p[on], q[on], agreeing[on]
        root = {c: c for c in set(comp.tolist())}

        def top(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        out = []
        for k in np.argsort(-agreeing, kind="stable").tolist():
            i, j = int(p[k]), int(q[k])
            u, v = top(int(comp[i])), top(int(comp[j]))
            if u != v and min(paths[i] & paths[j]) == path and linked(np.frombuffer(sets[i], np.uint64), np.frombuffer(sets[j], np.uint64)):
                root[max(u, v)] = min(u, v)
                out.append((min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))))
        if out:
            yield pair_rows(out)


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted full sets are similar enough."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges the two runs
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return THRESHOLD[1] * shared >= THRESHOLD[0] * (len(x) + len(y) - shared)


def links_of_nodes(rows: DataFrame, classes: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of small nodes, (path, id, comp), compared exhaustively."""
    sketched = rows.select("path", "id", "comp").join(classes.select("id", "sketch"), "id").select("path", "id", "comp", "sketch")
    found = sketched.repartition("path").sortWithinPartitions("path").mapInArrow(with_partner, "path long, id long")
    found = store(found, "near-partners")
    sized = found.join(sets.select("id", F.length("members").alias("size")), "id")
    blocks = sized.groupBy("path").agg(F.ceil(F.sum("size") / HELD).alias("blocks"))
    every = found.groupBy("id").agg(F.collect_set("path").alias("paths")).join(sets, "id").join(classes.select("id", "sketch"), "id")
    every = every.join(rows.select("id", "comp").distinct(), "id")
    placed = found.join(blocks, "path").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select("path", "id", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
    met = placed.join(every, "id").select("path", "low", "high", "block", "id", "comp", "paths", "sketch", "members")
    return met.repartition("path", "low", "high").sortWithinPartitions("path", "low", "high").mapInArrow(links_within, "a long, b long")


def pair_rows(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    pairs = sorted(set(pairs))
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])


# -- components -------------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """(id, comp) of every end of a link: the smallest id that can be reached."""
    edges = store(links.select(F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).where("low < high").distinct(), "near-edges")
    seen = None
    while True:
        for large in (True, False):
            if large:  # every neighbour above goes to the least one in reach
                ends = edges.select(F.col("low").alias("u"), F.col("high").alias("v")).unionByName(edges.select(F.col("high").alias("u"), F.col("low").alias("v")))
                least = ends.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
                edges = ends.where("v > u").join(least, "u").select(F.col("m").alias("low"), F.col("v").alias("high"))
            else:  # every neighbour below, and the place itself, go to the least of them
                least = edges.groupBy("high").agg(F.min("low").alias("m"))
                moved = edges.join(least, "high")
                edges = moved.select(F.col("m").alias("low"), F.col("low").alias("high")).unionByName(moved.select(F.col("m").alias("low"), "high"))
            edges = edges.where("low < high").distinct()
        edges = store(edges, "near-edges")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            return edges.select(F.col("high").alias("id"), F.col("low").alias("comp")).unionByName(edges.select(F.col("low").alias("id"), F.col("low").alias("comp")).distinct())
        seen = state


def with_component(rows: DataFrame, comp: DataFrame | None, column: str = "id") -> DataFrame:
    """``rows`` plus the component of ``column`` (itself where it has no link)."""
    if comp is None:
        return rows.withColumn("comp", F.col(column))
    comp = comp.select(F.col("id").alias("_id"), F.col("comp").alias("_comp"))
    return rows.join(comp, F.col(column) == F.col("_id"), "left").withColumn("comp", F.coalesce("_comp", column)).drop("_id", "_comp")


def different(pairs: DataFrame, comp: DataFrame | None) -> DataFrame:
    """Distinct pairs (a, b) whose ends aren't in one component."""
    if comp is None:
        return pairs.where("a <> b").distinct()
    pairs = with_component(pairs.distinct(), comp, "a").withColumnRenamed("comp", "_ca")
    return with_component(pairs, comp, "b").where("_ca <> comp").select("a", "b")


# -- the whole --------------------------------------------------------------------------


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = store(src.mapInArrow(sign, SIGNATURE), "near-signatures")
    has_set = signed.where("n > 0 AND doc_id IS NOT NULL")
    classes = store(has_set.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch")), "near-classes")

    sets = None
    comp: DataFrame | None = None

    def settle(found: DataFrame) -> None:
        nonlocal comp
        new = store(found, "near-links")
        if not new.isEmpty():
            comp = store(components(with_roots(new, comp)), "near-components")

    trees, walkers = 0, classes.select("id", "sketch")
    wanted = TREES
    while trees < wanted:
        rows = walkers.mapInArrow(walk(trees + 1, wanted), "id long, paths array<long>").select(F.explode("paths").alias("path"), "id")
        trees, depth = wanted, DEPTH
        large: list[DataFrame] = []
        while True:
            nodes = rows.groupBy("path").agg(F.count("*").alias("members"), F.min("id").alias("first")).where("members > 1")
            rows = store(rows.join(nodes, "path"), "near-nodes")
            if rows.isEmpty():
                break
            if sets is None:  # the full sets of all that share a node with another
                sets = full_sets(src, classes, rows.select("id").distinct())

            # the best of the nodes' first members for each member
            star = different(rows.select(F.col("first").alias("a"), F.col("id").alias("b")), comp)
            best = similar(star, classes).groupBy("b").agg(F.max(F.struct("agreeing", (-F.col("a")).alias("a"))).alias("best"))
            settle(confirm(best.select((-F.col("best.a")).alias("a"), "b"), sets))

            rows = with_component(rows.select("path", "id", "members"), comp)
            mixed = rows.groupBy("path").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("path")
            rows = store(rows.join(mixed, "path"), "near-mixed")
            light = rows.where(F.col("members") <= SMALL)
            if not light.isEmpty():
                settle(links_of_nodes(light, classes, sets))

            heavy = rows.where(F.col("members") > SMALL)
            if heavy.isEmpty():
                break
            down = heavy.select("path", "id").join(classes.select("id", "sketch"), "id").select("path", "id", "sketch")
            large.append(down.select("id", "sketch").dropDuplicates(["id"]))
            rows = down.mapInArrow(descend, "id long, paths array<long>").select(F.explode("paths").alias("path"), "id").distinct()
            depth += 1
        if large:  # the nodes of the first level hold all that went deeper
            walkers, wanted = large[0], max(wanted, trees_for(depth))

    one = classes.select("h1", "h2", "n", F.col("id").alias("class_id"))
    one = with_component(one, comp, "class_id").select("h1", "h2", "n", "comp")
    # rows without a set are spread by their id: as null keys they would meet in one place
    out = signed.where("n > 0").drop("sketch").join(one, ["h1", "h2", "n"], "left")
    out = out.unionByName(signed.where("n = 0").drop("sketch").withColumn("comp", F.lit(None).cast("long")))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def full_sets(src: DataFrame, classes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, members): the full sets of the classes named."""
    wanted = ids.select(F.col("id").alias("doc_id"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 128):
            s = [x.tobytes() for x in shingle_sets(text_bytes(b.column("text")))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s, pa.binary())], names=["id", "members"])

    # rows that repeat a document's id may hold other texts: the class's own is told by its hashes
    own = classes.join(ids, "id").select("id", "n", "h1", "h2")
    return store(own_sets(src.join(wanted, "doc_id", "left_semi").mapInArrow(full, "id long, members binary"), own), "near-sets")


def without_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns as they are, of one document of each component
    (the smallest id); of rows that repeat an id with the same text one stays."""
    name = free_name(docs.columns, "kept_id")
    kept = near_duplicates(docs).where("kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias(name))
    repeats = kept.groupBy(name).count().where("count > 1").select(name)
    same = F.col("doc_id").cast("long") == F.col(name)
    out = docs.join(kept, same, "left_semi")
    if not repeats.isEmpty():
        again = out.join(repeats, same, "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(repeats, same, "left_anti").unionByName(again)
    return out.unionByName(docs.where(F.col("doc_id").isNull()))


def with_roots(new: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The new links and, as links, the components known so far."""
    if comp is None:
        return new
    return new.unionByName(comp.select(F.col("comp").alias("a"), F.col("id").alias("b")))


def own_sets(found: DataFrame, own: DataFrame) -> DataFrame:
    """One set of each class: where an id has several texts, that of the class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small(batches, 1024):
            n, h1, h2 = [], [], []
            for m in b.column("members").to_pylist():
                s = np.frombuffer(m, np.uint64)
                x, y = set_hashes(s)
                n.append(len(s))
                h1.append(x)
                h2.append(y)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, pa.int64()) for x in (n, h1, h2))], names=["id", "members", "n", "h1", "h2"])

    signed = found.mapInArrow(run, "id long, members binary, n long, h1 long, h2 long")
    return signed.join(own, ["id", "n", "h1", "h2"], "left_semi").dropDuplicates(["id"]).select("id", "members")


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 4], ' ') END AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 75 * (na.n + nb.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT u AS id, u AS reach FROM e UNION SELECT r.id, e.v FROM r JOIN e ON r.reach = e.u),
c AS (SELECT id, min(reach) AS comp FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.comp, d.doc_id) AS component_id, coalesce(c.comp, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.id = d.doc_id"""
