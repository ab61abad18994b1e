"""Operator 12: the trie of conversations that share their first turns.

Every sequence of first turns is a node. A node's identity is the XOR of hashes of its
turns and their places (128 bits), a running aggregate over a conversation's turns, so a
node is a group of equal hashes: its members are counted with partial aggregation, however
many share a first turn. Nodes that follow each other without a branch or an end have the
same members; such *runs* (same smallest member, same count) are the balls of the trie. A
path from the root to a leaf meets at most sqrt(2 * turns) runs, since each new one
needs another conversation of at least that length.

The leaves' paths, sorted, are dealt into shards. A shard writes its part of the trie as
balanced parentheses; blocks of least excess give findclose, which delimits the subtree of
a run; the rank of leaf pairs "()" counts its leaves, and a cumulative array of the runs'
savings gives its sum. Runs on a shard's first or last path are spines: other shards may
hold more of their subtrees. Their counts are added up over shards, and the savings of the
spine runs themselves, left out before, are added once each, to all runs above them.

Cases: rows without a conv_id take no part; null turns come first and ties in ``turn`` go by
the md5 of role and text, equal rows being interchangeable; null role or text is empty; a
conversation may be empty after rebuilding and is then a member of the root only; an empty
table has no conversation and gives no node. Very long texts are hashed where they are read;
a very long conversation is numbered and hashed in bands of ``BAND`` turns, whose totals
are added up. Only the four named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import store
from prospecta.operators.keys import split_key

BITS = 10  #: turns are numbered and hashed in bands of 2**BITS
BAND = 1 << BITS
SHARD = 1 << 16  #: runs on the paths of one shard
BLOCK = 64  #: parentheses of an excess block
CHUNK = 12  #: conversations that end at a node are listed by 2**CHUNK neighbouring ids
GROUP, SHIFTED = 5, 9  #: conversations of a group share up to SHIFTED - 1 turns of its first


# -- turns


def turns(conversations: DataFrame) -> DataFrame:
    """(conv, turn, key, size): a hash and the UTF-8 bytes in place of role and text."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")).alias("key"),
        F.octet_length(text).cast("long").alias("size"),
    )


def numbered(rows: DataFrame) -> DataFrame:
    """``pos``, the place of each row in its conversation, from 0. Rows are ranked within
    bands of neighbouring turns; the bands before give the offset."""
    rows = rows.withColumn("band", F.coalesce(F.shiftright("turn", BITS), F.lit(-(1 << 62))))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("conv", "band").agg(F.count(F.lit(1)).alias("m")).select("conv", "band", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv", "band").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.withColumn("pos", F.row_number().over(within) - 1).join(counts, ["conv", "band"]).select("conv", (F.col("pos") + F.col("offset")).alias("pos"), "key", "size")


def shared_turns(conv: Column) -> Column:
    return F.crc32(conv.cast("string").cast("binary")) % SHIFTED


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations' turns (conv, pos, key, size, last) and all conversations
    (conv, turns): the first h turns of the group's first conversation, then the own ones
    after the first h."""
    sizes = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("own"))
    c = sizes.select("conv", "own", shared_turns(F.col("conv")).alias("h"), (F.col("conv") - F.col("conv") % GROUP).alias("base"))
    b = sizes.select(F.col("conv").alias("base"), F.col("own").alias("there"))
    c = c.join(b, "base", "left").withColumn("lead", F.least("h", F.coalesce("there", F.lit(0))))
    c = store(c.withColumn("turns", F.col("lead") + F.greatest(F.col("own") - F.col("h"), F.lit(0))), "trie-conversations")
    heads = rows.where(F.col("pos") < SHIFTED - 1).withColumnRenamed("conv", "base").join(c.select("conv", "base", "lead", "turns"), "base").where(F.col("pos") < F.col("lead"))
    of = c.select(split_key(F.col("conv")).alias("k"), "lead", "h", "turns")
    own = rows.join(of, split_key(F.col("conv")) == F.col("k")).where(F.col("pos") >= F.col("h")).withColumn("pos", F.col("pos") - F.col("h") + F.col("lead"))
    columns = ["conv", "pos", "key", "size", (F.col("pos") == F.col("turns") - 1).alias("last")]
    return heads.select(*columns).unionByName(own.select(*columns)), c.select("conv", "turns")


def prefixes(rows: DataFrame) -> DataFrame:
    """Every turn with the hash of all turns up to it (h1, h2), that of those before it
    (p1, p2), and the bytes before it (``above``)."""
    rows = rows.withColumns({"band": F.shiftright("pos", BITS), "e1": F.xxhash64(F.lit("a"), "pos", "key"), "e2": F.xxhash64(F.lit("b"), "pos", "key")})
    total = rows.groupBy("conv", "band").agg(F.bit_xor("e1").alias("b1"), F.bit_xor("e2").alias("b2"), F.sum("size").alias("bytes"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    total = total.select("conv", "band", *[f(c).over(before).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bytes"))]).where(F.col("band") > 0)
    upto = Window.partitionBy("conv", "band").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"r1": F.bit_xor("e1").over(upto), "r2": F.bit_xor("e2").over(upto), "upto": F.sum("size").over(upto)}).join(total, ["conv", "band"], "left")
    h = {i: F.col(f"r{i}").bitwiseXOR(F.coalesce(f"b{i}", F.lit(0))) for i in (1, 2)}
    return rows.select(
        "conv", (F.col("pos") + 1).alias("depth"), "size", "last",
        h[1].alias("h1"), h[2].alias("h2"), h[1].bitwiseXOR(F.col("e1")).alias("p1"), h[2].bitwiseXOR(F.col("e2")).alias("p2"),
        (F.col("upto") - F.col("size") + F.coalesce("bytes", F.lit(0))).alias("above"),
    )


# -- nodes and runs


def nodes_of(at: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, h1, h2, p1, p2, n, owner, size, above): each node, its members counted and
    its owner, the smallest of them. The root has hash 0 and depth 0."""
    zero = F.lit(0).cast("long")
    root = conversations.agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("owner")).where("n > 0")
    root = root.select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), zero.alias("p1"), zero.alias("p2"), "n", "owner", zero.alias("size"), zero.alias("above"))
    least = [F.min(c).alias(c) for c in ("p1", "p2", "size", "above")]
    return root.unionByName(at.groupBy("depth", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("conv").alias("owner"), *least).select(*root.columns))


def runs_of(nodes: DataFrame) -> DataFrame:
    """Runs, by (owner, n): top and end, bytes above, own savings, children, parent's owner."""
    runs = nodes.groupBy("owner", "n").agg(
        F.min("depth").alias("first"), F.max("depth").alias("final"), F.min("above").alias("above"), F.sum("size").alias("bytes"),
        F.min_by(F.struct("h1", "h2", "p1", "p2"), "depth").alias("top"), F.max_by(F.struct("h1", "h2"), "depth").alias("end"),
    )
    runs = runs.select("owner", "n", "first", "final", "above", ((F.col("n") - 1) * F.col("bytes")).alias("saved"), "top", "end")
    runs = store(runs, "trie-runs")
    up = runs.where("first > 0").select(F.col("first") - 1, F.col("top.p1"), F.col("top.p2")).toDF("final", "e1", "e2")
    children = up.groupBy("final", "e1", "e2").agg(F.count(F.lit(1)).alias("children"))
    ends = runs.select("final", F.col("end.h1").alias("e1"), F.col("end.h2").alias("e2"), F.col("owner").alias("above_owner"))
    parents = runs.select("owner", "n", (F.col("first") - 1).alias("final"), F.col("top.p1").alias("e1"), F.col("top.p2").alias("e2")).where("final >= 0")
    parents = parents.join(ends, ["final", "e1", "e2"]).select("owner", "n", "above_owner")
    keyed = runs.withColumns({"e1": F.col("end.h1"), "e2": F.col("end.h2")}).join(children, ["final", "e1", "e2"], "left")
    keyed = keyed.join(parents, ["owner", "n"], "left").withColumn("children", F.coalesce("children", F.lit(0)))
    return store(keyed.drop("e1", "e2", "end"), "trie-joined-runs")


def leaf_paths(at: DataFrame, runs: DataFrame) -> DataFrame:
    """The path of every leaf: its runs from the root on, named by the hash of their tops,
    and ``name``, the sort key made of these."""
    name = F.concat(*[F.lpad(F.hex(c), 16, "0") for c in ("h1", "h2")])
    tops = runs.select(F.col("top.h1").alias("h1"), F.col("top.h2").alias("h2"), F.col("first").alias("depth"), "owner", "n", "saved")
    step = F.struct("depth", name.alias("run"), "owner", "n", "saved")
    leaf = runs.where("children = 0").select(F.col("owner").alias("conv"))  # each owner has one last run
    zero = F.lit(0).cast("long")
    start = leaf.select("conv", zero.alias("depth"), zero.alias("h1"), zero.alias("h2"))
    seen = start.unionByName(at.select("conv", "depth", "h1", "h2").join(leaf, "conv", "left_semi"))
    path = F.sort_array(F.collect_list(step)).alias("path")
    paths = seen.join(tops, ["depth", "h1", "h2"]).groupBy("conv").agg(path)
    return paths.select(F.concat_ws("", F.transform("path", lambda s: s["run"])).alias("name"), F.transform("path", lambda s: s.dropFields("depth")).alias("path"))


# -- balanced parentheses


class Parentheses:
    """A balanced sequence (True opens) with the least excess of blocks, and of pairs of
    blocks, pairs of pairs and so on above them."""

    def __init__(self, opens: np.ndarray):
        self.opens = opens
        excess = np.cumsum(np.where(opens, 1, -1))
        pad = -len(excess) % BLOCK
        self.blocks = np.concatenate([excess, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, BLOCK)
        self.least = [self.blocks.min(1)]
        while len(self.least[-1]) > 1:
            m = self.least[-1]
            m = np.concatenate([m, np.full(len(m) % 2, np.iinfo(np.int64).max)])
            self.least.append(np.minimum(m[::2], m[1::2]))
        self.leaves = np.cumsum(np.concatenate([opens[:-1] & ~opens[1:], [False]]))

    def findclose(self, at: np.ndarray) -> np.ndarray:
        """The closing place of the pairs that open at ``at``: the first place after it where
        the excess is less than at it."""
        block, inside = np.divmod(at, BLOCK)
        target = self.blocks[block, inside] - 1
        low = (self.blocks[block] <= target[:, None]) & (np.arange(BLOCK) > inside[:, None])
        out = block * BLOCK + low.argmax(1)
        todo = np.flatnonzero(~low.any(1))
        level, node = np.zeros(len(todo), np.int64), block[todo]
        found = np.zeros(len(todo), bool)
        for k, m in enumerate(self.least):  # up, until the block to the right goes low enough
            go = np.flatnonzero(~found)
            right = go[(node[go] % 2 == 0) & (node[go] + 1 < len(m))]
            hit = right[m[node[right] + 1] <= target[todo[right]]]
            node[hit] += 1
            level[hit], found[hit] = k, True
            node[~found] //= 2
        for k in range(len(self.least) - 1, 0, -1):  # down, to the leftmost block that does
            go = np.flatnonzero(level == k)
            node[go] *= 2
            node[go] += self.least[k - 1][node[go]] > target[todo[go]]
            level[go] = k - 1
        out[todo] = node * BLOCK + (self.blocks[node] <= target[todo][:, None]).argmax(1)
        return out

    def pairs_within(self, at: np.ndarray, close: np.ndarray) -> np.ndarray:
        """Leaf pairs in the subtrees that open at ``at`` (the pair itself included)."""
        return self.leaves[close] - self.leaves[at] + (self.opens[at] & ~self.opens[at + 1])


RESULT = "run string, owner long, n long, leaves long, saved long, own long, spine array<string>"


def shard(size: np.ndarray, run: pa.Array, owner: np.ndarray, n: np.ndarray, saved: np.ndarray) -> pa.RecordBatch:
    """The runs of a shard, given by its paths' lengths and, path after path, their runs.
    ``spine`` is null where ``leaves`` and ``saved`` are whole."""
    code = run.dictionary_encode().indices.to_numpy()
    start = np.cumsum(size) - size
    row = np.repeat(np.arange(len(size)), size)
    k = np.arange(len(code)) - start[row]
    held = (row > 0) & (k < np.concatenate(([0], size[:-1]))[row])
    held[held] = code[held.nonzero()[0]] == code[start[row[held] - 1] + k[held]]  # the path before has it
    new = np.flatnonzero(~held)
    common = np.bincount(row[held], minlength=len(size))
    closes = np.concatenate(([0], (size[:-1] - common[1:])))
    # per path: the closing ones of the path before, then its new opening ones
    counts = np.stack([closes, size - common], 1).reshape(-1)
    opens = np.concatenate([np.repeat(np.tile([False, True], len(size)), counts), np.zeros(size[-1], bool)])
    tree, at = Parentheses(opens), np.flatnonzero(opens)
    close = tree.findclose(at)
    spine = (row[new] == 0) | (close >= len(opens) - size[-1])  # on the first or the last path
    own = saved[new]
    total = np.cumsum(np.where(spine, 0, own))
    upto = np.cumsum(opens)  # opening ones so far: subtrees are ranges of these
    first, last = upto[at] - 1, upto[close] - 1
    within = total[last] - total[first] + np.where(spine, 0, own)[first]
    names = run.take(pa.array(new)).to_pylist()
    listed: list[list[str] | None] = [None] * len(new)
    for i in np.flatnonzero(spine):
        j = new[i]
        listed[i] = run.slice(start[row[j]], k[j] + 1).to_pylist()
    values = [pa.array(names, pa.string()), *[pa.array(x, pa.int64()) for x in (owner[new], n[new], tree.pairs_within(at, close), within, own)], pa.array(listed, pa.list_(pa.string()))]
    return pa.RecordBatch.from_arrays(values, names=["run", "owner", "n", "leaves", "saved", "own", "spine"])


def in_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def arrays(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        paths = pa.Table.from_batches(held)["path"].combine_chunks()
        size, flat = paths.value_lengths().to_numpy().astype(np.int64), paths.flatten()
        return shard(size, flat.field("run"), *[flat.field(c).to_numpy(zero_copy_only=False) for c in ("owner", "n", "saved")])

    held, n = [], 0
    for b in batches:
        ends = np.cumsum(b.column("path").value_lengths().to_numpy())
        at = 0
        while at < b.num_rows:
            done = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, done + SHARD - n)))
            stop = min(stop, b.num_rows)
            held.append(b.slice(at, stop - at))
            n += int(ends[stop - 1] - done)
            at = stop
            if n >= SHARD or at < b.num_rows:
                yield arrays(held)
                held, n = [], 0
    if held:
        yield arrays(held)


def subtrees(paths: DataFrame) -> DataFrame:
    """(owner, n, leaves, saved) of every run, its whole subtree counted."""
    found = paths.repartitionByRange("name").sortWithinPartitions("name").select("path").mapInArrow(in_shards, RESULT)
    found = store(found, "trie-shards")
    spines = found.where("spine IS NOT NULL").groupBy("run").agg(
        F.min("owner").alias("owner"), F.min("n").alias("n"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"), F.min("own").alias("own"), F.min("spine").alias("spine")
    )
    spines = store(spines, "trie-spines")
    above = spines.select(F.explode("spine").alias("run"), "own").groupBy("run").agg(F.sum("own").alias("below"))
    merged = spines.join(above, "run").select("owner", "n", "leaves", (F.col("saved") + F.col("below")).alias("saved"))
    return found.where("spine IS NULL").select("owner", "n", "leaves", "saved").unionByName(merged)


# -- ends


def end_digests(at: DataFrame, conversations: DataFrame) -> DataFrame:
    """(depth, h1, h2, ends_sha256) of every node where conversations end. Their ids are
    put together by neighbouring ids first; a node's pieces are then hashed one by one."""
    zero = F.lit(0).cast("long")
    ends = at.where("last").select("depth", "h1", "h2", "conv").unionByName(conversations.where("turns = 0").select(zero.alias("depth"), zero.alias("h1"), zero.alias("h2"), "conv"))
    key = ["depth", "h1", "h2"]
    ids = F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda i: i.cast("string")))
    pieces = ends.groupBy(*key, F.shiftright("conv", CHUNK).alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h = None, None
        done: list[tuple] = []
        for b in batches:
            for *node, ids in zip(*[b.column(c).to_pylist() for c in (*key, "ids")]):
                if node == now:
                    h.update(b"," + ids.encode())
                    continue
                if now is not None:
                    done.append((*now, h.hexdigest()))
                now, h = node, hashlib.sha256(ids.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], names=[*key, "ends_sha256"])
                done = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, h.hexdigest())], names=[*key, "ends_sha256"])

    return pieces.repartition(*key).sortWithinPartitions(*key, "piece").drop("piece").mapInArrow(run, "depth long, h1 long, h2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256) of every node."""
    rows = store(numbered(turns(conversations)), "trie-turns")
    again, convs = rebuilt(rows)
    at = store(prefixes(again), "trie-prefixes")
    nodes = store(nodes_of(at, convs), "trie-nodes")
    runs = runs_of(nodes)
    whole = subtrees(leaf_paths(at, runs))
    of = runs.join(whole, ["owner", "n"]).select(
        F.concat_ws(" ", "owner", "n").alias("of"), "first", "final", "children", "above_owner", F.col("above").alias("top"), "leaves", whole["saved"].alias("total")
    )
    ends = end_digests(at, convs)
    joined = nodes.join(ends, ["depth", "h1", "h2"], "left").join(of, F.concat_ws(" ", nodes["owner"], nodes["n"]) == F.col("of"))
    return joined.select(
        F.col("owner").alias("conv_id"),
        "depth",
        F.when(F.col("depth") > F.col("first"), F.col("owner")).otherwise(F.col("above_owner")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"),
        F.when(F.col("depth") < F.col("final"), F.lit(1)).otherwise(F.col("children")).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"),
        (F.col("total") - (F.col("n") - 1) * (F.col("above") - F.col("top"))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: crc32 of a decimal number's text, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
  lambda a, x: list_reduce(range(8), lambda r, i: xor(r >> 1, (r & 1) * 3988292384), xor(a, x)), 4294967295))"""

ORACLE = f"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) - 1 AS pos, k, size FROM (
    SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, strlen(coalesce(text, '')) AS size
    FROM conversations WHERE conv_id IS NOT NULL)),
c AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {_CRC} % {SHIFTED} AS h FROM (SELECT DISTINCT conv_id FROM t)),
shared AS (SELECT c.conv_id, t.pos, t.k, t.size FROM c JOIN t ON t.conv_id = c.base AND t.pos < c.h),
lead AS (SELECT conv_id, count(*) AS m FROM shared GROUP BY 1),
r AS (SELECT * FROM shared UNION ALL
  SELECT t.conv_id, t.pos - c.h + coalesce(m, 0), t.k, t.size FROM t JOIN c USING (conv_id) LEFT JOIN lead USING (conv_id) WHERE t.pos >= c.h),
p AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS size FROM c UNION ALL
  SELECT conv_id, pos + 1, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos), size FROM r),
n AS (SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n, any_value(size) AS size FROM p GROUP BY 1, 2),
ch AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS m FROM n WHERE depth > 0 GROUP BY 1),
up AS (SELECT left(path, 32 * j) AS path, CAST(sum((n - 1) * size) AS BIGINT) AS saved, count(*) FILTER (WHERE leaf) AS leaves
  FROM (SELECT n.path, n.n, n.size, ch.path IS NULL AS leaf, unnest(range(depth + 1)) AS j FROM n LEFT JOIN ch ON ch.path = n.path) GROUP BY 1),
ends AS (SELECT path, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h
  FROM (SELECT conv_id, arg_max(path, depth) AS path FROM p GROUP BY 1) GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(ch.m, 0) AS n_children, up.leaves AS n_leaves, up.saved AS saved_tokens,
  coalesce(ends.h, sha256('')) AS ends_sha256
FROM n JOIN up ON up.path = n.path LEFT JOIN ch ON ch.path = n.path LEFT JOIN ends ON ends.path = n.path
LEFT JOIN n parent ON n.depth > 0 AND parent.depth = n.depth - 1 AND parent.path = left(n.path, 32 * (n.depth - 1))"""
