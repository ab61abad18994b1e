"""Operator 3: mix sources to target weights along a low-discrepancy schedule.

* Targets: the total (``SHARE`` of all words) is divided by weight; a source stops at
  ``CAP`` times its size and the excess is shared again by weight, until none is above.
* Blocks: each source's documents, shuffled by a hash of the id, form one stream of words
  that is cut into blocks of ``BLOCK`` words.
* Schedule: slot k's golden-ratio point frac(k * phi) is mapped through the cumulative
  shares of the sources; a source's slots are ranked in order of k, and rank r takes block
  r modulo the number of its blocks, so that a source is repeated evenly, whole rounds
  first. The last slot of a source takes only the words that are missing to its target.
* A document's ``taken`` is the number of its words in taken blocks, repeats counted.

Everything is DataFrame operations. No source, slot range or stream is ever gathered in
one task: running sums and ranks are taken inside small chunks and offset by the sums of
the chunks before, points meet the cumulative shares in bins of the unit interval.

Cases: null text has 0 words; documents without words are returned with 0 taken; null is a
source of its own, last in order; repeated rows are separate documents with equal rights
(equal rows differ only in which of them is taken); without any words all targets are 0;
only ``doc_id``, ``source`` and ``text`` are read; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prospecta.llm.common import WORD, store

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
BLOCK = 256
CHUNK = 1 << 16  #: slots ranked together
GOLDEN = (math.sqrt(5) - 1) / 2


def running_sum(df: DataFrame, group: list[str], chunk: Column, order: list, value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the earlier rows of its group. ``chunk`` must
    rise with the order; each chunk is summed by itself and offset by the chunks before."""
    df = df.withColumn("_chunk", chunk).withColumn("_value", value.cast("long"))
    sums = df.groupBy(*group, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    inside = Window.partitionBy(*group, "_chunk").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    df = df.join(sums, [*group, "_chunk"])
    return df.withColumn(name, F.col("_inside") + F.col("_before")).drop("_chunk", "_value", "_inside", "_before")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """``df`` with its row number from 0 in a total order: sorted by ranges, numbered in
    each range and offset by the ranges' sizes (one number per range is collected)."""
    df = store(df.orderBy(*order).withColumn("_range", F.spark_partition_id()), name)
    sizes = sorted(df.groupBy("_range").count().collect())
    starts, n = [], 0
    for r in sizes:
        starts.append((r["_range"], n))
        n += r["count"]
    if not starts:
        return df.drop("_range").withColumn(name, F.lit(0).cast("long"))
    first = F.get(F.array(*[F.lit(s).cast("long") for _, s in starts]), F.array_position(F.array(*[F.lit(p) for p, _ in starts]), F.col("_range")).cast("int") - 1)
    rank = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1
    return df.withColumn(name, first + rank).drop("_range")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, idx, source_size, target) from rows (source, size)."""
    src = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    src = numbered(src, [F.col("source").asc_nulls_last()], "idx")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("idx") % len(weights)).cast("int"))
    src = store(src.withColumn("weight", weight), "mix-sources")
    most = F.col("source_size") * float(cap)
    total = (src.agg(F.sum("source_size").alias("n")).first()["n"] or 0) * share
    level = 0.0
    while total:  # words per weight; it rises until no source is above its cap
        above = most < F.col("weight") * level
        r = src.agg(F.sum(F.when(above, most).otherwise(0.0)).alias("full"), F.sum(F.when(above, 0.0).otherwise(F.col("weight"))).alias("rest")).first()
        if not r["rest"]:
            break
        new = (total - r["full"]) / r["rest"]
        if new <= level:
            break
        level = new
    return src.withColumn("target", F.least(most, F.col("weight") * level)).drop("weight")


def golden_point(k: Column) -> Column:
    """frac(k * phi) without losing digits for large k."""
    high, low = F.floor(k / (1 << 24)), k % (1 << 24)
    step = math.fmod(GOLDEN * (1 << 24), 1.0)
    x = (high * F.lit(step)) % 1.0 + (low * F.lit(GOLDEN)) % 1.0
    return x % 1.0


def schedule(quota: DataFrame, slots: int) -> DataFrame:
    """(idx, rank) of every slot, from (idx, quota) with quotas that sum to ``slots``."""
    spark = quota.sparkSession
    quota = quota.where(F.col("quota") > 0).select("idx", "quota")
    edges = running_sum(quota.withColumn("_all", F.lit(0)), ["_all"], F.floor(F.col("idx") / 4096), ["idx"], F.col("quota"), "start").drop("_all")
    bins = max(1, slots // 100_000)
    low, high = F.col("start") / slots, (F.col("start") + F.col("quota")) / slots
    to_bin = lambda x: F.least(F.floor(x * bins), F.lit(bins - 1)).cast("long")
    edges = edges.select("idx", low.alias("x"), F.explode(F.sequence(to_bin(low), to_bin(high))).alias("bin"), F.lit(None).cast("long").alias("k"))
    edges = edges.withColumn("x", F.greatest("x", F.col("bin") / bins))  # the source that is open where a bin begins
    points = spark.range(slots).select(F.lit(None).cast("long").alias("idx"), golden_point(F.col("id")).alias("x"), F.col("id").alias("k"))
    points = points.withColumn("bin", to_bin(F.col("x")))
    inside = Window.partitionBy("bin").orderBy("x", F.col("k").asc_nulls_first(), "idx").rowsBetween(Window.unboundedPreceding, 0)
    both = edges.select("idx", "x", "bin", "k").unionByName(points.select("idx", "x", "bin", "k"))
    picked = both.withColumn("idx", F.last("idx", ignorenulls=True).over(inside)).where(F.col("k").isNotNull()).select("idx", "k")
    ranked = running_sum(picked, ["idx"], F.floor(F.col("k") / CHUNK), ["k"], F.lit(1), "rank").select("idx", "rank")
    # A source's share of the points differs from its quota by a few slots: the last ones go or come.
    have = ranked.groupBy("idx").agg(F.count("*").alias("have"))
    missing = quota.join(have, "idx", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < quota")
    missing = missing.select("idx", F.explode(F.sequence(F.col("have"), F.col("quota") - 1)).alias("rank"))
    return ranked.join(quota, "idx").where("rank < quota").select("idx", "rank").unionByName(missing)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, block: int = BLOCK, seed: int = 1) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row."""
    size = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    sizes = store(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size")), "mix-sizes")
    src = store(targets(sizes, weights, share, cap), "mix-targets")
    # words asked of a source, its blocks, and the slots that hold them
    asked, blocks = F.round("target").cast("long"), F.ceil(F.col("source_size") / block).cast("long")
    quota = F.when(F.col("source_size") > 0, F.floor(asked / F.col("source_size")) * blocks + F.ceil((asked % F.when(F.col("source_size") > 0, F.col("source_size"))) / block)).otherwise(0)
    src = src.withColumns({"asked": asked, "blocks": blocks, "quota": quota.cast("long")})
    slots = src.agg(F.sum("quota").alias("n")).first()["n"] or 0

    keyed = sizes.join(src.select(F.col("source").alias("s"), "idx", "source_size", "target"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    columns = ["doc_id", "source", "size", "source_size", "target"]
    if not slots:
        return keyed.select(*columns, F.lit(0).cast("long").alias("taken"))

    slot = schedule(src, slots).join(src.select("idx", "source_size", "asked", "blocks"), "idx")
    slot = slot.withColumn("block", F.col("rank") % F.col("blocks"))
    whole = F.least(F.lit(block), F.col("source_size") - F.col("block") * block)
    left = F.col("asked") - F.floor(F.col("rank") / F.col("blocks")) * F.col("source_size") - F.col("block") * block
    times = slot.groupBy("idx", "block").agg(F.sum((left >= whole).cast("long")).alias("full"), F.max(F.when((left < whole) & (left > 0), left).otherwise(0)).alias("part"))

    filled = keyed.where("size > 0").withColumn("h", F.xxhash64(F.lit(seed), "doc_id"))
    bits = max(4, math.ceil(math.log2(max(1, sizes.count()) / 20_000)))
    chunk = F.shiftright("h", 64 - bits)  # chunks follow the order of h
    placed = running_sum(filled, ["idx"], chunk, ["h", "doc_id", "size"], F.col("size"), "start")
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    a, b = F.greatest("start", F.col("block") * block), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.join(times, ["idx", "block"], "left")
    took = (b - a) * F.coalesce("full", F.lit(0)) + F.greatest(F.lit(0), F.least(b, F.col("block") * block + F.coalesce("part", F.lit(0))) - a)
    taken = pieces.groupBy("idx", "start", *columns).agg(F.sum(took).cast("long").alias("taken")).select(*columns, "taken")
    return taken.unionByName(keyed.where("size = 0").select(*columns, F.lit(0).cast("long").alias("taken")))
