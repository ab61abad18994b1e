"""Records of delimited text whose quoted fields may hold line breaks, from scans that split.

A line is read on its own, and what it does to the reader is a function of one bit: does it
start inside a quoted field, and does it end inside one? ``ends_open`` gives both answers
from the line alone. If no line that starts outside ends inside, every line is a record and
that is all there is to do. Only files in which some line does are put together:

1. their lines are numbered within their splits and stored (numbers of one scan). A line
   without a quote leaves the bit as it is, so only lines with one are stored again with
   their states;
2. the functions are composed per split, and over the splits of a file, which tells the
   state at every split's start and, by running windows within the splits, at every line
   with a quote; of the others only those between two such lines, inside a field, are picked;
3. a line that starts inside belongs to the record of the last line before it that does not.

Fields follow the usual reader: a quote opens a quoted field only at the field's start, two
quotes inside are one, text after the closing quote is kept as it stands, and quotes inside
other fields are plain characters. Bytes are decoded, never replaced: control characters
stay. A carriage return before the line break is part of the break, outside quotes.
Records of more than ``LONGEST`` characters over several lines (a quote that is never
closed would swallow the rest of a file) are not put together: their lines are rejected one
by one. So records and rejected lines together hold every line that is not empty.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prospecta.operators.keys import split_key
from prospecta.session import scratch_path

#: The longest record over several lines, the usual reader's limit for one field.
LONGEST = 131072

# parts of a field; possessive throughout, so long lines neither backtrack nor recurse
_QUOTED = r'[^"]*+(?:""[^"]*+)*+'


def _patterns(sep: str) -> tuple[str, str, str]:
    """Ends inside when started outside; when started inside; one field after a separator."""
    s = f"\\x{ord(sep):02x}"
    field = rf'(?:"{_QUOTED}"[^{s}]*+|(?!")[^{s}]*+)'
    tail = rf'(?:{field}{s})*+"{_QUOTED}\z'
    return rf"\A{tail}", rf'\A{_QUOTED}(?:\z|"[^{s}]*+{s}{tail})', rf'\G{s}("{_QUOTED}"?+[^{s}]*+|[^{s}]*+)'


def lines_of(spark: SparkSession, paths: str | Sequence[str], encoding: str) -> DataFrame:
    """(value, file, split) of every line, decoded; breaks are line feeds only."""
    raw = spark.read.option("lineSep", "\n").text(paths if isinstance(paths, str) else list(paths))
    value = F.col("value") if encoding.upper() in ("UTF-8", "UTF8") else F.decode(F.col("value").cast("binary"), encoding)
    return raw.select(value.alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))


def ends_open(value: Column, sep: str) -> tuple[Column, Column]:
    """Does the line end inside a quoted field, started outside and started inside one?"""
    outside, inside, _ = _patterns(sep)
    quoted = value.contains('"')
    return quoted & value.rlike(outside), ~quoted | value.rlike(inside)


def fields_of(record: Column, sep: str) -> Column:
    """The fields of a record as an array of texts."""
    pattern = _patterns(sep)[2]
    opened = rf'\A"({_QUOTED})"?'

    def plain(f: Column) -> Column:
        inner = F.replace(F.regexp_extract(f, opened, 1), F.lit('""'), F.lit('"'))
        return F.when(f.startswith('"'), F.concat(inner, F.regexp_replace(f, opened, ""))).otherwise(f)

    parsed = F.transform(F.regexp_extract_all(F.concat(F.lit(sep), record), F.lit(pattern), F.lit(1)), plain)
    return F.when(record.contains('"'), parsed).otherwise(F.split(record, f"\\x{ord(sep):02x}", -1))


def _start_states(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """State at the start of each row of a sequence of functions (f0, f1): ``known`` (0 or
    1, null if it hangs on the state before the first row) and ``flip``, whether an
    unknown one is turned round until here."""
    upto = Window.partitionBy(*keys).orderBy(order)
    before = upto.rowsBetween(Window.unboundedPreceding, -1)
    swap = (F.col("f0") & ~F.col("f1")).cast("int")
    df = df.withColumn("_swaps", F.coalesce(F.sum(swap).over(before), F.lit(0)))
    fixed = F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").cast("int").alias("v"), F.col("_swaps").alias("s")))
    df = df.withColumn("_fixed", F.last(fixed, ignorenulls=True).over(before))
    known = F.pmod(F.col("_fixed.v") + F.col("_swaps") - F.col("_fixed.s"), F.lit(2)) == 1
    return df.withColumns({"known": known, "flip": F.pmod("_swaps", F.lit(2)) == 1}).drop("_swaps", "_fixed")


def _after(state: Column) -> Column:
    return F.when(state, F.col("f1")).otherwise(F.col("f0"))


def _joined(lines: DataFrame, sep: str) -> DataFrame:
    """(file, value, reject) of the records of files with records over several lines."""
    spark = lines.sparkSession
    f0, f1 = ends_open(F.col("value"), sep)
    path = scratch_path(spark, "numbered-lines")
    lines.select("*", F.monotonically_increasing_id().alias("id"), f0.alias("f0"), f1.alias("f1"), F.col("value").contains('"').alias("quoted")).write.parquet(path)
    lines = spark.read.parquet(path)
    # lines without a quote leave the state as it is: only the others go through the windows
    at = _start_states(lines.where("quoted"), ["file", "split"], "id")
    ends = F.struct(_after(F.coalesce("known", "flip")).alias("f0"), _after(F.coalesce("known", ~F.col("flip"))).alias("f1"))
    path = scratch_path(spark, "quoted-lines")
    here = Window.partitionBy("file", "split").orderBy("id")
    at.select("file", "split", "id", "value", "f0", "f1", "known", "flip", ends.alias("e"), F.lead("id").over(here).alias("next")).write.parquet(path)
    at = spark.read.parquet(path)
    changed = at.groupBy("file", "split").agg(F.max_by("e", "id").alias("e"), F.min("id").alias("next"))
    splits = lines.groupBy("file", "split").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).join(changed, ["file", "split"], "left")
    splits = splits.select("file", "split", "lo", "hi", "next", F.coalesce("e.f0", F.lit(False)).alias("f0"), F.coalesce("e.f1", F.lit(True)).alias("f1"))
    begin = _start_states(splits, ["file"], "split").select("file", "split", "lo", "hi", F.col("next").alias("first"), F.coalesce("known", "flip").alias("inside"))
    at = at.join(begin, ["file", "split"]).withColumn("open", F.coalesce("known", F.col("flip") != F.col("inside")))
    at = at.select("file", "split", "id", "value", "hi", "next", "open", _after(F.col("open")).alias("on"))
    # the record of a line: the last line at or before it that starts outside; where it has
    # several lines, that one holds a quote
    head = F.when(~F.col("open"), F.struct("split", "id"))
    heads = begin.join(at.groupBy("file", "split").agg(F.max(head).alias("head")), ["file", "split"], "left")
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("file", "split", "lo", "hi", "first", "inside", F.last("head", ignorenulls=True).over(earlier).alias("carried"))
    path = scratch_path(spark, "split-states")
    heads.write.parquet(path)  # a row per split
    heads = spark.read.parquet(path)
    at = at.withColumn("head", F.last(head, ignorenulls=True).over(here)).join(heads.select("file", "split", "carried"), ["file", "split"])
    path = scratch_path(spark, "stated-lines")
    at.select("file", "split", "id", "value", "hi", "next", "open", "on", F.coalesce("head", "carried").alias("head")).write.parquet(path)
    at = spark.read.parquet(path)
    # lines without a quote inside a field: what lies between two lines with one, or before the first
    between = at.where("on").select("head", (F.col("id") + 1).alias("a"), F.coalesce(F.col("next") - 1, "hi").alias("b"))
    before = heads.where("inside").select(F.col("carried").alias("head"), F.col("lo").alias("a"), F.coalesce(F.col("first") - 1, "hi").alias("b"))
    inner = between.unionByName(before).where("a <= b").select("head", F.explode(F.sequence("a", "b")).alias("id"))
    plain = lines.where("NOT quoted").select("file", "split", "id", "value")
    single = plain.join(inner.select("id"), "id", "left_anti").select("file", "value")
    single = single.unionByName(at.where(~F.col("open") & ~F.col("on")).select("file", "value")).withColumn("reject", F.lit(False))
    several = at.where(F.col("open") | F.col("on")).select("file", "head", "split", "id", "value").unionByName(plain.join(inner, "id").select("file", "head", "split", "id", "value"))
    several = several.withColumn("of", F.concat_ws("|", "file", "head.split", "head.id"))
    size = several.groupBy("of").agg(F.sum(F.length("value") + 1).alias("size")).select(split_key(F.col("of")).alias("k"), "size")
    several = several.join(size, split_key(F.col("of")) == F.col("k"))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("split", "id", "value"))), lambda x: x["value"]), "\n")
    whole = several.where(F.col("size") <= LONGEST).groupBy("of").agg(F.first("file").alias("file"), text.alias("value")).select("file", "value", F.lit(False).alias("reject"))
    return single.unionByName(whole).unionByName(several.where(F.col("size") > LONGEST).select("file", "value", F.lit(True).alias("reject")))


def read_records(spark: SparkSession, paths: str | Sequence[str], encoding: str, sep: str) -> DataFrame:
    """(file, value, reject, fields) of every record that is not empty. One pass looks for files
    with records over several lines; all other files are read line by line, lazily."""
    lines = lines_of(spark, paths, encoding)
    files = [r["file"] for r in lines.where(ends_open(F.col("value"), sep)[0]).select("file").distinct().collect()]
    records = lines.where(~F.col("file").isin(files)) if files else lines
    records = records.select("file", "value", F.lit(False).alias("reject"))
    if files:
        records = records.unionByName(_joined(lines.where(F.col("file").isin(files)), sep))
    records = records.withColumn("value", F.regexp_replace("value", r"\r\z", "")).where(F.col("value") != "")
    return records.select("file", "value", "reject", fields_of(F.col("value"), sep).alias("fields"))
