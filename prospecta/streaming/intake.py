"""Incremental intake of landed files (INC2) with Structured Streaming.

A parquet/CSV file source over the landing folder, ``trigger(availableNow=True)``
to process whatever has landed and stop, a checkpoint that remembers processed
files (a re-run with the same checkpoint adds nothing), and ``foreachBatch`` that
maps each micro-batch with the static registry tables (stream-static joins) and
writes it under ``batch_id=<n>`` with overwrite - a retried batch replaces its own
output, so the sink is exactly-once. Registry files that land twice, under whatever name,
are told by their content.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prospecta.session import rows_df
from prospecta.sources.registry import CORRUPT, positional_rows


def run_available(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    checkpoint: str,
    output: str,
    transform: Callable[[DataFrame], DataFrame],
    *,
    fmt: str = "parquet",
    max_files_per_trigger: int | None = None,
) -> None:
    reader = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(landing)

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{output.rstrip('/')}/batch_id={batch_id}")

    q = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


FILE, REJECT, REPEATED = "arquivo", "malformada", "repetido"


def _side(output: str, what: str) -> str:
    return f"{output.rstrip('/')}_{what}"


def run_available_registry_csv(
    spark: SparkSession,
    landing: str,
    columns: Sequence[str],
    checkpoint: str,
    output: str,
    transform: Callable[[DataFrame], DataFrame],
    *,
    max_files_per_trigger: int | None = None,
) -> None:
    """INC2 over landed registry files (headerless ``;`` latin-1). The stream brings the
    names of new files only, their content is read by the positional scan that staging
    uses. A micro-batch is written three times, each under ``batch_id=<n>`` with overwrite,
    so a retried batch replaces its own files:

    * ``<output>_raw``: one pass over the files, rows and rejected records in partitions
      of their own, each with its file;
    * ``<output>_files``: the batch's files with a digest of their records. A file whose
      records were taken before, in this batch or an earlier one, is marked as repeated;
    * ``output``: ``transform`` of the rows of the files that are not repeated."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    stream = reader.load(landing).select("path")  # the content is not read here

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        names = [r["path"] for r in batch.collect()]
        if not names:
            return
        session = batch.sparkSession
        part = f"batch_id={batch_id}"
        raw, files = f"{_side(output, 'raw')}/{part}", f"{_side(output, 'files')}/{part}"
        rows = positional_rows(session, names, columns, file_column=FILE)
        rows.withColumn(REJECT, F.col(CORRUPT).isNotNull().cast("int")).write.mode("overwrite").partitionBy(REJECT).parquet(raw)
        stored = session.read.schema(_raw_schema(columns)).parquet(raw)
        _mark_files(stored, _earlier_digests(session, output, batch_id)).write.mode("overwrite").parquet(files)
        fresh = session.read.parquet(files).where(~F.col(REPEATED)).select(FILE)
        ok = stored.where(F.col(REJECT) == 0).join(F.broadcast(fresh), FILE, "left_semi").select(*columns)
        transform(ok).write.mode("overwrite").parquet(f"{output.rstrip('/')}/{part}")

    q = (
        stream.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()


def _raw_schema(columns: Sequence[str]) -> str:
    return ", ".join(f"`{c}` string" for c in (*columns, CORRUPT, FILE)) + f", {REJECT} int"


def _mark_files(stored: DataFrame, earlier: DataFrame) -> DataFrame:
    """(file, digest, repeated): the digest adds up two hashes of every record, so equal
    records count each time and their order does not matter; of the files of a batch with
    one digest the first by name is taken. Partial sums per file: one row per task and file."""
    record = [F.coalesce(F.col(c), F.lit("\u0000")) for c in stored.columns if c not in (FILE, REJECT)]
    hashed = stored.select(FILE, *[F.xxhash64(F.lit(seed), *record).alias(f"h{seed}") for seed in (1, 2)])
    # added up in halves: sums of long, not of decimal
    halves = [F.sum(f(F.col(f"h{seed}"))).alias(f"{half}{seed}") for seed in (1, 2) for half, f in (("hi", lambda h: F.shiftright(h, 32)), ("lo", lambda h: h.bitwiseAND(F.lit(0xFFFFFFFF))))]
    sums = [F.col(f"hi{seed}").cast("decimal(20,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"lo{seed}").cast("decimal(20,0)") for seed in (1, 2)]
    digests = hashed.groupBy(FILE).agg(F.count(F.lit(1)).alias("n"), *halves).select(FILE, F.concat_ws("-", "n", *[s.cast("decimal(38,0)") for s in sums]).alias("digest"))
    first = digests.groupBy("digest").agg(F.min(FILE).alias("first"))
    marked = digests.join(first, "digest").join(earlier.withColumn("known", F.lit(True)), "digest", "left")
    return marked.select(FILE, "digest", (F.col("known").isNotNull() | (F.col(FILE) != F.col("first"))).alias(REPEATED))


def _earlier_digests(spark: SparkSession, output: str, batch_id: int) -> DataFrame:
    """Digests taken by other batches (a retried batch doesn't count its own)."""
    path = _side(output, "files")
    schema = f"{FILE} string, digest string, {REPEATED} boolean, batch_id long"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return rows_df(spark, [], "digest string")
    return spark.read.schema(schema).parquet(path).where(F.col("batch_id") != batch_id).select("digest").distinct()


def read_rejects(spark: SparkSession, output: str, columns: Sequence[str]) -> DataFrame:
    """(arquivo, linha) of the records that did not fit, repeated files left out."""
    raw = spark.read.schema(f"{_raw_schema(columns)}, batch_id long").parquet(_side(output, "raw")).where(F.col(REJECT) == 1)
    files = spark.read.parquet(_side(output, "files")).where(~F.col(REPEATED)).select(FILE, "batch_id")
    return raw.join(files, [FILE, "batch_id"], "left_semi").select(FILE, F.col(CORRUPT).alias("linha"))


def read_output(spark: SparkSession, output: str) -> DataFrame:
    return spark.read.parquet(output)
