"""Session helpers: a configured SparkSession, the shared scratch location, and literal
frames."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULT_CONF: dict[str, str] = {
    "spark.ui.enabled": "false",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def get_spark(
    app: str = "prospecta",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Build (or reuse) a session. On a cluster leave ``master`` None so the launcher's
    master, ``spark.checkpoint.dir`` and partition sizing apply."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in {**DEFAULT_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir`` (or the context's
    checkpoint dir). When neither is set, local mode (tests) gets a private temp
    folder; on a cluster this is an error - never a machine-local folder there."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if not d:
        d = spark.conf.get("spark.checkpoint.dir", None)
        if not d:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
            d = tempfile.mkdtemp(prefix="prospecta-ckpt-")  # local mode only (tests)
        sc.setCheckpointDir(d)
        d = sc.getCheckpointDir() or d
    return d.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path under the shared checkpoint root for a job's own
    intermediate or output files (never a machine-local temp dir)."""
    return f"{checkpoint_root(spark)}/prospecta/{name}-{uuid.uuid4().hex[:12]}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of every write or action inside go when it has ended; else they stay on
    the executors' disks until the driver happens to collect its garbage, those of all earlier
    steps beside the present one's. A later run of the same frame shuffles anew."""
    old = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if old is None else spark.conf.set(_CLEANUP, old)


@contextmanager
def stored_while(spark: SparkSession, df: DataFrame, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in the shared folder, written once and deleted at the end: for rows
    that a step reads more than once."""
    with scratch_while(spark, name) as path:
        with shuffles_freed(spark):
            df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_while(spark: SparkSession, name: str) -> Iterator[str]:
    """A fresh scratch path whose files are deleted at the end."""
    path = scratch_path(spark, name)
    try:
        yield path
    finally:
        fs, at = _at(spark, path)
        fs.delete(at, True)


def _at(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table."""
    fs, at = _at(spark, path)
    return fs.getContentSummary(at).getLength()


def rows_df(spark: SparkSession, rows, schema) -> DataFrame:
    """A small literal DataFrame (reports, one-row events) built on the JVM side:
    ``createDataFrame`` from a Python list goes through a Python RDD and starts
    Python workers just to unpickle a handful of rows."""
    from pyspark.sql import types as T

    if isinstance(schema, str):
        schema = T._parse_datatype_string(schema)
    fields = schema.fields
    if not rows:
        return spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in fields])
    import datetime as _dt

    def lit(v, t):
        # wall-clock values for TIMESTAMP_NTZ are passed as text, so the driver's
        # local time zone never shifts them
        if isinstance(t, T.TimestampNTZType) and isinstance(v, _dt.datetime):
            return F.lit(v.replace(tzinfo=None).isoformat(sep=" ")).cast(t)
        if isinstance(t, T.TimestampType) and isinstance(v, _dt.datetime) and v.tzinfo is None:
            v = v.replace(tzinfo=_dt.UTC)  # naive instants are UTC
        return F.lit(v).cast(t)

    structs = [F.struct(*[lit(v, f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs))).select(*[f.name for f in fields])
