"""Versioned, country-partitioned ``leads`` with blue/green activation.

Layout under a warehouse root (any path Spark can write; the small pointer and manifest
files go through the same Hadoop file system, ``.tmp`` + one overwriting rename)::

    versions/<version>/pais=BR/part-*.parquet      one write job per source run
    versions/<version>/_manifest.json              {"BR": "<version>", "FR": "<older>"}
    summaries/<version>/pais=BR/{counts,ids}       mergeable quality summary of those files
    active_version.txt                             name of the live version

Carry-forward (V3) records, in the new version's manifest, which older version
holds each other country instead of copying files; the reader unions one
``basePath``-anchored read per manifest entry, so partition pruning on ``pais`` keeps
working and an old version is never modified or deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from prospecta import schema as S
from prospecta.operators import mapping as M
from prospecta.operators import quality as Q
from prospecta.session import shuffles_freed

POINTER = "active_version.txt"
MANIFEST = "_manifest.json"


def new_version_id(now: datetime | None = None) -> str:
    """V1: ``YYYYmmddTHHMMSSffffffZ`` (UTC, microseconds)."""
    return (now or datetime.now(UTC)).strftime("%Y%m%dT%H%M%S%fZ")


def version_dir(root: str, version: str) -> str:
    return f"{root.rstrip('/')}/versions/{version}"


def _hadoop(path: str):
    """(FileSystem, Path, JVM, configuration) of a warehouse path, from the active
    session: whatever file system Spark writes the data to, local ones included, the
    pointer and manifests go to the same."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise RuntimeError("no active Spark session for a warehouse path")
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(conf), hpath, jvm, conf


def _read_text(path: str) -> str | None:
    fs, hpath, jvm, _ = _hadoop(path)
    if not fs.exists(hpath):
        return None
    stream = fs.open(hpath)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def _write_atomic(path: str, text: str) -> None:
    """Write a ``.tmp`` file, then rename it over the target in one step (``FileContext``
    with OVERWRITE): at no time is there no target. On object stores without a rename the
    file system's own semantics apply."""
    fs, hpath, jvm, conf = _hadoop(path)
    fs.setWriteChecksum(False)  # no checksum files beside the pointer
    fs.mkdirs(hpath.getParent())
    tmp = jvm.org.apache.hadoop.fs.Path(hpath.getParent(), f".{hpath.getName()}.{uuid.uuid4().hex[:8]}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    fs.setWriteChecksum(True)
    rename = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    how = SparkSession.getActiveSession().sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(hpath).toUri(), conf).rename(fs.makeQualified(tmp), fs.makeQualified(hpath), how)


def active_version(root: str) -> str | None:
    """V2 read: the live version name, or None before the first activation."""
    txt = _read_text(f"{root.rstrip('/')}/{POINTER}")
    return (txt or "").strip() or None


def activate(root: str, version: str) -> None:
    """V2 switch: write ``.tmp`` then rename, after the version's write committed."""
    _write_atomic(f"{root.rstrip('/')}/{POINTER}", version)


def read_manifest(root: str, version: str) -> dict[str, str]:
    txt = _read_text(f"{version_dir(root, version)}/{MANIFEST}")
    return json.loads(txt) if txt else {}


#: Columns that published files are clustered by, and the column with Bloom filters.
CLUSTERED, LOOKED_UP = ("regiao", "cod_atividade"), "id_estab"


def clustered(df: DataFrame) -> DataFrame:
    """Rows of one region and activity side by side, sorted within files, so that the filters
    on them (F3, F4) skip row groups and pages by their least and greatest values. Rows are
    dealt by hash and AQE evens the partitions out: it joins small ones to its advisory size and
    splits what a region with a third of the rows makes large. Ranges would have to be sampled
    first, for which the whole mapping runs a second time."""
    return df.hint("rebalance", *CLUSTERED).sortWithinPartitions(*CLUSTERED, LOOKED_UP)


#: Rows that move in one pass of ``clustered_in_passes``, and passes at most: each reads the table again.
PASS_ROWS, PASSES = 16_000_000, 4


def clustered_in_passes(df: DataFrame, *, pass_rows: int = PASS_ROWS) -> Iterator[DataFrame]:
    """``clustered`` rows of a written table, a share of the regions and activities in each
    frame: written one after the other, only one share is in a shuffle at a time."""
    n = min(PASSES, max(1, -(-df.count() // pass_rows)))
    for i in range(n):
        yield clustered(df.where(F.pmod(F.xxhash64(*CLUSTERED), F.lit(n)) == i) if n > 1 else df)


def lookup_options(row_group: int = 64 << 20) -> dict[str, str]:
    """Writer options: Bloom filters on the id, so a point lookup (F16) reads only the row
    groups that may hold it; they are sized by the ids that a row group does hold, up to what
    it can."""
    return {
        "compression": "zstd",
        "parquet.block.size": str(row_group),
        f"parquet.bloom.filter.enabled#{LOOKED_UP}": "true",
        # without an expected number of values the writer tries sizes and keeps the least that does
        "parquet.bloom.filter.adaptive.enabled": "true",
        f"parquet.bloom.filter.candidates.number#{LOOKED_UP}": "10",
        "parquet.bloom.filter.max.bytes": str(max(2048, row_group // 64)),
    }


@dataclass(frozen=True)
class Materialized:
    version: str
    pais: str
    n_written: int
    n_rejected: int


def materialize(
    spark: SparkSession,
    candidates: DataFrame,
    root: str,
    version: str,
    pais: str,
    *,
    max_records_per_file: int | None = None,
    n_skipped: int = 0,
) -> Materialized:
    """SNK3: contract-check ``candidates`` (canonical columns) and write the valid
    rows of one country under ``versions/<version>/pais=<pais>``.

    One job: valid and rejected counts are Observation metrics of the write's own
    (final) stage, where each task's update counts once. Files are clustered (see
    ``clustered``) and sized by AQE; ``max_records_per_file`` bounds them further if given. ``n_skipped`` are rows left out before the mapping (FR orphans); they
    count as rejected. An empty input writes no data file."""
    checked = clustered(M.contract_columns(candidates))
    obs = Observation(f"materialize_{pais}")
    checked = checked.observe(
        obs,
        F.sum(F.when(F.col("reject_reason").isNull(), 1).otherwise(0)).alias("ok"),
        F.sum(F.when(F.col("reject_reason").isNotNull(), 1).otherwise(0)).alias("bad"),
    )
    valid = checked.where(F.col("reject_reason").isNull()).select(*S.canonical_select_exprs())
    valid = valid.withColumn("is_synthetic", F.coalesce("is_synthetic", F.lit(False))).withColumn(
        "flag_difusao_restrita", F.coalesce("flag_difusao_restrita", F.lit(False))
    )
    out = f"{version_dir(root, version)}/pais={pais}"
    writer = valid.drop("pais").write.mode("overwrite").options(**lookup_options())
    if max_records_per_file:
        writer = writer.option("maxRecordsPerFile", int(max_records_per_file))
    writer.parquet(out)
    got = obs.get
    return Materialized(version, pais, int(got.get("ok") or 0), int(got.get("bad") or 0) + n_skipped)


def carry_forward(root: str, version: str, exclude_pais: str) -> dict[str, str]:
    """V3: the new version's manifest points every country except ``exclude_pais``
    at the version that currently serves it (nothing is copied)."""
    cur = active_version(root)
    manifest = dict(read_manifest(root, cur)) if cur else {}
    manifest.pop(exclude_pais, None)
    return manifest


def write_manifest(root: str, version: str, manifest: dict[str, str]) -> None:
    _write_atomic(f"{version_dir(root, version)}/{MANIFEST}", json.dumps(manifest, sort_keys=True))


def read_country(spark: SparkSession, root: str, version: str, pais: str) -> DataFrame:
    """One country's rows as the version that holds them wrote them."""
    base = version_dir(root, version)
    return spark.read.option("basePath", base).parquet(f"{base}/pais={pais}").select(*S.CANONICAL_COLUMNS)


def summary_dir(root: str, version: str, pais: str) -> str:
    return f"{root.rstrip('/')}/summaries/{version}/pais={pais}"


def country_summary(spark: SparkSession, root: str, version: str, pais: str) -> Q.Summary:
    """The stored quality summary of a country; one that was never written (an older
    warehouse) is made from the country's files and kept."""
    path = summary_dir(root, version, pais)
    fs, hpath, jvm, _ = _hadoop(path)
    frames = []
    made = None
    for part in ("counts", "ids"):
        if not fs.exists(jvm.org.apache.hadoop.fs.Path(hpath, f"{part}/_SUCCESS")):
            made = made or Q.summarise(read_country(spark, root, version, pais))
            getattr(made, part).write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{part}")
        frames.append(spark.read.parquet(f"{path}/{part}"))
    return Q.Summary(frames[0], frames[1].withColumn("pais", F.lit(pais)).select("pais", "id_estab", "n"))


def version_summary(spark: SparkSession, root: str, manifest: dict[str, str]) -> Q.Summary:
    """The summaries of a manifest's countries, added up."""
    return Q.merge_summaries([country_summary(spark, root, v, p) for p, v in sorted(manifest.items())])


def read_version(spark: SparkSession, root: str, version: str) -> DataFrame:
    """Every country of ``version`` (own partitions + carried-forward ones)."""
    manifest = read_manifest(root, version)
    if not manifest:
        raise ValueError(f"version {version} has no manifest")
    out = None
    for pais, ver in sorted(manifest.items()):
        df = read_country(spark, root, ver, pais)
        out = df if out is None else out.unionByName(df)
    return out


def read_active(spark: SparkSession, root: str) -> DataFrame:
    """SRC6: the live ``leads`` table; error when nothing was activated yet."""
    v = active_version(root)
    if v is None:
        raise LookupError("no active version")
    return read_version(spark, root, v)


@dataclass(frozen=True)
class Published:
    version: str
    materialized: Materialized
    quality: dict
    activated: bool


def publish(
    spark: SparkSession,
    candidates: DataFrame,
    root: str,
    pais: str,
    *,
    thresholds: Q.QualityThresholds | None = None,
    version: str | None = None,
    n_skipped: int = 0,
) -> Published:
    """V4: materialise -> carry forward -> quality over the whole candidate version ->
    activate only if every check passed (a failure leaves the pointer untouched).

    Quality adds up the countries' stored summaries: only the country that was written is
    read again, for its own summary; of the others only counts and ids."""
    version = version or new_version_id()
    with shuffles_freed(spark):
        mat = materialize(spark, candidates, root, version, pais, n_skipped=n_skipped)
        manifest = carry_forward(root, version, exclude_pais=pais)
        manifest[pais] = version
        write_manifest(root, version, manifest)
        report = Q.report_of(version_summary(spark, root, manifest), thresholds).first().asDict()
    ok = bool(report["passed"])
    if ok:
        activate(root, version)
    return Published(version, mat, report, ok)
