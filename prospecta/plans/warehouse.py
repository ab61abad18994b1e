"""The published ``leads`` table the serving queries read.

Production flow (and the reference's): ingest jobs map registry dumps to canonical
rows and publish them as Parquet partitioned by ``pais``; every list, chart, gate,
score and quality job then reads that table. Here the table is built from the
driver's tables once per session and input folder, written under the shared
``spark.checkpoint.dir`` (a written table, not an in-memory cache: it survives
executor loss and cuts the ingest lineage), and read back lazily. Demo rows live in
their own tree (SNK7) and are unioned in only where a job wants them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prospecta import schema as S
from prospecta.plans import ingest as I
from prospecta.plans import publish as PB
from prospecta.plans import search as SE
from prospecta.session import scratch_path, shuffles_freed, stored_while
from prospecta.sources import testdata as TD

_PUBLISHED: dict[tuple[str, str, str], "Published"] = {}


@dataclass(frozen=True)
class Published:
    real: str
    demo: str


def _key(spark: SparkSession, sf_dir: str) -> tuple[str, str, str]:
    return (spark.sparkContext.applicationId, sf_dir.rstrip("/"), _inputs(spark, sf_dir))


def _still_there(spark: SparkSession, p: "Published") -> bool:
    """Both trees were committed and are still present (a cleaned scratch folder forces a
    rebuild), looked up through the file system that Spark wrote them to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = [jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS") for path in (p.real, p.demo)]
    return all(m.getFileSystem(conf).exists(m) for m in marks)


def _inputs(spark: SparkSession, sf_dir: str) -> str:
    """Files of the input tables, those in a table's folder too, with their sizes and times:
    changed inputs are noticed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(sf_dir)
    found, files = folder.getFileSystem(conf).listFiles(folder, True), []
    while found.hasNext():
        x = found.next()
        files.append(f"{x.getPath()}:{x.getLen()}:{x.getModificationTime()}")
    return ";".join(sorted(files))


def publish_leads(spark: SparkSession, sf_dir: str, *, force: bool = False) -> Published:
    """Write real leads (BR + FR, partitioned by ``pais``) and the demo rows."""
    k = _key(spark, sf_dir)
    if not force and k in _PUBLISHED and _still_there(spark, _PUBLISHED[k]):
        return _PUBLISHED[k]
    real = scratch_path(spark, "leads")
    demo = scratch_path(spark, "demo-leads")
    with shuffles_freed(spark):
        # one country after the other, mapped and then clustered: the shuffles of one step at a time
        for mapped in (I.br_mapped, I.fr_mapped):
            with stored_while(spark, mapped(spark, sf_dir).valid, "mapped") as rows:
                for some in PB.clustered_in_passes(rows):
                    some.write.mode("append").options(**PB.lookup_options()).partitionBy("pais").parquet(real)
        TD.demo_leads_from_part(spark, sf_dir).write.mode("overwrite").partitionBy("pais").parquet(demo)
    _PUBLISHED[k] = Published(real, demo)
    return _PUBLISHED[k]


_READ_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in S.CANONICAL_FIELDS if n != "pais"] + [T.StructField("pais", T.StringType(), True)])


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The published tree with its known schema (no footer inference per read);
    ``pais`` comes from the partition folders as text; canonical column order."""
    return spark.read.schema(_READ_SCHEMA).parquet(path).select(*S.CANONICAL_COLUMNS)


def real_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, publish_leads(spark, sf_dir).real)


def demo_leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, publish_leads(spark, sf_dir).demo)


_INDEXED: dict[str, SE.Index] = {}


def search_index(spark: SparkSession, sf_dir: str) -> SE.Index:
    """The text-search index of the published version, built once per version."""
    p = publish_leads(spark, sf_dir)
    if p.real not in _INDEXED:
        _INDEXED[p.real] = SE.build(spark, leads(spark, sf_dir))
    return _INDEXED[p.real]


def leads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Real leads plus the demo rows (the filters decide whether demo rows show)."""
    return real_leads(spark, sf_dir).unionByName(demo_leads(spark, sf_dir))
