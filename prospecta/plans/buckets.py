"""Staged registry tables bucketed by company key (SNK1, J1): one shuffle when a dump is
staged instead of one at every join.

``ESTABELECIMENTOS``, ``EMPRESAS`` and ``SIMPLES`` are written with the same number of
buckets on ``cnpj_basico``, sorted within, so their joins read matching buckets and move
nothing. A bucket is never split, so companies with more than ``heavy`` establishments
stay out of the buckets: their establishments are written evenly to a table of their own
and meet the few companies concerned (at most rows / heavy of them) in a broadcast.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prospecta.operators import mapping as M
from prospecta.plans import publish as PB

KEY = "cnpj_basico"
LARGE = ("ESTABELECIMENTOS", "EMPRESAS", "SIMPLES")
HEAVY = 1_000_000  #: establishments of a company that is kept out of the buckets


@dataclass(frozen=True)
class Staged:
    root: str
    buckets: int


def _name(root: str, entity: str) -> str:
    return f"staged_{hashlib.md5(root.encode()).hexdigest()[:12]}_{entity.lower()}"


def stage_buckets(spark: SparkSession, tables: dict[str, DataFrame], root: str, *, buckets: int, heavy: int = HEAVY) -> Staged:
    """Write the three tables; the layout is noted beside them for later sessions."""
    est = tables["ESTABELECIMENTOS"]
    path = f"{root}/HEAVY"
    est.groupBy(KEY).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > heavy).select(KEY).write.mode("overwrite").parquet(path)
    keys = spark.read.schema(f"{KEY} string").parquet(path)
    est.join(F.broadcast(keys), KEY, "left_semi").select(*est.columns).write.mode("overwrite").parquet(f"{root}/HEAVY_ESTABELECIMENTOS")
    light = est.join(F.broadcast(keys), KEY, "left_anti").select(*est.columns)
    for entity, df in {**tables, "ESTABELECIMENTOS": light}.items():
        # dealt by the bucket's own hash first: one file per bucket
        out = df.repartition(buckets, KEY).write.mode("overwrite").bucketBy(buckets, KEY).sortBy(KEY)
        out.option("path", f"{root}/{entity}").format("parquet").saveAsTable(_name(root, entity))
    PB._write_atomic(f"{root}/_buckets.json", json.dumps({"buckets": buckets, "schemas": {e: d.schema.simpleString() for e, d in tables.items()}}))
    return Staged(root, buckets)


def open_buckets(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The staged tables with their buckets known to the session, and those of the heavy
    companies."""
    note = json.loads(PB._read_text(f"{root}/_buckets.json"))
    out = {}
    for entity, schema in note["schemas"].items():
        name = _name(root, entity)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{c.split(':')[0]}` {c.split(':')[1]}" for c in schema[len("struct<") : -1].split(","))
            spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {note['buckets']} BUCKETS LOCATION '{root}/{entity}'")
        out[entity] = spark.table(name)
    out["HEAVY"] = spark.read.schema(f"{KEY} string").parquet(f"{root}/HEAVY")
    out["HEAVY_ESTABELECIMENTOS"] = spark.read.schema(out["ESTABELECIMENTOS"].schema).parquet(f"{root}/HEAVY_ESTABELECIMENTOS")
    return out


def br_joined(spark: SparkSession, root: str, municipio: DataFrame, natureza: DataFrame) -> DataFrame:
    """J1 from the staged buckets: no exchange of establishments, companies or simples."""
    t = open_buckets(spark, root)
    light = M.br_joined(t["ESTABELECIMENTOS"], t["EMPRESAS"], t["SIMPLES"], municipio, natureza, company_first=False)
    few = [F.broadcast(t[e].join(F.broadcast(t["HEAVY"]), KEY, "left_semi")) for e in ("EMPRESAS", "SIMPLES")]
    return light.unionByName(M.br_joined(t["HEAVY_ESTABELECIMENTOS"], *few, municipio, natureza, company_first=False))
